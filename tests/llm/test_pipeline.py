"""The pipeline's stages on a small fixture against plain versions of what each has to do."""

import collections

import corpus_pipeline
import pytest

from fixmine.llm import registry
from tests.llm.test_operators import plain_lines, shingle_set


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return "/root/testdata/sf0.001"


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    bench = [shingle_set(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        before, after = docs.collect(), spark.read.parquet(f"{tmp_path}/{k}")
        docs, rows = after, after.collect()
        old, new = {r["doc_id"]: r for r in before}, {r["doc_id"]: r for r in rows}
        if k < 4:
            assert after.columns == columns
            assert set(new) <= set(old)
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        if k == 0:
            good = [i for i, q in labels.items() if q == 1]
            assert all(i in new for i in good)
            assert sum(i not in new for i, q in labels.items() if q == 0) >= 0.8 * sum(q == 0 for q in labels.values())
        if k == 1:
            import hashlib

            want = {i: h for i, _, _, h in plain_lines([(r["doc_id"], r["text"]) for r in before])}
            assert {i: hashlib.sha256(r["text"].encode()).hexdigest() for i, r in new.items()} == want
        if k == 2:
            sets = {i: shingle_set(r["text"]) for i, r in old.items()}
            for i in set(old) - set(new):
                assert any(j < i and 100 * len(sets[i] & s) >= 80 * len(sets[i] | s) for j, s in sets.items() if s)
            kept = [(i, sets[i]) for i in new if sets[i]]
            assert not any(100 * len(a & b) >= 80 * len(a | b) for x, (_, a) in enumerate(kept) for _, b in kept[:x])
        if k == 3:
            dirty = {i for i, r in old.items() if any(b and len(b & shingle_set(r["text"])) >= 0.8 * len(b) for b in bench)}
            assert set(new) == set(old) - dirty
        if k == 4:
            total = collections.Counter()
            for r in rows:
                total[r["doc_id"]] += r["length"]
            assert total == {r["doc_id"]: r["doc_tokens"] for r in rows}
            assert set(total) == set(old)


def test_run_is_registered(spark, folder):
    assert registry.QUERIES["pipeline"](spark, folder).count() > 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, bitmap string, text_hash long, doc_key string, kept boolean, _owner int"


def odd_rows(spark, tmp_path):
    """A folder whose documents have nulls in every column, empty and long texts, ties, repeats and columns of clashing names."""
    from tests.llm.test_operators import corpus, prose

    rows = [(i, t, "en", "s", len(t or ""), "b", 1, "k", True, 2) for i, t in corpus()]
    rows += [(None, prose(1, 120), None, None, None, None, None, None, None, None), (None, None, *[None] * 8), rows[6], rows[6], (7, None, *[None] * 8), (8, "", "en", None, 0, None, None, None, None, None)]
    spark.createDataFrame(rows, ODD).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(100, 30)), (None, prose(2, 90)), (3, None), (4, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    rows = odd_rows(spark, tmp_path)
    whole = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (whole, whole.limit(0), whole.drop("n_chars", "lang")):
            out = stage(spark, docs, str(tmp_path))
            n = out.count()
            if name != "packing":
                assert out.columns == docs.columns
                assert n <= docs.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    kept = {r["doc_id"] for r in corpus_pipeline.line_deduplication(spark, whole, str(tmp_path)).collect()}
    assert kept == {r[0] for r in rows}


def test_results_outlive_other_stages_and_runs(spark, folder):
    """Lazily held results stay readable: a stage's after the next is called, stages composed without writing, an operator's, two runs'."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lines = corpus_pipeline.line_deduplication(spark, docs, folder)
    report = registry.QUERIES["op7_line_dedup"](spark, folder)
    near = corpus_pipeline.minhash_near_dedup(spark, lines, folder)
    assert lines.count() == docs.count() == report.count()
    out = docs
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, folder)
    assert out.count() > 0
    groups = registry.QUERIES["op6_exact_dedup"](spark, folder)
    one = corpus_pipeline.run(spark, folder)
    two = corpus_pipeline.run(spark, folder)
    assert one.count() == two.count() > 0
    assert groups.count() == docs.count()
    assert 0 < near.count() <= docs.count()
