"""Bucketed caches, records of any shape, disjoint paths, long common runs, inserts and model transfers against plain versions."""

import random
import time
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fixmine.functions import common, strings
from fixmine.operators import features, graph, linkage, models
from fixmine.plans import workflows
from fixmine.sources import cache, records


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=str)


def test_bucketed_cache(spark, tmp_path):
    name, schema = "t_" + uuid.uuid4().hex, "url string, body string, n int"
    cache.create(spark.createDataFrame([("a", "1", 1), ("a", "2", 0), ("b", None, 3), (None, "x", 1)], schema), name, f"file://{tmp_path}/c", "url", 8)
    cache.put(spark.createDataFrame([("b", "old", 4), ("c", "new", 5)], schema), name, "url")
    cache.put(spark.createDataFrame([("b", "late", 1)], schema), name, "url")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",), (None,)], "url string")
    want = [("a", "2", 0), ("b", "late", 1), ("c", "new", 5)]
    assert rows(cache.get(wanted, name, "url"), "url", "body", "n") == want
    assert rows(cache.missing(wanted, name, "url")) == [("d",)]
    cache.compact(spark, name, name + "2", f"file://{tmp_path}/c2", "url")
    assert spark.table(name + "2").count() == 3
    assert rows(cache.get(wanted, name + "2", "url"), "url", "body", "n") == want
    with pytest.raises(ValueError, match="there is a table"):
        cache.create(spark.createDataFrame([], schema), name, f"file://{tmp_path}/c3", "url")
    for n in (name, name + "2"):
        spark.sql(f"DROP TABLE {n}")


def test_a_look_up_does_not_move_the_cache(spark, tmp_path):
    name, limit = "t_" + uuid.uuid4().hex, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    cache.create(spark.range(1000).selectExpr("concat('u', id) AS url", "'b' AS body"), name, f"file://{tmp_path}/c", "url", 8)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        wanted = spark.range(500).selectExpr("concat('u', id * 3) AS url")
        plan = cache.get(wanted, name, "url")._jdf.queryExecution().executedPlan().toString()
        scan = plan.index("FileScan parquet")
        left = plan[: plan.index("Range")] if plan.index("Range") > scan else plan[plan.index("Range") :]
        assert "Exchange" not in left[left.index("SortMergeJoin") : left.index("FileScan parquet")] and "Bucketed: true" in plan
        assert cache.get(wanted, name, "url").count() == 334
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # shows what is read
        one = spark.table(name).where("url = 'u7'")._jdf.queryExecution().executedPlan().toString()
        assert "SelectedBucketsCount: 1 out of 8" in one
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "true")
        spark.sql(f"DROP TABLE {name}")


def test_records_of_any_shape(spark):
    texts = {
        1: '{"artifactComponents": [{"componentCoordinateType": "Maven", "coordOne": "Org", "coordTwo": null, "versionRanges": [{"versionRange": "<2", "updateToVersion": 2, "componentInstances": [{"componentInstanceHash": "x"}, {}]}, {}]}]}',
        2: '{"components": [{"name": "lib", "versions": []}, {"type": " ", "name": "Other"}]}',
        3: '{"components": "none"}', 4: "not json", 5: None, 6: "[]", 7: '{"components": []}',
        8: '{"components": [{"name": "p", "versions": [{"patch": {"url": "u"}, "instances": ["h1", {"hash": "h2"}]}]}]}',
    }
    df = spark.createDataFrame(list(texts.items()), "k int, j string")
    none = (None,) * 4
    want = [(1, "maven:org", "<2", "2", None, None, ["x", None]), (1, "maven:org", *none, None), (2, "lib", *none, None), (2, "other", *none, None), (8, "p", None, None, None, "u", ["h1", "h2"])]
    assert rows(records.variant_versions(df, "k", "j")) == sorted(want, key=str)
    detail = spark.createDataFrame([(7, '{"components": [{"name": "d"}]}'), (8, '{"components": [{"name": "never"}]}'), (4, '{"components": [{"name": "late"}]}')], "k int, j string")
    out = records.variant_versions(df, "k", "j", detail)
    assert rows(out.where("k IN (4, 7, 8)"), "k", "component") == [(4, "late"), (7, "d"), (8, "p")]


def disjoint(children, root, node):
    """Shortest paths first, of equal ones the least, with their inner nodes taken out."""
    direct = node in children.get(root, ()) and node != root
    n, used = int(direct), {root}
    while node != root:
        paths, seen, found = [[root]], {root}, None
        while paths and not found:
            after = {}
            for p in paths:
                for y in sorted(children.get(p[-1], ())):
                    if y not in seen and y not in used and not (direct and p == [root] and y == node):
                        after[y] = min(after.get(y, [*p, y]), [*p, y])
            seen |= set(after)
            paths, found = sorted(after.values()), after.get(node)
        if not found:
            return n
        n += 1
        used |= set(found[1:-1])
    return n


def test_disjoint_paths_by_joins(spark):
    r = random.Random(6)
    edges, pairs, want = [], [], []
    for key in range(3):
        names = [f"{key}{c}" for c in "abcdefghijkl"]
        e = {(r.choice(names), r.choice(names)) for _ in range(34)}
        children = {}
        for a, b in e:
            children.setdefault(a, set()).add(b)
        edges += [(key, a, b) for a, b in e] + [(key, a, b) for a, b in list(e)[:3]]
        for a, b in {(r.choice(names), r.choice(names)) for _ in range(25)}:
            pairs.append((key, a, b))
            want.append((key, a, b, disjoint(children, a, b)))
    out = graph.local_connectivity(spark.createDataFrame(edges, "key long, src string, dst string"), spark.createDataFrame(pairs, "key long, root string, node string"), "key")
    assert rows(out, "key", "root", "node", "connectivity") == sorted(want, key=str)
    assert max(w[3] for w in want) > 2


def plain_run(a, b):
    best, row = (0, 0, 0), [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                n = new[j + 1] = row[j] + 1
                here = (n, i - n + 1, j - n + 1)
                if n > best[0] or (n == best[0] and here[1:] < best[1:]):
                    best = here
        row = new
    return best


def test_longest_common_runs(spark):
    r = random.Random(1)
    texts = [("".join(r.choice("abé") for _ in range(r.randrange(40))), "".join(r.choice("abé𝒜") for _ in range(r.randrange(40)))) for _ in range(80)] + [(None, "a"), ("", ""), ("a", None), ("aaa", "aaaa"), ("xay", "zaw")]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(texts)], "k int, a string, b string").repartition(3)
    got = {x["k"]: tuple(x["r"]) for x in df.select("k", common.longest_common_run("a", "b").alias("r")).collect()}
    assert got == {k: plain_run(a or "", b or "") for k, (a, b) in enumerate(texts)}
    words = [(" ".join(r.choice(["up", "down", "Up"]) for _ in range(r.randrange(30))), "\n".join(r.choice(["up", "down", "\x85"]) for _ in range(r.randrange(30)))) for _ in range(40)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(words)], "k int, a string, b string")
    got = {x["k"]: tuple(x["r"]) for x in df.select("k", common.longest_common_run("a", "b", words=True).alias("r")).collect()}
    split = lambda t: [w for w in t.replace("\n", " ").split(" ") if w]
    assert got == {k: plain_run(split(a), split(b)) for k, (a, b) in enumerate(words)}


def test_long_texts_take_little_more_than_their_length():
    rng = np.random.default_rng(0)
    took = []
    for n in (20_000, 160_000):
        a = rng.integers(0, 5000, n)
        b = np.concatenate((rng.integers(0, 5000, n // 2), a[100:1100], rng.integers(0, 5000, n // 2)))
        began = time.time()
        assert common.longest_common([(a, b), (np.zeros(n, int), np.zeros(n, int))]) == [(1000, 100, n // 2), (n, 0, 0)]
        took.append(time.time() - began)
    assert took[1] < 60 * took[0] + 2


def test_slices_of_a_batch_change_nothing(monkeypatch):
    a, b = pd.Series(["abcabc", None, "zzz", "qabq"]), pd.Series(["cab", "x", "zz", "ab"])
    whole = common._found(a, b, False)
    monkeypatch.setattr(common, "SLICE", 3)
    assert common._found(a, b, False).equals(whole)
    assert common._found(a[:0], b[:0], False).empty


def test_pairs_that_share_words(spark):
    left = spark.createDataFrame([(1, "a b c d e f"), (2, "c d e"), (3, None), (4, "a b c"), (5, "a b c a b c")], "a int, t string")
    right = spark.createDataFrame([(1, "x c  d\te y"), (2, "a b c"), (3, "")], "b int, t string")
    assert rows(linkage.sharing_grams(left, "a", right, "b", "t", 3)) == [(1, 1), (1, 2), (2, 1), (4, 2), (5, 2)]


def test_outcomes_of_inserts(spark):
    edges = spark.createDataFrame([("g", "r", "a"), ("g", "a", "b")], "g string, src string, dst string")
    new = [("g", "a", "c", 1), ("g", "b", "c", 2), ("g", "b", "a", 3), ("g", "r", "b", 4), ("g", "b", "r", 5), ("g", "z", "q", 6), ("h", "r", "x", 7), ("g", "a", "c", 8), ("g", "c", "d", 9)]
    out = graph.insert_outcomes(edges, spark.createDataFrame(new, "g string, src string, dst string, n int"), "g", "n")
    assert [r["added"] for r in out.orderBy("n").collect()] == [True, None, False, None, False, False, False, False, False]


def test_equal_names_leave_similar_ones_out(spark):
    left, right = (spark.createDataFrame([(x,) for x in names], f"{c} string") for c, names in (("a", ["kibana", "kiban", "zz"]), ("b", ["kibana", "kibanator", "kib"])))
    out = linkage.names_or_similar(left, "a", right, "b", strings.longest_common_substring(F.col("a"), F.col("b")), 2)
    assert rows(out) == sorted([("kibana", "kibana", 6.0, True), ("kiban", "kibana", 5.0, False), ("kiban", "kibanator", 5.0, False), ("kiban", "kib", 3.0, False)], key=str)


def test_idf_of_two_corpora(spark):
    counts = lambda data: features.term_counts(spark.createDataFrame(data, "k int, t array<string>"), "k", "t")
    out = features.idf_of_two(counts([(1, ["a", "a", "b"]), (2, ["a"])]), 2, counts([(1, ["a", "a", "z"])]), 3)
    assert [(r["token"], r["df"], round(r["idf"], 9)) for r in out.orderBy("token").collect()] == [("a", 4, 0.0), ("b", 1, round(np.log(5 / 2), 9))]


def test_groups_left_out_and_ranked_features(spark):
    r = random.Random(3)
    data = [(k // 8, k, float(x), float(x + r.gauss(0, 0.1)), r.random(), int(x > 0.8)) for k in range(400) for x in [r.random()]]
    df = spark.createDataFrame(data, "e int, id int, a double, b double, c double, y int").cache()
    out = models.leave_group_out(df, df, ["a", "b", "c"], {"ab": ["a", "b"], "c": ["c"]}, "y", kind="linear")
    x = np.array([(q[2], q[3], q[4], q[5]) for q in data])
    for name, cols in (("ab", [2]), ("c", [0, 1])):
        design = np.column_stack([x[:, cols], np.ones(len(x))])
        want = design @ np.linalg.lstsq(design, x[:, 3], rcond=None)[0]
        got = {q["id"]: q["score"] for q in out.where(F.col("left_out") == name).collect()}
        assert max(abs(got[k] - want[k]) for k in range(400)) < 1e-6
    ranked, scores = workflows.rank_features(df, "e", "id", ["a", "b", "c"], "y", ks=(1, 3))
    assert ranked.count() == 400 and rows(ranked.groupBy("e").agg(F.max("rank").alias("m")), "m") == [(8,)] * 50
    # with a feature that decides the label, what is ranked first is positive wherever an entity has a positive
    share = sum(any(q[5] for q in data if q[0] == e) for e in range(50)) / 50
    assert scores.where("k = 1").first()["precision"] == pytest.approx(share, abs=0.06)
