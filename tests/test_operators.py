"""Operators on hand-made edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from fixmine.operators import diffs, graph, linkage, metrics, ranking, votes
from fixmine.plans import workflows
from fixmine.sources import files
from fixmine.streaming import stages


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=str)


def test_votes_keep_ties_and_skip_nulls(spark):
    v = spark.createDataFrame([("a", 1), ("a", 2), ("a", 1), ("a", 2), ("b", None), ("c", 3), ("c", 4), ("c", 5)], "item string, vote long")
    assert rows(votes.modes(v, "item", "vote")) == [("a", [1, 2], 2), ("c", [3, 4, 5], 1)]
    assert rows(votes.above(v, "item", "vote", 1)) == [("a", 1, 2), ("a", 2, 2)]
    assert votes.modes(v.limit(0), "item", "vote").count() == 0


def test_threshold_curve_against_every_threshold(spark):
    r = random.Random(1)
    data = [(r.randrange(6), r.choice([0.0, 0.001, 0.05, 0.999, 1.0, 0.5004, r.random()]), int(r.random() < 0.3)) for _ in range(200)]
    curve = {round(x["threshold"] * 1000): x for x in metrics.threshold_curve(spark.createDataFrame(data, "g long, s double, y int"), ["g"], "s", "y").collect()}
    assert sorted(curve) == list(range(1, 1000))
    for i in (1, 2, 50, 49, 500, 501, 998, 999):
        f = []
        for g in range(6):
            own = [(s > i / 1000, y) for k, s, y in data if k == g]
            tp, n, p = sum(a and y for a, y in own), sum(a for a, _ in own), sum(y for _, y in own)
            f.append(2 * tp / (n + p) if n + p else 0)
        assert curve[i]["f1"] == pytest.approx(sum(f) / 6)


def test_metrics_with_odd_groups(spark):
    data = [("none", 1, 0), ("none", 2, 0), ("all", 1, 1), ("all", 2, 1), ("small", 1, 1)]
    df = spark.createDataFrame(data, "g string, r long, y int")
    out = {x["k"]: x for x in metrics.topk_prf(df, ["g"], "r", "y", (1, 3)).collect()}
    assert out[3]["precision"] == pytest.approx((0 + 2 / 3 + 1 / 3) / 3)
    assert out[1]["recall"] == pytest.approx((0 + 0.5 + 1) / 3)
    e = {x["k"]: x for x in metrics.recall_effort_mrr(df, ["g"], "r", "y", (1, 5)).collect()}
    assert e[5]["effort"] == pytest.approx((5 + 1 + 1) / 3)
    assert e[1]["mrr"] == pytest.approx((0 + 0.75 + 1) / 3)


def test_voting_fusion_and_versions(spark):
    df = spark.createDataFrame([(1, 2, 9), (5, 9, 9)], "a long, b long, c long")
    assert rows(ranking.fuse_by_vote(df, ["a", "b", "c"]), "closest", "last") == [(18, 5), (3, 9)]
    tags = spark.createDataFrame([("x", t) for t in ("v1.9", "v1.10", "v1.10-rc1", "v1.2")], "g string, tag string")
    ordered = [r[1] for r in rows(ranking.rank_within(tags, ["g"], [ranking.version_key(F.col("tag"))], "n"), "n", "tag")]
    assert ordered == ["v1.2", "v1.9", "v1.10", "v1.10-rc1"]


def test_commit_match_ignores_empty_hashes(spark):
    p = spark.createDataFrame([("c", "abcdef123", "abcdef1", "fix"), ("c", "ffff", "", "title"), ("c", "0000", "", None)], "cve string, hash string, short string, subject string")
    t = spark.createDataFrame([("c", "abcdef", ""), ("c", "", "title"), ("c", "9", None)], "cve string, hash string, title string")
    m = linkage.commit_match(F.col("p.hash"), F.col("p.short"), F.col("p.subject"), F.col("t.hash"), F.col("t.title"))
    assert rows(linkage.matched(p, t, "cve", m), "hash") == [("abcdef123",), ("ffff",)]


def test_interval_pairs_against_all_pairs(spark):
    r = random.Random(2)
    data = [(k % 2, k, 1_600_000_000 + r.randrange(0, 200 * 86400)) for k in range(60)] + [(0, 100, 1_600_000_000), (0, 101, 1_600_000_000 + 31 * 86400 - 1), (0, 102, 1_600_000_000 + 31 * 86400)]
    df = spark.createDataFrame(data, "g long, i long, t long").withColumn("t", F.timestamp_seconds("t"))
    want = sorted((g, i, j) for g, i, t in data for h, j, u in data if g == h and (u, j) > (t, i) and abs(u - t) // 86400 <= 30)
    assert rows(linkage.interval_pairs(df, "g", "t", "i", 30), "g", "a", "b") == sorted(want, key=str)


def test_graph_on_diamonds_cycles_and_reverse_edges(spark):
    e = spark.createDataFrame([("r", "N", None), ("r", "b", None), ("N", "p", None), ("b", "p", None), ("p", "r", None), ("p", "q", "EX"), ("q", "z", None)], "src string, dst string, tag string")
    roots = spark.createDataFrame([("r",)], "root string")
    assert rows(graph.bfs_levels(e, roots, 2), "node", "level") == [("N", 1), ("b", 1), ("p", 2), ("r", 0)]
    s = graph.path_scores(graph.simple_paths(graph.without_tag(e), roots, 4), F.array_contains("path", "N"))
    assert {r["node"]: r["score"] for r in s.collect()} == {"N": 2.0, "b": 1.0, "p": 1.5}
    assert rows(graph.only_tagged(e)) == [("q",)]
    new = spark.createDataFrame([(1, "p", "N", None), (1, "z", "y", None), (1, "z", "y", None), (1, "unknown", "x", None)], "g int, src string, dst string, tag string")
    assert graph.add_edges(e.select(F.lit(1).alias("g"), "*"), new, "g").count() == 8


def test_closure_spreads_hits(spark):
    pred = spark.createDataFrame([("c", "a"), ("c", "x"), ("d", "m")], "entity string, key string")
    truth = spark.createDataFrame([("c", "a"), ("c", "b"), ("c", "z"), ("d", "n")], "entity string, key string")
    eq = spark.createDataFrame([("c", "a", "b"), ("c", "b", "a")], "entity string, a string, b string")
    out = {r["entity"]: (r["tp"], r["fp"], r["fn"], r["precision"]) for r in graph.patch_set_scores(pred, truth, eq).collect()}
    assert out == {"c": (1, 1, 1, 0.5), "d": (0, 1, 1, 0.0)}


def test_diffs_with_new_and_renamed_files(spark):
    diff = "diff --git a/x.c b/x.c\nnew file mode 100644\n--- /dev/null\n+++ b/x.c\n@@ -0,0 +1,2 @@\n+int a;\n+int b;\n\\ No newline at end of file\ndiff --git a/o b/n\nsimilarity index 100%\nrename from o\nrename to n\ndiff --git a/y.py b/y.py\n--- a/y.py\n+++ b/y.py\n@@ -3,2 +3,1 @@ def f():\n-    gone\n     stays"
    lines = diffs.diff_lines(spark.createDataFrame([(1, diff), (2, ""), (3, None)], "k long, d string"), "k", "d")
    assert rows(lines, "file", "kind", "old", "new") == [("x.c", "add", None, 1), ("x.c", "add", None, 2), ("y.py", "ctx", 4, 3), ("y.py", "del", 3, None)]
    assert rows(diffs.changed_functions(lines, "k"), "file", "function", "change") == [("y.py", "f", "modified")]


def test_braces(spark):
    df = spark.createDataFrame([("a { b { c } d } e { f }", 8), ("none", 1), (None, 0)], "code string, at long")
    assert [tuple(r["span"]) for r in diffs.enclosing_braces(df, "code", "at").collect()] == [(2, 14), (None, None), (None, None)]


def test_filter_and_vote(spark):
    c = spark.createDataFrame([("v", f, h, h[:2], "s") for f, h in ((1, "aa1"), (2, "aa1"), (1, "bb2"), (2, "bb2"), (1, "cc3"))], "cve string, file int, hash string, short string, subject string")
    a = spark.createDataFrame([("v", 2), ("v", 2), ("v", 1)], "cve string, vote long")
    won = workflows.filter_and_vote(c, a)
    assert rows(won, "cve", "number", "hash", "frequency") == [("v", 2, "bb2", 2)]
    s = workflows.vote_scores(won, spark.createDataFrame([("v", "bb2"), ("v", "x")], "cve string, hash string")).first()
    assert (s["macro_precision"], s["macro_recall"]) == (1.0, 0.5)


def test_localise(spark):
    """Best paths, sources, extension and the cut-off for too many, on one small graph."""
    edges = [("r", "N", None), ("r", "R", None), ("N", "p1", None), ("R", "i", None), ("i", "p2", None), ("r", "p3", "SG"), ("p1", "p4", "EX"), ("p5", "p3", "EX"), ("p1", "bad", "EX"), ("i", "p5", "EX"), ("N", "p6", None), ("R", "p6", None)]
    e = spark.createDataFrame(edges, "src string, dst string, tag string")
    roots = spark.createDataFrame([("r",)], "root string")
    patches = spark.createDataFrame([(f"p{k}", True) for k in range(1, 7)] + [("bad", False)], "node string, good boolean")
    via, rules = F.array_contains("path", "N"), {"good": F.col("good")}
    run = lambda **more: [r["node"] for r in workflows.localise(e, roots, patches, via, rules, **more).orderBy("node").collect()]
    assert run() == ["p6"]  # two paths: 1 and 1/2
    assert run(source=F.col("mid") == "N") == ["p1", "p3", "p6"]
    assert run(source=F.col("mid") == "N", valid=F.lit(True)) == ["p1", "p3", "p4", "p5", "p6"]
    assert run(source=F.col("mid") == "N", valid=F.lit(True), most=4) == []
    assert run(ablate=["N"]) == ["p3"]


def test_hits_pass_along_a_long_chain(spark):
    chain = [("e", f"k{k:02d}", f"k{k + 1:02d}") for k in range(41)]
    truth = spark.createDataFrame([("e", f"k{k:02d}") for k in range(42)], "entity string, key string")
    hit = spark.createDataFrame([("e", "k00")], "entity string, key string")
    both = spark.createDataFrame(chain + [(e, b, a) for e, a, b in chain], "entity string, a string, b string")
    one_way = spark.createDataFrame([c for c in chain if c[1] < "k05"], "entity string, a string, b string")
    row = graph.patch_set_scores(hit, truth, both).first()
    assert (row["tp"], row["fn"], row["recall"]) == (1, 0, 1.0)
    assert graph.patch_set_scores(hit, truth, one_way).first()["fn"] == 42 - 6
    back = spark.createDataFrame([("e", "a", "k00"), ("e", "b", "k00"), ("e", "b", "k41")], "entity string, a string, b string")
    more = truth.union(spark.createDataFrame([("e", "a"), ("e", "b")], "entity string, key string"))
    assert graph.patch_set_scores(hit, more, back).first()["fn"] == 41 + 1


def test_connected(spark):
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(50)]
    up = {x: x for e in edges for x in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    out = graph.connected(spark.createDataFrame(edges, "a long, b long"))
    assert {x["node"]: x["component"] for x in out.collect()} == up


def test_numbers_of_any_length_in_versions(spark):
    tags = ["1.20240101120000", "1.20240101120059", "1.9", "1.10", "1.00010", "1.10-rc1", "2"]
    df = spark.createDataFrame([(t,) for t in tags], "tag string").withColumn("k", ranking.version_key(F.col("tag")))
    keys = {x["tag"]: x["k"] for x in df.collect()}
    assert keys["1.20240101120000"] < keys["1.20240101120059"] < keys["2"]
    assert keys["1.9"] < keys["1.10"] == keys["1.00010"]


def test_local_connectivity_and_searches_by_hand(spark):
    e = spark.createDataFrame([("g", *x) for x in [("r", "a"), ("r", "b"), ("a", "t"), ("b", "t"), ("r", "t"), ("a", "c"), ("c", "t"), ("x", "t")]], "key string, src string, dst string")
    pairs = spark.createDataFrame([("g", "r", "t"), ("g", "r", "c"), ("g", "r", "x"), ("g", "r", "r")], "key string, root string, node string")
    assert rows(graph.local_connectivity(e, pairs, "key"), "node", "connectivity") == [("c", 1), ("r", 0), ("t", 3), ("x", 0)]
    refs = spark.createDataFrame([("r", "N", "n0"), ("r", "N", "n1"), ("r", "M", "p0")], "root string, source string, node string")
    links = [("n0", f"i{k}", k) for k in range(8)] + [("n1", "i0", 0), ("n1", "n0", 1), ("i0", "n0", 0), ("i0", "q", 1), ("i6", "never", 0), ("p0", "never", 0), ("q", "never", 0), ("i1", "i2", 0), ("i2", "i1", 0)]
    kinds = [("n0", "common_url"), ("n1", "issue_url"), ("p0", "patch_url"), ("q", "patch_url"), ("never", "patch_url")] + [(f"i{k}", "issue_url") for k in range(8)]
    out = graph.deep_search(refs, spark.createDataFrame(links, "node string, child string, pos int"), spark.createDataFrame(kinds, "node string, type string"))
    found = {(x["src"], x["dst"]): x["level"] for x in out.collect()}
    assert found["n0", "i7"] == found["n1", "i0"] == 3
    assert ("n1", "n0") not in found and ("i0", "n0") not in found  # no page adds what is no issue, change or repository; a pair is there
    assert found["i0", "q"] == 4 and found["i1", "i2"] == 4 and ("i2", "i1") not in found
    assert not any(dst == "never" for _, dst in found)


def test_expanded_pointers_have_no_depth(spark):
    import json

    deep = [{"a": k + 1} for k in range(3000)] + ["end"]
    loop = [{"a": 1, "b": 0}, [0, 2], "x", True]
    texts = [json.dumps(deep), json.dumps(loop), "[]", "{}", "no", json.dumps([[1, 1, 9, -1, "k"], "s"])]
    df = files.expand_pointers(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string"), "t")
    out = {x["k"]: x["value"] for x in df.collect()}
    assert out[0] == '{"a": ' * 3000 + '"end"' + "}" * 3000
    assert json.loads(out[1]) == {"a": [None, "x"], "b": None}
    assert (out[2], out[3], out[4]) == ("null", None, None)
    assert json.loads(out[5]) == ["s", "s", None, None, None]


def test_words_that_overlap_are_found_by_their_rarest(spark):
    from fixmine.operators import features

    r = random.Random(5)
    pool = [f"w{min(r.randrange(60), r.randrange(60))}" for _ in range(4000)]
    make = lambda n, most: [(k, sorted(set(r.choices(pool, k=r.randrange(most))))) for k in range(n)]
    a, b = make(60, 60), make(30, 9) + [(99, [])]
    for least in (0.3, 0.5, 1.0):
        want = sorted((i, j, len(set(x) & set(y))) for i, x in a for j, y in b if y and len(set(x) & set(y)) >= least * len(y))
        out = features.overlapping(spark.createDataFrame(a, "i int, w array<string>"), "i", spark.createDataFrame(b, "j int, w array<string>"), "j", "w", least)
        assert sorted((x["i"], x["j"], x["shared"]) for x in out.collect()) == want


def test_safe_rows_and_stages(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"b": 1}'), (2, "{"), (3, None)], "k long, x string")
    assert rows(stages.safe_rows(df, "k", "x", stages.parse_json), "k", "status") == [(1, "ok"), (2, "failed"), (3, "ok")]
    assert rows(stages.with_retry(df, "k", "x", stages.parse_json, lambda x: x), "k", "status") == [(1, "ok"), (2, "ok"), (3, "ok")]
    steps = [("one", lambda d: d.withColumn("y", F.length("x"))), ("two", lambda d: d.where("y > 1"))]
    assert rows(stages.run_stages(df, "k", str(tmp_path), steps), "k") == [(1,)]
    more = df.union(spark.createDataFrame([(4, "abc")], "k long, x string"))
    assert rows(stages.run_stages(more, "k", str(tmp_path), steps), "k") == [(1,), (4,)]
    assert spark.read.parquet(f"{tmp_path}/one").count() == 4


def test_streaming_votes(spark, tmp_path):
    spark.createDataFrame([("i", "a"), ("i", "a"), ("i", "b")], "item string, c string").withColumn("ts", F.timestamp_seconds(F.lit(1_600_000_000))).write.json(str(tmp_path / "in"))
    events = spark.readStream.schema("item string, c string, ts timestamp").json(str(tmp_path / "in"))
    q = stages.streaming_votes(events, "item", "c", "ts").writeStream.format("memory").queryName("votes").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("votes"), "c", "n") == [("a", 2), ("b", 1)]
    got = []
    stages.stream_modes(events, "item", "c", lambda d, n: got.extend(d.collect())).trigger(availableNow=True).start().awaitTermination()
    assert [r["modes"] for r in got] == [["a"]]


def test_sources(spark, tmp_path):
    (tmp_path / "e1").mkdir()
    (tmp_path / "e1" / "a.csv").write_text("h1,h,subject,body,x\nh2,h,only\n")
    (tmp_path / "e1" / "repo_config.csv").write_text("owner,repo\n")
    got = files.guarded(files.entity_csv(spark, str(tmp_path)), ["subject", "body"], ["hash", "short", "subject", "body"])
    assert rows(got, "entity", "file", "hash") == [("e1", "a.csv", "h1")]
    (tmp_path / "feed.json").write_text('{"vulnerabilities": [{"cve": {"id": "CVE-2020-0001", "descriptions": [{"lang": "en", "value": "d"}, {"lang": "es", "value": "x"}]}}]}')
    f = files.feed(spark, str(tmp_path / "feed.json"))
    assert rows(f.where("language = 'en'"), "id", "description") == [("CVE-2020-0001", "d")]
    files.split_by_year(f, "id", str(tmp_path / "years"))
    assert [r["year"] for r in spark.read.json(str(tmp_path / "years")).select("year").distinct().collect()] == [2020]
    with pytest.raises(ValueError):
        files.frame(spark, "x.docx")
    t = files.append(spark.createDataFrame([(1, "a")], "k long, v string"), str(tmp_path / "sink"), "k")
    t = files.append(spark.createDataFrame([(1, "b"), (2, "c")], "k long, v string"), str(tmp_path / "sink"), "k")
    assert rows(t) == [(1, "a"), (2, "c")]
    p = files.expand_pointers(spark.createDataFrame([('[{"a": 1, "b": 2}, "x", [1, 3], 7]',), ("bad",)], "j string"), "j")
    assert [r["value"] for r in p.collect()] == ['{"a": "x", "b": ["x", 7]}', None]
    cache = spark.createDataFrame([("u1", "page")], "url string, raw string").withColumn("url_hash", F.unhex(F.md5(F.col("url").cast("binary"))))
    hit, miss = files.cached(spark.createDataFrame([("u1",), ("u2",)], "url string"), cache, "url")
    assert (rows(hit, "raw"), rows(miss, "url")) == ([("page",)], [("u2",)])
    digest = spark.createDataFrame([("feed.json", "00")], "name string, sha256 string")
    assert rows(files.verified(spark, str(tmp_path / "feed.json"), digest), "ok") == [(False,)]


def test_rows_that_take_too_long_fail(spark):
    import time

    def work(x):
        time.sleep(5 if x == "slow" else 0)
        if x == "bad":
            raise ValueError("no" * 400)
        return x

    df = spark.createDataFrame([(1, "fast"), (2, "slow"), (3, "bad"), (4, None)], "k int, x string")
    out = {r["k"]: r for r in stages.safe_rows(df, "k", "x", work, timeout=0.5, elapsed=True).collect()}
    assert [out[k]["status"] for k in (1, 2, 3, 4)] == ["ok", "failed", "failed", "ok"]
    assert out[2]["error"].startswith("TimeoutError") and 0.4 < out[2]["elapsed"] < 3
    assert len(out[3]["error"]) > 800
    twice = stages.with_retry(df.where("k < 4"), "k", "x", work, lambda x: "again", timeouts=(0.5, 2.0))
    assert rows(twice, "k", "status", "result") == [(1, "ok", "fast"), (2, "ok", "again"), (3, "ok", "again")]


def test_repeated_predictions_and_empty_groups(spark):
    p = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 5)], "g string, i int")
    t = spark.createDataFrame([("a", 1), ("a", 3), ("c", 7)], "g string, i int")
    assert rows(metrics.list_scores(p, t, ["g"], "i"), "g", "tp", "fp", "fn") == [("a", 2, 1, 1), ("b", 0, 1, 0), ("c", 0, 0, 1)]
    assert metrics.list_scores(p.limit(0), t.limit(0), ["g"], "i").count() == 0


def test_redirects_end_or_lead_nowhere(spark):
    r = spark.createDataFrame([(f"u{k}", f"u{k + 1}") for k in range(70)] + [("x", "y"), ("y", "z"), ("z", "y"), ("s", "s")], "source string, target string")
    urls = spark.createDataFrame([("u0",), ("u69",), ("x",), ("y",), ("s",), ("alone",)], "url string")
    assert rows(files.final_urls(urls, r, "url"), "url", "final") == [("alone", "alone"), ("s", None), ("u0", "u70"), ("u69", "u70"), ("x", None), ("y", None)]


def test_functions_around_lines_and_braces(spark):
    code = "int f(void)\n{\n  if (x)\n  {\n  }\n}\nstatic char *g(int a)\n{\n  return a;\n}".split("\n")
    lines = spark.createDataFrame([("k", n, t) for n, t in enumerate(code, 1)], "k string, n int, line string")
    found = diffs.enclosing_function(lines, ["k"], lines.where("n IN (1, 4, 6, 9)"))
    assert rows(found, "n", "function") == [(1, "f"), (4, "f"), (6, "f"), (9, "g")]
    text = "}} a { b { c } d } { e }"
    df = spark.createDataFrame([(text, p) for p in (0, 9, 16, 20, 23)] + [(None, 1)], "code string, at int")
    assert [tuple(r["span"]) if r["span"]["begin"] is not None else None for r in diffs.enclosing_braces(df, "code", "at").collect()] == [None, (5, 17), (5, 17), (19, 23), (19, 23), None]


def test_hunks_end_where_their_header_says(spark):
    diff = "\n".join(["--- a/one", "+++ b/one", "@@ -1,2 +1,2 @@ f", "--- gone", "+++ here", " stay", "--- a/two", "+++ b/two", "@@ -3 +3,2 @@", "-x", "+y", "\\ No newline", "+z", " beyond"])
    out = rows(diffs.diff_lines(spark.createDataFrame([(1, diff)], "k int, d string"), "k", "d"), "file", "kind", "old", "new", "line")
    assert out == sorted([("one", "del", 1, None, "-- gone"), ("one", "add", None, 1, "++ here"), ("one", "ctx", 2, 2, "stay"), ("two", "del", 3, None, "x"), ("two", "add", None, 3, "y"), ("two", "add", None, 4, "z")], key=str)


def test_dense_numbers_over_partitions(spark):
    values = [random.Random(4).randrange(1000) for _ in range(500)]
    df = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v int, k int").repartition(7)
    out = ranking.numbered(df, [F.desc("v"), "k"], "n").collect()
    assert [x["n"] for x in sorted(out, key=lambda x: (-x["v"], x["k"]))] == list(range(500))
