"""Steps whose intermediate rows follow the input, and keys of large numbers."""

from pyspark.sql import functions as F

from fixmine.functions import strings, urls
from fixmine.operators import graph, linkage


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=str)


def test_search_of_pairs_keeps_to_edges_that_lead_to_the_node(spark):
    n = 3000
    links = spark.range(n).selectExpr("'g' AS key", "'m' AS _at", "concat('c', id) AS _to").union(spark.createDataFrame([("g", "r", "m"), ("g", "x", "c7")], "key string, _at string, _to string"))
    pairs = spark.range(n).selectExpr("'g' AS key", "'r' AS root", "concat('c', id) AS node")
    led = graph._leading(links, pairs, ["key", "root", "node"])
    assert led.count() == 2 * n + 1
    out = graph.local_connectivity(links.toDF("key", "src", "dst"), pairs, "key")
    assert out.count() == n and out.where("connectivity <> 1").count() == 0
    # a node that stands above the root, and a circle
    edges = spark.createDataFrame([("g", *e) for e in [("u", "r"), ("r", "a"), ("a", "b"), ("b", "a"), ("b", "u"), ("a", "t"), ("b", "t"), ("u", "t")]], "key string, src string, dst string")
    asked = spark.createDataFrame([("g", "r", "t"), ("g", "t", "r"), ("g", "r", "u")], "key string, root string, node string")
    assert rows(graph.local_connectivity(edges, asked, "key"), "root", "node", "connectivity") == [("r", "t", 1), ("r", "u", 1), ("t", "r", 0)]


def test_siblings_are_made_distinct_only_where_they_can_repeat(spark):
    e = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "c"), ("q", "a"), ("q", "b"), ("q", "d"), ("q", "d")], "src string, dst string")
    every = e.select(F.col("dst").alias("node"))
    out = graph.siblings(e, every, every)
    want = {(x, y) for g in ("abc", "abd") for x in g for y in g}
    assert rows(out) == sorted(want, key=str)
    # below the union only the third join has an aggregate above it
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")


def test_issue_search_compares_names_once(spark):
    many = spark.range(2000)
    issues = many.selectExpr("concat('e', id) AS entity", "'ABC-1' AS key", "concat('product', id % 2) AS product").union(spark.createDataFrame([("e1", "ABC-1", "product0")], "entity string, key string, product string"))
    commits = many.selectExpr("concat('product', id % 5) AS repo", "concat('h', id) AS hash", "'see abc-1 and ABC-1' AS message").union(spark.createDataFrame([("product0", "h1", "abc-1"), ("q", "h2", "ABC-1")], "repo string, hash string, message string"))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def alike(a, b):
        seen.add(1)
        return 1.0 if a == b else 0.0

    out = linkage.issue_search(issues, commits, alike(F.col("product"), F.col("repo")), 1.0)
    # 400 changes of product0 and 400 of product1; h1 is of both, so e0, e2, ... have it too, and e1 has both products
    assert out.count() == out.distinct().count() == 1000 * 401 + 999 * 400 + 800
    assert seen.value < 1000


def test_merged_branches_compares_patches_once(spark):
    t = spark.range(6000).selectExpr("'e' AS entity", "CASE WHEN id % 2 = 0 THEN concat('b', id % 7) END AS branch", "CASE WHEN id % 2 = 0 THEN 'long patch' ELSE 'patch' END AS patch")
    seen = linkage.merged_branches(t)
    assert seen.count() == 3001 and rows(seen.where("patch = 'patch'")) == [("e", "b0", "patch")]
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate", plan.index("Join")) and plan.count("Aggregate") == 3


def test_numbers_of_issues_are_no_commits(spark):
    for url in ("https://bugzilla.example.com/show_bug.cgi?id=100160", "https://bugzilla.example.com/show_bug.cgi?a=b&id=1234567"):
        assert spark.range(1).select(urls.patch_key(F.lit(url))).first()[0] == url
    assert spark.range(1).select(urls.patch_key(F.lit("https://git.example.org/x/commit/?id=1001603"))).first()[0] == "git_100160"


def _exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in x]


def test_pairs_of_texts_are_summed_up_where_the_texts_are(spark):
    from fixmine.queries import linking

    found = _exchanges(linking.shared_token_stats(spark, "/root/testdata/sf0.001"))
    assert found and not [x for x in found if "doc_id" in x and ("item_id" in x or "token" in x)]


def test_cosines_are_summed_up_where_the_texts_are(spark):
    from fixmine.operators import features
    from fixmine.queries import linking

    found = _exchanges(linking.tfidf_cosine(spark, "/root/testdata/sf0.001"))
    assert found and not [x for x in found if "doc_id" in x and ("item_id" in x or "token" in x)]
    a = spark.createDataFrame([(k, f"t{j}", 1 + (k * j) % 3) for k in range(9) for j in range(k, k + 5)], "a int, token string, n long")
    idfs, b = features.idf(a, 9), a.where("a < 4").withColumnRenamed("a", "b")
    plain = features.tfidf_cosine(features.weights(a, "a", idfs), "a", features.weights(b, "b", idfs), "b")
    told = lambda df: rows(df.select("a", "b", F.round("cosine", 9)))
    assert told(features.cosines(a, "a", b, "b", idfs)) == told(plain)


def test_ranked_pairs_are_summed_up_where_the_texts_are(spark):
    from fixmine.operators import similarity

    x = spark.range(50).selectExpr("id AS a", "explode(array('s', concat('t', id % 7))) AS token", "0.7D AS x").repartition("a")
    y = spark.range(3).selectExpr("id AS b", "explode(array('s', concat('t', id))) AS token", "0.7D AS y")
    pairs, _ = similarity.cosine_candidates(x, "a", y, "b", 2)
    assert not [e for e in _exchanges(pairs) if "(b#" in e and "a#" in e]


def test_blocks_go_to_the_parts_that_are_in_them(spark, monkeypatch):
    from fixmine.operators import history

    met, walk = spark.sparkContext.accumulator(0), history._walk

    def counted(key, marks, nodes):
        met.add(len(nodes))
        return walk(key, marks, nodes)

    monkeypatch.setattr(history, "_walk", counted)
    monkeypatch.setattr(history, "RANGES", 20)
    commits = spark.range(400).selectExpr("1L AS repo", "id AS commit", "id AS order", "CASE WHEN id > 0 THEN array(id - 1) ELSE CAST(array() AS ARRAY<BIGINT>) END AS parents")
    ranges = spark.range(1, 400).selectExpr("id * 37 % 400 AS range", "1L AS repo", "id - 1 AS base", "id AS head")
    out = history.commit_ranges(commits, ranges, block=50)
    assert rows(out.select("range", "commit")) == sorted(((k * 37 % 400, k) for k in range(1, 400)), key=str)
    assert met.value <= 3000


def test_equal_ranges_and_points_meet_once(spark):
    points = spark.range(20000).selectExpr("id AS e", "CAST(id % 3 AS DOUBLE) AS v")
    bands = spark.range(20000).selectExpr("id + 5 AS k", "0.5D AS low", "1.0D AS high").union(spark.createDataFrame([(2, 0.0, 0.0)], "k long, low double, high double"))
    out = linkage.summed_ranges(points, "v", bands, "low", "high", "k", 2.0)
    assert rows(out.groupBy("v", "count", "first").agg(F.count("*"))) == [(0.0, 1, 2, 6667), (1.0, 20000, 5, 6667)]


def test_diffs_are_dealt_out_whole(spark):
    from fixmine.operators import diffs

    d = spark.range(20000).selectExpr("id", "'--- a\\n+++ b\\n@@ -1 +1 @@\\n-x\\n+y' AS diff")
    out = diffs.diff_lines(d, "id", "diff")
    found = _exchanges(out) + [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "REPARTITION" in x]
    assert out.count() == 40000 and len({x.strip() for x in found}) == 1 and "REPARTITION_BY_NUM" in found[0]


def test_lines_and_files_are_dealt_out_by_their_number(spark):
    from fixmine.store import dealt

    assert dealt(spark.range(100_000), ["id"]).rdd.getNumPartitions() == 25 and dealt(spark.range(5), ["id"]).rdd.getNumPartitions() == 4


def test_outputs_are_written_by_all_tasks(spark, tmp_path):
    from fixmine.queries import lookups

    spark.range(40).repartition(4).write.csv(f"{tmp_path}/made")
    lookups._rename(spark, f"{tmp_path}/made", f"{tmp_path}/out", "s0_output.csv")
    files = list((tmp_path / "out").rglob("s0_output.csv"))
    assert len(files) == 4 and sum(len(f.read_text().split()) for f in files) == 40


def test_texts_are_read_once_for_overlaps(spark):
    from fixmine.operators import features

    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def words(k):
        seen.add(1)
        return [f"w{k % 7}", f"v{k % 5}", f"only{k}"]

    left = spark.range(500).select("id", words("id").alias("w"))
    right = spark.createDataFrame([(0, ["w1", "v1"]), (1, ["w2", "nowhere"]), (2, [])], "j int, w array<string>")
    out = features.overlapping(left, "id", right, "j", "w", 1.0)
    want = [(k, 0, 2, 1.0, 2 / 3) for k in range(500) if k % 7 == 1 and k % 5 == 1]
    assert rows(out) == sorted(want, key=str) and seen.value == 500


def test_folds_are_told_once_for_all_models(spark):
    from fixmine.operators import models

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def feature(k):
        seen.add(1)
        return None if k % 9 == 0 else float(k * 37 % 101)

    plain = spark.range(400).selectExpr("id", "CAST(id * 53 % 89 AS DOUBLE) AS b", "CASE WHEN id % 11 > 0 THEN CAST(id * 37 % 101 + id % 40 > 60 AS INT) END AS y")
    df = plain.withColumn("a", feature("id"))
    out = models.cross_scored(df, "id", ["a", "b"], "y", {"p": "logistic", "v": "linear"}, 3)
    got = {r["id"]: (r["p"], r["v"]) for r in out.collect()}
    assert len(got) == 400 and seen.value <= 3 * 400
    # each fold by the models that are fitted for it alone
    whole = spark.createDataFrame(df.collect(), df.schema).withColumn("fold", models.fold(F.col("id"), 3))
    for place, kind in enumerate(("logistic", "linear")):
        for k in range(3):
            for r in models.fit_predict(whole.where(f"fold <> {k}"), whole.where(f"fold = {k}"), ["a", "b"], "y", kind).collect():
                assert abs(r["score"] - got[r["id"]][place]) < 1e-9


def test_models_that_rank_together_score_in_one_table(spark):
    from fixmine.plans import workflows

    df = spark.range(300).selectExpr("id div 6 AS e", "CASE WHEN id = 299 THEN 298 ELSE id END AS id", "CAST(id * 37 % 101 AS DOUBLE) AS a", "CAST(id * 53 % 89 AS DOUBLE) AS b", "CAST(id * 37 % 101 + id % 40 > 60 AS INT) AS y")
    ranked, _ = workflows.rank_features(df, "e", "id", ["a", "b"], "y", ks=(1, 3))
    assert "Join" not in ranked._jdf.queryExecution().executedPlan().toString()
    # the rows of an id that repeats meet all scores of that id
    assert ranked.count() == 302 and ranked.where("id = 298").count() == 4


def test_fused_ranks_are_dealt_out_by_their_number(spark):
    from fixmine.queries import evaluation

    for query in (evaluation.fusion_borda, evaluation.fusion_voting):
        found = _exchanges(query(spark, "/root/testdata/sf0.1"))
        assert len(found) == 1 and ", 5), REPARTITION_BY_NUM" in found[0]


def test_entities_are_dealt_out_once_for_linkage(spark):
    from fixmine.queries import linking

    df = linking.linkage_precision_recall(spark, "/root/testdata/sf0.001")
    by = [x.split("Exchange hashpartitioning(")[1].split(")")[0] for x in _exchanges(df)]
    assert by and not [x for x in by if "hash#" in x]
    assert "ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_digest_is_made_once_for_its_numbers(spark):
    from fixmine.operators import history

    changes = spark.createDataFrame([("r", 1, "/a/b", None, "x"), ("r", 2, "/a/b", "x", "y"), ("r", 3, "/a/b", "y", "x")], "repo string, commit int, path string, old string, new string")
    plan = history.folder_deltas(changes, ["repo"], "")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 2 and "Generate" not in plan
    commits = spark.createDataFrame([("r", 1, None), ("r", 2, 1), ("r", 3, 2)], "repo string, commit int, parent int")
    assert rows(history.tree_classes(commits, changes, ["repo"])) == [("r", 1, 1, 2), ("r", 2, 2, 1), ("r", 3, 1, 2)]


def test_pairs_of_one_key_are_dealt_out_to_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(linkage, "PORTION", 100, raising=False)
    monkeypatch.setattr(linkage, "PAIRS", 1 << 16, raising=False)
    issues = spark.range(1000).selectExpr("id AS entity", "'ABC-1' AS key", "'name' AS product").union(spark.createDataFrame([(7, "ABC-1", "other"), (-1, "abc-1", "third")], "entity long, key string, product string"))
    commits = spark.range(1000).selectExpr("'name' AS repo", "concat('h', id) AS hash", "'see ABC-1' AS message").union(spark.createDataFrame([("other", "h7", "abc-1"), ("third", "x", "ABC-1"), ("third", "h8", "ABC-1")], "repo string, hash string, message string"))
    out = linkage.issue_search(issues, commits, strings.edit_similarity(F.col("product"), F.col("repo")), 1.0)
    each = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(each) == out.distinct().count() == 1_000_000 + 2 and max(each) < 250_000
    assert rows(out.where("entity < 0")) == [(-1, "abc-1", "h8"), (-1, "abc-1", "x")]


def test_no_table_has_the_counts_of_all_texts(spark, monkeypatch):
    from fixmine.queries import history, linking

    kind, seen = type(spark.range(0)), []
    plain = kind.checkpoint

    def noted(self, *a, **b):
        out = plain(self, *a, **b)
        seen.append(out.count())
        return out

    monkeypatch.setattr(kind, "checkpoint", noted)
    assert history.top_documents(spark, "/root/testdata/sf0.01").count() > 0
    assert max(seen) * 4 < linking._counts(spark, "/root/testdata/sf0.01", "documents", "doc_id").count()


def test_top_cosines_of_texts_with_rare_words_and_repeated_ids(spark, monkeypatch):
    from fixmine.operators import features, similarity

    # w0 is in all rows but two, so that its idf is not 0; x1, x2, ... are in one row each; id 3 has two rows, and one row has no words
    left = spark.range(60).selectExpr("IF(id = 59, 3, id) AS a", "IF(id = 7, '', concat('w0 w', id % 5, ' w', id % 7, ' w', id % 7, ' x', id)) AS text")
    right = spark.createDataFrame([(0, "w1 w2 x3 x3 x59"), (1, "w0 w3 nowhere"), (2, "x11"), (3, "nowhere"), (4, None)], "b int, text string")
    words = F.filter(F.split("text", " "), lambda w: w != "")
    counts = lambda df, key: features.term_counts(df.withColumn("t", words), key, "t")
    idfs = features.idf(counts(left, "a"), 60)
    told = lambda df: rows(df.select("b", "a", F.round("cosine", 9), "place"))
    want = told(similarity.top_cosine(features.weights(counts(left, "a"), "a", idfs), "a", features.weights(counts(right, "b"), "b", idfs), "b", 4))
    assert len(want) > 8
    for common, few in ((100_000, 500), (3, 500), (0, 500), (3, 2)):
        monkeypatch.setattr(similarity, "COMMON", common)
        monkeypatch.setattr(similarity, "FEW", few)
        assert told(similarity.top_cosine_texts(left, "a", right, "b", words, 4)) == want
    one = spark.createDataFrame([(None, "u v"), (1, "v"), (2, "t"), (3, "t")], "a int, text string")
    assert rows(similarity.top_cosine_texts(one, "a", right.limit(1).select(F.lit("i").alias("b"), F.lit("u").alias("text")), "b", words, 1).select("b", "a", "place")) == [("i", None, 1)]


def test_siblings_below_one_parent_are_dealt_out_and_met_once(spark, monkeypatch):
    monkeypatch.setattr(linkage, "PORTION", 100, raising=False)
    monkeypatch.setattr(linkage, "PAIRS", 1 << 16, raising=False)
    # all nodes have two parents in common
    e = spark.range(1000).selectExpr("explode(array('p', 'q')) AS src", "concat('c', id) AS dst")
    every = e.select(F.col("dst").alias("node"))
    out = graph.siblings(e, every, every)
    each = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(each) == out.distinct().count() == 1_000_000 and max(each) < 250_000
    # no pair is shuffled to be made distinct
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and "Aggregate" not in plan[: plan.index("Join")]


def test_siblings_of_nodes_with_few_and_many_parents(spark, monkeypatch):
    links = {(p, f"n{k}") for k in range(40) for p in (f"a{k % 3}", f"b{k % 4}", f"b{k % 5}", f"c{k % 7}")} | {(f"a{k % 3}", f"m{k}") for k in range(9)}
    e = spark.createDataFrame([*links, *links, (None, "n1"), ("a1", None), (None, None)], "src string, dst string")
    nodes, pool = (e.where(x).select(F.col("dst").alias("node")) for x in ("dst LIKE '%1%' OR dst LIKE 'm%'", "dst NOT LIKE '%2'"))
    asked, found = ({r["node"] for r in df.distinct().collect()} for df in (nodes, pool))
    want = sorted({(x, y) for p, x in links for q, y in links if p == q and x in asked and y in found}, key=str)
    for most in (64, 3, 1):
        monkeypatch.setattr(graph, "PARENTS", most, raising=False)
        assert rows(graph.siblings(e, nodes, pool)) == want
