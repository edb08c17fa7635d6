"""Record shaping and the smaller functions."""

import datetime

from pyspark.sql import functions as F

from fixmine.functions import strings, values
from fixmine.operators import graph, linkage, metrics
from fixmine.sources import records


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=str)


def test_names_and_dates(spark):
    df = spark.createDataFrame([("cpe:2.3:a:v:My_Prod-1:2", "static int foo(char *bar)", "src/a.py", "https://x.org/2020/05/06/post", "on 6 May 2020", "Wed May 6 10:00:00 2020 +0200"), ("a:b", "", "README", "https://x.org/2020/99", "no date", "bad")], "c string, h string, p string, u string, m string, g string")
    out = df.select(strings.product_key(F.col("c")).alias("c"), strings.header_tokens(F.col("h")).alias("h"), strings.language_of(F.col("p")).alias("p"), values.url_date(F.col("u")).alias("u"), values.month_name_date(F.col("m")).alias("m"), values.compact_date(F.col("g")).alias("g")).collect()
    day = datetime.date(2020, 5, 6)
    assert tuple(out[0]) == ("myprod1", ["bar", "foo"], "Python", day, day, "20200506")
    assert tuple(out[1]) == (None, [], "Unknown", None, None, "0")


def test_token_pipeline(spark):
    df = spark.createDataFrame([("fixesOverflow in the Parser",)], "t string")
    out = df.select(strings.text_tokens(F.col("t"), ("in", "the"), {"fixes": "fix"}).alias("k"), strings.occurrences(F.array(F.lit("Over"), F.lit("none")), F.col("t")).alias("n"), strings.base_names(F.array(F.lit("a/b.c"), F.lit("d/b.c"))).alias("b")).first()
    assert (out["k"], out["n"], out["b"]) == (["fix", "overflow", "parser"], 1, ["b.c"])


def test_records(spark):
    nested = spark.sql("SELECT array(named_struct('language', 'C', 'repos', array(named_struct('name', 'o##r', 'ids', array('x', 'y'))))) l")
    assert rows(records.nested_lists(nested, "l")) == [("C", "o", "r", "x"), ("C", "o", "r", "y")]
    truth = spark.createDataFrame([("1", "e", "", None, "https://a/1 https://a/2", "", "main (x)"), ("2", "f", "", "", "u", "", "")], "a string, b string, c string, d string, e string, f string, g string")
    assert rows(records.truth_links(truth, spark.createDataFrame([("f",)], "entity string"))) == [("e", "main", "https://a/1"), ("e", "main", "https://a/2")]
    cases = [(200, 5, "done"), (200, 0, "wait"), (200, None, "wait"), (302, 1, "done"), (400, 5, "pass"), (404, 5, "pass"), (410, 0, "pass"), (422, 5, "pass"), (403, 0, "wait"), (403, 5, "all wait"), (401, 5, "stop"), (429, 0, "all wait"), (500, 1, "all wait"), (None, None, "retry")]
    s = spark.createDataFrame(cases, "s int, r int, v string")
    assert all(r["v"] == r["w"] for r in s.withColumn("w", records.verdict(F.col("s"), F.col("r"))).collect())
    j = spark.createDataFrame([('{"cve":{"CVE_data_meta":{"ID":"CVE-1"},"problemtype":{"problemtype_data":[{"description":[{"value":"CWE-79"},{"value":""}]},{"description":[]}]},"references":"CWE-20"},"impact":{"baseMetricV3":{"cvssV3":{"baseScore":9.8,"vectorString":"V"}}},"cpe23Uri":"cpe:a"}',)], "j string")
    r = j.select(records.vulnerability_record(F.col("j")).alias("r")).first()["r"]
    assert (r["id"], r["cwes"], r["cpes"], r["score2"], r["score3"], r["vector3"]) == ("CVE-1", ["CWE-79"], ["cpe:a"], None, 9.8, "V")


def test_searches_branches_and_closest(spark):
    issues = spark.createDataFrame([("e", "ABC-1", "kibana"), ("e", "ABC-2", "kibana")], "entity string, key string, product string")
    commits = spark.createDataFrame([("kibana", "h1", "fix abc-1 now"), ("other", "h2", "ABC-1"), ("kibana", "h3", "ABC-12")], "repo string, hash string, message string")
    assert rows(linkage.issue_search(issues, commits, strings.word_overlap(F.col("product"), F.col("repo")))) == [("e", "ABC-1", "h1")]
    t = spark.createDataFrame([("e", "main", "git_abc"), ("e", None, "git_a"), ("e", None, "zzz")], "entity string, branch string, patch string")
    assert rows(linkage.merged_branches(t)) == [("e", "main", "git_a"), ("e", "main", "git_abc"), ("e", None, "zzz")]
    v = spark.createDataFrame([("1.2", "1.2"), ("1.2", "1.2.1"), ("9", "1.2")], "w string, t string")
    assert rows(linkage.closest(v, [], "w", "t", F.lit(0.5))) == [("1.2", "1.2"), ("9", "1.2")]


def test_graph_sources_and_search(spark):
    refs = spark.createDataFrame([("e", "N", "u1"), ("e", "D", "u2")], "k string, source string, url string")
    edges = graph.from_sources(refs, "k")
    assert edges.count() == 4
    by_id = spark.createDataFrame([("e", "e", "c1")], "k string, root string, node string")
    by_key = spark.createDataFrame([("e", "u1", "c2"), ("e", "gone", "c3")], "k string, holder string, node string")
    assert rows(graph.from_search(edges, by_id, by_key, "k").where("tag = 'SG'"), "src", "dst") == [("e", "c1"), ("u1", "c2")]
    n = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "node string, score double")
    assert rows(graph.deeper_than(n, "score", n.where("node = 'a'")), "node") == [("a",)]
    assert graph.deeper_than(n, "score", n.limit(0)).count() == 2


def test_confusion_without_positives(spark):
    m = metrics.confusion(spark.createDataFrame([(0, 0)], "p int, e int"), "p", "e").first()
    assert (m["precision"], m["f1"], m["accuracy"]) == (0.0, 0.0, 1.0)


def test_names_suffixes_and_blanks(spark):
    t = spark.createDataFrame([("static void do_it(Foo *f_1, unsigned len) /* for */",), ("",), (None,)], "c string")
    assert [r[0] for r in t.select(strings.header_tokens(F.col("c"))).collect()] == [["1", "Foo", "f", "it", "len"], [], None]
    p = spark.createDataFrame([("a/b.C",), ("x.inl",), ("y.PHP",), ("z.tar.gz",), ("Makefile",), (None,), ("q.h++",), ("w.go",)], "p string")
    assert [(r[0], r[1]) for r in p.select(strings.language_of(F.col("p")), strings.is_searched(F.col("p"))).collect()] == [("C", True), ("Cpp", True), ("PHP", False), ("Unknown", False), ("Unknown", False), (None, False), ("Cpp", True), ("Go", True)]
    s = spark.createDataFrame([("a\\r\\nb\\nc\\rd\\t  e\n f ",)], "s string")
    assert s.select(strings.squeeze(F.col("s"))).first()[0] == "a b c d\\t e\n f "
