"""Whole workflows and the models' transfer between groups, each against its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixmine.functions import strings
from fixmine.operators import features, graph, linkage, models
from fixmine.plans import workflows
from fixmine.queries.base import query, table
from fixmine.queries.linking import _DOCS, _ITEMS, _LCS, _counts

_CANDIDATES = "SELECT concat('c', CAST(l_suppkey % 20 AS VARCHAR(9))) AS cve, concat('b', CAST(l_linenumber AS VARCHAR(9))) AS file, concat('h', CAST(l_partkey AS VARCHAR(9))) AS hash, concat('s', CAST(l_partkey % 100 AS VARCHAR(9))) AS short, l_returnflag AS subject FROM {lineitem}"
_ANSWERS = "SELECT concat('c', CAST(user_id % 23 AS VARCHAR(9))) AS cve, CASE WHEN event_id % 11 > 0 THEN 1 + event_id % 5 + event_id % 3 END AS vote FROM {events}"


@query(f"""
WITH r AS (SELECT DISTINCT * FROM ({_CANDIDATES.format(lineitem='lineitem')})), n AS (SELECT cve, v, count(*) AS n FROM (SELECT cve, hash AS v FROM r UNION ALL SELECT cve, short FROM r) GROUP BY 1, 2),
m AS (SELECT cve, v FROM n QUALIFY rank() OVER (PARTITION BY cve ORDER BY n DESC) = 1), o AS (SELECT cve, hash, short, subject, min(file) AS file FROM r GROUP BY 1, 2, 3, 4),
k AS (SELECT *, row_number() OVER (PARTITION BY cve ORDER BY hash, short, subject, file) AS number FROM o WHERE EXISTS (SELECT 1 FROM m WHERE m.cve = o.cve AND m.v IN (o.hash, o.short, o.subject))),
a AS (SELECT cve, vote, count(*) AS frequency FROM ({_ANSWERS.format(events='events')}) WHERE vote IS NOT NULL GROUP BY 1, 2), w AS (SELECT * FROM a QUALIFY rank() OVER (PARTITION BY cve ORDER BY frequency DESC) = 1)
SELECT w.cve, w.vote AS number, k.hash, w.frequency FROM w LEFT JOIN k ON k.cve = w.cve AND k.number = w.vote
""")
def filter_and_vote(spark, d):
    """Candidates of each entity, screened and numbered, and which of them the most answers name."""
    return workflows.filter_and_vote(spark.sql(_CANDIDATES, lineitem=table(spark, d, "lineitem")), spark.sql(_ANSWERS, events=table(spark, d, "events")))


@query()
def ranked_by_features(spark, d):
    """Top-k scores of a ranking by two models' fused ranks, every line scored by models that have not seen its order."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.expr("l_orderkey * 10 + l_linenumber").alias("id"), "l_quantity", "l_extendedprice", "l_discount", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return workflows.rank_features(rows, "l_orderkey", "id", ["l_quantity", "l_extendedprice", "l_discount"], "y")[1].select("k", *(F.round(c, 3).alias(c) for c in ("precision", "recall", "f1")))


_FIT = "SELECT regr_slope(l_extendedprice, {x}) AS s, regr_intercept(l_extendedprice, {x}) AS i FROM lineitem WHERE l_suppkey % 2 = 0"


@query(f"WITH m AS ({_FIT.format(x='l_quantity')}) SELECT l_orderkey, l_linenumber, round(i + s * l_quantity, 3) AS score FROM lineitem, m WHERE l_suppkey % 2 <> 0")
def transferred_scores(spark, d):
    """Lines of odd suppliers scored by a model of the even ones."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", (F.col("l_suppkey") % 2).alias("half"))
    return models.cross_group(rows, "half", [0], ["l_quantity"], "l_extendedprice", kind="linear").select("l_orderkey", "l_linenumber", F.round("score", 3).alias("score"))


@query(f"""
WITH a AS ({_FIT.format(x='l_discount')}), b AS ({_FIT.format(x='l_quantity')}), t AS (SELECT * FROM lineitem WHERE l_suppkey % 2 <> 0)
SELECT l_orderkey, l_linenumber, 'amount' AS left_out, round(i + s * l_discount, 3) AS score FROM t, a UNION ALL SELECT l_orderkey, l_linenumber, 'terms', round(i + s * l_quantity, 3) FROM t, b
""")
def group_left_out(spark, d):
    """The same with one group of features left out at a time."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice", "l_suppkey")
    out = models.leave_group_out(rows.where("l_suppkey % 2 = 0"), rows.where("l_suppkey % 2 <> 0"), ["l_quantity", "l_discount"], {"amount": ["l_quantity"], "terms": ["l_discount"]}, "l_extendedprice", kind="linear")
    return out.select("l_orderkey", "l_linenumber", "left_out", F.round("score", 3).alias("score"))


@query(f"""
WITH a AS (SELECT token, count(*) AS n FROM {_DOCS} GROUP BY 1), b AS (SELECT token, sum(n)::BIGINT AS n FROM {_ITEMS} GROUP BY 1)
SELECT token, a.n + coalesce(b.n, 0) AS df, round(ln(((SELECT count(*) FROM documents) + (SELECT count(*) FROM benchmark)) / (a.n + coalesce(b.n, 0) + 1)), 6) AS idf FROM a LEFT JOIN b USING (token)
""")
def idf_of_two_corpora(spark, d):
    """Weights of the documents' tokens, with the occurrences in a second corpus counted in."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    out = features.idf_of_two(_counts(spark, d, "documents", "doc_id"), docs.count(), _counts(spark, d, "benchmark", "item_id"), items.count())
    return out.select("token", "df", F.round("idf", 6).alias("idf"))


_EDGES = "SELECT 'g' AS g, concat('n', CAST(n_regionkey AS VARCHAR(9))) AS src, concat('k', CAST(n_nationkey AS VARCHAR(9))) AS dst FROM {nation}"
_NEW = "SELECT 'g' AS g, concat(CASE WHEN c_custkey % 4 = 0 THEN 'x' ELSE 'k' END, CAST(c_nationkey AS VARCHAR(9))) AS src, CASE c_custkey % 3 WHEN 0 THEN concat('n', CAST(c_nationkey % 5 AS VARCHAR(9))) WHEN 1 THEN concat('c', CAST(c_custkey % 40 AS VARCHAR(9))) ELSE concat('k', CAST(c_custkey % 25 AS VARCHAR(9))) END AS dst, c_custkey AS n FROM {customer}"


@query(f"""
WITH e AS ({_EDGES.format(nation='nation')}), x AS ({_NEW.format(customer='customer')}), k AS (SELECT src AS node FROM e UNION SELECT dst FROM e), p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e),
s AS (SELECT x.*, src IN (SELECT node FROM k) AND p.a IS NULL AS sound, dst IN (SELECT node FROM k) AS there FROM x LEFT JOIN p ON p.a = least(src, dst) AND p.b = greatest(src, dst)),
o AS (SELECT *, sound AND row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst), sound ORDER BY n) = 1 AS ok, row_number() OVER (PARTITION BY dst, sound ORDER BY n) = 1 AS first FROM s)
SELECT g, src, dst, n, CASE WHEN NOT ok THEN false WHEN NOT there AND first THEN true END AS added FROM o
""")
def insert_outcomes(spark, d):
    """What becomes of each edge that is put into a graph: a new node, an edge between nodes that are there, or nothing."""
    return graph.insert_outcomes(spark.sql(_EDGES, nation=table(spark, d, "nation")), spark.sql(_NEW, customer=table(spark, d, "customer")), "g", "n")


@query(f"""
WITH a AS (SELECT DISTINCT CASE WHEN p_partkey % 9 = 0 THEN lower(s.m) ELSE lower(p_name) END AS a FROM part JOIN (SELECT min(c_mktsegment) AS m FROM customer) s ON true), b AS (SELECT DISTINCT lower(c_mktsegment) AS b FROM customer),
s AS (SELECT a, b, CAST({_LCS.format(a='b', b='a')} AS DOUBLE) AS score FROM a, b WHERE a NOT IN (SELECT b FROM b))
SELECT a, b, CAST(length(a) AS DOUBLE) AS score, true AS exact FROM a JOIN b ON a = b UNION ALL SELECT a, b, score, false FROM s WHERE score > 2 QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 10
""")
def names_or_similar(spark, d):
    """Names that are equal, and only for the others those with the longest common substrings."""
    least = table(spark, d, "customer").agg(F.min("c_mktsegment").alias("m"))
    a = table(spark, d, "part").join(F.broadcast(least)).select(F.lower(F.when(F.col("p_partkey") % 9 == 0, F.col("m")).otherwise(F.col("p_name"))).alias("a"))
    b = table(spark, d, "customer").select(F.lower("c_mktsegment").alias("b"))
    return linkage.names_or_similar(a, "a", b, "b", strings.longest_common_substring(F.col("b"), F.col("a")), 2)
