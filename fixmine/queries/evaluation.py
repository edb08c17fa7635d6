"""Ranks, fusion and metrics over line items as ranked candidates of their orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixmine.operators import metrics, ranking
from fixmine.queries.base import query, table
from fixmine.store import dealt

_KEYS = ["l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_returnflag"]
_ORDER = "l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_returnflag"
_R = f"(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS r, CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem)"
_KS = (1, 2, 3, 5, 10)
_KV = ", ".join(f"({k})" for k in _KS)


def ranked(spark, d):
    rows = table(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return ranking.rank_within(rows, ["l_orderkey"], [F.desc("l_extendedprice"), *_KEYS], "r")


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, r AS rank FROM {_R}")
def rank_in_group(spark, d):
    return ranked(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", F.col("r").alias("rank"))


@query(f"SELECT l_orderkey, l_partkey, l_extendedprice FROM {_R} WHERE r <= 3")
def topk_in_group(spark, d):
    return ranking.top_within(table(spark, d, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), *_KEYS], 3).select("l_orderkey", "l_partkey", "l_extendedprice")


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem JOIN (SELECT l_orderkey, max(l_quantity) AS m FROM lineitem GROUP BY 1) USING (l_orderkey) WHERE l_quantity = m")
def max_priority(spark, d):
    return ranking.best_within(table(spark, d, "lineitem"), ["l_orderkey"], "l_quantity").select("l_orderkey", "l_partkey", "l_quantity")


@query(f"""
WITH g AS (SELECT l_orderkey, k, sum(CASE WHEN r <= k THEN y ELSE 0 END) AS tp, sum(y) AS p FROM {_R}, (VALUES {_KV}) t(k) GROUP BY ALL)
SELECT CAST(k AS BIGINT) AS k, round(avg(tp / k), 6) AS precision, round(avg(CASE WHEN p = 0 THEN 0 ELSE tp / p END), 6) AS recall, round(avg(2 * tp / (k + p)), 6) AS f1 FROM g GROUP BY k
""")
def topk_prf_macro(spark, d):
    return metrics.topk_prf(ranked(spark, d), ["l_orderkey"], "r", "y", _KS).select("k", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"""
WITH g AS (SELECT l_orderkey, k, sum(CASE WHEN r <= k THEN y ELSE 0 END) AS tp, sum(y) AS p, min(CASE WHEN y = 1 THEN r END) AS f, coalesce(avg(CASE WHEN y = 1 THEN 1.0::DOUBLE / r END), 0) AS m
           FROM {_R}, (VALUES {_KV}) t(k) GROUP BY l_orderkey, k)
SELECT CAST(k AS BIGINT) AS k, round(avg(CASE WHEN p = 0 THEN 0 ELSE tp / p END), 6) AS recall,
       round(avg(CASE WHEN k = 1 THEN 1 WHEN f < k THEN f ELSE k END), 6) AS effort, round(avg(m), 6) AS mrr FROM g GROUP BY k
""")
def recall_mrr_effort(spark, d):
    return metrics.recall_effort_mrr(ranked(spark, d), ["l_orderkey"], "r", "y", _KS).select("k", *(F.round(c, 6).alias(c) for c in ("recall", "effort", "mrr")))


@query(f"""
SELECT round(avg(least(b, 5)), 6) AS mean_rank, round(avg(CASE WHEN b <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate
FROM (SELECT coalesce(min(CASE WHEN y = 1 THEN r END), 6) AS b FROM {_R} GROUP BY l_orderkey)
""")
def hit_rate_at_n(spark, d):
    return metrics.best_rank_at(ranked(spark, d), ["l_orderkey"], "r", "y", 5).select(F.round("mean_rank", 6).alias("mean_rank"), F.round("hit_rate", 6).alias("hit_rate"))


_CURVE = """
WITH t AS (SELECT CAST(i AS DOUBLE) / 1000 AS threshold FROM range(1, 1000) x(i)),
s AS (SELECT l_orderkey, l_discount AS s, CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem),
g AS (SELECT l_orderkey, s, count(*) AS n, sum(y) AS tp FROM s GROUP BY 1, 2),
c AS (SELECT threshold, l_orderkey, sum(CASE WHEN s > threshold THEN n ELSE 0 END) AS n, sum(CASE WHEN s > threshold THEN tp ELSE 0 END) AS tp, sum(tp) AS p FROM g, t GROUP BY 1, 2),
m AS (SELECT threshold, avg(CASE WHEN n = 0 THEN 0 ELSE tp / n END) AS precision, avg(CASE WHEN p = 0 THEN 0 ELSE tp / p END) AS recall, avg(CASE WHEN n + p = 0 THEN 0 ELSE 2 * tp / (n + p) END) AS f1 FROM c GROUP BY 1)
"""


def _curve(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_discount", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return metrics.threshold_curve(rows, ["l_orderkey"], "l_discount", "y")


_MEASURES = ("precision", "recall", "f1")
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in _MEASURES)


@query(f"{_CURVE} SELECT threshold, {_ROUNDED} FROM m")
def threshold_prf(spark, d):
    return _curve(spark, d).select("threshold", *(F.round(c, 6).alias(c) for c in _MEASURES))


@query(f"{_CURVE} SELECT threshold, {_ROUNDED} FROM m ORDER BY round(f1, 9) DESC, threshold LIMIT 1")
def threshold_search(spark, d):
    return metrics.best_threshold(_curve(spark, d)).select("threshold", *(F.round(c, 6).alias(c) for c in _MEASURES))


def _fusion(how: str, expr: str):
    sql = f"""
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(fused, 9) AS fused, row_number() OVER (PARTITION BY l_orderkey ORDER BY fused DESC, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_returnflag) AS rank
    FROM (SELECT *, {expr} AS fused FROM (SELECT *, l_extendedprice / 100000 AS a, l_quantity / 50 AS b, l_tax AS c FROM lineitem))
    """

    def run(spark, d):
        rows = table(spark, d, "lineitem").withColumns({"a": F.col("l_extendedprice") / 100000, "b": F.col("l_quantity") / 50, "c": F.col("l_tax")})
        fused = ranking.fuse_scores(rows, ["a", "b", "c"], how)
        return ranking.rank_within(fused, ["l_orderkey"], [F.desc("fused"), *_KEYS]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("fused", 9).alias("fused"), "rank")

    run.__name__ = f"fusion_{how}"
    query(sql)(run)


for _how, _expr in (("max", "greatest(a, b, c)"), ("min", "least(a, b, c)"), ("sum", "a + b + c")):
    _fusion(_how, _expr)

_TIES = ", l_partkey, l_suppkey, l_linenumber, l_shipdate, l_returnflag, l_extendedprice, l_quantity, l_tax, l_discount"
_RANKS = f"(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC{_TIES}) AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC{_TIES}) AS b, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_tax DESC{_TIES}) AS c FROM lineitem)"


def _three_ranks(spark, d):
    ties = [*_KEYS, "l_extendedprice", "l_quantity", "l_tax", "l_discount"]
    # dealt out by their number, so that no task's sorts grow with the table
    rows = dealt(table(spark, d, "lineitem").select("l_orderkey", *(c for c in ties if c != "l_orderkey")), ["l_orderkey"], 1 << 17)
    for name, score in (("a", "l_extendedprice"), ("b", "l_quantity"), ("c", "l_tax")):
        rows = ranking.rank_within(rows, ["l_orderkey"], [F.desc(score), *ties], name)
    return rows, ties


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, fused, row_number() OVER (PARTITION BY l_orderkey ORDER BY fused{_TIES}) AS rank FROM (SELECT *, a + b + c AS fused FROM {_RANKS})")
def fusion_borda(spark, d):
    rows, ties = _three_ranks(spark, d)
    return ranking.rank_within(ranking.fuse_scores(rows, ["a", "b", "c"], "borda"), ["l_orderkey"], ["fused", *ties]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "fused", "rank")


@query(f"""
WITH s AS (SELECT *, least(a, b, c) AS lo, greatest(a, b, c) AS hi, a + b + c - least(a, b, c) - greatest(a, b, c) AS mid FROM {_RANKS}),
v AS (SELECT *, CASE WHEN mid - lo >= hi - mid THEN mid + hi ELSE lo + mid END AS closest, CASE WHEN mid - lo >= hi - mid THEN lo ELSE hi END AS last FROM s)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, closest, last, row_number() OVER (PARTITION BY l_orderkey ORDER BY closest, last{_TIES}) AS rank FROM v
""")
def fusion_voting(spark, d):
    rows, ties = _three_ranks(spark, d)
    return ranking.rank_within(ranking.fuse_by_vote(rows, ["a", "b", "c"]), ["l_orderkey"], ["closest", "last", *ties]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "closest", "last", "rank")


@query("""
WITH n AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fn, count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn FROM labels)
SELECT tp, fp, fn, tn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
       round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((fp + fn) / (tp + fp + fn + tn), 6) AS error FROM n
""")
def confusion_metrics(spark, d):
    m = metrics.confusion(table(spark, d, "labels"), "quality", "toxic")
    return m.select("tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy", "error")))


_SETS = """
WITH p AS (SELECT DISTINCT o_custkey AS g, o_orderpriority AS x FROM orders WHERE o_orderstatus = 'F'), t AS (SELECT DISTINCT o_custkey AS g, o_orderpriority AS x FROM orders WHERE o_orderstatus <> 'F'),
n AS (SELECT g, count(*) FILTER (p.x IS NOT NULL AND t.x IS NOT NULL) AS tp, count(*) FILTER (t.x IS NULL) AS fp, count(*) FILTER (p.x IS NULL) AS fn FROM p FULL JOIN t USING (g, x) GROUP BY g),
s AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM n)
"""


def _priority_sets(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderpriority").alias("x"), "o_orderstatus")
    return metrics.set_scores(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), ["g"], "x")


@query(_SETS + f"SELECT g, tp, fp, fn, {_ROUNDED} FROM s")
def set_scores(spark, d):
    return _priority_sets(spark, d).select("g", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in _MEASURES))


@query(_SETS + """
SELECT count(*) AS groups, count(*) FILTER (tp + fp > 0) AS found, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
  round(avg(precision) FILTER (tp + fp > 0), 6) AS found_precision, round(avg(recall) FILTER (tp + fp > 0), 6) AS found_recall, round(avg(f1) FILTER (tp + fp > 0), 6) AS found_f1,
  round(sum(tp) / (sum(tp) + sum(fp)), 6) AS micro_precision, round(sum(tp) / (sum(tp) + sum(fn)), 6) AS micro_recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1 FROM s
""")
def macro_micro_summary(spark, d):
    s = metrics.summarise(_priority_sets(spark, d))
    return s.select("groups", "found", *(F.round(c, 6).alias(c) for c in s.columns[2:]))


@query("""
WITH h AS (SELECT o_custkey AS g, count(*) AS h FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1), t AS (SELECT o_custkey AS g, count(*) AS t FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT g, round(least(1.0, coalesce(h, 0) / t), 6) AS recall FROM t LEFT JOIN h USING (g)
""")
def capped_recall(spark, d):
    o = table(spark, d, "orders").withColumn("g", F.col("o_custkey"))
    return metrics.capped_recall(o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")), o.where("o_orderstatus = 'F'"), ["g"]).select("g", F.round("recall", 6).alias("recall"))


_LABELLED = "(SELECT l_orderkey, l_partkey, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS label FROM lineitem GROUP BY 1, 2)"


@query(f"""
SELECT l_orderkey, l_partkey, label FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, label ORDER BY md5(concat_ws('|', '7', CAST(l_partkey AS VARCHAR))), l_partkey) AS n FROM {_LABELLED})
WHERE label = 1 OR n <= 2
""")
def negative_sample(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("label"))
    return ranking.sample_negatives(rows, ["l_orderkey"], "label", "l_partkey", 2, "7")


@query("SELECT o_orderkey, ('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 6))::BIGINT % 5 AS fold FROM orders")
def fold_split(spark, d):
    from fixmine.operators.models import fold

    return table(spark, d, "orders").select("o_orderkey", fold(F.col("o_orderkey"), 5).alias("fold"))


@query("""
WITH s AS (SELECT count(*) AS n, sum(l_quantity) AS sx, sum(l_extendedprice) AS sy, sum(l_quantity * l_quantity) AS sxx, sum(l_quantity * l_extendedprice) AS sxy FROM lineitem)
SELECT round((n * sxy - sx * sy) / (n * sxx - sx * sx), 4) AS slope, round((sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n, 4) AS intercept FROM s
""")
def linear_fit(spark, d):
    from fixmine.operators.models import linear_fit as fit

    return fit(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))
