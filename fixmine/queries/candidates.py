"""Votes, frequency filters, screening, histograms and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixmine.functions import strings
from fixmine.operators import filters, ranking, selection, votes
from fixmine.queries.base import query, table

_N = "(SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2)"


@query(f"""
SELECT user_id, array_to_string(list_sort(list(event_type)), ',') AS modes, max(n) AS frequency FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY n DESC) AS r FROM {_N}) WHERE r = 1 GROUP BY user_id
""")
def vote_modes(spark, d):
    return votes.modes(table(spark, d, "events"), "user_id", "event_type").withColumn("modes", F.array_join("modes", ","))


def _threshold(f: int):
    def run(spark, d):
        return votes.above(table(spark, d, "events"), "user_id", "event_type", f)

    run.__name__ = f"vote_threshold_{f}"
    query(f"SELECT user_id, event_type, n FROM {_N} WHERE n > {f}")(run)


for _f in (0, 5, 7):
    _threshold(_f)


@query("""
WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
n AS (SELECT r, user_id, event_type, count(*) AS n FROM e, (VALUES (3), (5), (10)) t(r) WHERE k <= r AND event_type IS NOT NULL GROUP BY ALL)
SELECT CAST(r AS BIGINT) AS rounds, user_id, array_to_string(list_sort(list(event_type)), ',') AS modes, max(n) AS frequency FROM (SELECT *, rank() OVER (PARTITION BY r, user_id ORDER BY n DESC) AS q FROM n) WHERE q = 1 GROUP BY r, user_id
""")
def vote_prefix_rounds(spark, d):
    e = ranking.rank_within(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "k")
    return votes.prefix_modes(e, "user_id", "event_type", "k", (3, 5, 10)).withColumn("modes", F.array_join("modes", ","))


@query("""
WITH r AS (SELECT DISTINCT l_returnflag AS g, l_suppkey AS f, CAST(l_partkey AS VARCHAR) AS a, CAST(l_linenumber AS VARCHAR) AS b, l_linestatus AS c FROM lineitem),
n AS (SELECT g, v, count(*) AS n FROM (SELECT g, a AS v FROM r UNION ALL SELECT g, b FROM r) GROUP BY g, v),
m AS (SELECT g, v FROM (SELECT *, rank() OVER (PARTITION BY g ORDER BY n DESC) AS k FROM n) WHERE k = 1),
o AS (SELECT g, a, b, c, min(f) AS f FROM r GROUP BY g, a, b, c)
SELECT g, f, a, b, c FROM o WHERE EXISTS (SELECT 1 FROM m WHERE m.g = o.g AND m.v IN (o.a, o.b, o.c))
""")
def cross_branch_frequency(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_suppkey").alias("f"), F.col("l_partkey").cast("string").alias("a"), F.col("l_linenumber").cast("string").alias("b"), F.col("l_linestatus").alias("c"))
    return votes.cross_branch_frequency(rows, ["g"], "f", ("a", "b", "c"))


@query("SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1")
def year_histogram(spark, d):
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.count("*").alias("n"))


@query("SELECT length(p_name) AS length, count(*) AS n FROM part GROUP BY 1")
def length_histogram(spark, d):
    return table(spark, d, "part").groupBy(F.length("p_name").cast("long").alias("length")).agg(F.count("*").alias("n"))


@query("""SELECT p_brand, p_type, array_to_string(list_sort(list(DISTINCT p_size)), ',') AS "values" FROM part GROUP BY 1, 2""")
def set_group_versions(spark, d):
    return votes.grouped_sets(table(spark, d, "part"), "p_brand", "p_type", "p_size").withColumn("values", F.array_join("values", ","))


@query("""
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "n_F", count(*) FILTER (o_orderstatus = 'O') AS "n_O", count(*) FILTER (o_orderstatus = 'P') AS "n_P", count(*) AS total
FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY 1
""")
def stage_pivot(spark, d):
    return votes.pivot_counts(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("""
SELECT p_name, p_retailprice, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1
""")
def best_by_name(spark, d):
    return ranking.first_by(table(spark, d, "part"), ["p_name"], F.struct("p_retailprice", -F.col("p_partkey")), ["p_retailprice", "p_partkey"])


@query("""
WITH w AS (SELECT user_id, event_type, count(*) AS w FROM events GROUP BY 1, 2), t AS (SELECT *, sum(w) OVER (PARTITION BY user_id) AS s, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, event_type) AS r FROM w)
SELECT user_id, event_type AS main, round(100 * w / s, 2) AS percent FROM t WHERE r = 1
""")
def main_category_share(spark, d):
    return votes.main_share(table(spark, d, "events").withColumn("one", F.lit(1)), "user_id", "event_type", "one")


@query("""
SELECT l_suppkey, count(*) FILTER (l_linestatus = 'F') AS done, count(*) AS "all" FROM lineitem GROUP BY 1
""")
def done_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_linestatus") == "F").alias("done"), F.count("*").alias("all"))


@query("""
SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS low, max(l_extendedprice) AS high,
       round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS q2, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3 FROM lineitem GROUP BY 1
""")
def numeric_summary(spark, d):
    """Counts, moments and exact quartiles; the quartiles come from refined histograms."""
    x, rows = F.col("l_extendedprice"), table(spark, d, "lineitem")
    sums = rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_samp(x), 4).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"))
    q = selection.exact_quantiles(rows, ["l_returnflag"], "l_extendedprice", (0.25, 0.5, 0.75))
    named = [F.round(F.max(F.when(F.col("share") == p, F.col("quantile"))), 4).alias(n) for n, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))]
    return sums.join(q.groupBy("l_returnflag").agg(*named), "l_returnflag")


_TERMS = ("the", "der", "la", "que")


@query("SELECT doc_id, " + "CASE " + " ".join(f"WHEN contains(lower(text), ' {t} ') THEN '{t}'" for t in _TERMS) + " END AS hit FROM documents WHERE " + " OR ".join(f"contains(lower(text), ' {t} ')" for t in _TERMS))
def closed_source_filter(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(strings.contains_any(F.col("text"), _TERMS)).select("doc_id", strings.first_of(F.col("text"), _TERMS).alias("hit"))


_FILES_SQL = """
(SELECT p_partkey AS id, list_value(concat('src/', replace(p_type, ' ', '_'), '.', CASE p_partkey % 4 WHEN 0 THEN 'erb' WHEN 1 THEN 'java' WHEN 2 THEN 'md' ELSE 'rs' END),
   concat(CASE WHEN p_partkey % 3 = 0 THEN 'Tests/' ELSE 'lib/' END, p_size, '.', CASE p_partkey % 5 WHEN 0 THEN 'py' WHEN 1 THEN 'h' ELSE 'rst' END)) AS files FROM part)
"""


def v_files(spark, d):
    """Changed files of a change for each part."""
    k = F.col("p_partkey")
    one = F.concat(F.lit("src/"), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("."), F.when(k % 4 == 0, "erb").when(k % 4 == 1, "java").when(k % 4 == 2, "md").otherwise("rs"))
    two = F.concat(F.when(k % 3 == 0, "Tests/").otherwise("lib/"), F.col("p_size").cast("string"), F.lit("."), F.when(k % 5 == 0, "py").when(k % 5 == 1, "h").otherwise("rst"))
    return table(spark, d, "part").select(k.alias("id"), F.array(one, two).alias("files"))


_SUFFIX = "split_part(f, '.', len(string_split(f, '.')))"
_CODE = """('java', 'py', 'c', 'cc', 'cpp', 'cxx', 'c++', 'js', 'go', 'rb', 'cs', 'as', 'php', 'pl', 'coffee', 'h', 'm', 'ts', 'kt', 'mjs', 'twig', 'htaccess', 'tpl', 'pt', 'scala', 's', 'erb',
 'swf', 'asm', 'groovy', 'jsp', 'sh', 'hpp', 'phps', 'script', 'wscript', 'ldif', 'Tokens', 'nsi', 'tcl', 'idl', 'pyx', 'ps1', 'toml', 'inl', 'x', 'S', 'hbs')"""


@query(f"""
SELECT id, len(list_filter(files, lambda f: {_SUFFIX} IN {_CODE})) > 0 AS code, len(list_filter(files, lambda f: NOT contains(lower(f), 'test'))) > 0 AS beyond,
       len(list_filter(files, lambda f: {_SUFFIX} IN {_CODE} AND NOT contains(lower(f), 'test'))) > 0 AS both_rules FROM {_FILES_SQL}
""")
def code_change_filter(spark, d):
    f = F.col("files")
    return v_files(spark, d).select("id", filters.changes_code(f).alias("code"), filters.changes_beyond_tests(f).alias("beyond"), filters.changes_code_beyond_tests(f).alias("both_rules"))


@query(f"""
SELECT id, CASE WHEN id % 7 = 0 THEN true WHEN id % 7 = 1 THEN false WHEN id % 7 = 2 THEN true ELSE len(list_filter(files, lambda f: {_SUFFIX} IN {_CODE} AND NOT contains(lower(f), 'test'))) > 0 END AS passes FROM {_FILES_SQL}
""")
def confirmed_code_changes(spark, d):
    """Every seventh change is none of git; two more of seven have no files, one of them at the hub."""
    k = F.col("id")
    files = F.when((k % 7).isin(1, 2), F.array().cast("array<string>")).otherwise(F.col("files"))
    return v_files(spark, d).select("id", filters.confirmed_code_change(F.when(k % 7 == 0, "svn").otherwise("git_commit"), k % 7 == 1, files).alias("passes"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) <= 8)")
def limited_groups(spark, d):
    return filters.no_more_than(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 8)


@query("""
SELECT o_orderkey, o_totalprice > 100000 AS large, o_orderpriority IN ('1-URGENT', '2-HIGH') AS urgent, o_orderstatus <> 'F' AS unfinished,
  o_totalprice > 100000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'F' AS selected FROM orders
""")
def rule_selection(spark, d):
    o = filters.screen(table(spark, d, "orders"), large=F.col("o_totalprice") > 100000, urgent=F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), unfinished=F.col("o_orderstatus") != "F")
    return o.select("o_orderkey", "large", "urgent", "unfinished", "selected")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_unmatched(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return filters.todo(c, o, "c_custkey")


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT k, CASE WHEN b.k IS NULL THEN 'only_a' WHEN a.k IS NULL THEN 'only_b' ELSE 'both' END AS side FROM (SELECT k FROM a UNION SELECT k FROM b) u LEFT JOIN a USING (k) LEFT JOIN b USING (k)
""")
def overlap_sets(spark, d):
    o = table(spark, d, "orders").withColumn("k", F.col("o_custkey"))
    return filters.overlap(o.where("o_orderpriority = '1-URGENT'"), o.where("o_orderstatus = 'P'"), "k")


@query("SELECT p_brand, p_container FROM (SELECT DISTINCT p_brand, concat(p_type, '/', p_size) AS p_container FROM part) ORDER BY md5(concat_ws('|', '3', p_brand, p_container)), p_brand, p_container LIMIT 817")
def first_in_hash_order(spark, d):
    rows = table(spark, d, "part").select("p_brand", F.concat("p_type", F.lit("/"), F.col("p_size").cast("string")).alias("p_container")).distinct()
    return rows.orderBy(ranking.hash_order("3", "p_brand", "p_container"), "p_brand", "p_container").limit(817)


@query("""
SELECT k, a, b FROM (SELECT strftime(l_shipdate, '%Y-%m-%d') AS k, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)::BIGINT AS a, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS b FROM lineitem GROUP BY 1)
""")
def conditional_counts(spark, d):
    k = F.date_format("l_shipdate", "yyyy-MM-dd").alias("k")
    return table(spark, d, "lineitem").groupBy(k).agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("b"))


@query("""
SELECT p_brand, p_partkey, span FROM (SELECT p_brand, p_partkey, p_size * 3 - 60 AS span, row_number() OVER (PARTITION BY p_brand ORDER BY p_size * 3 - 60, p_partkey) AS r FROM part) WHERE r = 1
""")
def minimum_span(spark, d):
    rows = table(spark, d, "part").withColumn("span", F.col("p_size") * 3 - 60)
    return ranking.first_by(rows, ["p_brand"], F.struct(-F.col("span"), -F.col("p_partkey")), ["p_partkey", "span"])


@query("""
WITH c AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_orderpriority) AS p, count(*) AS n FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN n = 1 THEN 'single' WHEN s = 1 AND p = 1 THEN 'one_group' WHEN s = 1 THEN 'one_branch' WHEN p = 1 THEN 'branches' ELSE 'many' END AS kind FROM c
""")
def truth_classes(spark, d):
    c = table(spark, d, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderstatus").alias("s"), F.countDistinct("o_orderpriority").alias("p"), F.count("*").alias("n"))
    s, p = F.col("s") == 1, F.col("p") == 1
    return c.select("o_custkey", F.when(F.col("n") == 1, "single").when(s & p, "one_group").when(s, "one_branch").when(p, "branches").otherwise("many").alias("kind"))
