"""Parsing of diffs, logs, answers and nested records, over texts made of the tables' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixmine.functions import strings
from fixmine.operators import diffs, parsing
from fixmine.queries.base import query, table
from fixmine.streaming import stages

# A diff for each part: two files for every third part; the second hunk deletes as many lines as p_size % 3.
_DIFF = """
concat('diff --git a/src/f', CAST(p_size AS VARCHAR), '.c b/src/f', CAST(p_size AS VARCHAR), '.c', chr(10), '--- a/src/f', CAST(p_size AS VARCHAR), '.c', chr(10), '+++ b/src/f', CAST(p_size AS VARCHAR), '.c', chr(10),
 '@@ -', CAST(p_size + 1 AS VARCHAR), ',3 +', CAST(p_size + 1 AS VARCHAR), ',4 @@ int main(void)', chr(10), ' ', p_type, chr(10), '-', p_name, chr(10), '+', p_brand, chr(10), '+', p_name, '2', chr(10), ' end', chr(10),
 '@@ -', CAST(p_size + 40 AS VARCHAR), ',2 +', CAST(p_size + 41 AS VARCHAR), ',2 @@', chr(10), repeat(concat('-', p_type, chr(10)), p_size % 3), '+tail',
 CASE WHEN p_partkey % 3 = 0 THEN concat(chr(10), 'diff --git a/lib/g.py b/lib/g.py', chr(10), '--- a/lib/g.py', chr(10), '+++ b/lib/g.py', chr(10), '@@ -1,1 +1,2 @@', chr(10), ' def run():', chr(10), '+    pass') ELSE '' END)
"""


def v_diffs(spark, d):
    """A unified diff for each part."""
    return table(spark, d, "part").select("p_partkey", F.expr(_DIFF.replace("VARCHAR", "STRING")).alias("diff"))


@query("SELECT p_partkey, CAST(3 + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS added, CAST(1 + p_size % 3 AS BIGINT) AS deleted, concat(CASE WHEN p_partkey % 3 = 0 THEN 'lib/g.py,' ELSE '' END, 'src/f', CAST(p_size AS VARCHAR), '.c') AS files FROM part")
def diff_counts(spark, d):
    return diffs.diff_counts(diffs.diff_lines(v_diffs(spark, d), "p_partkey", "diff"), "p_partkey").withColumn("files", F.array_join("files", ","))


@query("""
WITH c AS (SELECT p_partkey, concat('src/f', CAST(p_size AS VARCHAR), '.c') AS file, p_size + 1 AS s, p_type, p_name, p_brand, p_size % 3 AS k FROM part)
SELECT p_partkey, file, 'ctx' AS kind, CAST(s AS BIGINT) AS old, CAST(s AS BIGINT) AS new, p_type AS line FROM c
UNION ALL SELECT p_partkey, file, 'del', s + 1, NULL, p_name FROM c
UNION ALL SELECT p_partkey, file, 'add', NULL, s + 1, p_brand FROM c
UNION ALL SELECT p_partkey, file, 'add', NULL, s + 2, concat(p_name, '2') FROM c
UNION ALL SELECT p_partkey, file, 'ctx', s + 2, s + 3, 'end' FROM c
UNION ALL SELECT p_partkey, file, 'del', s + 39 + i, NULL, p_type FROM c, (VALUES (0), (1)) t(i) WHERE i < k
UNION ALL SELECT p_partkey, file, 'add', NULL, s + 40, 'tail' FROM c
UNION ALL SELECT p_partkey, 'lib/g.py', 'ctx', 1, 1, 'def run():' FROM c WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 'lib/g.py', 'add', NULL, 2, '    pass' FROM c WHERE p_partkey % 3 = 0
""")
def diff_parse(spark, d):
    return diffs.diff_lines(v_diffs(spark, d), "p_partkey", "diff").select("p_partkey", "file", "kind", "old", "new", "line")


@query("""
WITH c AS (SELECT p_partkey, p_size + 1 AS s, p_type, p_name FROM part)
SELECT p_partkey, CAST(i AS BIGINT) AS n, CASE WHEN i = s THEN p_type WHEN i = s + 1 THEN p_name WHEN i = s + 2 THEN 'end' ELSE concat('line ', CAST(i AS VARCHAR)) END AS line FROM c, range(1, 70) r(i)
WHERE i < s + 10
""")
def diff_reverse(spark, d):
    """The first hunk of each diff taken back from a file that it made."""
    c = table(spark, d, "part").select("p_partkey", (F.col("p_size") + 1).alias("s"), "p_type", "p_name", "p_brand")
    i, s = F.col("n"), F.col("s")
    after = c.withColumn("n", F.explode(F.sequence(F.lit(1), s + 10))).withColumn("line", F.when(i == s, F.col("p_type")).when(i == s + 1, F.col("p_brand")).when(i == s + 2, F.concat("p_name", F.lit("2"))).when(i == s + 3, F.lit("end")).otherwise(F.concat(F.lit("line "), F.when(i < s, i).otherwise(i - 1).cast("string"))))
    lines = diffs.diff_lines(v_diffs(spark, d), "p_partkey", "diff").where("file LIKE 'src%' AND hunk LIKE '%main%'")
    return diffs.reverse_apply(after.select("p_partkey", F.col("n").cast("long").alias("n"), "line"), lines, ["p_partkey"]).select("p_partkey", F.col("n").cast("long").alias("n"), "line")


@query("""
SELECT p_partkey, concat('src/f', CAST(p_size AS VARCHAR), '.c') AS file, 'main' AS function, 'modified' AS change FROM part
UNION ALL SELECT p_partkey, 'lib/g.py', 'run', 'modified' FROM part WHERE p_partkey % 3 = 0
""")
def changed_functions(spark, d):
    lines = diffs.diff_lines(v_diffs(spark, d), "p_partkey", "diff")
    return diffs.changed_functions(lines, "p_partkey")


_LOG = """
concat('commit ', md5(CAST(p_partkey AS VARCHAR)), chr(10), 'Author: ', p_brand, ' <x@y>', chr(10), 'Date:   2020-01-01', chr(10), chr(10), '    ', p_name, chr(10), '    second line', chr(10), chr(10), 'diff --git a/b', CAST(p_size AS VARCHAR), '.c b/x', chr(10), '+code',
 chr(10), 'commit ', md5(p_name), chr(10), 'Author: Other', chr(10), 'Date:   2021-02-03', chr(10), chr(10), '    only ', p_type)
"""


@query("""
SELECT p_partkey, md5(CAST(p_partkey AS VARCHAR)) AS hash, concat(p_brand, ' <x@y>') AS author, '2020-01-01' AS date, concat(p_name, chr(10), 'second line') AS message, concat('b', CAST(p_size AS VARCHAR), '.c') AS files FROM part
UNION ALL SELECT p_partkey, md5(p_name), 'Other', '2021-02-03', concat('only ', p_type), '' FROM part
""")
def gitlog_sessionize(spark, d):
    logs = table(spark, d, "part").select("p_partkey", F.expr(_LOG.replace("VARCHAR", "STRING")).alias("log"))
    return diffs.git_log(logs, "p_partkey", "log").withColumn("files", F.array_join("files", ","))


_ANSWER = "concat('notes Patch Number: 99', chr(10), 'CVE-', CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ':' END, chr(10), 'Patch Number: ', CAST(o_custkey AS VARCHAR), ' and', chr(10), 'none', chr(10), 'so Patch Number: ', CAST(o_orderkey % 10 AS VARCHAR))"


@query("SELECT o_orderkey, o_custkey AS vote FROM orders UNION ALL SELECT o_orderkey, o_orderkey % 10 FROM orders UNION ALL SELECT o_orderkey, 99 FROM orders WHERE o_orderkey % 5 = 0")
def answer_parse(spark, d):
    """Lines before the header count only where there is no header: the ids of every fifth order do not match it."""
    a = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "CVE-none").otherwise(F.concat(F.lit("CVE-"), F.col("o_orderkey").cast("string"))).alias("cve"), F.expr(_ANSWER.replace("VARCHAR", "STRING")).alias("answer"))
    return parsing.answer_votes(a, ["o_orderkey", "cve"], "cve", "answer").select("o_orderkey", "vote")


@query("SELECT o_orderkey, concat('prod', CAST(o_custkey AS VARCHAR)) AS product, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('1.', CAST(o_custkey % 9 AS VARCHAR)) END AS version FROM orders")
def product_version_parse(spark, d):
    text = F.expr("concat('x\nPRODUCT: prod', CAST(o_custkey AS STRING), '\nVERSION: before ', CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE concat('1.', CAST(o_custkey % 9 AS STRING)) END, '\nVERSION: 9.9')")
    return parsing.product_version(table(spark, d, "orders").withColumn("answer", text), ["o_orderkey"], "answer")


@query("SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events")
def json_unnest(spark, d):
    return parsing.json_pairs(table(spark, d, "events"), "event_id", "props")


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'failed' ELSE 'ok' END AS status FROM events")
def safe_row_pipeline(spark, d):
    """Rows whose properties have been cut off fail without stopping the others."""
    broken = table(spark, d, "events").withColumn("props", F.when(F.col("event_id") % 10 == 0, F.lit('{"cut')).otherwise(F.col("props")))
    return stages.safe_rows(broken, "event_id", "props", stages.parse_json).select("event_id", "status")


_FEED = """concat('{"cve":"CVE-', CAST(p_partkey AS VARCHAR), '","nodes":[{"cpe_match":[', CASE WHEN p_partkey % 2 = 0 THEN concat('{"vulnerable":true,"cpe23Uri":"cpe:2.3:a:', replace(p_brand, '#', ''), ':', replace(p_name, ' ', '_'), ':', CAST(p_size AS VARCHAR), '"}') ELSE '' END, '],"children":[{"cpe_match":[{"vulnerable":true,"cpe23Uri":"cpe:2.3:a:child:', replace(p_type, ' ', '_'), ':', CAST(p_size AS VARCHAR), '"},{"vulnerable":false,"cpe23Uri":"cpe:2.3:a:not:x:1"}]}]}]}')"""


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN replace(p_brand, '#', '') ELSE 'child' END AS vendor, CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '_') ELSE replace(p_type, ' ', '_') END AS product, CAST(p_size AS VARCHAR) AS version FROM part")
def feed_products(spark, d):
    feed = table(spark, d, "part").select("p_partkey", F.expr(_FEED.replace("VARCHAR", "STRING")).alias("feed"))
    return parsing.vulnerable_products(feed, "p_partkey", "feed")


@query("SELECT p_brand, p_size AS version, arg_min(p_name, p_partkey) AS patch FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1, 2")
def first_patch_per_version(spark, d):
    return parsing.first_patches(table(spark, d, "part").withColumn("patch", F.when(F.col("p_partkey") % 3 != 0, F.col("p_name"))), ["p_brand", F.col("p_size").alias("version")], "patch", "p_partkey")


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 4 THEN 4 WHEN o_orderkey % 5 = 3 THEN 3 WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS BIGINT) AS stage FROM orders")
def provenance_stage(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    return parsing.highest_stage(o, "o_orderkey", {4: o.where(k % 5 == 4), 3: o.where(k % 5 == 3), 1: o.where(k % 2 == 0)})


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'finished' ELSE 'error' END AS state, max(event_id) FILTER (event_type = 'purchase') AS last FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1")
def log_state(spark, d):
    lines = table(spark, d, "events").select(F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("] id="), F.col("user_id").cast("string"), F.lit(" "), F.when(F.col("event_type") == "purchase", "finished").when(F.col("event_type") == "error", "error").otherwise("note")).alias("line"))
    return parsing.log_states(lines, "line").select(F.col("id").cast("long").alias("user_id"), "state", F.col("last_finished").alias("last"))


@query()
def logistic_cv_scores(spark, d):
    """Scores of balanced logistic models, each line by one that has not seen its order."""
    from fixmine.operators import models

    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return models.cross_validated(rows, "l_orderkey", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "y").select("l_orderkey", "l_partkey", "l_linenumber", F.round("score", 6).alias("score"))


@query()
def boosted_cv_scores(spark, d):
    """Boosted trees over orders in two folds, 20 rounds instead of the operator's 500."""
    from fixmine.operators import models

    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.dayofyear("o_orderdate").cast("double").alias("day"), F.col("o_custkey").cast("double").alias("who"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return models.cross_validated(rows, "o_orderkey", ["price", "day", "who"], "y", folds=2, kind="boosted", rounds=20).select("o_orderkey", F.round("score", 4).alias("score"))


_FAKE = """concat('diff --git a/x.sql b/x.sql', chr(10), '--- a/x.sql', chr(10), '+++ b/x.sql', chr(10), '@@ -1,3 +1,3 @@', chr(10), ' ', p_name, chr(10), '--- ', p_type, chr(10), '+++ ', p_brand, chr(10), '', chr(10), chr(92), ' No newline at end of file', chr(10),
 '--- a/', repeat('d/', 700), 'y.c', chr(9), '2020', chr(10), '+++ b/', repeat('d/', 700), 'y.c', chr(10), '@@ -5 +5 @@', chr(10), '-', p_size, chr(10), '+@@ -1', chr(10), ' beyond')"""


@query("""
SELECT p_partkey, 'x.sql' AS file, 'ctx' AS kind, CAST(1 AS BIGINT) AS old, CAST(1 AS BIGINT) AS new, p_name AS line FROM part
UNION ALL SELECT p_partkey, 'x.sql', 'del', 2, NULL, '-- ' || p_type FROM part UNION ALL SELECT p_partkey, 'x.sql', 'add', NULL, 2, '++ ' || p_brand FROM part UNION ALL SELECT p_partkey, 'x.sql', 'ctx', 3, 3, '' FROM part
UNION ALL SELECT p_partkey, repeat('d/', 700) || 'y.c', 'del', 5, NULL, CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT p_partkey, repeat('d/', 700) || 'y.c', 'add', NULL, 5, '@@ -1' FROM part
""")
def diff_parse_lookalikes(spark, d):
    """Changed lines that look like headers, an empty line of context, a path of 1403 characters, and lines beyond a hunk."""
    rows = table(spark, d, "part").select("p_partkey", F.expr(_FAKE).alias("diff"))
    return diffs.diff_lines(rows, "p_partkey", "diff").select("p_partkey", "file", "kind", "old", "new", "line")


@query("SELECT doc_id, n_words, 'Text: ' || n_words || ' words in ' || lang AS prompt FROM (SELECT doc_id, lang, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n_words FROM documents)")
def prompt_build(spark, d):
    n = F.size(strings.words(F.col("text"))).cast("long")
    return table(spark, d, "documents").select("doc_id", n.alias("n_words"), strings.prompt("Text: {n} words in {lang}", n=n, lang=F.col("lang")).alias("prompt"))
