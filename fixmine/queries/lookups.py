"""Scores of lists and outputs, version ranges, change features and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixmine.functions import strings
from fixmine.operators import diffs, filters, linkage, metrics, parsing, votes
from fixmine.plans import workflows
from fixmine.queries.base import query, table
from fixmine.queries.records import v_diffs
from fixmine.queries.shaping import spark_sql
from fixmine.sources import files, records
from fixmine.store import scratch
from fixmine.streaming import stages


@query("""
WITH p AS (SELECT l_orderkey AS g, l_suppkey AS i FROM lineitem), t AS (SELECT DISTINCT o_orderkey AS g, o_custkey % 50 + 1 AS i FROM orders WHERE o_orderkey % 3 <> 0), h AS (SELECT g, count(*) FILTER (t.i IS NOT NULL) AS tp, count(*) FILTER (t.i IS NULL) AS fp FROM p LEFT JOIN t USING (g, i) GROUP BY 1),
m AS (SELECT g, count(*) AS fn FROM t WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.g = t.g AND p.i = t.i) GROUP BY 1)
SELECT g, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + coalesce(fn, 0), 0), 0), 6) AS recall FROM h FULL JOIN m USING (g)
""")
def list_scores(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_suppkey").alias("i"))
    t = table(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("g"), (F.col("o_custkey") % 50 + 1).alias("i"))
    return metrics.list_scores(p, t, ["g"], "i").select("g", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("SELECT i // 50 AS block, CAST(sum(CASE WHEN v < 50 THEN 1 ELSE 0 END) + 1 AS BIGINT) AS rank FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, value AS v FROM events) GROUP BY 1")
def ranks_from_losses(spark, d):
    from fixmine.operators.ranking import numbered

    e = numbered(table(spark, d, "events").select("event_id", (F.col("value") < 50).alias("lost")), ["event_id"], "i")
    return metrics.ranks_from_losses(e, "i", "lost", 50)


@query("SELECT lang, count(*) AS n, round(avg(CASE WHEN p = quality THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM (SELECT lang, quality, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN n_chars > 500 THEN 1 ELSE 0 END AS p FROM documents JOIN labels USING (doc_id)) GROUP BY 1")
def label_accuracy(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("p", F.when(F.col("doc_id") % 5 != 0, (F.col("n_chars") > 500).cast("long")))
    return metrics.label_accuracy(rows, "p", "quality", ["lang"]).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT p_partkey, round((CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END + 1) / 4, 6) AS accuracy FROM part")
def token_accuracy(spark, d):
    s = F.col("p_size")
    p = F.array(F.when(s % 2 == 0, 1).otherwise(9), F.when(s % 3 == 0, 2).otherwise(9), F.lit(3))
    return table(spark, d, "part").select("p_partkey", F.round(metrics.token_accuracy(p, F.array(*map(F.lit, (1, 2, 3, 4)))), 6).alias("accuracy"))


_SCORED = "SELECT l_orderkey AS id, l_discount + l_tax * {w} AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM {t}"
_KS = (1, 2, 5)


def _curve(w: str) -> str:
    ranked = f"SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS r FROM ({_SCORED.format(w=w, t='lineitem')})"
    return " UNION ALL ".join(f"SELECT 's{w}' AS system, CAST({k} AS BIGINT) AS k, round(avg(tp / {k}), 6) AS precision, round(avg(CASE WHEN p > 0 THEN tp / p ELSE 0 END), 6) AS recall FROM (SELECT id, sum(label) AS p, sum(CASE WHEN r <= {k} THEN label ELSE 0 END) AS tp FROM ({ranked}) GROUP BY 1)" for k in _KS)


@query(" UNION ALL ".join(_curve(w) for w in ("0", "3")))
def evaluated_outputs(spark, d):
    """Two systems' outputs as files, evaluated together and written as tables."""
    folder = scratch(spark, "outputs")
    for w in ("0", "3"):
        rows = spark.sql(_SCORED.replace("{w}", w), t=table(spark, d, "lineitem"))
        # Spark names the files itself, so each is renamed; the parts of one output have its name in folders of their own
        rows.write.option("header", True).csv(f"{folder}-{w}")
        _rename(spark, f"{folder}-{w}", folder, f"s{w}_output.csv")
    precision, _ = workflows.evaluate_outputs(spark, folder, scratch(spark, "results"), _KS)
    return precision.select("system", "k", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def _rename(spark, folder: str, to: str, name: str) -> None:
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = fs.Path(folder)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = [x.getPath() for x in system.listStatus(at) if x.getPath().getName().startswith("part-")]
    for k, part in enumerate(parts):
        system.mkdirs(fs.Path(f"{to}/{k}"))
        system.rename(part, fs.Path(f"{to}/{k}/{name}"))


@query("SELECT 'CVE-' || p_size AS entity, array_to_string(list_sort(list(DISTINCT v)), ' ') AS values FROM (SELECT p_size, p_brand AS v FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT p_size, p_name FROM part WHERE p_partkey % 5 <> 0) GROUP BY 1")
def multi_map(spark, d):
    part = table(spark, d, "part")
    name = F.concat(F.lit("CVE-"), F.col("p_size").cast("string")).alias("entity")
    one = part.select(F.when(F.col("p_partkey") % 4 == 0, F.lit("other")).otherwise(name).alias("entity"), F.col("p_brand").alias("v"))
    two = part.select(name, F.when(F.col("p_partkey") % 5 == 0, F.lit("")).otherwise(F.col("p_name")).alias("v"))
    return votes.multi_map([one, two], "entity", "v").withColumn("values", F.array_join("values", " "))


@query("SELECT p_brand, CAST(sum(p_size + 2 * p_partkey) AS BIGINT) AS total FROM part GROUP BY 1")
def nested_sum(spark, d):
    item = lambda n: F.struct(F.lit("r").alias("name"), n.alias("n"))
    rows = table(spark, d, "part").select("p_brand", F.array(item(F.col("p_size").cast("long")), item(F.lit(None).cast("long")), item((2 * F.col("p_partkey")).cast("long"))).alias("items"))
    return votes.nested_sum(rows, "p_brand", "items", "n")


@query("""
WITH a AS (SELECT DISTINCT p_brand, p_size FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT DISTINCT p_brand, p_size FROM part WHERE p_partkey % 4 <> 0)
SELECT *, 'b' AS missing FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'a' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
""")
def differences(spark, d):
    part = table(spark, d, "part")
    return filters.differences(part.where("p_partkey % 3 <> 0"), part.where("p_partkey % 4 <> 0"), ["p_brand", "p_size"])


@query("SELECT p_partkey, p_size % 3 = 0 OR p_size % 4 = 0 AS kept, array_to_string(list_sort(list_distinct([p_brand, p_name, 'z', 'z'])), '|') AS \"all\", CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS common, round(1 / 3, 6) AS smoothed FROM part")
def sets_of_tokens(spark, d):
    s = F.col("p_size")
    tags = F.array(F.when(s % 3 == 0, "see attachment 5").otherwise("x"), F.when(s % 4 == 0, "from html content").otherwise("y"))
    one, two, three = F.array("p_brand", F.lit("z")), F.array("p_name", F.lit("z"), "p_brand"), F.array(F.when(s % 2 == 0, F.col("p_brand")).otherwise("q"))
    return table(spark, d, "part").select(
        "p_partkey", filters.kept_references(tags).alias("kept"), F.array_join(strings.union_of(F.array("p_brand", F.lit("z")), F.array("p_name", F.lit("z"))), "|").alias("all"),
        F.array_join(strings.intersection_of(one, two, three), "|").alias("common"), F.round(strings.smoothed_overlap(F.array(F.lit("z")), F.array("p_name", F.lit("z"))), 6).alias("smoothed"),
    )


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'KEY-' || p_size END AS key, CASE WHEN p_size >= 10 THEN p_size || ',' ELSE '' END || '100' AS numbers FROM part")
def ids_in_text(spark, d):
    text = spark_sql("concat('see ', CASE WHEN p_size % 2 = 0 THEN 'KEY-' ELSE 'no' END, CAST(p_size AS VARCHAR), ' and 100, x7')")
    return table(spark, d, "part").select("p_partkey", strings.issue_key(text).alias("key"), F.array_join(strings.numeric_ids(text), ",").alias("numbers"))


@query("SELECT p_partkey, 'f' || p_size || '.c main.py' AS files, 'free_it,run' AS functions FROM part")
def code_mentions(spark, d):
    text = spark_sql("concat('In src/f', CAST(p_size AS VARCHAR), '.c and main.py the call free_it() or run() fails, x.unknown')")
    return table(spark, d, "part").select("p_partkey", F.array_join(strings.mentions(text, strings.FILE_NAME), " ").alias("files"), F.array_join(strings.mentions(text, strings.FUNCTION, 1), ",").alias("functions"))


_RANGES = """concat('{"nodes":[{"operator":"OR","cpe_match":[{"vulnerable":true,"cpe23Uri":"cpe:2.3:a:own:', p_brand, ':', CASE WHEN p_size % 2 = 0 THEN '*' ELSE CAST(p_size AS VARCHAR) END, '"', CASE WHEN p_size % 4 = 0 THEN ',"versionEndExcluding":"9"' ELSE '' END, '}]', CASE WHEN p_size % 3 = 0 THEN concat(',"children":[{"cpe_match":[{"vulnerable":true,"cpe23Uri":"cpe:2.3:a:child', CHR(92), CHR(92), ':', p_brand, ':7"}]}]') ELSE '' END, '}]}')"""


@query("SELECT p_partkey, 'OR' AS operator, CASE WHEN p_size % 3 = 0 THEN 'child' || chr(92) ELSE 'own' END AS vendor, p_brand AS product, CASE WHEN p_size % 3 = 0 THEN '7' WHEN p_size % 2 = 1 THEN CAST(p_size AS VARCHAR) ELSE '9' END AS version FROM part WHERE p_size % 3 = 0 OR p_size % 2 = 1 OR p_size % 4 = 0")
def version_triples(spark, d):
    return parsing.version_triples(table(spark, d, "part").select("p_partkey", spark_sql(_RANGES).alias("feed")), "p_partkey", "feed")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'child' ELSE 'own' END AS vendor, p_brand AS product FROM part")
def product_set(spark, d):
    feed = spark_sql(_RANGES)
    return parsing.product_set(table(spark, d, "part").select("p_partkey", feed.alias("feed")), "p_partkey", "feed")


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'page' WHEN 1 THEN 'other' END AS chosen FROM part")
def readable_diffs(spark, d):
    diff, no = "concat('--- a', CHR(10), '+++ b', CHR(10), '@@ -1 +1 @@ {}')", F.lit("<html>")
    page, other = F.when(F.col("p_size") % 3 == 0, F.expr(diff.format("page"))).otherwise(no), F.when(F.col("p_size") % 3 < 2, F.expr(diff.format("other"))).otherwise(no)
    return table(spark, d, "part").select("p_partkey", F.regexp_extract(diffs.readable_diff(page, other), "@@ ([a-z]+)$", 1).alias("chosen")).withColumn("chosen", F.nullif("chosen", F.lit("")))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'f' || p_size || '.c g.py' ELSE 'f' || p_size || '.c' END AS files, CASE WHEN p_partkey % 3 = 0 THEN 'lib/g.py src/f' || p_size || '.c' ELSE 'src/f' || p_size || '.c' END AS paths, 'main' AS functions,
 CAST(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS passes, CAST(1 AS BIGINT) AS tails FROM part
""")
def commit_features(spark, d):
    lines = diffs.diff_lines(v_diffs(spark, d), "p_partkey", "diff")
    f = diffs.commit_features(lines, "p_partkey")
    n = lambda t: F.coalesce(F.element_at("tokens", F.lit(t)), F.lit(0)).cast("long")
    return f.select("p_partkey", F.array_join("files", " ").alias("files"), F.array_join("paths", " ").alias("paths"), F.array_join("functions", " ").alias("functions"), n("pass").alias("passes"), n("tail").alias("tails"))


@query("SELECT p_partkey, 'fix|the|' || lower(replace(p_name, ' ', '|')) || '|src|foo|bar|c|do|it|x|1' AS tokens FROM part")
def token_streams(spark, d):
    t = diffs.token_stream(F.concat(F.lit("Fix the "), "p_name"), F.array(F.lit("src/fooBar.c")), F.array(F.lit("doIt")), F.lit("x1"))
    return table(spark, d, "part").select("p_partkey", F.array_join(t, "|").alias("tokens"))


@query("SELECT p_partkey, n, CASE WHEN n < 2 THEN NULL WHEN n < 2 + p_size THEN 'first' ELSE 'f' || p_size END AS function FROM part, (SELECT unnest([1, 2, 5, 40, 60]) AS n) WHERE n <= p_size + 4")
def enclosing_functions(spark, d):
    """The function that a line lies in: two functions, the second of which begins at line p_size + 2."""
    n, s = F.col("n"), F.col("p_size")
    lines = table(spark, d, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(1), s + 4)).alias("n"))
    lines = lines.withColumn("line", F.when(n == 1, "#include <x>").when(n == s + 2, F.concat(F.lit("static int f"), s.cast("string"), F.lit("(void)"))).when(n == 2, "int first(int a)").otherwise("    if (a) { call(a); }"))
    wanted = lines.where(n.isin(1, 2, 5, 40, 60)).select("p_partkey", "n")
    return diffs.enclosing_function(lines.select("p_partkey", "n", "line"), ["p_partkey"], wanted)


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 8 END AS first, CASE WHEN p_size % 2 = 0 THEN 12 + length(p_name) END AS last FROM part")
def enclosing_braces(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("} int f"), F.when(F.col("p_size") % 2 == 0, " {").otherwise("  "), "p_name", F.lit("{{}}"[0:0]), F.lit("{}"), F.lit(" }")).alias("code"), F.lit(9).alias("at"))
    return diffs.enclosing_braces(rows, "code", "at").select("p_partkey", F.col("span.begin").alias("first"), F.col("span.end").alias("last"))


@query("""
WITH p AS (SELECT DISTINCT p_size AS e, p_name AS product FROM part WHERE p_partkey % 2 = 0), r AS (SELECT DISTINCT p_size AS e, p_name || '-' || lower(p_type) AS repo FROM part), w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(product), '[^a-z0-9]+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(repo), '[^a-z0-9]+'), lambda x: x <> '')) AS b FROM p JOIN r USING (e))
SELECT e, product, repo, round(len(list_intersect(a, b)) / greatest(len(a), len(b)), 6) AS score FROM w WHERE len(list_intersect(a, b)) / greatest(len(a), len(b)) >= 0.4
""")
def name_matches(spark, d):
    part = table(spark, d, "part")
    p, r = part.where("p_partkey % 2 = 0").select(F.col("p_size").alias("e"), F.col("p_name").alias("product")), part.select(F.col("p_size").alias("e"), F.concat("p_name", F.lit("-"), F.lower("p_type")).alias("repo"))
    return linkage.name_matches(p, r, "e", "product", "repo", 0.4).withColumn("score", F.round("score", 6))


@query("SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def commits_of_repos(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return linkage.commits_of_repos(table(spark, d, "lineitem").select("l_suppkey", "l_partkey"), s, "l_suppkey")


@query("SELECT c_custkey, v AS ours, w AS theirs, coalesce(v = w, false) AS agree FROM (SELECT c_custkey, c_nationkey AS v FROM customer WHERE c_custkey % 4 <> 0) FULL JOIN (SELECT c_custkey, c_custkey % 25 AS w FROM customer WHERE c_custkey % 3 <> 0) USING (c_custkey)")
def compared_versions(spark, d):
    c = table(spark, d, "customer")
    return linkage.compared_versions(c.where("c_custkey % 4 <> 0").select("c_custkey", F.col("c_nationkey").alias("v")), c.where("c_custkey % 3 <> 0").select("c_custkey", (F.col("c_custkey") % 25).alias("v")), ["c_custkey"], "v")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 10 <> 9 THEN 'b' || c_nationkey END AS before, CASE WHEN c_custkey % 10 <> 8 THEN CASE WHEN c_custkey % 5 = 0 THEN 'b' ELSE 'a' END || c_nationkey END AS after,
 CASE WHEN c_custkey % 10 = 9 THEN 'added' WHEN c_custkey % 10 = 8 THEN 'deleted' WHEN c_custkey % 5 = 0 THEN 'same' ELSE 'modified' END AS status FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0
""")
def aligned_with_lookup(spark, d):
    """Functions changed on either side, the other side taken from the whole version where it is missing."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    old = c.where(k % 10 != 9).select("c_custkey", F.concat(F.lit("b"), F.col("c_nationkey").cast("string")).alias("v"))
    new = c.where(k % 10 != 8).select("c_custkey", F.concat(F.when(k % 5 == 0, "b").otherwise("a"), F.col("c_nationkey").cast("string")).alias("v"))
    changed = lambda df: df.where((k % 2 == 0) | (k % 3 == 0))
    return linkage.aligned_with_lookup(changed(old).where((k % 7 != 0) | (k % 10 == 8)), changed(new).where((k % 7 == 0) | (k % 3 == 0) | (k % 10 == 9)), old, new, ["c_custkey"], "v")


@query("SELECT 'CVE-' || (1990 + p_size % 30) || '-' || p_partkey AS id, p_name FROM part WHERE p_partkey % 9 = 0")
def feed_lookup(spark, d):
    path = scratch(spark, "years")
    rows = table(spark, d, "part").select(F.concat(F.lit("CVE-"), (F.col("p_size") % 30 + 1990).cast("string"), F.lit("-"), F.col("p_partkey").cast("string")).alias("id"), "p_name", "p_partkey")
    files.split_by_year(rows.drop("p_partkey"), "id", path)
    return files.lookup(spark, path, rows.where("p_partkey % 9 = 0"), "id").select("id", "p_name")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation")
def frame_or_default(spark, d):
    r, n = table(spark, d, "region").select("r_regionkey", "r_name"), table(spark, d, "nation").select((F.col("n_nationkey") + 100).alias("r_regionkey"), F.col("n_name").alias("r_name"))
    path = f"{scratch(spark, 'there')}.parquet"
    r.write.parquet(path)
    return files.frame_or(spark, path, n).union(files.frame_or(spark, f"{path}-none.parquet", n))


@query("SELECT 'n=' || n_regionkey AS folder, CAST(sum(length(n_name) + 1) AS BIGINT) AS length FROM nation GROUP BY 1")
def file_sizes(spark, d):
    path = scratch(spark, "sizes")
    table(spark, d, "nation").select("n_name", F.col("n_regionkey").alias("n")).write.partitionBy("n").text(path)
    return files.file_info(spark, path).groupBy("folder").agg(F.sum("length").alias("length"))


@query("""
WITH RECURSIVE r AS (SELECT c_custkey AS s, CASE WHEN c_custkey % 50 = 7 THEN c_custkey ELSE c_custkey // 2 END AS t FROM customer WHERE c_custkey % 3 <> 0), w AS (SELECT c_custkey AS u, c_custkey AS place, 0 AS n FROM customer UNION ALL SELECT u, t, n + 1 FROM w JOIN r ON s = place WHERE n < 30)
SELECT u AS url, CASE WHEN max(n) < 30 THEN arg_max(place, n) END AS final FROM w GROUP BY 1
""")
def final_urls(spark, d):
    """Chains of redirects from each number to its half, some of which lead to themselves."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    r = c.where(k % 3 != 0).select(k.alias("source"), F.when(k % 50 == 7, k).otherwise(F.floor(k / 2)).cast("long").alias("target"))
    return files.final_urls(c.select(k.alias("url")), r, "url").select("url", "final")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'detail' ELSE p_brand END AS component, '<' || p_size AS range, p_name AS patch FROM part")
def vendor_details(spark, d):
    """Records without components take those of their detail page."""
    parts = lambda name: F.array(F.struct(name.alias("component_name"), F.array(F.struct(F.concat(F.lit("<"), F.col("p_size").cast("string")).alias("version_range"), F.col("p_name").alias("patch"))).alias("versions")))
    part = table(spark, d, "part")
    own = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 != 0, parts(F.col("p_brand"))).alias("components"))
    return records.with_detail(own, "id", "components", part.select(F.col("p_partkey").alias("id"), parts(F.lit("detail")).alias("components")))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 12 = 0 THEN 'failed' ELSE 'ok' END AS status, n_nationkey % 12 = 0 AS slow FROM nation")
def timed_rows(spark, d):
    """Rows that take longer than a tenth of a second fail, and the time of each is taken."""
    import time

    def work(x):
        time.sleep(2 if int(x) % 12 == 0 else 0)
        return x

    rows = table(spark, d, "nation").select("n_nationkey", F.col("n_nationkey").cast("string").alias("x"))
    out = stages.safe_rows(rows, "n_nationkey", "x", work, timeout=0.3, elapsed=True)
    return out.select("n_nationkey", "status", (F.col("elapsed") > 0.25).alias("slow"))
