"""Readers, sinks and shaping of nested records, over files written from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixmine.operators import parsing
from fixmine.queries.base import query, table
from fixmine.queries.shaping import spark_sql
from fixmine.sources import files, records
from fixmine.store import scratch


@query("SELECT p_partkey AS id, p_name AS name, p_size AS size, kind FROM part, (SELECT unnest(['parquet', 'json', 'csv', 'orc']) AS kind)")
def frames_by_ending(spark, d):
    """One table written in four formats and read by the ending of its path, with columns renamed."""
    rows, out = table(spark, d, "part").select("p_partkey", "p_name", "p_size"), None
    for kind, ending in (("parquet", "parquet"), ("json", "jsonl"), ("csv", "csv"), ("orc", "orc")):
        path = f"{scratch(spark, 'frame')}.{ending}"
        rows.write.option("header", True).format(kind).save(path)
        one = files.frame(spark, path, {"p_partkey": "id", "p_name": "name", "p_size": "size"})
        one = one.select(F.col("id").cast("long").alias("id"), "name", F.col("size").cast("long").alias("size"), F.lit(kind).alias("kind"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT concat('size=', p_size) AS entity, count(*) AS n, count(*) FILTER (p_partkey % 9 = 0) AS guarded FROM part GROUP BY 1")
def entity_files(spark, d):
    """Records in a folder for each entity; every ninth has too long a subject."""
    path = scratch(spark, "entities")
    subject = F.when(F.col("p_partkey") % 9 == 0, F.repeat(F.lit("x"), 1200)).otherwise(F.col("p_name"))
    rows = table(spark, d, "part").select(F.md5("p_name").alias("hash"), F.lit("short").alias("short"), subject.alias("subject"), F.lit("the body, with a comma").alias("body"), F.lit("e").alias("extra"), F.col("p_size").alias("size"))
    rows.write.partitionBy("size").csv(path)
    read = files.entity_csv(spark, path)
    good = files.guarded(read, ["subject", "body"], ["hash", "subject"]).groupBy("entity").agg(F.count("*").alias("good"))
    return read.groupBy("entity").agg(F.count("*").alias("n")).join(good, "entity", "left").select("entity", "n", (F.col("n") - F.coalesce("good", F.lit(0))).alias("guarded"))


@query("SELECT p_brand || ' ' || p_name AS line, count(*) AS n FROM part GROUP BY 1")
def text_lines(spark, d):
    path = scratch(spark, "lines")
    table(spark, d, "part").select(F.concat_ws(" ", "p_brand", "p_name")).write.text(path)
    return files.lines(spark, path).groupBy("line").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name FROM nation")
def documents_per_entity(spark, d):
    """One document over several lines in each file."""
    path = scratch(spark, "documents")
    text = F.concat(F.lit('{\n "n_nationkey": '), F.col("n_nationkey").cast("string"), F.lit(',\n "n_name": "'), "n_name", F.lit('"\n}'))
    table(spark, d, "nation").select(text, F.col("n_nationkey").alias("k")).repartition("k").write.partitionBy("k").text(path)
    for folder in [r[0] for r in spark.read.text(path).select("k").distinct().collect()]:
        spark.read.text(f"{path}/k={folder}", wholetext=True).write.text(f"{path}-json/{folder}", lineSep="\n")
    return files.documents(spark, f"{path}-json", "n_nationkey long, n_name string", ending="txt").select("n_nationkey", "n_name")


@query("SELECT CAST(1990 + p_size % 30 AS VARCHAR) AS year, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1")
def feed_by_year(spark, d):
    path = scratch(spark, "years")
    rows = table(spark, d, "part").select(F.concat(F.lit("CVE-"), (F.col("p_size") % 30 + 1990).cast("string"), F.lit("-"), F.col("p_partkey").cast("string")).alias("id"), "p_partkey")
    files.split_by_year(rows, "id", path)
    return spark.read.json(path).groupBy(F.col("year").cast("string").alias("year")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


_ITEM = """concat('{"cve":{"id":"CVE-', CAST(p_partkey AS VARCHAR), '","descriptions":[{"lang":"en","value":"', p_name, '"},{"lang":"es","value":"no"}]}}')"""


@query("SELECT concat('CVE-', p_partkey) AS id, p_name AS description FROM part")
def paged_feed(spark, d):
    """Pages of a feed, of which the English descriptions are taken."""
    path = scratch(spark, "feed")
    items = table(spark, d, "part").select(F.col("p_size").alias("page"), spark_sql(_ITEM).alias("item")).groupBy("page").agg(F.concat(F.lit('{"vulnerabilities":['), F.array_join(F.collect_list("item"), ","), F.lit("]}")).alias("value"))
    items.select("value").repartition(50).write.text(path)
    single = spark.read.text(path)
    out = scratch(spark, "pages")
    single.write.text(out)
    return files.feed(spark, out, lines=True).where("language = 'en'").select("id", "description")


@query("SELECT p_brand AS language, 'own' || p_size AS owner, 'rep' AS repo, p_partkey AS entity FROM part")
def nested_lists(spark, d):
    rows = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.collect_list("p_partkey").alias("ids"))
    repos = rows.groupBy("p_brand").agg(F.collect_list(F.struct(F.concat(F.lit("own"), F.col("p_size").cast("string"), F.lit("##rep")).alias("name"), "ids")).alias("repos"))
    nested = repos.select(F.array(F.struct(F.col("p_brand").alias("language"), "repos")).alias("lists"))
    return records.nested_lists(nested, "lists")


@query("SELECT p_brand AS component, '<' || p_size AS range, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS instance, concat('h', p_partkey) AS patch FROM part")
def vendor_versions(spark, d):
    instances = F.when(F.col("p_partkey") % 5 != 0, F.array("p_name"))
    v = F.struct(F.concat(F.lit("<"), F.col("p_size").cast("string")).alias("version_range"), F.lit("1").alias("fix_version"), F.lit("d").alias("fix_date"), F.concat(F.lit("h"), F.col("p_partkey").cast("string")).alias("patch"), instances.alias("instances"))
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.collect_list(v).alias("versions")).select(F.array(F.struct(F.col("p_brand").alias("component_name"), "versions")).alias("components"))
    return records.vendor_versions(rows, "components").select("component", "range", "instance", "patch")


@query("SELECT p_name, p_size, arg_max(p_brand, p_partkey) AS p_brand, max(p_partkey) AS p_partkey FROM part WHERE p_brand <> 'n/a' GROUP BY 1, 2")
def last_written(spark, d):
    return records.last_written(table(spark, d, "part").where("p_brand <> 'n/a'"), ["p_name", "p_size"], ["p_brand", "p_partkey"], "p_partkey")


@query("SELECT n_nationkey, sha256(n_name) AS sha256, n_nationkey % 3 <> 0 AS ok FROM nation")
def verified_files(spark, d):
    """Files against digests, every third of which is wrong."""
    path = scratch(spark, "files")
    n = table(spark, d, "nation")
    for k in range(n.count()):  # a file each, of a name of its own
        n.where(F.col("n_nationkey") == k).select("n_name").coalesce(1).write.option("lineSep", " ").text(f"{path}/k={k}")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.regexp_extract("path", "k=([0-9]+)", 1).cast("long").alias("k"))
    wanted = found.join(n, found["k"] == n["n_nationkey"]).select("name", F.when(F.col("k") % 3 == 0, "00").otherwise(F.sha2(F.concat("n_name", F.lit(" ")), 256)).alias("sha256"))
    out = files.verified(spark, path, wanted).select(F.regexp_extract("path", "k=([0-9]+)", 1).cast("long").alias("n_nationkey"), "ok")
    return out.join(n, "n_nationkey").select("n_nationkey", F.sha2("n_name", 256).alias("sha256"), "ok")


@query("SELECT p_partkey, concat('2020-', p_size) AS modified, CAST(p_partkey AS VARCHAR) AS size FROM part")
def feed_meta(spark, d):
    text = F.concat(F.lit("lastModifiedDate:2020-"), F.col("p_size").cast("string"), F.lit("\r\nsize:"), F.col("p_partkey").cast("string"), F.lit("\r\nsha256:AB"))
    m = files.meta(text)
    return table(spark, d, "part").select("p_partkey", m["lastModifiedDate"].alias("modified"), m["size"].alias("size"))


@query("SELECT 2000 + p_size AS year, p_partkey % 5 <> 0 AS changed FROM (SELECT p_size, min(p_partkey) AS p_partkey FROM part GROUP BY 1) ")
def changed_feeds(spark, d):
    """Feeds whose META differs from the one stored, or is not stored."""
    rows = table(spark, d, "part").groupBy("p_size").agg(F.min("p_partkey").alias("k")).select((F.col("p_size") + 2000).cast("long").alias("year"), "k")
    now = rows.select("year", F.concat(F.lit("sha256:"), F.col("k").cast("string")).alias("meta"), "k")
    stored = now.where("k % 5 = 0 OR k % 5 = 1").select("year", F.when(F.col("k") % 5 == 0, F.col("meta")).otherwise("sha256:old").alias("meta"))
    changed = files.changed(now, stored, "year", "meta")
    return now.select("year").join(changed.select("year", F.lit(True).alias("changed")), "year", "left").na.fill(False, ["changed"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def appended(spark, d):
    """Four deliveries of orders with several lines each, one of them twice and each overlapping those before; at last all are there once."""
    path, lines = scratch(spark, "sink"), table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    for rule in ("l_orderkey % 2 = 0", "l_orderkey % 3 = 0", "l_orderkey % 3 = 0", "true"):
        out = files.append(lines.where(rule), path, "l_orderkey")
    return out


@query("SELECT n, entity, branch, url FROM (SELECT p_partkey AS n, 'CVE-' || p_size AS entity, regexp_extract(p_type, '^([^( ]*)', 1) AS branch, unnest(['http://s/' || p_partkey, 'http://g/' || p_name[1:1], 'http://h/1']) AS url FROM part WHERE p_size % 4 <> 0)")
def truth_links(spark, d):
    k = F.col("p_partkey").cast("string")
    rows = table(spark, d, "part").select(
        k.alias("a"), F.concat(F.lit("CVE-"), F.col("p_size").cast("string")).alias("b"), F.concat(F.lit("http://s/"), k).alias("c"), F.lit("").alias("e"),
        F.concat(F.lit("http://g/"), F.substring("p_name", 1, 1), F.lit(", http://h/1")).alias("f"), F.lit("x").alias("g"), F.concat("p_type", F.lit("(old)")).alias("h"),
    )
    uncertain = table(spark, d, "part").where("p_size % 4 = 0").select(F.concat(F.lit("CVE-"), F.col("p_size").cast("string")).alias("entity")).distinct()
    return records.truth_links(rows, uncertain, keep=["n"]).select(F.col("n").cast("long").alias("n"), "entity", "branch", "url")


@query("SELECT n_nationkey % 2 = 0 AS filled, count(*) AS n FROM nation WHERE n_nationkey % 2 = 0 GROUP BY 1")
def non_empty_files(spark, d):
    path = scratch(spark, "maybe")
    table(spark, d, "nation").where("n_nationkey % 2 = 0").select("n_name", F.col("n_nationkey").alias("k")).repartition(25, "k").write.partitionBy("k").text(path)
    return files.non_empty(spark, path).groupBy((F.col("length") > 0).alias("filled")).agg(F.count("*").alias("n"))


@query("SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title FROM pages")
def page_titles(spark, d):
    return table(spark, d, "pages").select("page_id", records.page_title(F.col("html")).alias("title"))


_RECORD = """concat('{"cve":{"CVE_data_meta":{"ID":"CVE-', CAST(p_partkey AS VARCHAR), '"},"problemtype":{"problemtype_data":[{"description":[{"lang":"en","value":"CWE-', CAST(p_size AS VARCHAR), '"}', CASE WHEN p_size % 2 = 0 THEN ',{"lang":"en","value":"NVD-CWE-Other"}' ELSE '' END, ']}]},"references":{"x":"CWE-9999"}},"configurations":{"nodes":[{"cpe_match":[{"cpe23Uri": "cpe:2.3:a:', p_brand, '"}]}]},"impact":{"baseMetricV2":{"cvssV2":{"baseScore":', CAST(p_size % 10 AS VARCHAR), '.5,"vectorString":"AV:N"}}', CASE WHEN p_size % 3 = 0 THEN concat(',"baseMetricV3":{"cvssV3":{"baseScore":', CAST(p_size % 9 AS VARCHAR), '.1,"vectorString":"CVSS:3"}}') ELSE '' END, '}}')"""


@query("SELECT p_partkey, 'CVE-' || p_partkey AS id, 'CWE-' || p_size || CASE WHEN p_size % 2 = 0 THEN ' NVD-CWE-Other' ELSE '' END AS cwes, 'cpe:2.3:a:' || p_brand AS cpes, p_size % 10 + 0.5 AS score2, CASE WHEN p_size % 3 = 0 THEN p_size % 9 + 0.1 END AS score3, CASE WHEN p_size % 3 = 0 THEN 'CVSS:3' END AS vector3 FROM part")
def vulnerability_records(spark, d):
    r = table(spark, d, "part").select("p_partkey", records.vulnerability_record(spark_sql(_RECORD)).alias("r"))
    return r.select("p_partkey", "r.id", F.array_join("r.cwes", " ").alias("cwes"), F.array_join("r.cpes", " ").alias("cpes"), "r.score2", "r.score3", "r.vector3")


@query("SELECT p_partkey, unnest(['a.c', 'b' || p_size || '.py']) AS filename, unnest([p_size, 0]) AS additions, unnest(['@@ -1 +1 @@', NULL]) AS patch FROM part")
def commit_files(spark, d):
    json = spark_sql("""concat('{"sha":"x","files":[{"filename":"a.c","status":"modified","additions":', CAST(p_size AS VARCHAR), ',"deletions":1,"patch":"@@ -1 +1 @@"},{"filename":"b', CAST(p_size AS VARCHAR), '.py","status":"added","additions":0,"deletions":0}]}')""")
    return table(spark, d, "part").select("p_partkey", F.explode(records.commit_files(json)).alias("f")).select("p_partkey", "f.filename", F.col("f.additions").cast("int").alias("additions"), "f.patch")


@query("SELECT p_partkey, concat('{\"name\": \"', p_name, '\", \"tags\": [\"', p_brand, '\", null, ', p_size, ']}') AS value FROM part")
def expanded_pointers(spark, d):
    """Objects and lists that hold places in an array; a place of its own container is null."""
    pool = F.concat(F.lit('[{"name":1,"tags":2},"'), "p_name", F.lit('",[3,2,4],"'), "p_brand", F.lit('",'), F.col("p_size").cast("string"), F.lit("]"))
    return files.expand_pointers(table(spark, d, "part").select("p_partkey", pool.alias("json")), "json").select("p_partkey", "value")


@query("SELECT 'u' || o_custkey AS url, max(o_custkey % 3 = 0) AS hit FROM orders GROUP BY 1")
def cache_lookup(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("url"), "o_custkey")
    stored = o.where("o_custkey % 3 = 0").select("url").distinct().withColumn("url_hash", F.unhex(F.md5(F.col("url").cast("binary")))).withColumn("body", F.lit("text"))
    hit, missing = files.cached(o, stored, "url")
    return hit.select("url", F.lit(True).alias("hit")).union(missing.select("url", F.lit(False)))


@query("SELECT 'u' || o_custkey AS url, CASE WHEN o_custkey % 3 = 0 THEN 'kept' WHEN o_custkey % 3 = 1 THEN 'new' END AS body FROM orders GROUP BY 1, 2")
def fetched_texts(spark, d):
    """Stored texts first, then those fetched now; the cache has both afterwards."""
    o = table(spark, d, "orders").select(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("url"), "o_custkey").distinct()
    hashed = lambda df, text: df.select("url", F.unhex(F.md5(F.col("url").cast("binary"))).alias("url_hash"), F.lit(text).alias("body"))
    stored, fetched = hashed(o.where("o_custkey % 3 = 0"), "kept"), hashed(o.where("o_custkey % 3 < 2"), "new")
    return files.coalesced(o.select("url"), files.upserted(stored, fetched.join(stored.select("url"), "url", "left_anti").select("url", "url_hash", "body"), "url"), "url", "body")


@query("SELECT conv_id, turn, regexp_extract(text, '[a-z]+', 0) AS first FROM conversations WHERE conv_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def collected_rows(spark, d):
    """Rows of chosen ids, written and read again."""
    path = scratch(spark, "collected")
    ids = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("conv_id"))
    files.collect_into(table(spark, d, "conversations"), ids, "conv_id", path)
    return spark.read.parquet(path).select("conv_id", "turn", F.regexp_extract("text", "[a-z]+", 0).alias("first"))


_COMMITS = "SELECT md5(CAST(l_orderkey * 10 + l_linenumber AS VARCHAR(20))) AS hash, l_orderkey AS pull, l_shipdate AS date, concat('title ', CAST(l_linenumber AS VARCHAR(9))) AS title FROM {lineitem}"


@query(f"WITH c AS ({_COMMITS.format(lineitem='lineitem')}) SELECT o_orderkey AS pull, count(hash) AS commits, min(title) AS first FROM orders LEFT JOIN c ON pull = o_orderkey GROUP BY 1")
def pull_commits(spark, d):
    """Changes of each pull request; one without keeps a row."""
    c = spark.sql(_COMMITS, lineitem=table(spark, d, "lineitem"))
    lists = c.groupBy("pull").agg(F.collect_list(F.struct("hash", "title")).alias("commits"))
    pulls = table(spark, d, "orders").select(F.col("o_orderkey").alias("pull")).join(lists, "pull", "left")
    return records.commits_of(pulls, "pull", "commits").groupBy("pull").agg(F.count("hash").alias("commits"), F.min("title").alias("first"))


@query(f"WITH c AS ({_COMMITS.format(lineitem='lineitem')}) SELECT w.hash, title, strftime(date, '%Y-%m-%d') AS day, c.hash IS NOT NULL AS valid FROM (SELECT DISTINCT md5(CAST(l_orderkey * 10 + 1 AS VARCHAR)) AS hash FROM lineitem UNION SELECT 'none') w LEFT JOIN (SELECT hash, min(title) AS title, min(date) AS date FROM c GROUP BY 1) c ON c.hash = w.hash")
def commit_lookup(spark, d):
    """Date and title of wanted changes; those that are not there are not valid."""
    c = spark.sql(_COMMITS, lineitem=table(spark, d, "lineitem"))
    wanted = table(spark, d, "lineitem").select(F.md5((F.col("l_orderkey") * 10 + 1).cast("string")).alias("hash")).distinct().union(spark.createDataFrame([("none",)], "hash string"))
    return records.looked_up(wanted, c, "hash", ["title", "date"]).select("hash", "title", F.date_format("date", "yyyy-MM-dd").alias("day"), "valid")


@query("""
WITH t AS (SELECT o_custkey AS repo, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders), r AS (SELECT repo, max(n) FILTER (id % 5 = 0) AS hi, coalesce(max(n) FILTER (id % 7 = 0), 0) AS lo FROM t GROUP BY 1)
SELECT t.repo, t.id FROM t JOIN r USING (repo) WHERE hi IS NOT NULL AND n > lo AND n <= hi
""")
def log_range(spark, d):
    """Changes after one tag's and up to another's, in the order of the log."""
    log = table(spark, d, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("id"), "o_orderdate")
    return records.between_tags(log, ["repo"], ["o_orderdate", "id"], F.col("id") % 7 == 0, F.col("id") % 5 == 0).select("repo", "id")


_TABLE = "concat('<table><tr><th>Lang</th><th>Repo</th></tr><tr><td><b>', p_brand, '</b></td><td>', CAST(p_size AS VARCHAR), ',', '125</td></tr></table>')"


@query("SELECT p_partkey, p_brand AS language, p_size * 1000 + 125 AS n FROM part")
def table_counts(spark, d):
    """Cells of a table, whose numbers have separators of thousands."""
    cells = parsing.table_cells(spark_sql(_TABLE))
    return table(spark, d, "part").select("p_partkey", F.element_at(cells, 2).alias("row")).select("p_partkey", F.col("row")[0].alias("language"), F.col("row")[1].cast("long").alias("n"))


@query("SELECT p_partkey, 'Initial' AS type, '2020-01-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') AS date, unnest(['Added', 'Removed']) AS action, unnest(['CWE', 'Reference']) AS kind, unnest([NULL, p_brand]) AS old, unnest([p_name, NULL]) AS new FROM part")
def change_history(spark, d):
    one = lambda action, kind, old, new: F.struct(F.lit(action).alias("action"), F.lit(kind).alias("type"), old.alias("old"), new.alias("new"))
    none = F.lit(None).cast("string")
    entry = F.struct(F.lit("Initial").alias("type"), F.concat(F.lit("2020-01-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0")).alias("date"), F.array(one("Added", "CWE", none, F.col("p_name")), one("Removed", "Reference", F.col("p_brand"), none)).alias("changes"))
    return parsing.change_history(table(spark, d, "part").select("p_partkey", F.array(entry).alias("entries")), "p_partkey", "entries")
