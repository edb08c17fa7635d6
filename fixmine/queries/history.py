"""Commit ranges, equal trees, functions in code, records as of a date, similarity joins, parts of ranges: each against its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fixmine.functions import common, strings
from fixmine.operators import code, history, linkage, selection, similarity
from fixmine.queries.base import query, table
from fixmine.queries.linking import _DOCS, _ITEMS, _WEIGHTS
from fixmine.sources import cache, records
from fixmine.store import scratch

# A graph for each repository: every seventh change starts from the one before the last, every fifth merges an older one.
_GRAPH = """
SELECT repo, n, commit, CASE WHEN n % 7 = 3 THEN before2 ELSE before1 END AS p1, CASE WHEN n % 5 = 0 THEN before4 END AS p2 FROM (
  SELECT o_custkey % 40 AS repo, o_orderkey AS commit, row_number() OVER w AS n, lag(o_orderkey, 1) OVER w AS before1, lag(o_orderkey, 2) OVER w AS before2, lag(o_orderkey, 4) OVER w AS before4
  FROM {orders} WINDOW w AS (PARTITION BY o_custkey % 40 ORDER BY o_orderdate, o_orderkey)) g
"""


@query(f"""
WITH RECURSIVE g AS ({_GRAPH.format(orders='orders')}), e AS (SELECT repo, commit, unnest([p1, p2]) AS parent FROM g),
r AS (SELECT repo, commit AS head, lag(commit) OVER (PARTITION BY repo ORDER BY n) AS base FROM g WHERE n % 20 = 0),
w AS (SELECT head AS range, repo, head AS node, 'head' AS side FROM r UNION SELECT head, repo, base, 'base' FROM r WHERE base IS NOT NULL
      UNION SELECT w.range, w.repo, e.parent, w.side FROM w JOIN e ON e.repo = w.repo AND e.commit = w.node WHERE e.parent IS NOT NULL)
SELECT range, repo, node AS commit FROM w WHERE side = 'head' EXCEPT SELECT range, repo, node FROM w WHERE side = 'base'
""")
def commit_ranges(spark, d):
    """Changes between each release and the one before, over graphs with branches and merges."""
    g = spark.sql(_GRAPH, orders=table(spark, d, "orders"))
    commits = g.select("repo", "commit", F.col("n").alias("order"), F.array_compact(F.array("p1", "p2")).alias("parents"))
    releases = g.where("n % 20 = 0").selectExpr("repo", "commit AS head", "lag(commit) OVER (PARTITION BY repo ORDER BY n) AS base", "commit AS range")
    return history.commit_ranges(commits, releases)


_LINE = "SELECT o_custkey AS repo, o_orderkey AS commit, row_number() OVER w AS pos, lag(o_orderkey) OVER w AS parent FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
_FILES = """
SELECT repo, commit, pos, path, lag(new) OVER (PARTITION BY repo, path ORDER BY pos) AS old, new FROM (
  SELECT repo, commit, pos, path, CASE WHEN blob = 'FR' THEN NULL ELSE blob END AS new FROM (
    SELECT c.repo, c.commit, c.pos, concat('src/', CAST(l_linenumber % 2 AS VARCHAR(9)), '/', CAST(l_partkey % 2 AS VARCHAR(9)), '.c') AS path, max(concat(l_linestatus, l_returnflag)) AS blob
    FROM {line} c JOIN {lineitem} l ON l.l_orderkey = c.commit GROUP BY 1, 2, 3, 4) a) b
"""


@query(f"""
WITH c AS ({_LINE.format(orders='orders')}), ch AS ({_FILES.format(line='c', lineitem='lineitem')}), p AS (SELECT DISTINCT repo, path FROM ch), x AS (SELECT c.repo, c.commit, c.pos, p.path FROM c JOIN p USING (repo)),
s AS (SELECT x.repo, x.commit, x.path || ':' || ch.new AS file FROM x ASOF JOIN ch ON x.repo = ch.repo AND x.path = ch.path AND x.pos >= ch.pos),
t AS (SELECT c.repo, c.commit, coalesce(string_agg(file, ' ' ORDER BY file), '') AS tree FROM c LEFT JOIN s ON s.repo = c.repo AND s.commit = c.commit GROUP BY 1, 2)
SELECT repo, commit, min(commit) OVER (PARTITION BY repo, tree) AS representative, count(*) OVER (PARTITION BY repo, tree) AS copies FROM t
""")
def equal_trees(spark, d):
    """Changes between which a diff is empty, from the changed files of each alone."""
    line = spark.sql(_LINE, orders=table(spark, d, "orders"))
    changes = spark.sql(_FILES, line=line, lineitem=table(spark, d, "lineitem"))
    return history.tree_classes(line.select("repo", "commit", "parent"), changes, ["repo"])


_CODE = """concat('/* a header { that is no block */', chr(10), 'int f_', CAST(p_partkey AS VARCHAR), '(int a,', chr(10), '    int b)', chr(10), '{', chr(10), '  char *s = "}{"; // }', chr(10), repeat(concat('  a(b); /* {', chr(10), ' } */', chr(10)), CAST(p_size % 7 AS INT)),
  '  if (a) { g(); }', chr(10), '}', chr(10), chr(10), 'struct s { int x; };', chr(10), 'static void h', CAST(p_partkey AS VARCHAR), '() { for (;;) { } }', chr(10), 'int declared(int);', chr(10))"""


def _sources(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", "p_size", _CODE.replace("AS VARCHAR)", "AS STRING)").replace("chr(10)", "'\\n'") + " AS code")


@query("""
SELECT p_partkey, 'f_' || p_partkey AS function, 2 AS start, 7 + 2 * (p_size % 7) AS end FROM part
UNION ALL SELECT p_partkey, 'h' || p_partkey, 10 + 2 * (p_size % 7), 10 + 2 * (p_size % 7) FROM part
""")
def function_ranges(spark, d):
    """Where each function begins and ends; braces in strings and comments, blocks inside, structures and declarations are none."""
    return code.functions(_sources(spark, d), ["p_partkey"], "code")


@query("""
SELECT p_partkey, n AS line, CASE WHEN n BETWEEN 2 AND 7 + 2 * (p_size % 7) THEN 'f_' || p_partkey WHEN n = 10 + 2 * (p_size % 7) THEN 'h' || p_partkey END AS function FROM part, (SELECT unnest(range(1, 27, 3)) AS n)
""")
def functions_of_lines(spark, d):
    """The function that holds each changed line."""
    files = _sources(spark, d)
    points = files.select("p_partkey", F.explode(F.sequence(*(F.lit(x).cast("long") for x in (1, 26, 3)))).alias("line"))
    return code.functions_at(points, code.functions(files, ["p_partkey"], "code"), ["p_partkey"], "line").select("p_partkey", "line", "function")


_EVENTS = """
SELECT l_partkey % 200 AS key, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'Added' WHEN 1 THEN 'Removed' ELSE 'Changed' END AS action, concat('k', CAST(l_suppkey % 3 AS VARCHAR(9))) AS kind,
  CASE WHEN l_linenumber % 3 > 0 THEN l_returnflag END AS old, CASE WHEN l_linenumber % 3 <> 1 THEN l_linestatus END AS new FROM {lineitem}
"""


@query(f"""
WITH e AS ({_EVENTS.format(lineitem='lineitem')}), x AS (SELECT key, date, l_orderkey, l_linenumber, 0 AS m, kind, old AS value, 0 AS held FROM e WHERE old IS NOT NULL UNION ALL SELECT key, date, l_orderkey, l_linenumber, 1, kind, new, 1 FROM e WHERE new IS NOT NULL),
p AS (SELECT o_orderkey, o_orderkey % 200 AS key, CAST(o_orderdate AS DATE) AS at FROM orders),
s AS (SELECT o_orderkey, kind, value, arg_max(held, (date, l_orderkey, l_linenumber, m)) AS held FROM p JOIN x ON x.key = p.key AND x.date <= p.at GROUP BY ALL)
SELECT p.o_orderkey, string_agg(kind || '=' || value, ',' ORDER BY kind, value) FILTER (held = 1) AS state FROM p LEFT JOIN s ON s.o_orderkey = p.o_orderkey GROUP BY 1
""")
def records_at(spark, d):
    """What each record held at the dates of another table, by replaying what was added, removed and changed."""
    e = spark.sql(_EVENTS, lineitem=table(spark, d, "lineitem"))
    one = F.struct("l_orderkey", "l_linenumber", "action", F.col("kind").alias("type"), "old", "new")
    entries = e.groupBy("key", "date").agg(F.array_sort(F.collect_list(one)).alias("changes"))
    points = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 200).alias("key"), F.col("o_orderdate").cast("date").alias("at"))
    held = history.held_at(history.intervals(entries, "key", "date", "changes"), points, "key", "at")
    pairs = F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "value"))))
    state = F.array_join(F.transform(pairs, lambda x: F.concat_ws("=", x["kind"], x["value"])), ",")
    return held.groupBy("o_orderkey").agg(F.nullif(state, F.lit("")).alias("state"))


@query("WITH n AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS a, b.p_name AS b, levenshtein(a.p_name, b.p_name) AS distance FROM n a, n b WHERE levenshtein(a.p_name, b.p_name) * 3 <= greatest(length(a.p_name), length(b.p_name))")
def similar_names(spark, d):
    """All pairs of names with an edit similarity of two thirds or more."""
    n = table(spark, d, "part")
    return similarity.edit_join(n.select(F.col("p_name").alias("a")), "a", n.select(F.col("p_name").alias("b")), "b", (2, 3))


@query("""
WITH n AS (SELECT DISTINCT lower(regexp_extract(text, '[A-Za-z]{8,}')) AS w FROM documents), m AS (SELECT DISTINCT lower(regexp_extract(text, '[A-Za-z]{8,}')) AS w FROM benchmark)
SELECT n.w AS a, m.w AS b, levenshtein(n.w, m.w) AS distance FROM n, m WHERE n.w <> '' AND m.w <> '' AND levenshtein(n.w, m.w) * 5 <= greatest(length(n.w), length(m.w))
""")
def similar_words(spark, d):
    """First long words of documents and of benchmark items with a similarity of four fifths or more."""
    word = F.nullif(F.lower(F.regexp_extract("text", "[A-Za-z]{8,}", 0)), F.lit(""))
    return similarity.edit_join(table(spark, d, "documents").select(word.alias("a")), "a", table(spark, d, "benchmark").select(word.alias("b")), "b", (4, 5))


@query(f"""
WITH i AS (SELECT token, ln((SELECT count(*) FROM documents) / (count(*) + 1)) AS idf FROM {_DOCS} GROUP BY 1),
c AS (SELECT doc_id, item_id, sum(a.w * b.w) / (any_value(a.norm) * any_value(b.norm)) AS cosine FROM {_WEIGHTS.format(k='doc_id', c=_DOCS)} a JOIN {_WEIGHTS.format(k='item_id', c=_ITEMS)} b USING (token) WHERE a.w <> 0 AND b.w <> 0 GROUP BY 1, 2)
SELECT item_id, doc_id, round(cosine, 4) AS cosine, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(cosine, 12) DESC, doc_id) AS place FROM c) WHERE place <= 10
""")
def top_documents(spark, d):
    """The ten documents most like each benchmark item."""
    texts = lambda name, key: table(spark, d, name).select(key, "text")
    return similarity.top_cosine_texts(texts("documents", "doc_id"), "doc_id", texts("benchmark", "item_id"), "item_id", strings.alnum_tokens(F.col("text")), 10).select("item_id", "doc_id", F.round("cosine", 4).alias("cosine"), "place")


def _parts_sql(column: str, t: str, most: int) -> str:
    """All levels of halves of the range, of which those stay whose parent is too full."""
    return f"""
WITH v AS (SELECT CAST(floor({column}) AS BIGINT) AS v FROM {t} WHERE {column} IS NOT NULL), r AS (SELECT min(v) AS low, max(v) - min(v) AS span FROM v), b AS (SELECT low, CASE WHEN span = 0 THEN 0 ELSE CAST(floor(log2(span)) AS INT) + 1 END AS top FROM r),
n AS (SELECT low, top, bits, (v - low) >> bits AS node, count(*) AS n FROM v, b, (SELECT unnest(range(0, 40)) AS bits) WHERE bits <= top GROUP BY ALL)
SELECT n.low + (n.node << n.bits) AS low, n.low + ((n.node + 1) << n.bits) - 1 AS high, n.n FROM n LEFT JOIN n p ON p.bits = n.bits + 1 AND p.node = n.node >> 1 WHERE (n.bits = n.top OR p.n > {most}) AND (n.n <= {most} OR n.bits = 0)
"""


@query(_parts_sql("o_totalprice", "orders", 100))
def price_parts(spark, d):
    """Ranges of prices with at most a hundred orders each."""
    return selection.bisected(table(spark, d, "orders").select(F.floor("o_totalprice").alias("v")), "v", 100)


@query(_parts_sql("CASE WHEN l_linenumber = 1 THEN 777 ELSE l_extendedprice END", "lineitem", 500))
def skewed_parts(spark, d):
    """The same of a column in which one value has a quarter of the rows."""
    return selection.bisected(table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") == 1, 777).otherwise(F.floor("l_extendedprice")).cast("long").alias("v")), "v", 500)


_TAGS = "SELECT p_brand, concat('v', CAST(p_size AS VARCHAR(9)), '.', CAST(p_partkey % 3 AS VARCHAR(9))) AS wanted, concat('v', CAST(p_partkey % 30 AS VARCHAR(9)), CASE WHEN p_partkey % 4 = 0 THEN '.1' ELSE '.' END, CAST(p_size % 5 AS VARCHAR(9))) AS tag FROM {part}"
_COMMON = "list_max(flatten(list_transform(range(1, length(wanted) + 1), lambda i: list_transform(range(0, length(wanted) - i + 2), lambda l: CASE WHEN contains(tag, wanted[i:i + l - 1]) THEN l ELSE 0 END))))"


@query(f"""
WITH t AS ({_TAGS.format(part='part')}), x AS (SELECT DISTINCT a.p_brand, a.wanted, b.tag FROM t a JOIN t b USING (p_brand)),
s AS (SELECT *, CASE WHEN wanted = tag THEN 3.0 WHEN contains(tag, wanted) OR contains(wanted, tag) THEN 2.0 ELSE {_COMMON} / length(tag) END AS s FROM x)
SELECT p_brand, wanted, min(tag) AS tag FROM (SELECT * FROM s QUALIFY s = max(s) OVER (PARTITION BY p_brand, wanted)) GROUP BY 1, 2
""")
def closest_version(spark, d):
    """The tag that is a wanted version, contains it or is contained, else the one of which the longest common substring is the largest part; the first of equals."""

    t = spark.sql(_TAGS, part=table(spark, d, "part"))
    pairs = t.select("p_brand", "wanted").distinct().join(t.select("p_brand", "tag").distinct(), "p_brand")
    share = strings.longest_common_substring(F.col("wanted"), F.col("tag")) / F.length("tag")
    return linkage.closest(pairs, ["p_brand"], "wanted", "tag", share)


_VENDORS = """CASE p_partkey % 5
 WHEN 0 THEN concat('{"id": ', CAST(p_partkey AS VARCHAR), ', "artifactComponents": [{"componentCoordinateType": "MAVEN", "coordOne": "', p_brand, '", "coordTwo": " ", "versionRanges": [{"versionRange": "<', CAST(p_size AS VARCHAR), '", "updateToVersion": "2", "patch": "h', CAST(p_partkey AS VARCHAR), '", "componentInstances": [{"componentInstanceHash": "i1"}, {"other": 1}]}]}]}')
 WHEN 1 THEN concat('{"components": [{"name": "', p_brand, '", "versions": [{"affected": "', CAST(p_size AS VARCHAR), '", "fix": {"commit": "h', CAST(p_partkey AS VARCHAR), '"}}, {"version_range": "*", "patch": {"url": "u"}, "instances": ["x", "y"]}]}]}')
 WHEN 2 THEN concat('{"data": {"components": [{"type": "GO", "group": "', p_brand, '"}]}}') WHEN 3 THEN '{"components": []}' ELSE 'no json' END"""


@query("""
SELECT p_partkey, 'maven:' || lower(p_brand) AS component, '<' || p_size AS range, '2' AS fix_version, 'h' || p_partkey AS patch, 'i1,-' AS instances FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT p_partkey, lower(p_brand), CAST(p_size AS VARCHAR), NULL, 'h' || p_partkey, NULL FROM part WHERE p_partkey % 5 = 1
UNION ALL SELECT p_partkey, lower(p_brand), '*', NULL, 'u', 'x,y' FROM part WHERE p_partkey % 5 = 1
UNION ALL SELECT p_partkey, 'go:' || lower(p_brand), NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 5 = 2
UNION ALL SELECT p_partkey, 'npm:' || p_size, '1', NULL, NULL, NULL FROM part WHERE p_partkey % 5 = 3 AND p_size % 2 = 0
""")
def variant_versions(spark, d):
    """Components of vendor records of differing shapes in one column; of a record without any, those of its detail page."""
    part = table(spark, d, "part")
    rows = part.selectExpr("p_partkey", _VENDORS.replace("AS VARCHAR)", "AS STRING)") + " AS json")
    size = F.col("p_size").cast("string")
    detail = part.where("p_size % 2 = 0").select("p_partkey", F.concat(F.lit('{"components": [{"type": "NPM", "name": "'), size, F.lit('", "versions": [{"version_range": "1"}]}]}')).alias("json"))
    out = records.variant_versions(rows.where("p_partkey % 5 <> 4 OR p_size > 0"), "p_partkey", "json", detail.where("p_partkey % 5 = 3"))
    return out.select("p_partkey", "component", "range", "fix_version", "patch", F.array_join("instances", ",", "-").alias("instances"))


@query("""
WITH w AS (SELECT DISTINCT o_custkey FROM orders), c AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'third' WHEN c_custkey % 2 = 0 THEN 'second ' || c_nationkey ELSE 'first' END AS body FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 4 = 0)
SELECT 'u' || o_custkey AS url, body FROM w LEFT JOIN c ON c_custkey = o_custkey
""")
def bucketed_cache(spark, d):
    """Texts of the wanted addresses from a cache that was filled in three batches; the latest of each address counts."""
    path, name = scratch(spark, "cache"), "cache_" + uuid.uuid4().hex
    stored = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("url"), "c_nationkey")
    cache.create(stored.where("c_custkey % 3 <> 0").select("url", F.lit("first").alias("body")), name, path, "url", 16)
    cache.put(stored.where("c_custkey % 3 <> 0 AND c_custkey % 2 = 0").select("url", F.concat(F.lit("second "), F.col("c_nationkey").cast("string")).alias("body")), name, "url")
    cache.put(stored.where("c_custkey % 4 = 0").select("url", F.lit("third").alias("body")), name, "url")
    wanted = table(spark, d, "orders").select(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("url"))
    return cache.get(wanted, name, "url").select("url", "body").union(cache.missing(wanted, name, "url").select("url", F.lit(None).cast("string")))


_RUN_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"
_RUN_GRAMS = "SELECT {k}, i - 1 AS p, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT {k}, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT {k}, {w} AS w FROM {t}))"


@query(f"""
WITH d AS ({_RUN_GRAMS.format(k='doc_id', w=_RUN_WORDS, t='documents')}), b AS ({_RUN_GRAMS.format(k='item_id', w=_RUN_WORDS, t='benchmark')}),
m AS (SELECT doc_id, item_id, d.p AS p, d.p - b.p AS shift, d.p - row_number() OVER (PARTITION BY doc_id, item_id, d.p - b.p ORDER BY d.p) AS run FROM d JOIN b USING (g)),
r AS (SELECT doc_id, item_id, min(p) AS start, min(p) - shift AS item_start, count(*) + 4 AS words FROM m GROUP BY doc_id, item_id, shift, run)
SELECT doc_id, item_id, words, start, item_start FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY words DESC, start, item_start) = 1
""")
def longest_passages(spark, d):
    """The longest run of words that each document shares with each benchmark item, where it is five words or more."""
    docs, items = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", "text")
    pairs = linkage.sharing_grams(docs, "doc_id", items, "item_id", "text", 5)
    both = pairs.join(docs, "doc_id").join(items.withColumnRenamed("text", "item"), "item_id")
    run = both.select("doc_id", "item_id", common.longest_common_run("text", "item", words=True).alias("r"))
    return run.select("doc_id", "item_id", F.col("r.length").alias("words"), F.col("r.begin_a").alias("start"), F.col("r.begin_b").alias("item_start"))
