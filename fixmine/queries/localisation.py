"""Localisation of changes in reference graphs that are made of the parts of each brand."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixmine.operators import filters, graph
from fixmine.plans import workflows
from fixmine.queries.base import query, table

# A graph for each brand: sources N and R below the root; by p_partkey % 6 a part is a change below N, an issue below R, a change found by a
# search, a change below the brand's first issue, a change tied to its first change below N, or one attached to N.
_PARTS = "SELECT p_brand AS b, p_partkey AS p, p_partkey % 6 AS m, concat('u', CAST(p_partkey AS VARCHAR(20))) AS u FROM {part}"
_FIRSTS = "SELECT b, 'u' || CAST(min(CASE WHEN m = 1 THEN p END) AS VARCHAR(20)) AS i, 'u' || CAST(min(CASE WHEN m = 0 THEN p END) AS VARCHAR(20)) AS j FROM k GROUP BY b"
_GRAPH = f"""
WITH k AS ({_PARTS}), f AS ({_FIRSTS}) SELECT DISTINCT root, src, dst, tag FROM (
 SELECT b AS root, b AS src, concat(b, '/N') AS dst, CAST(NULL AS VARCHAR(9)) AS tag FROM k UNION ALL SELECT b, b, concat(b, '/R'), NULL FROM k
 UNION ALL SELECT b, concat(b, '/N'), u, NULL FROM k WHERE m = 0 UNION ALL SELECT b, concat(b, '/R'), u, NULL FROM k WHERE m = 1 UNION ALL SELECT b, b, u, 'SG' FROM k WHERE m = 2
 UNION ALL SELECT k.b, i, u, NULL FROM k JOIN f ON k.b = f.b WHERE m = 3 AND i IS NOT NULL UNION ALL SELECT k.b, j, u, 'EX' FROM k JOIN f ON k.b = f.b WHERE m = 4 AND j IS NOT NULL
 UNION ALL SELECT b, concat(b, '/N'), u, 'attach' FROM k WHERE m = 5)
"""
_G = "(" + _GRAPH.format(part="part") + ")"
_K = "(" + _PARTS.format(part="part") + ")"


def v_graph(spark, d):
    """(root, src, dst, tag) of the brands' graphs."""
    return spark.sql(_GRAPH, part=table(spark, d, "part"))


def v_nodes(spark, d):
    k = F.col("p_partkey") % 6
    return table(spark, d, "part").select(F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("node"), F.when(k == 1, "issue_url").otherwise("patch_url").alias("type"), "p_size", "p_brand", "p_partkey")


def v_roots(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("root")).distinct()


def _is_trusted():
    return F.col("mid").endswith("/N")


@query(f"""
WITH k AS (SELECT p_brand AS b, p_partkey AS p, p_partkey % 6 AS m, concat('u', CAST(p_partkey AS VARCHAR)) AS u, p_size > 10 AS good FROM part), f AS (SELECT b, min(CASE WHEN m = 0 THEN p END) AS j FROM k GROUP BY b),
fi AS (SELECT b, count(*) FILTER (m = 1) > 0 AS has_issue FROM k GROUP BY b),
s AS (SELECT k.b, p, m, CASE WHEN m = 3 THEN 0.25 ELSE 1 END AS s FROM k JOIN fi ON k.b = fi.b WHERE good AND (m IN (0, 2, 5) OR m = 3 AND has_issue)), best AS (SELECT b, p FROM s QUALIFY s = max(s) OVER (PARTITION BY b)),
u AS (SELECT b, p FROM best UNION SELECT b, p FROM s WHERE m IN (0, 2)), e AS (SELECT k.b, k.p FROM k JOIN f ON k.b = f.b JOIN u ON u.b = f.b AND u.p = f.j WHERE k.m = 4 AND k.good),
a AS (SELECT b, p FROM u UNION SELECT b, p FROM e)
SELECT b AS root, concat('u', CAST(p AS VARCHAR)) AS node FROM a QUALIFY count(*) OVER (PARTITION BY b) <= 60
""")
def localised_patches(spark, d):
    """The whole localisation: rules, best paths, trusted and found changes, extension, and no result where there are too many."""
    patches = v_nodes(spark, d).where("type = 'patch_url'")
    edges = v_graph(spark, d).select("src", "dst", "tag")
    via = F.exists("path", lambda x: x.endswith("/N"))
    return workflows.localise(edges, v_roots(spark, d), patches, via, {"good": F.col("p_size") > 10}, source=_is_trusted(), valid=F.lit(True), most=60)


@query(f"""
SELECT DISTINCT b AS root, u AS node FROM {_K} WHERE m IN (0, 2)
""")
def direct_or_found(spark, d):
    return graph.direct_or_found(v_graph(spark, d).select("src", "dst", "tag"), v_roots(spark, d), _is_trusted())


_CLEANED = f"""
WITH k AS (SELECT *, p % 4 <> 3 AND m <> 1 AS chosen FROM {_K}), f AS (SELECT b, min(CASE WHEN m = 1 THEN p END) AS i, min(CASE WHEN m = 0 THEN p END) AS j FROM k GROUP BY b),
used AS (SELECT k.b, f.i FROM k JOIN f ON k.b = f.b WHERE m = 3 AND chosen AND i IS NOT NULL GROUP BY 1, 2), n AS (SELECT b || '/N' AS node FROM k UNION SELECT b || '/R' FROM k UNION SELECT b FROM k UNION SELECT u FROM k WHERE chosen UNION SELECT concat('u', CAST(i AS VARCHAR)) FROM used),
e AS (SELECT g.src, g.dst, g.tag FROM {_G} g LEFT JOIN k s ON s.u = g.src LEFT JOIN k t ON t.u = g.dst WHERE coalesce(g.tag, '') <> 'attach' AND NOT (coalesce(g.tag, '') = 'EX' AND coalesce(s.chosen, false) <> coalesce(t.chosen, false)) AND g.src IN (SELECT node FROM n) AND g.dst IN (SELECT node FROM n))
"""


def _cleaned(spark, d):
    nodes, roots = v_nodes(spark, d), v_roots(spark, d)
    chosen = nodes.where("p_partkey % 4 <> 3 AND type = 'patch_url'")
    edges = v_graph(spark, d).select("src", "dst", "tag")
    ends = roots.select(F.col("root").alias("node"), F.lit("root").alias("type"))
    for source in ("/N", "/R"):
        ends = ends.union(roots.select(F.concat("root", F.lit(source)), F.lit("source")))
    paths = graph.simple_paths(edges, roots, 4, chosen.select("node"))
    on_paths = paths.select(F.explode("path").alias("node"))
    return graph.subgraph_by_rules(nodes.select("node", "type").union(ends), edges, chosen, on_paths)


@query(f"{_CLEANED} SELECT src, dst, tag FROM e")
def rule_subgraph_edges(spark, d):
    return _cleaned(spark, d)[1]


@query(f"{_CLEANED} SELECT src AS node FROM e UNION SELECT dst FROM e")
def rule_subgraph_nodes(spark, d):
    return _cleaned(spark, d)[0].select("node")


_RULE_ROWS = "(SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'svn' WHEN 1 THEN 'diff_file' ELSE 'git_commit' END AS kind, concat('https://', CASE p_partkey % 5 WHEN 0 THEN 'gist.github.com/x/' WHEN 1 THEN 'git.example.org/' ELSE 'github.com/o/r/commit/' END, CASE WHEN p_partkey % 11 = 0 THEN 'files/' ELSE '' END, p_partkey) AS url, p_size > 3 AS reachable, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_size % 10 <> 1 END AS valid, TIMESTAMP '2020-01-01 00:00:00' AS published, CASE WHEN p_size % 6 = 0 THEN NULL ELSE TIMESTAMP '2020-01-01 00:00:00' + to_days(CAST(p_size * 25 - 100 AS INTEGER)) END AS changed, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_partkey % 10) / 10.0 END AS alike, p_size % 7 <> 2 AS code FROM part)"


@query(f"""
SELECT p_partkey, kind IN ('git_commit', 'svn') AS of_kind, NOT contains(url, '/files/') AS not_in_files, reachable, coalesce(valid, false) AS valid, kind <> 'git_commit' OR changed IS NULL OR abs(floor((epoch(published) - epoch(changed)) / 86400)) <= 730 AS in_time,
 CASE WHEN alike IS NULL THEN NOT contains(url, 'github.') ELSE alike >= 0.5 END AND NOT contains(url, 'gist') AS of_product, kind <> 'git_commit' OR code AS code FROM {_RULE_ROWS}
""")
def patch_rules(spark, d):
    """The seven rules that select changes, each as a column."""
    k, s = F.col("p_partkey"), F.col("p_size")
    day = F.lit("2020-01-01 00:00:00").cast("timestamp")
    rows = table(spark, d, "part").select(
        "p_partkey", F.when(k % 4 == 0, "svn").when(k % 4 == 1, "diff_file").otherwise("git_commit").alias("kind"),
        F.concat(F.lit("https://"), F.when(k % 5 == 0, "gist.github.com/x/").when(k % 5 == 1, "git.example.org/").otherwise("github.com/o/r/commit/"), F.when(k % 11 == 0, "files/").otherwise(""), k.cast("string")).alias("url"),
        (s > 3).alias("reachable"), F.when(s % 9 != 0, s % 10 != 1).alias("valid"), day.alias("published"), F.when(s % 6 != 0, F.timestamp_seconds(F.unix_timestamp(day) + (s * 25 - 100) * 86400)).alias("changed"), F.when(k % 3 != 0, (k % 10) / 10.0).alias("similar"), (s % 7 != 2).alias("code"),
    )
    rules = filters.patch_rules(*(F.col(c) for c in ("kind", "url", "reachable", "valid", "published", "changed", "similar", "code")))
    return filters.screen(rows, **rules).select("p_partkey", *rules)


@query(f"SELECT u AS node FROM {_K} WHERE m IN (0, 3, 4) AND p % 4 IN (0, 2)")
def confirmed_patches(spark, d):
    k = F.col("p_partkey")
    rows = v_nodes(spark, d).where((k % 6).isin(0, 3, 4)).withColumn("kind", F.when(k % 4 == 0, "git_commit").when(k % 4 == 2, "svn").otherwise("diff_file"))
    return graph.confirmed(rows).select("node")


_INFO = "concat('https://github.com/own', CAST(p_size AS VARCHAR(9)), '/rep', CAST(p_partkey AS VARCHAR(9)), '/x/ABC-', CAST(p_partkey AS VARCHAR(9)), CASE WHEN p_size % 2 = 0 THEN '/CVE-2020' ELSE '/DEF2-7/ABC-' || CAST(p_partkey AS VARCHAR(9)) END)"


@query(f"SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'ABC-' || CAST(p_partkey AS VARCHAR) ELSE 'ABC-' || CAST(p_partkey AS VARCHAR) || ' DEF2-7' END AS issue_keys, concat('own', CAST(p_size AS VARCHAR), '/rep', CAST(p_partkey AS VARCHAR)) AS github_repo FROM part")
def node_info(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.expr(_INFO).alias("url"))
    return graph.node_info(rows, "url").select("p_partkey", F.array_join("issue_keys", " ").alias("issue_keys"), "github_repo")


_TYPE = "CASE {} % 5 WHEN 0 THEN 'patch_url' WHEN 2 THEN 'github_repo_url' WHEN 3 THEN 'common_url' ELSE 'issue_url' END"
_STEPS = (1, 2, 3, 5, 8, 13, 21)


def _round(k: int, level: int, edges: str, front: str) -> str:
    return f"""
s{k} AS (SELECT * FROM (SELECT f.root, f.node, l.child, l.type, min(l.pos) AS pos FROM {front} f JOIN l ON l.node = f.node WHERE l.node <> l.child AND NOT EXISTS (SELECT 1 FROM {edges} e WHERE e.root = f.root AND (e.src = l.node AND e.dst = l.child OR e.src = l.child AND e.dst = l.node)) GROUP BY ALL)
 QUALIFY row_number() OVER (PARTITION BY root, least(node, child), greatest(node, child) ORDER BY node) = 1),
n{k} AS (SELECT root, node, child, pos FROM (SELECT * FROM s{k} WHERE NOT EXISTS (SELECT 1 FROM {edges} e WHERE e.root = s{k}.root AND (e.src = s{k}.child OR e.dst = s{k}.child)) QUALIFY row_number() OVER (PARTITION BY root, child ORDER BY node) = 1) WHERE type = 'issue_url'),
f{k} AS (SELECT root, child AS node FROM n{k} QUALIFY row_number() OVER (PARTITION BY root, node ORDER BY pos, child) <= 5), e{k} AS (SELECT * FROM {edges} UNION ALL SELECT root, node, child, {level} FROM s{k})"""


@query(f"""
WITH r AS (SELECT p_brand AS root, p_brand || '/N' AS source, p_partkey AS p, concat('u', CAST(p_partkey AS VARCHAR)) AS node FROM part WHERE p_partkey % 9 = 0),
l AS (SELECT concat('u', CAST(p_partkey AS VARCHAR)) AS node, concat('u', CAST((p_partkey * 3 + d) % 5000 AS VARCHAR)) AS child, {_TYPE.format('((p_partkey * 3 + d) % 5000)')} AS type, d AS pos FROM part, (SELECT unnest([{', '.join(map(str, _STEPS))}]) AS d) WHERE {_TYPE.format('((p_partkey * 3 + d) % 5000)')} <> 'common_url'),
e0 AS (SELECT DISTINCT root, root AS src, source AS dst, 1 AS level FROM r UNION ALL SELECT DISTINCT root, source, node, 2 FROM r), f0 AS (SELECT DISTINCT root, node FROM r WHERE {_TYPE.format('p')} NOT IN ('patch_url', 'github_repo_url')),
{_round(1, 3, 'e0', 'f0')}, {_round(2, 4, 'e1', 'f1')}
SELECT root, src, dst, CAST(level AS BIGINT) AS level FROM e2
""")
def deep_search(spark, d):
    """Two rounds of expansion with the rule that only five new issues of a page are looked into."""
    part, name = table(spark, d, "part"), lambda c: F.concat(F.lit("u"), c.cast("string"))
    refs = part.where("p_partkey % 9 = 0").select(F.col("p_brand").alias("root"), F.concat("p_brand", F.lit("/N")).alias("source"), name(F.col("p_partkey")).alias("node"))
    to = part.select("p_partkey", F.explode(F.array(*map(F.lit, _STEPS))).alias("pos")).withColumn("to", (F.col("p_partkey") * 3 + F.col("pos")) % 5000)
    links = to.select(name(F.col("p_partkey")).alias("node"), name(F.col("to")).alias("child"), "pos")
    numbers = part.select(F.col("p_partkey").alias("k")).union(to.select("to")).distinct()
    return graph.deep_search(refs, links, numbers.select(name(F.col("k")).alias("node"), F.expr(_TYPE.format("k")).alias("type")))


@query(f"""
WITH k AS (SELECT * FROM {_K}), f AS (SELECT b, count(*) FILTER (m = 1) > 0 AS has_issue, min(CASE WHEN m = 1 THEN p END) AS i, min(CASE WHEN m = 0 THEN p END) AS j, count(*) FILTER (m = 3) AS n3, count(*) FILTER (m = 4) AS n4 FROM k GROUP BY b)
SELECT k.b AS root, u AS node, CASE WHEN m = 3 THEN 0.25 ELSE 1.0 END AS "CN", 1 AS "PC", CASE WHEN m = 3 THEN round(1 / 3, 6) ELSE 1.0 END AS "DP", CASE WHEN m = 0 AND p = j THEN 1 + n4 ELSE 1 END AS "DG", 1 AS "C", CASE WHEN m = 0 AND p = j THEN 1 + n4 ELSE 1 END AS "DG_C", round(CASE WHEN m = 0 AND p = j THEN 1 + n4 ELSE 1 END / CASE WHEN m = 3 THEN 3 ELSE 1 END, 6) AS "DG_DP"
FROM k JOIN f ON k.b = f.b WHERE m IN (0, 2, 5) OR m = 3 AND has_issue
""")
def node_priorities(spark, d):
    """All priorities of the changes of each brand's graph, degrees with the edges that tie changes."""
    edges = v_graph(spark, d)
    plain = graph.without_tag(edges)
    targets = v_nodes(spark, d).where("type = 'patch_url'").select("node")
    scores = graph.path_scores(graph.simple_paths(plain, v_roots(spark, d), 4, targets), F.exists("path", lambda x: x.endswith("/N")))
    pairs = scores.select(F.col("root").alias("key"), "root", "node")
    joined = graph.local_connectivity(plain.withColumnRenamed("root", "key"), pairs, "key")
    out = graph.priorities(scores, graph.degrees(edges), joined)
    return out.withColumns({c: F.round(c, 6) for c in ("DP", "DG_DP")})


@query("""
SELECT r.root, 'c' || CAST(c_custkey AS VARCHAR) AS node, CAST(CASE WHEN n_regionkey = r.k THEN 1 ELSE 0 END + CASE WHEN s_suppkey IS NOT NULL AND (direct OR via AND (n_regionkey <> r.k OR s_nationkey <> c_nationkey)) THEN 1 ELSE 0 END AS BIGINT) AS connectivity
FROM customer JOIN nation ON n_nationkey = c_nationkey CROSS JOIN (SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS root, r_regionkey AS k FROM region) r
LEFT JOIN supplier ON s_suppkey * 20 = c_custkey
LEFT JOIN (SELECT n_regionkey AS rk, n_nationkey + 1 AS s, true AS direct FROM nation) x ON x.s = s_suppkey AND x.rk = r.k LEFT JOIN (SELECT n_nationkey AS nk, n_regionkey AS rk, true AS via FROM nation) y ON y.nk = s_nationkey AND y.rk = r.k
""".replace("(direct OR via", "(coalesce(direct, false) OR coalesce(via, false)"))
def local_connectivity(spark, d):
    """Paths from each region to each customer that share no node."""
    from fixmine.queries.network import v_edges
    from fixmine.queries.network import v_roots as regions

    roots = regions(spark, d)
    edges = v_edges(spark, d).select("src", "dst").distinct().join(F.broadcast(roots.withColumnRenamed("root", "key")))
    pairs = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node")).join(F.broadcast(roots)).select(F.col("root").alias("key"), "root", "node")
    return graph.local_connectivity(edges, pairs, "key").select("root", "node", "connectivity")


@query(f"SELECT u AS node, p AS score FROM {_K} WHERE p >= (SELECT max(p) FROM {_K} WHERE m = 1)")
def deeper_nodes(spark, d):
    rows = v_nodes(spark, d).select("node", F.col("p_partkey").alias("score"), "type")
    return graph.deeper_than(rows, "score", rows.where("type = 'issue_url'")).select("node", "score")


@query(f"""
WITH e AS (SELECT * FROM {_G}), n AS (SELECT root, src AS x FROM e UNION SELECT root, dst FROM e), k AS (SELECT * FROM {_K}),
a AS (SELECT b AS root, b AS src, concat('s', CAST(p AS VARCHAR)) AS dst FROM k WHERE p % 10 = 1 UNION SELECT b, u, concat('s', CAST(p AS VARCHAR)) FROM k WHERE p % 10 = 2 UNION SELECT b, concat('z', u), 'lost' FROM k WHERE p % 10 = 3)
SELECT root, src, dst, tag FROM e UNION ALL SELECT root, src, dst, 'SG' FROM a WHERE (root, src) IN (SELECT (root, x) FROM n)
""")
def searched_edges(spark, d):
    """Changes found by id below the root, those found by an issue's key below the node that has it."""
    k, found = F.col("p_partkey"), F.concat(F.lit("s"), F.col("p_partkey").cast("string"))
    n = v_nodes(spark, d)
    by_id = n.where(k % 10 == 1).select(F.col("p_brand").alias("root"), found.alias("node")).select("root", "root", "node").toDF("key", "root", "node")
    by_key = n.where(k % 10 == 2).select(F.col("p_brand").alias("key"), F.col("node").alias("holder"), found.alias("node")).union(n.where(k % 10 == 3).select("p_brand", F.concat(F.lit("z"), "node"), F.lit("lost")))
    return graph.from_search(v_graph(spark, d).withColumnRenamed("root", "key"), by_id, by_key, "key").withColumnRenamed("key", "root")


@query("SELECT DISTINCT lang AS entity, lang AS src, source AS dst FROM documents UNION ALL SELECT lang, source, concat('u', CAST(doc_id AS VARCHAR)) FROM documents")
def source_edges(spark, d):
    refs = table(spark, d, "documents").select(F.col("lang").alias("entity"), "source", F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"))
    return graph.from_sources(refs, "entity").select("entity", "src", "dst")
