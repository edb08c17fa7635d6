"""Text, URL, date and vector functions over documents, pages, parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixmine.functions import strings, urls, values
from fixmine.operators import features, ranking
from fixmine.queries.base import query, table
from fixmine.store import checkpoints

_TOKENS = "(SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents)"


@query(f"SELECT token, count(DISTINCT doc_id) AS df, round(ln((SELECT count(*) FROM documents) / (count(DISTINCT doc_id) + 1)), 6) AS idf FROM {_TOKENS} GROUP BY token")
def doc_frequency_idf(spark, d):
    docs = table(spark, d, "documents").withColumn("tokens", strings.alnum_tokens(F.col("text")))
    return features.document_frequency(docs, "tokens").select("token", "df", F.round(F.log(F.lit(float(docs.count())) / (F.col("df") + 1)), 6).alias("idf"))


_VOCABULARY = "SELECT token FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM {}) GROUP BY token"


@query(f"SELECT token, CASE WHEN b IS NULL THEN 'only_a' WHEN a IS NULL THEN 'only_b' ELSE 'both' END AS side FROM (SELECT token, 1 AS a FROM ({_VOCABULARY.format('documents')})) x FULL JOIN (SELECT token, 1 AS b FROM ({_VOCABULARY.format('benchmark')})) y USING (token)")
def vocabulary_overlap(spark, d):
    from fixmine.operators.filters import overlap

    words = lambda t: table(spark, d, t).select(F.explode(strings.alnum_tokens(F.col("text"))).alias("token"))
    return overlap(words("documents"), words("benchmark"), "token")


_VEC = "(SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


@query(f"""
WITH e AS (SELECT label, arg_min(v, vec_id) AS w FROM {_VEC} GROUP BY label)
SELECT vec_id, e.label AS exemplar, round(list_cosine_similarity(v, w), 6) AS cosine FROM {_VEC} q, e
""")
def vector_cosine(spark, d):
    e = table(spark, d, "embeddings")
    # one exemplar for each label, all of which are asked of every vector; sent to the tasks if they are few
    checkpoints(spark)
    exemplars = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("w")).withColumnRenamed("label", "exemplar").checkpoint()
    exemplars = F.broadcast(exemplars) if exemplars.count() <= 1000 else exemplars
    return e.join(exemplars, F.lit(True)).select("vec_id", "exemplar", F.round(values.cosine(F.col("embedding"), F.col("w")), 6).alias("cosine"))


@query("""
SELECT o_orderkey, CAST(floor((epoch(o_orderdate) - epoch(TIMESTAMP '1995-06-17 12:30:00')) / 86400) AS BIGINT) AS span,
       CAST(abs(date_diff('day', CAST(o_orderdate AS DATE), DATE '1995-06-17')) AS BIGINT) AS distance, abs(epoch(o_orderdate) - epoch(TIMESTAMP '1995-06-17 12:30:00')) < 31 * 86400 AS near
FROM orders
""")
def day_span(spark, d):
    o, ref = F.col("o_orderdate"), F.lit("1995-06-17 12:30:00").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", values.day_span(o, ref).alias("span"), values.day_distance(F.date_format(o, "yyyyMMdd"), F.lit("19950617")).alias("distance"), values.within_days(o, ref, 30).alias("near"))


@query("""
SELECT o_orderkey, min(CAST(floor((epoch(l_shipdate) - epoch(o_orderdate)) / 86400) AS BIGINT)) AS lag FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
HAVING min(CAST(floor((epoch(l_shipdate) - epoch(o_orderdate)) / 86400) AS BIGINT)) < 0
""")
def negative_lag_report(spark, d):
    both = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy("o_orderkey").agg(F.min(values.day_span(F.col("l_shipdate"), F.col("o_orderdate"))).alias("lag")).where("lag < 0")


@query("""
SELECT page_id, regexp_extract(url, '^([a-zA-Z]+)://', 1) AS scheme, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS path,
       regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS query, split_part(url, '#', 1) AS canonical FROM pages
""")
def url_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", *(c.alias(n) for n, c in urls.parts(u).items()), urls.canonical(u).alias("canonical"))


_SHAPES = (
    ("'https://github.com/own', CAST(p_size AS VARCHAR), '/rep', CAST(p_partkey AS VARCHAR), '/commit/', h", "patch_url", "git"),
    ("'https://github.com/own', CAST(p_size AS VARCHAR), '/rep', CAST(p_partkey AS VARCHAR), '/issues/', CAST(p_partkey AS VARCHAR)", "issue_url", "raw"),
    ("'https://github.com/own', CAST(p_size AS VARCHAR), '/rep', CAST(p_partkey AS VARCHAR), '/pull/', CAST(p_partkey + 10 AS VARCHAR)", "issue_url", "raw"),
    ("'https://svn.example.org/viewvc?view=revision&revision=', CAST(p_partkey + 1000 AS VARCHAR)", "patch_url", "svn"),
    ("'https://bugzilla.example.com/show_bug.cgi?id=', CAST(p_partkey + 100 AS VARCHAR)", "issue_url", "raw"),
    ("'https://issues.example.org/jira/browse/ABC-', CAST(p_partkey AS VARCHAR)", "issue_url", "raw"),
    ("'https://example.com/files/part', CAST(p_partkey AS VARCHAR), '.tar'", "common_url", "raw"),
    ("'https://github.com/own', CAST(p_size AS VARCHAR), '/rep', CAST(p_partkey AS VARCHAR)", "common_github_url", "raw"),
)
_V_URLS = "(SELECT p_partkey, p_size, CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN concat({e})" for k, (e, _, _) in enumerate(_SHAPES)) + " END AS url, h FROM (SELECT *, md5(CAST(p_partkey AS VARCHAR)) AS h FROM part))"


def v_urls(spark, d):
    """One URL of each shape that the recognisers know, by part."""
    h = F.md5(F.col("p_partkey").cast("string"))
    sql = lambda e: F.expr("concat(" + e.replace("AS VARCHAR", "AS STRING") + ")")
    rows = table(spark, d, "part").select("p_partkey", "p_size", h.alias("h"))
    url = F.when(F.col("p_partkey") % 8 == 0, sql(_SHAPES[0][0]))
    for k, (e, _, _) in enumerate(_SHAPES[1:], 1):
        url = url.when(F.col("p_partkey") % 8 == k, sql(e))
    return rows.withColumn("url", url)


@query("SELECT p_partkey, url, CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN '{t}'" for k, (_, t, _) in enumerate(_SHAPES)) + " END AS type, CASE p_partkey % 8 WHEN 0 THEN concat('git_', substr(h, 1, 6)) WHEN 3 THEN concat('svn_', CAST(p_partkey + 1000 AS VARCHAR)) ELSE url END AS key, " + f"regexp_extract(url, 'github[.]com/([^/?#]+)', 1) AS owner, regexp_extract(url, 'github[.]com/[^/?#]+/([^/?#]+)', 1) AS repo FROM {_V_URLS}")
def url_typing(spark, d):
    u = F.col("url")
    owner, repo, _ = urls.owner_repo(u)
    return v_urls(spark, d).select("p_partkey", "url", urls.url_type(u).alias("type"), urls.patch_key(u).alias("key"), owner.alias("owner"), repo.alias("repo"))


@query(f"SELECT p_partkey, CASE p_partkey % 8 WHEN 1 THEN 'git_issue' WHEN 2 THEN 'git_pull_request' WHEN 4 THEN 'bugzilla' WHEN 5 THEN 'jira' END AS kind, CASE p_partkey % 8 WHEN 1 THEN concat('github.com/', CAST(p_partkey AS VARCHAR)) WHEN 2 THEN concat('github.com/', CAST(p_partkey + 10 AS VARCHAR)) WHEN 4 THEN concat('bugzilla.example.com/', CAST(p_partkey + 100 AS VARCHAR)) WHEN 5 THEN concat('issues.example.org/ABC-', CAST(p_partkey AS VARCHAR)) END AS issue FROM {_V_URLS}")
def issue_typing(spark, d):
    u = F.col("url")
    return v_urls(spark, d).select("p_partkey", urls.issue_kind(u).alias("kind"), urls.issue_id(u).alias("issue"))


@query(f"SELECT p_partkey, nullif(regexp_extract(url, '(?:^|[^0-9A-Za-z])([0-9a-f]{{6,40}})(?:[^0-9A-Za-z]|$)', 1), '') AS commit_id, nullif(regexp_extract(url, '(?:rev=r?|revision=r?|/r)([0-9]+)', 1), '') AS svn_id FROM {_V_URLS}")
def commit_id_extract(spark, d):
    u = F.col("url")
    return v_urls(spark, d).select("p_partkey", urls.commit_id(u).alias("commit_id"), urls.svn_id(u).alias("svn_id"))


@query()
def commit_id_strict(spark, d):
    """With the look-ahead rule, which DuckDB's regular expressions lack."""
    return v_urls(spark, d).select("p_partkey", urls.commit_id(F.col("url"), strict=True).alias("commit_id"))


_HREF = """'(?i)[ \\t\\r\\n]href[ \\t\\r\\n]*=[ \\t\\r\\n]*("[^"]*"|''[^'']*''|[^ \\t\\r\\n"''<>]+)'"""
_PLAIN = "replace(regexp_replace({}, '^[\"'']|[\"'']$', '', 'g'), '&amp;', '&')"
_MIXED = """concat(html, '<A class=x HREF=', chr(39), '/q', page_id, chr(39), '>one <b>of</b>  two</A> <a href=/bare', page_id, '>bare</a> <a data-x="1" hRef="/a?b&amp;c">amp</a>')"""


@query(f"SELECT page_id, pos, {_PLAIN.format('href')} AS href FROM (SELECT page_id, unnest(regexp_extract_all({_MIXED}, {_HREF}, 1)) AS href, unnest(range(len(regexp_extract_all({_MIXED}, {_HREF}, 1)))) AS pos FROM pages)")
def html_links(spark, d):
    """Targets in pages to which links with other quotes and in other cases are added."""
    return v_pages(spark, d).select("page_id", F.posexplode(urls.hrefs(F.col("html"))).alias("pos", "href")).withColumn("pos", F.col("pos").cast("long"))


def v_pages(spark, d):
    k = F.col("page_id").cast("string")
    more = F.concat("html", F.lit("<A class=x HREF='/q"), k, F.lit("'>one <b>of</b>  two</A> <a href=/bare"), k, F.lit('>bare</a> <a data-x="1" hRef="/a?b&amp;c">amp</a>'))
    return table(spark, d, "pages").select("page_id", "url", more.alias("html"))


_ANCHOR = """'(?is)<a[ \\t\\r\\n](?:[^<>]*[ \\t\\r\\n])?href[ \\t\\r\\n]*=[ \\t\\r\\n]*("[^"]*"|''[^'']*''|[^ \\t\\r\\n"''<>]+)[^<>]*>(.*?)</a>'"""


@query(f"SELECT page_id, {_PLAIN.format('h')} AS href, trim(regexp_replace(regexp_replace(t, '<[^>]*>', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM (SELECT page_id, unnest(regexp_extract_all({_MIXED}, {_ANCHOR}, 1)) AS h, unnest(regexp_extract_all({_MIXED}, {_ANCHOR}, 2)) AS t FROM pages)")
def html_anchors(spark, d):
    return v_pages(spark, d).select("page_id", F.explode(urls.anchors(F.col("html"))).alias("x")).select("page_id", "x.href", "x.text")


@query()
def html_links_resolved(spark, d):
    """Absolute addresses by the standard library's rules."""
    links = v_pages(spark, d).select("page_id", "url", F.explode(urls.hrefs(F.col("html"))).alias("href"))
    return links.select("page_id", "href", urls.resolve("url", "href").alias("target"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>[^<]*(</p>)?[^<]*</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), ' ')) AS visible FROM pages")
def html_text(spark, d):
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", "<(script|style)[^>]*>[^<]*(</p>)?[^<]*</(script|style)>", " "), "<[^>]*>", " "), r"[\t\n\f\r ]+", " ")
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.length(F.trim(bare)).cast("long").alias("visible"))


_M = {"emails": strings.EMAIL, "hex_ids": strings.HEX_ID, "versions": strings.VERSION}


@query("SELECT doc_id, " + ", ".join(f"array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{p}'))), ' ') AS {n}" for n, p in _M.items()) + " FROM documents")
def mention_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", *(F.array_join(strings.mentions(F.col("text"), p), " ").alias(n) for n, p in _M.items()))


_IDENT = "concat(replace(p_type, ' ', ''), 'XML', CAST(p_size AS VARCHAR), replace(p_name, ' ', 'Of'), 'v', CAST(p_partkey AS VARCHAR))"
_CAMEL = f"regexp_replace({_IDENT}, '[^A-Za-z0-9]+', ' ', 'g')"
for _rule in ("([A-Z])([A-Z][a-z])", "([a-z])([A-Z0-9])", "([A-Z])([0-9])", "([0-9])([A-Za-z])"):
    for _ in range(2):
        _CAMEL = f"regexp_replace({_CAMEL}, '{_rule}', '\\1 \\2', 'g')"


@query(f"SELECT p_partkey, array_to_string(list_filter(string_split(lower({_CAMEL}), ' '), lambda x: x <> ''), '|') AS tokens FROM part")
def camel_tokenize(spark, d):
    ident = F.expr(_IDENT.replace("VARCHAR", "STRING"))
    return table(spark, d, "part").select("p_partkey", F.array_join(strings.camel_tokens(ident), "|").alias("tokens"))


@query("""
SELECT item_id, size_words, array_to_string(hits, ',') AS hits, len(hits) AS n_hits FROM (
  SELECT item_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS size_words, list_filter(['the', 'of', 'and', 'der', 'que'], lambda w: contains(text, w)) AS hits FROM benchmark)
""")
def keyword_presence(spark, d):
    t = F.col("text")
    hits = strings.keyword_set(t, ("the", "of", "and", "der", "que"))
    return table(spark, d, "benchmark").select("item_id", F.size(strings.words(t)).cast("long").alias("size_words"), F.array_join(hits, ",").alias("hits"), F.size(hits).cast("long").alias("n_hits"))


_VERSION_TAG = "concat('v', CAST(p_size AS VARCHAR), '.', CAST(p_partkey % 10 AS VARCHAR), CASE WHEN p_partkey % 7 = 0 THEN '-rc1' ELSE '' END)"


def v_versions(spark, d):
    return table(spark, d, "part").select("p_brand", "p_partkey", F.expr(_VERSION_TAG.replace("VARCHAR", "STRING")).alias("tag"))


@query(f"SELECT p_partkey, tag, regexp_replace(tag, '(?i)[-._]?(alpha|beta|rc|pre|cr)[-._]?[0-9]*$', '') AS stripped, regexp_matches(tag, '-alpha|-beta|-rc|-pre|-cr') AS pre FROM (SELECT p_partkey, {_VERSION_TAG} AS tag FROM part)")
def prerelease_strip(spark, d):
    t = F.col("tag")
    return v_versions(spark, d).select("p_partkey", "tag", strings.strip_prerelease(t).alias("stripped"), strings.is_prerelease(t).alias("pre"))


@query(f"""
WITH t AS (SELECT DISTINCT p_brand, {_VERSION_TAG} AS tag FROM part), l AS (SELECT *, lag(tag, 1) OVER w AS one, lag(tag, 2) OVER w AS two FROM t WINDOW w AS (PARTITION BY p_brand ORDER BY tag))
SELECT p_brand, tag, CASE WHEN one IS NOT NULL AND contains(one, tag) THEN two ELSE one END AS previous FROM l
""")
def version_predecessor(spark, d):
    return ranking.predecessor(v_versions(spark, d).select("p_brand", "tag").distinct(), ["p_brand"], "tag", ["tag"])


@query(f"""
WITH t AS (SELECT DISTINCT p_brand, p_size, p_partkey % 10 AS minor, p_partkey % 7 = 0 AS rc, {_VERSION_TAG} AS tag FROM part)
SELECT p_brand, tag, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, minor, rc) AS place FROM t
""")
def version_order(spark, d):
    tags = v_versions(spark, d).select("p_brand", "tag").distinct()
    return ranking.rank_within(tags, ["p_brand"], [ranking.version_key(F.col("tag"))], "place")


@query("SELECT conv_id, turn, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 50) AS BIGINT) AS batch, concat('Role: ', role, ', Text: ', regexp_replace(text, '\\s+', ' ', 'g')) AS line FROM conversations")
def dialog_batches(spark, d):
    rows = features.batches(table(spark, d, "conversations"), ["conv_id"], ["turn"], 50)
    return rows.select("conv_id", "turn", "batch", strings.prompt("Role: {role}, Text: {text}", role=F.col("role"), text=F.regexp_replace("text", r"\s+", " ")).alias("line"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def text_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
