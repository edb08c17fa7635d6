"""Linkage joins over parts, orders, events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixmine.functions import strings
from fixmine.operators import features, linkage, ranking
from fixmine.queries.base import query, table
from fixmine.store import dealt

_LCS = "list_max(list_transform(range(1, length({a}) + 1), lambda i: list_max(list_transform(range(0, length({a}) - i + 2), lambda n: CASE WHEN contains({b}, substr({a}, i, n)) THEN n ELSE 0 END))))"


@query(f"""
WITH a AS (SELECT DISTINCT lower(p_name) AS a FROM part), b AS (SELECT DISTINCT lower(c_mktsegment) AS b FROM customer),
s AS (SELECT a, b, CAST({_LCS.format(a='b', b='a')} AS BIGINT) AS lcs FROM a, b)
SELECT a, b, lcs FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY lcs DESC, lcs / length(b) DESC, b) AS r FROM s WHERE lcs > 2) WHERE r <= 10
""")
def lcs_similarity_top10(spark, d):
    a, b = table(spark, d, "part").select(F.lower("p_name").alias("a")), table(spark, d, "customer").select(F.lower("c_mktsegment").alias("b"))
    pairs = linkage.gram_blocked(a, "a", b, "b").withColumn("lcs", strings.longest_common_substring(F.col("b"), F.col("a")))
    return ranking.top_within(pairs, ["a"], [F.desc("lcs"), F.desc(F.col("lcs") / F.length("b")), "b"], 10)


# Pairs of names that have three characters in a row in common: no pair with a common substring of that length is left out.
_GRAMS = "(SELECT DISTINCT p_name, unnest(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i, 3))) AS g FROM part)"
_PAIRS = f"(SELECT DISTINCT a.p_name AS a, b.p_name AS b FROM {_GRAMS} a JOIN {_GRAMS} b ON a.g = b.g AND a.p_name < b.p_name)"


def _name_pairs(spark, d):
    p = table(spark, d, "part").select("p_name")
    return linkage.gram_blocked(p.select(F.col("p_name").alias("a")), "a", p.select(F.col("p_name").alias("b")), "b").where("a < b")


def _noiseless(letters: str) -> str:
    """SQL without the words that say nothing, written out."""
    for n in ("project", "plugin", "python", "javascript", "java", "android", "csharp", "ruby"):
        letters = f"replace({letters}, '{n}', '')"
    return letters


_LETTERS = _noiseless("regexp_replace(lower({}), '[^\\p{{L}}]', '', 'g')")


@query(f"SELECT a, b, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS edit, round(1 - levenshtein({_LETTERS.format('a')}, {_LETTERS.format('b')}) / greatest(length({_LETTERS.format('a')}), length({_LETTERS.format('b')})), 6) AS letters, round(1 - levenshtein({_LETTERS.format('a')}, {_LETTERS.format(chr(34) + 'noisy' + chr(34))}) / greatest(length({_LETTERS.format('a')}), length({_LETTERS.format(chr(34) + 'noisy' + chr(34))})), 6) AS noisy FROM (SELECT a, b, concat('Java ', b, ' plugin z') AS noisy FROM {_PAIRS})")
def edit_similarity(spark, d):
    a, b = F.col("a"), F.col("b")
    letters = lambda c: strings.edit_similarity(strings.letters_only(a), strings.letters_only(c))
    return _name_pairs(spark, d).select("a", "b", F.round(strings.edit_similarity(a, b), 6).alias("edit"), F.round(letters(b), 6).alias("letters"), F.round(letters(F.concat(F.lit("Java "), b, F.lit(" plugin z"))), 6).alias("noisy"))


@query(f"SELECT a, b, round(jaro_similarity(a, b), 6) AS jaro, round(jaro_winkler_similarity(a, b), 6) AS winkler FROM {_PAIRS}")
def jaro_family(spark, d):
    return _name_pairs(spark, d).select("a", "b", F.round(strings.jaro("a", "b"), 6).alias("jaro"), F.round(strings.jaro_winkler("a", "b"), 6).alias("winkler"))


# A row of the table of longest common subsequences from the one before and the places where a character of a occurs in b.
_ROW = "list_transform(range(1, len(m) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(r[k], CASE WHEN m[k] = 1 THEN CASE WHEN k > 1 THEN r[k - 1] ELSE 0 END + 1 ELSE 0 END))))"
_MATCHES = "list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(b) + 1), lambda k: CASE WHEN substr(a, i, 1) = substr(b, k, 1) THEN 1 ELSE 0 END))"


@query(f"SELECT a, b, round(2 * list_last(list_reduce(list_prepend(list_transform(range(1, length(b) + 1), lambda k: 0), {_MATCHES}), lambda r, m: {_ROW})) / (length(a) + length(b)), 6) AS indel FROM {_PAIRS}")
def indel_similarity(spark, d):
    return _name_pairs(spark, d).select("a", "b", F.round(strings.indel_ratio("a", "b"), 6).alias("indel"))


@query()
def similarity_blend(spark, d):
    """The mean of five similarities; two of them are in no SQL dialect."""
    a, b = F.col("a"), F.col("b")
    return _name_pairs(spark, d).select("a", "b", F.round(strings.block_ratio("a", "b"), 6).alias("blocks"), F.round(strings.indel_ratio("a", "b"), 6).alias("indel"), F.round(strings.mean_similarity(a, b), 6).alias("mean"))


_CLEAN = _noiseless("regexp_replace(lower({}), '[^\\p{{L}}]', ' ', 'g')")
_CLEAN = f"list_distinct(list_filter(string_split({_CLEAN}, ' '), lambda x: x <> ''))"


@query(f"""
SELECT a, b, CAST(CASE WHEN 2 * n >= len(x) AND 2 * n >= len(y) THEN 1 ELSE 0 END AS BIGINT) AS same FROM (SELECT a, b, x, y, len(list_intersect(x, y)) AS n FROM (
  SELECT a, b, {_CLEAN.format('a')} AS x, {_CLEAN.format('b')} AS y FROM (SELECT DISTINCT p_name AS a, concat(CASE WHEN p_size % 2 = 0 THEN 'JavaScript' ELSE 'linux' END, '/', p_type, ' plugin ', split_part(p_name, ' ', 1)) AS b FROM part)))
""")
def word_overlap_match(spark, d):
    pairs = table(spark, d, "part").select(F.col("p_name").alias("a"), F.concat(F.when(F.col("p_size") % 2 == 0, "JavaScript").otherwise("linux"), F.lit("/"), "p_type", F.lit(" plugin "), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("b")).distinct()
    return pairs.select("a", "b", strings.word_overlap(F.col("a"), F.col("b")).alias("same"))


_COMMITS = """
(SELECT concat('CVE-', CAST(year(o_orderdate) AS VARCHAR), '-', CAST(o_orderkey AS VARCHAR)) AS cve, h AS hash, substr(h, 1, 7) AS short, CASE l_returnflag WHEN 'R' THEN 'fix' WHEN 'A' THEN 'add' ELSE 'none' END || ' ' || CAST(l_partkey AS VARCHAR) AS subject
 FROM (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag, md5(concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_partkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR))) AS h FROM lineitem) JOIN orders ON o_orderkey = l_orderkey)
"""
_TRUTH = f"(SELECT DISTINCT cve, substr(hash, 1, 10) AS hash, '' AS title FROM {_COMMITS} c WHERE substr(hash, 1, 1) < '4')"


def v_commits(spark, d, by=None):
    """Changes made of line items, named by a digest; ``by``: a column that they are dealt out by, before digests and subjects are made."""
    s = lambda c: F.col(c).cast("string")
    h = F.md5(F.concat(s("l_orderkey"), F.lit("-"), s("l_partkey"), F.lit("-"), s("l_linenumber")))
    # rows alike in what the digest is made of are alike in the digest
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linenumber").repartition("l_orderkey").distinct()
    rows = lines.join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    named = rows.select(F.concat(F.lit("CVE-"), F.year("o_orderdate").cast("string"), F.lit("-"), s("o_orderkey")).alias("cve"), "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    word = F.when(F.col("l_returnflag") == "R", "fix").when(F.col("l_returnflag") == "A", "add").otherwise("none")
    return (dealt(named, [by], 1 << 17, table(spark, d, "lineitem")) if by else named).withColumn("hash", h).select("cve", "hash", F.substring("hash", 1, 7).alias("short"), F.concat(word, F.lit(" "), s("l_partkey")).alias("subject"))


def v_truth(spark, d):
    return _truth_of(v_commits(spark, d))


def _truth_of(commits):
    return commits.where(F.substring("hash", 1, 1) < "4").select("cve", F.substring("hash", 1, 10).alias("hash"), F.lit("").alias("title")).distinct()


def _match():
    return linkage.commit_match(F.col("p.hash"), F.col("p.short"), F.col("p.subject"), F.col("t.hash"), F.col("t.title"))


@query(f"SELECT p.cve, p.hash, p.subject FROM {_COMMITS} p WHERE EXISTS (SELECT 1 FROM {_TRUTH} t WHERE t.cve = p.cve AND (contains(p.hash, t.hash) OR contains(t.hash, p.short) OR contains(t.hash, p.hash)))")
def commit_theta_match(spark, d):
    return linkage.matched(v_commits(spark, d), v_truth(spark, d), "cve", _match()).select("cve", "hash", "subject")


@query(f"""
WITH p AS (SELECT * FROM {_COMMITS}), t AS (SELECT * FROM {_TRUTH}), m AS (SELECT p.cve, count(DISTINCT p.hash) AS hits, count(DISTINCT t.hash) AS found FROM p JOIN t ON p.cve = t.cve AND (contains(p.hash, t.hash) OR contains(t.hash, p.short)) GROUP BY 1)
SELECT round(avg(coalesce(hits, 0) / n), 6) AS precision, round(avg(least(1, coalesce(found, 0) / k)), 6) AS recall, count(*) AS groups
FROM (SELECT cve, count(DISTINCT hash) AS n FROM p GROUP BY 1) JOIN (SELECT cve, count(DISTINCT hash) AS k FROM t GROUP BY 1) USING (cve) LEFT JOIN m USING (cve)
""")
def linkage_precision_recall(spark, d):
    # dealt out by entity once, so that joins, distinct hashes and counts stay where the entity is
    p = v_commits(spark, d, "cve")
    t = _truth_of(p)

    def counted(side, other, kind, n, hits):
        pairs = linkage.matched(p, t, "cve", _match(), kind).groupBy(f"{side}.cve", f"{side}.hash").agg(F.max(F.col(f"{other}.hash").isNotNull().cast("long")).alias("hit"))
        return pairs.groupBy("cve").agg(F.count("hash").alias(n), F.sum(F.when(F.col("hash").isNotNull(), F.col("hit")).otherwise(0)).alias(hits))

    both = counted("p", "t", "left", "n", "hits").join(counted("t", "p", "right", "k", "found"), "cve")
    return both.agg(F.round(F.avg(F.col("hits") / F.col("n")), 6).alias("precision"), F.round(F.avg(F.least(F.lit(1.0), F.col("found") / F.col("k"))), 6).alias("recall"), F.count("*").alias("groups"))


@query("""
SELECT a.o_custkey AS o_custkey, a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND (b.o_orderdate, b.o_orderkey) > (a.o_orderdate, a.o_orderkey)
 AND floor(abs(epoch(a.o_orderdate) - epoch(b.o_orderdate)) / 86400) <= 30
""")
def interval_related(spark, d):
    return linkage.interval_pairs(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey", 30)


_BANDS = "(SELECT p_partkey, p_retailprice / 10 AS low, p_retailprice / 10 + p_size / 25.0::DOUBLE AS high FROM part)"


@query(f"SELECT event_id, count(*) AS bands, min(p_partkey) AS first FROM events JOIN {_BANDS} ON value BETWEEN low AND high GROUP BY event_id")
def line_range_join(spark, d):
    bands = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") / 10).alias("low"), (F.col("p_retailprice") / 10 + F.col("p_size") / 25.0).alias("high"))
    held = linkage.summed_ranges(table(spark, d, "events").select("event_id", "value"), "value", bands, "low", "high", "p_partkey", 2.0)
    return held.groupBy("event_id").agg(F.sum("count").alias("bands"), F.min("first").alias("first"))


@query("""
WITH e AS (SELECT user_id, event_type, year(ts) * 12 + month(ts) AS m FROM events), k AS (SELECT (min(m) + max(m)) // 2 AS half FROM e),
a AS (SELECT user_id, event_type, count(*) AS before FROM e, k WHERE m <= half GROUP BY 1, 2), b AS (SELECT user_id, event_type, count(*) AS after FROM e, k WHERE m > half GROUP BY 1, 2)
SELECT user_id, event_type, before, after, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'deleted' WHEN before = after THEN 'same' ELSE 'modified' END AS status FROM a FULL JOIN b USING (user_id, event_type)
""")
def full_outer_alignment(spark, d):
    """Events of each user and type in the first half of the months against those in the second."""
    e = table(spark, d, "events").withColumn("m", F.year("ts") * 12 + F.month("ts"))
    e = e.join(F.broadcast(e.agg(F.expr("(min(m) + max(m)) div 2").alias("half"))), F.lit(True))
    count = lambda part: e.where(part).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return linkage.aligned(count("m <= half"), count("m > half"), ["user_id", "event_type"], "n")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS representative, count(*) OVER (PARTITION BY md5(text)) AS copies FROM documents QUALIFY count(*) OVER (PARTITION BY md5(text)) > 1")
def equivalent_pairs(spark, d):
    return linkage.equivalent_pairs(table(spark, d, "documents"), "doc_id", F.col("text"))


@query("""
WITH l AS (SELECT doc_id // 100 AS g, doc_id, quality FROM labels), p AS (SELECT g, doc_id AS p FROM l WHERE quality = 1), n AS (SELECT g, doc_id AS n FROM l WHERE quality = 0),
x AS (SELECT p.g, p, n, row_number() OVER (PARTITION BY p.g ORDER BY p, n) % 2 = 0 AS flipped FROM p JOIN n ON p.g = n.g)
SELECT g, CASE WHEN flipped THEN n ELSE p END AS "left", CASE WHEN flipped THEN p ELSE n END AS "right", flipped FROM x
""")
def pos_neg_pairs(spark, d):
    rows = table(spark, d, "labels").withColumn("g", F.floor(F.col("doc_id") / 100).cast("long"))
    return linkage.alternate_pairs(rows, "g", "quality", "doc_id")


@query("SELECT source, row_number() OVER (ORDER BY f, source) - 1 AS code FROM (SELECT source, min(doc_id) AS f FROM documents GROUP BY 1)")
def factorize_codes(spark, d):
    return linkage.factorise(table(spark, d, "documents"), "source", "doc_id")


_COUNTS = "(SELECT {k}, token, count(*) AS n FROM (SELECT {k}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM {t}) GROUP BY 1, 2)"
_DOCS, _ITEMS = _COUNTS.format(k="doc_id", t="documents"), _COUNTS.format(k="item_id", t="benchmark")


def _counts(spark, d, name, key):
    # texts are dealt out by key once, so that what is counted for a key and for its pairs stays where the text is
    return features.term_counts(table(spark, d, name).select(key, "text").repartition(key).withColumn("tokens", strings.alnum_tokens(F.col("text"))), key, "tokens")


@query(f"""
WITH s AS (SELECT item_id, count(*) AS size FROM {_ITEMS} GROUP BY 1)
SELECT doc_id, i.item_id, count(*) AS shared, round(count(*) / any_value(size), 6) AS ratio, min(least(d.n, i.n)) AS low, max(least(d.n, i.n)) AS high, CAST(sum(least(d.n, i.n)) AS BIGINT) AS total, round(avg(least(d.n, i.n)), 6) AS mean, round(var_pop(least(d.n, i.n)), 6) AS var
FROM {_DOCS} d JOIN {_ITEMS} i USING (token) JOIN s USING (item_id) GROUP BY doc_id, i.item_id
""")
def shared_token_stats(spark, d):
    s = features.shared_tokens(_counts(spark, d, "documents", "doc_id"), "doc_id", _counts(spark, d, "benchmark", "item_id"), "item_id")
    return s.select("doc_id", "item_id", "shared", F.round("ratio", 6).alias("ratio"), "low", "high", "total", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


_WEIGHTS = "(SELECT {k}, token, w, sqrt(sum(w * w) OVER (PARTITION BY {k})) AS norm FROM (SELECT {k}, token, n / (sum(n) OVER (PARTITION BY {k}) + 1) * idf AS w FROM {c} JOIN i USING (token)))"


@query(f"""
WITH i AS (SELECT token, ln((SELECT count(*) FROM documents) / (count(*) + 1)) AS idf FROM {_DOCS} GROUP BY 1)
SELECT doc_id, item_id, round(coalesce(sum(a.w * b.w) / nullif(any_value(a.norm) * any_value(b.norm), 0), 0), 4) AS cosine FROM {_WEIGHTS.format(k='doc_id', c=_DOCS)} a JOIN {_WEIGHTS.format(k='item_id', c=_ITEMS)} b USING (token) GROUP BY 1, 2
""")
def tfidf_cosine(spark, d):
    counts = _counts(spark, d, "documents", "doc_id")
    idfs = features.idf(counts, table(spark, d, "documents").count())
    pairs = features.cosines(counts, "doc_id", _counts(spark, d, "benchmark", "item_id"), "item_id", idfs)
    return pairs.select("doc_id", "item_id", F.round("cosine", 4).alias("cosine"))


_SETS = "(SELECT {k}, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM {t})"


@query(f"""
WITH p AS (SELECT doc_id, item_id, count(*) AS shared FROM (SELECT doc_id, unnest(w) AS t FROM {_SETS.format(k='doc_id', t='documents')}) JOIN (SELECT item_id, unnest(w) AS t FROM {_SETS.format(k='item_id', t='benchmark')}) USING (t) GROUP BY 1, 2)
SELECT doc_id, item_id, shared, round(shared / len(i.w), 6) AS ratio, round(shared / greatest(len(d.w), len(i.w)), 6) AS coefficient
FROM p JOIN {_SETS.format(k='doc_id', t='documents')} d USING (doc_id) JOIN {_SETS.format(k='item_id', t='benchmark')} i USING (item_id) WHERE 2 * shared >= len(i.w)
""")
def token_overlap_ratio(spark, d):
    """Documents with half of an item's distinct tokens or more."""
    sets = lambda t, k: table(spark, d, t).select(k, F.array_distinct(strings.alnum_tokens(F.col("text"))).alias("w"))
    s = features.overlapping(sets("documents", "doc_id"), "doc_id", sets("benchmark", "item_id"), "item_id", "w", 0.5)
    return s.select("doc_id", "item_id", "shared", F.round("ratio", 6).alias("ratio"), F.round("coefficient", 6).alias("coefficient"))


@query(f"""
WITH i AS (SELECT a.o_custkey, a.o_orderkey AS a, b.o_orderkey AS b, a.o_orderpriority || ' ' || a.o_orderstatus AS m, b.o_orderpriority || ' ' || b.o_orderstatus AS n FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND (b.o_orderdate, b.o_orderkey) > (a.o_orderdate, a.o_orderkey)
 AND floor(abs(epoch(a.o_orderdate) - epoch(b.o_orderdate)) / 86400) <= 90)
SELECT o_custkey, a, b FROM i WHERE contains(n, '1-') AND contains(m, '1-') OR m = n OR contains(m, n) OR contains(n, m) OR contains(m, '1-URGENT F') OR contains(n, '1-URGENT F')
""")
def interval_related_messages(spark, d):
    """Changes of one customer within 90 days whose messages go together, or one of which has the other's id."""
    o = table(spark, d, "orders").withColumn("message", F.concat_ws(" ", "o_orderpriority", "o_orderstatus")).withColumn("named", F.when(F.contains("message", F.lit("1-")), "1-").otherwise("1-URGENT F"))
    return linkage.interval_pairs(o, "o_custkey", "o_orderdate", "o_orderkey", 90, "message", "named")


@query("""
SELECT id, same, round(same / (n + 1), 6) AS share, m - same AS other FROM (
 SELECT p_partkey AS id, 2 AS n, 2 AS m, (CASE WHEN contains(a, b) OR contains(a, c) THEN 1 ELSE 0 END + CASE WHEN contains(e, b) OR contains(e, c) THEN 1 ELSE 0 END)::BIGINT AS same FROM (
  SELECT p_partkey, concat('src/', p_type, '/', p_name) AS a, concat('lib/', p_brand) AS e, split_part(p_name, ' ', 1) AS b, concat('Brand#', CAST(p_size AS VARCHAR)) AS c FROM part))
""")
def location_overlap(spark, d):
    own = F.array(F.concat(F.lit("src/"), F.col("p_type"), F.lit("/"), F.col("p_name")), F.concat(F.lit("lib/"), F.col("p_brand")))
    named = F.array(F.split_part("p_name", F.lit(" "), F.lit(1)), F.concat(F.lit("Brand#"), F.col("p_size").cast("string")))
    same, share, other = strings.location_overlap(own, named)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), same.alias("same"), F.round(share, 6).alias("share"), other.alias("other"))
