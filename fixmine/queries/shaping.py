"""Filters, joins, text, date and feature functions over rows of the tables, each against its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixmine.functions import strings, urls, values
from fixmine.operators import features, filters, linkage, models, parsing
from fixmine.queries.base import query, table
from fixmine.sources import files, records
from fixmine.store import scratch
from fixmine.streaming import stages


def spark_sql(e: str):
    """An expression that both engines read, but for the name of the type of text."""
    return F.expr(e.replace("AS VARCHAR)", "AS STRING)"))


@query("SELECT p_partkey FROM part WHERE p_size % 5 <> 0 AND length(p_name) < 12")
def row_guard(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("need"), "p_name")
    return files.guarded(rows, ["p_name"], ["need"], 12).select("p_partkey")


@query("SELECT p_partkey, p_size % 6 >= 3 AND length(p_name) < 11 AS ok FROM part")
def column_guard(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.array_repeat(F.lit("x"), (F.col("p_size") % 6).cast("int")).alias("cols"))
    return rows.select("p_partkey", filters.row_guard(F.col("cols"), 3, F.col("p_name"), 11).alias("ok"))


@query("""
WITH p AS (SELECT p_partkey AS id, 'o' || (p_size % 5) AS owner, 'r' || (p_size % 3) AS repo, p_partkey % 7 AS number FROM part), c AS (SELECT p_partkey % 100 + 1 AS parent, p_partkey AS id, 'o' || (p_size % 4) AS owner, 'r' || (p_size % 3) AS repo, p_partkey % 7 AS number FROM part)
SELECT c.parent, c.id, c.repo FROM c JOIN p ON p.id = c.parent WHERE c.repo = p.repo AND (c.owner = p.owner OR c.number = p.number)
""")
def pruned_children(spark, d):
    part, name = table(spark, d, "part"), lambda a, m: F.concat(F.lit(a), (F.col("p_size") % m).cast("string"))
    parents = part.select(F.col("p_partkey").alias("id"), name("o", 5).alias("owner"), name("r", 3).alias("repo"), (F.col("p_partkey") % 7).alias("number"))
    children = part.select((F.col("p_partkey") % 100 + 1).alias("parent"), F.col("p_partkey").alias("id"), name("o", 4).alias("owner"), name("r", 3).alias("repo"), (F.col("p_partkey") % 7).alias("number"))
    return filters.pruned_children(children.union(children), parents).select("parent", "id", "repo")


@query("SELECT p_partkey, p_partkey % 2 = 0 AND p_partkey % 3 = 0 AND p_size % 2 = 0 AS diff FROM part")
def diff_text(spark, d):
    text = spark_sql("concat(CASE WHEN p_partkey % 2 = 0 THEN '--- a' ELSE 'x' END, CASE WHEN p_partkey % 3 = 0 THEN '+++ b' ELSE 'y' END, CASE WHEN p_size % 2 = 0 THEN '@@ -1' ELSE '@' END)")
    return table(spark, d, "part").select("p_partkey", filters.is_diff(text).alias("diff"))


_SUFFIXES = "c H cpp cxx cc c++ h++ HPP hxx inl ii ixx java py rb js php html htm css sql swift go pl lua R matlab vb md txt".split()


@query(f"""
WITH p AS (SELECT p_partkey, ['{"', '".join(_SUFFIXES)}'][1 + p_partkey % {len(_SUFFIXES)}] AS e FROM part)
SELECT p_partkey, l AS language, l IN ('C', 'Go', 'Python', 'Cpp', 'Java', 'JavaScript') AS searched FROM (SELECT p_partkey,
  CASE WHEN lower(e) IN ('c', 'h') THEN 'C' WHEN lower(e) IN ('cpp', 'cxx', 'cc', 'c++', 'h++', 'hpp', 'hxx', 'inl', 'ii', 'ixx') THEN 'Cpp' WHEN e IN ('html', 'htm') THEN 'HTML'
  ELSE coalesce(MAP {{'java': 'Java', 'py': 'Python', 'rb': 'Ruby', 'js': 'JavaScript', 'php': 'PHP', 'css': 'CSS', 'sql': 'SQL', 'swift': 'Swift', 'go': 'Go', 'pl': 'Perl', 'lua': 'Lua', 'r': 'R', 'matlab': 'MATLAB', 'vb': 'Visual Basic'}}[lower(e)], 'Unknown') END AS l FROM p)
""")
def path_language(spark, d):
    """The language of each path, and whether its functions are searched."""
    path = F.concat(F.lit("src/v1.2/f."), F.element_at(F.array(*map(F.lit, _SUFFIXES)), (F.col("p_partkey") % len(_SUFFIXES) + 1).cast("int")))
    return table(spark, d, "part").select("p_partkey", strings.language_of(path).alias("language"), strings.is_searched(path).alias("searched"))


_MESSAGES = "SELECT o_orderkey, concat(o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN ' ' || o_orderstatus || ' fix' ELSE '' END) AS a, concat(o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN ' ' || o_orderstatus ELSE '' END) AS b, CASE WHEN o_orderkey % 5 = 0 THEN '1-' ELSE 'none' END AS i FROM {orders}"


@query(f"SELECT o_orderkey, contains(a, i) OR (contains(trim(a), ' ') AND contains(trim(b), ' ') AND (contains(a, b) OR contains(b, a))) AS ok FROM ({_MESSAGES.format(orders='orders')})")
def valid_messages(spark, d):
    rows = spark.sql(_MESSAGES, orders=table(spark, d, "orders"))
    return rows.select("o_orderkey", linkage.valid_message(F.col("a"), F.col("b"), F.col("i")).alias("ok"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'ABC-' || p_size ELSE 'ABC-' || p_size || ' DEF-1' END AS keys FROM part")
def issue_keys_without_cve(spark, d):
    keys = F.array(F.concat(F.lit("ABC-"), F.col("p_size").cast("string")), F.when(F.col("p_size") % 2 == 0, "CVE-2020-1").otherwise("DEF-1"))
    return table(spark, d, "part").select("p_partkey", F.array_join(filters.without_prefix(keys), " ").alias("keys"))


@query("SELECT o_orderkey, 'train' AS side FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) UNION ALL SELECT o_orderkey, 'test' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def train_test_split(spark, d):
    members = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    train, test = filters.train_test(table(spark, d, "orders"), members, "o_custkey")
    return train.select("o_orderkey", F.lit("train").alias("side")).union(test.select("o_orderkey", F.lit("test")))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'O'")
def subset_by_attributes(spark, d):
    return table(spark, d, "orders").where((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderstatus") == "O")).select("o_orderkey")


@query("SELECT o_orderkey, c_mktsegment, coalesce(c_acctbal, 0.5) AS c_acctbal, coalesce(n, 0) AS n FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey")
def left_features(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    n = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    out = linkage.left_features(table(spark, d, "orders").select("o_orderkey", "o_custkey"), [(c, ["o_custkey"]), (n, ["o_orderkey"])], {"c_acctbal": 0.5, "n": 0})
    return out.select("o_orderkey", "c_mktsegment", "c_acctbal", "n")


@query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F') ON l_orderkey = o_orderkey AND l_suppkey = o_custkey % 50 + 1")
def inner_merge(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 50 + 1).alias("l_suppkey"), "o_orderstatus")
    return linkage.merged(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber"), o, ["l_orderkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "o_orderstatus")


_ISSUES = "SELECT p_partkey AS entity, concat('KEY-', CAST(p_partkey % 50 AS VARCHAR(9))) AS key, p_brand AS product FROM {part} WHERE p_partkey % 10 = 0"
_CHANGES = "SELECT concat('Brand#', CAST(p_size % 60 AS VARCHAR(9))) AS repo, concat('h', CAST(p_partkey AS VARCHAR(9))) AS hash, concat('fixes key-', CAST(p_size AS VARCHAR(9)), ' and KEY-', CAST(p_partkey % 20 AS VARCHAR(9)), 'x') AS message FROM {part}"


@query(f"SELECT DISTINCT entity, key, hash FROM ({_ISSUES.format(part='part')}) i JOIN ({_CHANGES.format(part='part')}) c ON regexp_matches(upper(message), key || '([^0-9]|$)') WHERE 1 - levenshtein(product, repo) / greatest(length(product), length(repo)) >= 0.8")
def issue_search(spark, d):
    part = table(spark, d, "part")
    return linkage.issue_search(spark.sql(_ISSUES, part=part), spark.sql(_CHANGES, part=part), strings.edit_similarity(F.col("product"), F.col("repo")), 0.8)


_BRANCHES = "SELECT p_size AS entity, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS branch, CASE WHEN p_partkey % 3 = 0 THEN substr(md5(CAST(p_partkey % 40 AS VARCHAR(9))), 1, 6) ELSE md5(CAST(p_partkey % 40 AS VARCHAR(9))) END AS patch FROM {part}"


@query(f"""
WITH t AS ({_BRANCHES.format(part='part')}), k AS (SELECT * FROM t WHERE branch IS NOT NULL)
SELECT entity, branch, patch FROM k UNION ALL SELECT DISTINCT t.entity, (SELECT min(k.branch) FROM k WHERE k.entity = t.entity AND (contains(k.patch, t.patch) OR contains(t.patch, k.patch))) AS branch, t.patch FROM t WHERE t.branch IS NULL
""")
def merged_branches(spark, d):
    return linkage.merged_branches(spark.sql(_BRANCHES, part=table(spark, d, "part")))


_TAGS = "SELECT p_brand, concat('v', CAST(p_size AS VARCHAR(9))) AS wanted, concat('v', CAST(p_partkey % 30 AS VARCHAR(9)), CASE WHEN p_partkey % 4 = 0 THEN '.1' ELSE '' END) AS tag FROM {part}"


@query(f"""
WITH t AS ({_TAGS.format(part='part')}), x AS (SELECT DISTINCT a.p_brand, a.wanted, b.tag FROM t a JOIN t b USING (p_brand)),
s AS (SELECT *, CASE WHEN wanted = tag THEN 3.0 WHEN contains(wanted, tag) OR contains(tag, wanted) THEN 2.0 ELSE 1 - levenshtein(wanted, tag) / greatest(length(wanted), length(tag)) END AS s FROM x)
SELECT p_brand, wanted, min(tag) AS tag FROM (SELECT * FROM s QUALIFY s = max(s) OVER (PARTITION BY p_brand, wanted)) GROUP BY 1, 2
""")
def closest_tag(spark, d):
    t = spark.sql(_TAGS, part=table(spark, d, "part"))
    pairs = t.select("p_brand", "wanted").distinct().join(t.select("p_brand", "tag").distinct(), "p_brand")
    return linkage.closest(pairs, ["p_brand"], "wanted", "tag", strings.edit_similarity(F.col("wanted"), F.col("tag")))


@query("SELECT row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS place, p_partkey FROM part")
def global_order(spark, d):
    from fixmine.operators.ranking import numbered

    return numbered(table(spark, d, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), "p_partkey"], "place").select("place", "p_partkey")


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE 'my' || lower(replace(p_brand, '#', '')) || 'x' END AS product FROM part")
def product_keys(spark, d):
    cpe = spark_sql("CASE WHEN p_size % 7 = 0 THEN 'cpe:2.3:a' ELSE concat('cpe:2.3:a:vendor:My_', p_brand, '-X:1.0') END")
    return table(spark, d, "part").select("p_partkey", strings.product_key(cpe).alias("product"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'https://github.com/o/r/commit/' || p_partkey ELSE 'https://github.com/o/r/pull/' || p_partkey END AS page FROM part")
def api_pages(spark, d):
    url = spark_sql("concat('https://api.github.com/repos/o/r/', CASE WHEN p_size % 2 = 0 THEN 'commits/' ELSE 'pulls/' END, CAST(p_partkey AS VARCHAR))")
    return table(spark, d, "part").select("p_partkey", urls.api_to_page(url).alias("page"))


@query("SELECT p_partkey, concat(p_partkey, ',', p_size) AS numbers FROM part")
def issue_numbers(spark, d):
    text = spark_sql("concat('see #', CAST(p_partkey AS VARCHAR), ' and 77 (gh#', CAST(p_size AS VARCHAR), '-5) # none')")
    return table(spark, d, "part").select("p_partkey", F.array_join(parsing.issue_numbers(text), ",").alias("numbers"))


@query("SELECT p_partkey, array_to_string(list_sort(['f', 'v' || p_partkey, 'len' || p_size, 'buf', 'size', 't', 'public', 'Int']), ' ') AS names FROM part")
def header_names(spark, d):
    """Names of headers: 32 keywords are none, case counts, and an underscore parts names."""
    text = spark_sql("concat('public static volatile Int f_v', CAST(p_partkey AS VARCHAR), '(register const char *buf, size_t len', CAST(p_size AS VARCHAR), ', unsigned long buf, enum signed short double)')")
    return table(spark, d, "part").select("p_partkey", F.array_join(strings.header_tokens(text), " ").alias("names"))


@query("SELECT doc_id, regexp_replace(replace(replace(replace(concat('a', chr(92), 'n ', text, chr(92), 'r', chr(92), 'n  ', chr(92), 't z', chr(92), 'r '), chr(92) || 'r' || chr(92) || 'n', ' '), chr(92) || 'n', ' '), chr(92) || 'r', ' '), ' +', ' ', 'g') AS line FROM documents")
def squeezed(spark, d):
    """Spelled-out line breaks and runs of blanks become one blank; tabs, real line breaks and blanks at the ends stay."""
    slash = F.lit(chr(92))
    text = F.concat(F.lit("a"), slash, F.lit("n "), F.col("text"), slash, F.lit("r"), slash, F.lit("n  "), slash, F.lit("t z"), slash, F.lit("r "))
    return table(spark, d, "documents").select("doc_id", strings.squeeze(text).alias("line"))


@query("SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(lower(p_name), ' '), lambda x: x NOT IN ('red', 'blue')), lambda x: CASE x WHEN 'bolt' THEN 'screw' WHEN 'gear' THEN 'wheel' ELSE x END), ' ') AS tokens FROM part")
def stopped_tokens(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(strings.text_tokens(F.col("p_name"), ("red", "blue"), {"bolt": "screw", "gear": "wheel"}), " ").alias("tokens"))


@query("SELECT doc_id, CAST(contains(text, 'the') AS BIGINT) + CAST(contains(text, source) AS BIGINT) + CAST(contains(text, lang) AS BIGINT) AS n FROM documents")
def occurrences(spark, d):
    return table(spark, d, "documents").select("doc_id", strings.occurrences(F.array(F.lit("the"), "source", "lang"), F.col("text")).alias("n"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(['f' || p_size || '.c', 'g.h'])), ' ') AS names FROM part")
def base_names(spark, d):
    paths = F.array(spark_sql("concat('src/a/f', CAST(p_size AS VARCHAR), '.c')"), spark_sql("concat('lib/f', CAST(p_size AS VARCHAR), '.c')"), F.lit("g.h"))
    return table(spark, d, "part").select("p_partkey", F.array_join(strings.base_names(paths), " ").alias("names"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'http://a/' || p_partkey ELSE 'http://a/' || p_partkey || ' http://b/' || p_size END AS tagged, CASE WHEN p_size % 3 = 0 THEN 'http://b/' || p_size || ' http://c' ELSE 'http://c' END AS others FROM part")
def split_references(spark, d):
    refs = F.array(spark_sql("concat('http://a/', CAST(p_partkey AS VARCHAR), '__fdse__Patch')"), spark_sql("concat('http://b/', CAST(p_size AS VARCHAR), CASE WHEN p_size % 3 = 0 THEN '' ELSE '__fdse__Other__fdse__Issue' END)"), F.lit("http://c"))
    one, two = urls.split_references(refs, ("Patch", "Issue"))
    return table(spark, d, "part").select("p_partkey", F.array_join(one, " ").alias("tagged"), F.array_join(two, " ").alias("others"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def url_dates(spark, d):
    day = F.col("o_orderdate")
    url = F.concat(F.lit("https://x.org/"), F.when(F.col("o_orderkey") % 4 == 0, F.date_format(day, "yyyy/MM/dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format(day, "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 2, F.date_format(day, "yyyyMMdd")).otherwise("1999/13/45"), F.lit("/post"))
    return table(spark, d, "orders").select("o_orderkey", F.date_format(values.url_date(url), "yyyy-MM-dd").alias("day"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def named_dates(spark, d):
    day = F.col("o_orderdate")
    text = F.concat(F.lit("on "), F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "d MMMM yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "MMM d, yyyy")).otherwise("no day"), F.lit(" it was"))
    return table(spark, d, "orders").select("o_orderkey", F.date_format(values.month_name_date(text), "yyyy-MM-dd").alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '0' ELSE strftime(o_orderdate, '%Y%m%d') END AS day FROM orders")
def compact_dates(spark, d):
    line = F.when(F.col("o_orderkey") % 4 == 0, "broken").otherwise(F.concat(F.date_format("o_orderdate", "EEE MMM d"), F.lit(" 10:11:12 "), F.date_format("o_orderdate", "yyyy"), F.lit(" +0200")))
    return table(spark, d, "orders").select("o_orderkey", values.compact_date(line).alias("day"))


@query("SELECT o_orderkey, (o_orderkey % 7) * 3600.0 + (o_custkey % 60) * 60 + 1.5 AS seconds, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 10:20' WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 00:00' END AS at FROM orders")
def durations_and_times(spark, d):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.concat_ws(":", (k % 7).cast("string"), (F.col("o_custkey") % 60).cast("string"), F.lit("1.5"))
    at = F.when(k % 3 == 0, F.concat(day, F.lit("T10:20Z"))).when(k % 3 == 1, F.date_format("o_orderdate", "yyyy MM dd")).otherwise("never")
    return table(spark, d, "orders").select("o_orderkey", values.duration_seconds(text).alias("seconds"), F.date_format(values.parse_date(at), "yyyy-MM-dd HH:mm").alias("at"))


@query("""
SELECT p_partkey, round(one / total, 6) AS same, round(two / total, 6) AS related, round((4 + 8 - one - two + 1) / total, 6) AS other FROM (SELECT *, 13.0 AS total FROM (SELECT p_partkey,
 CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS one, CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 5 <> 0 AND p_size % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS two FROM part))
""")
def type_relations(spark, d):
    """Types a and b of a report against two of a change, and the impacts that each type has."""
    s = F.col("p_size")
    types = F.array(F.when(s % 3 == 0, "a").otherwise("x"), F.when(s % 2 == 0, "b").otherwise("y"))
    of = F.create_map(F.lit("a"), F.array(F.lit("leak"), F.lit("stop")), F.lit("b"), F.array(F.lit("none")), F.lit("x"), F.array(F.lit("none")), F.lit("y"), F.array(F.lit("none")))
    one, two, three = values.relation(F.array(F.lit("a"), F.lit("b")), types, F.array(F.lit("stop"), F.lit("zero")), F.array(F.when(s % 5 == 0, "leak").when(s % 3 == 0, "stop").otherwise("q"), F.lit("w")), of)
    return table(spark, d, "part").select("p_partkey", F.round(one, 6).alias("same"), F.round(two, 6).alias("related"), F.round(three, 6).alias("other"))


@query("""
SELECT p_partkey, len(list_intersect(x, y)) AS tokens_shared, round(len(list_intersect(x, y)) / len(x), 6) AS tokens_ratio, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS cves, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS issues, 1 AS links, 1 AS places, 0.5 AS places_ratio, 1 AS places_other FROM (
 SELECT p_partkey, p_size, list_distinct(regexp_extract_all(lower(concat(p_name, ' ', p_type, ' CVE-2020-1234 AB-', p_size, ' http://x/', p_partkey)), '[a-z0-9]+')) AS x,
  list_distinct(regexp_extract_all(lower(concat(p_name, CASE WHEN p_size % 2 = 0 THEN ' CVE-2020-1234' ELSE '' END, CASE WHEN p_size % 3 = 0 THEN ' AB-' || p_size ELSE '' END, ' http://x/', p_partkey)), '[a-z0-9]+')) AS y FROM part)
""")
def pair_features(spark, d):
    n, k = "CAST(p_size AS VARCHAR)", "CAST(p_partkey AS VARCHAR)"
    rows = table(spark, d, "part").select(
        "p_partkey", spark_sql(f"concat(p_name, ' ', p_type, ' CVE-2020-1234 AB-', {n}, ' http://x/', {k})").alias("said"),
        spark_sql(f"concat(p_name, CASE WHEN p_size % 2 = 0 THEN ' CVE-2020-1234' ELSE '' END, CASE WHEN p_size % 3 = 0 THEN concat(' AB-', {n}) ELSE '' END, ' http://x/', {k})").alias("message"),
        F.array(F.concat(F.lit("src/"), "p_name")).alias("files"), F.array("p_name", F.lit("nowhere")).alias("named"),
    )
    out = features.pair_features(rows, "said", "message", "files", "named")
    return out.select("p_partkey", "tokens_shared", F.round("tokens_ratio", 6).alias("tokens_ratio"), "cves", "issues", "links", "places", "places_ratio", "places_other")


@query("SELECT p_partkey, array_to_string(list_concat(list_transform(range(p_size % 4), lambda x: CAST(x AS DOUBLE)), list_transform(range(3 - least(3, p_size % 4)), lambda x: CAST(-1 AS DOUBLE))), ' ') AS padded FROM part")
def padded_vectors(spark, d):
    a = F.transform(F.when(F.col("p_size") % 4 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), (F.col("p_size") % 4 - 1).cast("int"))), lambda x: x.cast("double"))
    return table(spark, d, "part").select("p_partkey", F.array_join(values.pad(a, 3, -1.0), " ").alias("padded"))


@query("SELECT doc_id AS id, array_to_string(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')[1:128], ' ') AS text_a, lower(source) AS text_b, CAST(doc_id % 2 AS INTEGER) AS label FROM documents")
def pair_examples(spark, d):
    """Examples of all documents."""
    rows = table(spark, d, "documents").withColumn("y", F.col("doc_id") % 2)
    return models.examples(rows, "text", "source", "y", "doc_id")


@query("SELECT f AS fold, c AS kind, count(*) AS n FROM (SELECT CASE WHEN l_suppkey <= 10 THEN 'train' ELSE 'scored' END AS c, l_suppkey % 10 AS f FROM lineitem) GROUP BY 1, 2")
def group_sizes_for_transfer(spark, d):
    """How many lines of each supplier class a model is fitted on and asked for, when one group trains for all others."""
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_suppkey") <= 10, "train").otherwise("scored").alias("kind"), (F.col("l_suppkey") % 10).alias("fold"))
    return rows.groupBy("fold", "kind").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'second' ELSE 'first' END AS result FROM events")
def retried_rows(spark, d):
    """A second function for the rows that failed; those that fail again keep their error."""

    def first(x):
        if x in ("0", "3"):
            raise ValueError(x)
        return "first"

    def second(x):
        if x == "0":
            raise KeyError(x)
        return "second"

    rows = table(spark, d, "events").select("event_id", (F.col("event_id") % 6).cast("string").alias("x"))
    return stages.with_retry(rows, "event_id", "x", first, second).select("event_id", "status", "result")


@query("SELECT event_id, value * 2 AS value, 'b' AS stage FROM events WHERE event_type <> 'error' AND event_id % 2 = 0 OR event_type <> 'error' AND event_id % 3 = 0")
def staged_rows(spark, d):
    """Two stages over two deliveries; rows of the first are not run again in the second."""
    path = scratch(spark, "stages")
    steps = [("a", lambda x: x.where("event_type <> 'error'")), ("b", lambda x: x.select("event_id", (F.col("value") * 2).alias("value"), F.lit("b").alias("stage")))]
    events = table(spark, d, "events")
    stages.run_stages(events.where("event_id % 2 = 0"), "event_id", path, steps)
    return stages.run_stages(events.where("event_id % 2 = 0 OR event_id % 3 = 0"), "event_id", path, steps)


_URLS = ("https://securityfocus.com/bid/1", "http://OSVDB.org/x", "https://medium.com/")
_STATUS = (200, 204, 301, 400, 401, 403, 404, 410, 422, 429, 451, 500, 503, None)


@query(f"""
WITH a AS (SELECT o_orderkey, [{", ".join("NULL" if x is None else str(x) for x in _STATUS)}][1 + o_orderkey % {len(_STATUS)}] AS s, o_custkey % 3 AS r, ['{"', '".join(_URLS)}'][1 + o_orderkey % 3] AS u, o_custkey * 1000 AS size FROM orders),
v(s, spent, verdict) AS (VALUES (200, true, 'wait'), (200, false, 'done'), (204, true, 'wait'), (204, false, 'done'), (301, true, 'wait'), (301, false, 'done'), (403, true, 'wait'), (403, false, 'all wait')),
w(s, verdict) AS (VALUES (400, 'pass'), (404, 'pass'), (410, 'pass'), (422, 'pass'), (401, 'stop'), (429, 'all wait'), (451, 'all wait'), (500, 'all wait'), (503, 'all wait'))
SELECT o_orderkey, coalesce(v.verdict, w.verdict, 'retry') AS verdict, NOT contains(lower(u), 'securityfocus.com/bid') AND NOT contains(lower(u), 'osvdb.org/') AND size <= 1048576 AS fetchable
FROM a LEFT JOIN v ON v.s = a.s AND v.spent = (r = 0) LEFT JOIN w ON w.s = a.s
""")
def crawl_verdicts(spark, d):
    """What follows from each status, with and without requests that remain, and which pages may be fetched."""
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("o_orderkey") % len(values) + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", records.verdict(at(_STATUS), F.col("o_custkey") % 3).alias("verdict"), records.fetchable(at(_URLS), F.col("o_custkey") * 1000).alias("fetchable"))
