"""The registered queries of the corpus operators: one thin query per operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


from fixmine.llm.store import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


@query
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixmine.llm.near_dedup import near_groups

    return near_groups(read(spark, sf_dir, "documents"))


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixmine.llm.exact_dedup import exact_groups

    return exact_groups(read(spark, sf_dir, "documents"))


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixmine.llm.line_dedup import line_report

    return line_report(read(spark, sf_dir, "documents"))


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixmine.llm.decontaminate import leaks

    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixmine.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"))


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixmine.llm.secrets import scan_in_increments

    return scan_in_increments(read(spark, sf_dir, "documents"))


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixmine.llm.html_text import extract

    return extract(read(spark, sf_dir, "pages"))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixmine.llm.token_files import token_counts

    return token_counts(read(spark, sf_dir, "documents"))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixmine.llm.quality import classify

    return classify(read(spark, sf_dir, "documents"))


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixmine.llm.language import identify

    return identify(read(spark, sf_dir, "documents"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixmine.llm.periodic import run_report, with_planted_runs

    return run_report(with_planted_runs(read(spark, sf_dir, "documents")))


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixmine.llm.spelling import group_variants, letter_runs, with_planted_errors, word_counts

    return group_variants(word_counts(with_planted_errors(letter_runs(read(spark, sf_dir, "documents")))))


@query
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fixmine.llm.quality_rules import rule_report

    return rule_report(read(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op6_exact_dedup"] = f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""

ORACLES["op7_line_dedup"] = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.doc_id, k.pos, k.line, s.top IS NULL OR s.top = k.doc_id AS stays FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

_WORDS = f"list_filter(regexp_split_to_array({_LOWER}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"
_SETS = """
list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
     ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END)
"""

ORACLES["op1_decontaminate"] = f"""
WITH d AS (SELECT doc_id, unnest({_SETS}) AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
b AS (SELECT item_id, {_SETS} AS ss FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
i AS (SELECT item_id, len(ss) AS n_item, unnest(ss) AS s FROM b)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
FROM d JOIN i USING (s) GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item
"""

ORACLES["op10_near_dedup"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SETS} AS ss FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
p AS (SELECT doc_id, unnest(ss) AS s, len(ss) AS n FROM d),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM p a JOIN p b ON a.s = b.s AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.node WHERE r.root < l.y),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT doc_id, len(ss) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c ON c.node = d.doc_id
"""


# crc32 byte by byte, from the table that its polynomial gives
ORACLES["op12_spelling_variants"] = """
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
u AS (SELECT doc_id, w, count(*) AS c FROM r GROUP BY ALL),
b AS (SELECT w, c, flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [192 + (ord(x) >> 6), 128 + (ord(x) & 63)] END)) AS bytes FROM u),
h AS (SELECT w, c, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) AS h FROM b, t),
e AS (SELECT CASE WHEN h % 199 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
d AS (SELECT word, n, k, word[1:k - 1] || word[k + 1:] AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM v)),
p AS (SELECT a.word AS x, b.word AS y FROM d a JOIN d b ON a.cut = b.cut AND a.k = b.k AND a.word <> b.word
      UNION SELECT v.word, d.word FROM v JOIN d ON v.word = d.cut UNION SELECT d.word, v.word FROM v JOIN d ON v.word = d.cut),
near AS (SELECT p.x AS word, p.y AS other, o.n AS other_n, row_number() OVER (PARTITION BY p.x ORDER BY o.n DESC, p.y) AS place, count(*) OVER (PARTITION BY p.x) AS n_near FROM p JOIN v o ON o.word = p.y),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * v.n THEN other END AS form, CASE WHEN other_n >= 5 * v.n THEN other_n END AS form_n
      FROM v LEFT JOIN near ON near.word = v.word AND place = 1),
c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word JOIN f last ON last.word = c.at AND last.form IS NULL
"""


def _rules_sql() -> str:
    from fixmine.llm import quality_rules as q

    def fails(r: q.Rule) -> str:
        sides = [f"{r.scale} * {r.measure} < {r.least} * {r.of}" if r.least is not None else "", f"{r.scale} * {r.measure} > {r.most} * {r.of}" if r.most is not None else ""]
        return "(" + " OR ".join(x for x in sides if x) + ")"

    stop = ", ".join(f"'{w}'" for w in sorted({w for words in q.STOP_WORDS.values() for w in words}))
    names = ", ".join(f"CASE WHEN {fails(r)} THEN '{r.name}' END" for r in (*q.BASE, *q.RULES))
    return f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS l FROM w),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
a AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i) AS n_repeat_words FROM a GROUP BY doc_id),
m AS (SELECT l.doc_id, 1 AS one, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
      length(t) - length(translate(t, '!?', '')) AS n_marks, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
      len(list_distinct(list_filter(w, lambda x: x IN ({stop})))) AS n_stop_words,
      len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…) *$'))) AS n_ellipsis_lines,
      len(list_filter(l, lambda x: regexp_matches(x, '^[ \\t\\n\\x0B\\f\\r]*([-*•●]|[0-9]+[.)])[ \\t]'))) AS n_bullet_lines FROM l LEFT JOIN r ON r.doc_id = l.doc_id),
v AS (SELECT *, {" OR ".join(fails(x) for x in q.BASE)} AS base_failed, concat_ws(',', {names}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rules = '' AS kept, failed_rules FROM v
"""


ORACLES["op13_quality_rules"] = _rules_sql()

@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
