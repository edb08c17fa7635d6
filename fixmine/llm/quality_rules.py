"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

Every rule compares a multiple of one measure with a multiple of another (or of one), in whole numbers, so that no
verdict hangs on how a ratio is rounded. Measures are lengths, symbols, stop words, lines and repeats of one text; none needs
another row, so the table is read once and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixmine.llm.store import columns_for, spare

SYMBOLS, MARKS = "#*$%&|<>", "!?"
_SPACES = " \t\n\x0b\x0c\r"
#: Frequent function words of the languages that are expected; a text needs a few of any of them.
STOP_WORDS = {
    "en": "the be to of and that have with in is for on as are was this by from or an at it not".split(),
    "de": "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se avec ce".split(),
}


@dataclass(frozen=True)
class Rule:
    """Fails where ``scale * measure`` is below ``least`` or above ``most`` times the measure ``of``."""

    name: str
    measure: str
    of: str
    scale: int = 100
    least: int | None = None
    most: int | None = None


BASE = (
    Rule("words", "n_words", "one", 1, least=50),
    Rule("repeats", "n_repeat_words", "n_words", 100, most=50),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", 1, least=2, most=16),
    Rule("symbols", "n_symbols", "n_words", 100, most=10),
    Rule("marks", "n_marks", "n_words", 100, most=30),
    Rule("stop_words", "n_stop_words", "one", 1, least=2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 100, most=50),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", 100, most=30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", 100, most=90),
)


def measures(docs: DataFrame, text: str = "text", stop_words: dict[str, list[str]] = STOP_WORDS) -> DataFrame:
    """``docs`` with the measures of ``text`` as further columns; a null text has no words and no lines.

    Words are runs outside ``\\x20\\x09-\\x0D``, lines are split at \\n and count only with a word. n_repeat_words: words in windows of three words
    that the text holds twice or more: windows are sorted with their places, equal neighbours are marked, and the places that
    they cover are counted once. n_stop_words: different stop words, in lower case.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("_words", F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    rows = rows.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(_SPACES)) != ""))
    # a window is a hash above its place, in one number: the sort of windows is one of plain numbers
    rows = rows.withColumn("_bits", F.length(F.bin(F.size("_words"))))
    hashed = "shiftleft(xxhash64(w, get(_words, i + 1), get(_words, i + 2)), _bits) | i"
    rows = rows.withColumn("_windows", F.expr(f"sort_array(slice(transform(_words, (w, i) -> {hashed}), 1, greatest(size(_words) - 2, 0)))"))
    alike = "filter(_windows, (x, i) -> shiftright(x, _bits) <=> shiftright(get(_windows, i - 1), _bits) OR shiftright(x, _bits) <=> shiftright(get(_windows, i + 1), _bits))"
    rows = rows.withColumn("_alike", F.expr(f"transform({alike}, x -> cast(x & (shiftleft(1L, _bits) - 1) as int))"))
    # the few that are alike in hash are compared by their words
    exact = "struct(concat_ws(' ', get(_words, i), get(_words, i + 1), get(_words, i + 2)) AS w, i AS i)"
    rows = rows.withColumn("_exact", F.expr(f"sort_array(transform(_alike, i -> {exact}))"))
    again = "filter(_exact, (x, i) -> x.w <=> get(_exact, i - 1).w OR x.w <=> get(_exact, i + 1).w)"
    size = lambda c: F.size(c).cast("long")
    every = F.array(*[F.lit(w) for w in sorted({w for words in stop_words.values() for w in words})])
    numbers = F.struct(
        F.lit(1).cast("long").alias("one"), size("_words").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"), F.regexp_count(t, F.lit(f"[{MARKS}]")).cast("long").alias("n_marks"),
        size("_lines").alias("n_lines"), (size("_lines") - size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        size(F.expr(f"array_distinct(flatten(transform({again}, x -> array(x.i, x.i + 1, x.i + 2))))")).alias("n_repeat_words"),
        size(F.array_intersect("_words", every)).alias("n_stop_words"),
        size(F.filter("_lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).alias("n_ellipsis_lines"),
        size(F.expr("filter(_lines, x -> x rlike '^[\\\\x20\\\\x09-\\\\x0D]*([-*•●]|[0-9]+[.)])[\\\\x20\\\\x09]')")).alias("n_bullet_lines"),
    )
    # a generator, as a filter on a measure would else be pushed below the steps above and repeat them in itself
    return rows.select(*docs.columns, F.inline(F.array(numbers)))


def failed(rule: Rule) -> Column:
    value, limit = F.col(rule.measure) * rule.scale, F.col(rule.of)
    out = F.lit(False)
    if rule.least is not None:
        out = out | (value < limit * rule.least)
    if rule.most is not None:
        out = out | (value > limit * rule.most)
    return out


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Every row of ``docs`` (doc_id, text and any other columns) with its measures, base_failed, failed_rules and kept.

    failed_rules: names of the rules that fail, in the order of the tables, joined by commas. kept: no rule fails. A null, empty or
    wordless text fails the rule of the number of words. Rows that repeat fare alike; an empty table gives an empty
    table; other columns are not read.
    """
    rows = measures(columns_for(docs, doc_id="long", text="string")).drop("text")
    names = F.concat_ws(",", *[F.when(failed(r), F.lit(r.name)) for r in (*base, *rules)])
    base_failed = F.lit(False)
    for r in base:
        base_failed = base_failed | failed(r)
    return rows.withColumn("failed_rules", names).withColumn("base_failed", base_failed).withColumn("kept", F.col("failed_rules") == "")


def rule_report(docs: DataFrame) -> DataFrame:
    """The numbers of every document, and the verdict."""
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def accepted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, as they were."""
    name = spare(docs, "row")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name), F.col("text").cast("string").alias("text"))
    kept = F.lit(True)
    for r in (*base, *rules):
        kept = kept & ~failed(r)
    return measures(whole).where(kept).select(f"{name}.*")
