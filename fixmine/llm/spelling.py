"""Spelling variants: words one edit apart, joined on bands of letter parities.

The mask of a word has a bit for each letter, set where the letter occurs an odd number of times. One inserted, deleted or replaced
letter flips two bits at most, so of three bands of bits one is equal, and of the other bits, split into three bands again, one
more. Words meet on such an equal pair of bands and on a length that differs by one at most; a pair is looked at in its
first common pair of bands only, its masks may differ in two bits, and the edit distance of what is left is computed. Letters are
dealt to the bands by how evenly they split the vocabulary, so that bands are alike in size. Words are counted
before anything is joined: all later steps follow the vocabulary, not the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixmine.llm.store import columns_for, drop, keep

MIN_CHARS, MIN_COUNT = 6, 5
#: A form is this many times as frequent as its variant, at least.
RATIO = 5
#: Letters: a-z and all of U+00C0 to U+00FF, as only A-Z are lower-cased.
ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
BITS, BANDS = 60, 3
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def letter_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, word): every maximal run of letters of every text, with A-Z lower-cased; a null text has none."""
    rows = columns_for(docs, doc_id="long", text="string")
    low = F.translate("text", _UPPER, _UPPER.lower())
    return rows.select("doc_id", F.explode(F.regexp_extract_all(low, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("word"))


def with_planted_errors(runs: DataFrame, every: int = 199) -> DataFrame:
    """``runs`` where one of ``every`` words, by a crc32 of document and word, loses a letter; a null doc_id leaves words alone."""
    h = F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("word")))
    k = (F.col("h") % F.length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), k), F.substring("word", k + 2, F.length("word")))
    hit = F.col("doc_id").isNotNull() & (F.col("h") % every == 0)
    return runs.withColumn("h", h).select("doc_id", F.when(hit, cut).otherwise(F.col("word")).alias("word"))


def word_counts(words: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words that are long and frequent enough; frequent words are added up before they are shuffled."""
    long = words.where(F.length("word") >= min_chars)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _deal(items: list, hands: int) -> list[list]:
    """Deal to and fro."""
    out: list[list] = [[] for _ in range(hands)]
    for k, x in enumerate(items):
        turn, seat = divmod(k, hands)
        out[seat if turn % 2 == 0 else hands - 1 - seat].append(x)
    return out


def band_pairs() -> list[tuple[int, int]]:
    """(band, second band) as bit masks for each of the nine pairs; bit 0 is the letter that splits words most evenly."""
    out = []
    for first in _deal(list(range(BITS)), BANDS):
        rest = [b for b in range(BITS) if b not in first]
        out += [(sum(1 << b for b in first), sum(1 << b for b in second)) for second in _deal(rest, BANDS)]
    return out


def _letters_by_evenness(words: DataFrame) -> str:
    """The alphabet, letters first that are odd in about half of the words: one row of counts of the vocabulary."""
    odd = [F.sum((F.length("word") - F.length(F.replace("word", F.lit(c), F.lit("")))) % 2).alias(f"c{k}") for k, c in enumerate(ALPHABET)]
    n, *counts = words.agg(F.count("*"), *odd).first()
    return "".join(sorted(ALPHABET, key=lambda c: (abs(n - 2 * (counts[ALPHABET.index(c)] or 0)), c)))


def parity_mask(word: Column | str, letters: str) -> Column:
    """A bit for each letter by its place in ``letters`` (from ``BITS`` on places share bits), set where it occurs an odd number of times."""
    chars = F.split(word, "")
    # other characters share the first bit
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.instr(F.lit(letters), c) - 1, F.lit(BITS)))
    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0).cast("long"), lambda acc, c: acc.bitwiseXOR(bit(c)))


def near_pairs(counts: DataFrame) -> DataFrame:
    """(word, n, other, other_n), both ways, of all distinct words of ``counts`` (word, n) that one edit of a code point takes to each other."""
    letters = _letters_by_evenness(counts)
    masked = counts.select("word", "n", parity_mask("word", letters).alias("mask"), F.length("word").alias("size"))
    pairs = band_pairs()
    keyed = masked.withColumn("key", F.explode(F.array(*[F.struct(F.lit(k).alias("pair"), F.col("mask").bitwiseAND(F.lit(a | b)).alias("bits")) for k, (a, b) in enumerate(pairs)])))
    short = keyed.select("key.pair", "key.bits", F.explode(F.array("size", F.col("size") + 1)).alias("size"), F.col("size").alias("size_a"), F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("mask").alias("mask_a"))
    long = keyed.select("key.pair", "key.bits", "size", F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("mask").alias("mask_b"))
    flips = F.col("mask_a").bitwiseXOR(F.col("mask_b"))
    # the first pair of bands in which nothing is flipped
    first = F.lit(None).cast("int")
    for k, (a, b) in reversed(list(enumerate(pairs))):
        first = F.when(flips.bitwiseAND(F.lit(a | b)) == 0, F.lit(k)).otherwise(first)
    near = (F.bit_count(flips) <= 2) & ((F.col("size_a") < F.col("size")) | (F.col("a") < F.col("b"))) & (first == F.col("pair")) & (F.levenshtein("a", "b", 1) == 1)
    found = short.join(long, ["pair", "bits", "size"]).where(near).select("a", "n_a", "b", "n_b")
    return found.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("other_n")),
                                          F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))).alias("x")).select("x.*")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): steps double until all roots have no form. A form is ``RATIO`` times as frequent, so chains end."""
    now = keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = keep(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop(now)
        now = after
        if not after.where("moved").head(1):
            return after.select("word", "root")


def group_variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``counts`` (word string, n long; words distinct).

    n_near: words one inserted, deleted or replaced code point away. form: the near word of largest n (ties: the smallest in code-point
    order) if that n is ``ratio`` times the word's own; else null. root: the end of the chain of forms, the word itself without
    one. Null words are left out; an empty table gives an empty table.
    """
    vocabulary = keep(counts.where(F.col("word").isNotNull()).select("word", "n"), "vocabulary")
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("word"))).alias("best")
    near = near_pairs(vocabulary).groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    strong = -F.col("best.minus") >= ratio * F.col("n")
    near = keep(near.select("word", "n_near", F.when(strong, F.col("best.word")).alias("form"), F.when(strong, -F.col("best.minus")).alias("form_n")), "near")
    roots = _roots(near.where(F.col("form").isNotNull()))
    joined = vocabulary.join(near, "word", "left").join(roots, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def spelling_groups(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """The variants among the words of ``docs`` (text and any other columns): see ``group_variants``.

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased, of ``min_chars`` code points and ``min_count`` occurrences in all
    texts. Null and empty texts have none, rows that repeat count each, an empty table has no words.
    """
    return group_variants(word_counts(letter_runs(docs), min_chars, min_count), ratio)
