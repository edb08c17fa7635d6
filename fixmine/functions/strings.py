"""Column functions on strings: tokens, overlaps, mentions, similarity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Words that say nothing about a product's name.
NOISE = ("project", "plugin", "python", "javascript", "java", "android", "csharp", "ruby")


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def words(c: Column) -> Column:
    """White-space tokens without empty ones."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def alnum_tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"))


def camel_tokens(c: Column) -> Column:
    """Tokens of identifiers: splits at changes of case and between letters and digits, lower-cased."""
    out = F.regexp_replace(c, "[^A-Za-z0-9]+", " ")
    for rule in ("([A-Z])([A-Z][a-z])", "([a-z])([A-Z0-9])", "([A-Z])([0-9])", "([0-9])([A-Za-z])"):
        for _ in range(2):  # matches overlap by one character
            out = F.regexp_replace(out, rule, "$1 $2")
    return F.filter(F.split(F.lower(out), " "), lambda x: x != "")


def contains_any(c: Column, names: Sequence[str]) -> Column:
    """Whether the lower-cased text has one of the names with a blank on both sides."""
    low = F.lower(c)
    out = F.lit(False)
    for n in names:
        out = out | F.contains(low, F.lit(f" {n.lower()} "))
    return F.coalesce(out, F.lit(False))


def first_of(c: Column, names: Sequence[str]) -> Column:
    """The first of the names that the text has with blanks around it."""
    low = F.lower(c)
    return F.coalesce(*(F.when(F.contains(low, F.lit(f" {n.lower()} ")), F.lit(n)) for n in names))


def keyword_set(c: Column, words_: Sequence[str]) -> Column:
    """The words that occur in the text, in the order given."""
    return F.filter(F.array(*map(F.lit, words_)), lambda w: F.contains(c, w))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared over the larger of two sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))).cast("double")), F.lit(0.0))


def token_overlap(a: Column, b: Column) -> tuple[Column, Column]:
    """(shared distinct tokens, their share of the distinct tokens of a)."""
    n = F.size(F.array_intersect(a, b))
    return n.cast("long"), F.coalesce(F.try_divide(n.cast("double"), F.size(F.array_distinct(a)).cast("double")), F.lit(0.0))


def mentions(c: Column, pattern: str, group: int = 0) -> Column:
    """Sorted distinct matches of a pattern."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(group))))


EMAIL = "[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]*[A-Za-z0-9]"
HEX_ID = "[0-9a-f]{7,40}"
VERSION = "[0-9]+[.][0-9]+(?:[.][0-9]+)*"
CVE = "CVE-[0-9]{4}-[0-9]{4,}"
ISSUE_KEY = "[A-Z][A-Z0-9]+-[0-9]+"
FILE_NAME = "[A-Za-z0-9_-]+[.](?:c|h|cc|cpp|hpp|java|py|php|js|go|rb|ts|cs)\\b"
FUNCTION = "([A-Za-z_][A-Za-z0-9_]+)\\(\\)"
HASH_NUMBER = "#([0-9]+)"


def not_within(items: Column, urls: Column) -> Column:
    """The items that are in none of the urls."""
    return F.filter(items, lambda x: ~F.exists(urls, lambda u: F.contains(u, x)))


def location_overlap(own: Column, named: Column) -> tuple[Column, Column, Column]:
    """(own items that contain a named item, their share of n + 1, named less shared; the last may be negative)."""
    same = F.size(F.filter(own, lambda c: F.exists(named, lambda n: F.contains(c, n))))
    return same.cast("long"), same / (F.size(own) + F.lit(1.0)), (F.size(named) - same).cast("long")


def longest_common_substring(a: Column, b: Column) -> Column:
    """Length of the longest run of characters in both; for short strings, in the plan's own code."""
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(
        F.aggregate(
            F.sequence(F.lit(1), F.length(a)),
            F.lit(0),
            # a longer match can only begin here if one more character than the best so far is found
            lambda best, i: F.aggregate(F.sequence(i, F.length(a)), best, lambda m, j: F.when((j - i + 1 > m) & F.contains(b, a.substr(i, j - i + 1)), j - i + 1).otherwise(m)),
        )
    ).cast("long")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def without_noise(c: Column, noise: Sequence[str] = NOISE) -> Column:
    """The text with each noise word cut out wherever it is, one word after the other."""
    for n in noise:
        c = F.replace(c, F.lit(n), F.lit(""))
    return c


def letters_only(c: Column, noise: Sequence[str] = NOISE) -> Column:
    """Lower-case letters of any script, without noise words."""
    return without_noise(F.regexp_replace(F.lower(c), r"[^\p{L}]", ""), noise)


def clean_words(c: Column, noise: Sequence[str] = NOISE) -> Column:
    """Distinct words of letters, after the noise has been cut out of the text wherever it is."""
    out = without_noise(F.regexp_replace(F.lower(c), r"[^\p{L}]", " "), noise)
    return F.array_distinct(F.filter(F.split(out, " "), lambda x: x != ""))


def word_overlap(a: Column, b: Column, noise: Sequence[str] = NOISE) -> Column:
    """1 if the common words are at least half of the words of either, else 0; two empty names agree."""
    x, y = clean_words(a, noise), clean_words(b, noise)
    n = F.size(F.array_intersect(x, y))
    return F.when((2 * n >= F.size(x)) & (2 * n >= F.size(y)), 1).otherwise(0).cast("long")


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    m = len(mine)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def _winkler(a: str, b: str) -> float:
    j = _jaro(a, b)
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return j + same * 0.1 * (1 - j) if j > 0.7 else j


def _subsequence(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = last + 1 if x == y else max(row[j], row[j - 1])
            last = keep
    return 2 * row[-1] / (len(a) + len(b))


def _blocks(a: str, b: str) -> float:
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio()


def _pairwise(f):
    """An Arrow-batched function of two strings that scores each distinct pair of a batch once; null with a null."""

    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[tuple[str, str], float] = {}
        for a, b in batches:
            out = []
            for pair in zip(a, b, strict=True):
                if pair[0] is None or pair[1] is None:
                    out.append(None)
                    continue
                if pair not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[pair] = f(*pair)
                out.append(known[pair])
            yield pd.Series(out, dtype="float64")

    return run


jaro = _pairwise(_jaro)
jaro_winkler = _pairwise(_winkler)
indel_ratio = _pairwise(_subsequence)
block_ratio = _pairwise(_blocks)


def mean_similarity(a: Column, b: Column) -> Column:
    """Mean of the five similarities."""
    return (block_ratio(a, b) + edit_similarity(a, b) + jaro(a, b) + jaro_winkler(a, b) + indel_ratio(a, b)) / 5


def squeeze(c: Column) -> Column:
    """Line breaks that are spelled out (``\\r\\n``, ``\\n``, ``\\r``) as blanks, and runs of blanks as one; nothing is trimmed."""
    return F.regexp_replace(F.regexp_replace(c, r"\\r\\n|\\n|\\r", " "), " +", " ")


def strip_prerelease(c: Column) -> Column:
    return F.regexp_replace(c, "(?i)[-._]?(alpha|beta|rc|pre|cr)[-._]?[0-9]*$", "")


def is_prerelease(c: Column) -> Column:
    return c.rlike("-alpha|-beta|-rc|-pre|-cr")


def integers(c: Column) -> Column:
    """White-space tokens that are whole numbers."""
    return F.transform(F.filter(F.split(c, r"\s+"), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("long"))


def prompt(template: str, **cols: Column) -> Column:
    """The template with each {name} replaced by a column; nulls are empty."""
    out = F.lit(template)
    for name, c in cols.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def product_key(cpe: Column) -> Column:
    """The product field of a platform name, lower-case letters and digits only; null with fewer than five fields."""
    f = F.split(cpe, ":")
    return F.when(F.size(f) >= 5, F.regexp_replace(F.lower(F.get(f, F.lit(4))), "(?U)[\\W_]+", ""))


#: The 32 keywords that are no names in a function's header.
HEADER_WORDS = (
    "auto", "double", "int", "struct", "break", "else", "long", "switch", "case", "enum", "register", "typedef", "char", "extern", "return", "union",
    "const", "float", "short", "unsigned", "continue", "for", "signed", "void", "default", "goto", "sizeof", "volatile", "do", "if", "while", "static",
)


def header_tokens(c: Column) -> Column:
    """Distinct names of a function's header, sorted: runs of ASCII letters and digits that are no keywords, so an underscore parts two names."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit("([0-9a-zA-Z]+)")), lambda x: ~x.isin(list(HEADER_WORDS)))))


def text_tokens(c: Column, stop: Sequence[str] = (), lemmas: dict[str, str] | None = None) -> Column:
    """Identifier tokens without stop words, each by its lemma if the dictionary has one."""
    out = F.filter(camel_tokens(c), lambda x: ~x.isin(list(stop))) if stop else camel_tokens(c)
    if lemmas:
        table = F.create_map(*(F.lit(x) for kv in lemmas.items() for x in kv))
        out = F.transform(out, lambda x: F.coalesce(table[x], x))
    return out


def occurrences(items: Column, text: Column) -> Column:
    """How many of the items are in the text."""
    return F.size(F.filter(items, lambda x: F.contains(text, x))).cast("long")


def base_names(paths: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(paths, lambda p: F.element_at(F.split(p, "/"), -1))))


#: Suffixes of each language.
LANGUAGES = {
    "C": "c h", "Cpp": "cpp cxx cc c++ h++ hpp hxx inl ii ixx", "Java": "java", "Python": "py", "Ruby": "rb", "JavaScript": "js", "PHP": "php", "HTML": "html htm", "CSS": "css",
    "SQL": "sql", "Swift": "swift", "Go": "go", "Perl": "pl", "Lua": "lua", "R": "r", "MATLAB": "matlab", "Visual Basic": "vb",
}
#: Languages whose functions are searched.
SEARCHED = ("C", "Go", "Python", "Cpp", "Java", "JavaScript")


def language_of(path: Column) -> Column:
    """The language of a path by what follows its last dot, in any case; ``Unknown`` for other suffixes, null for a null path."""
    table = F.create_map(*(F.lit(x) for name, endings in LANGUAGES.items() for e in endings.split() for x in (e, name)))
    return F.when(path.isNotNull(), F.coalesce(F.try_element_at(table, F.lower(F.element_at(F.split(path, "[.]"), -1))), F.lit("Unknown")))


def is_searched(path: Column) -> Column:
    """Whether functions are searched in a file of this path."""
    return F.coalesce(language_of(path).isin(list(SEARCHED)), F.lit(False))


def union_of(*sets: Column) -> Column:
    """Distinct items of all arrays, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*sets))))


def intersection_of(*sets: Column) -> Column:
    """Items that all arrays have, sorted."""
    out = sets[0]
    for s in sets[1:]:
        out = F.array_intersect(out, s)
    return F.array_sort(F.array_distinct(out))


def smoothed_overlap(a: Column, b: Column) -> Column:
    """Shared distinct tokens over one more than the distinct tokens of b."""
    return F.size(F.array_intersect(a, b)) / (F.size(F.array_distinct(b)) + F.lit(1.0))


def issue_key(c: Column) -> Column:
    """The first key like ``ABC-12``, or null."""
    return F.nullif(F.regexp_extract(c, ISSUE_KEY, 0), F.lit(""))


def numeric_ids(c: Column, digits: int = 2) -> Column:
    """All runs of so many digits or more."""
    return F.regexp_extract_all(c, F.lit("([0-9]{%d,})" % digits))
