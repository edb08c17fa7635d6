"""Column functions on dates, numbers and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400


def seconds(c: Column) -> Column:
    return F.unix_timestamp(c.cast("timestamp"))


def day_span(a: Column, b: Column) -> Column:
    """Whole days from b to a, rounded down; 0 if either is missing."""
    return F.coalesce(F.floor((seconds(a) - seconds(b)) / DAY), F.lit(0)).cast("long")


def day_distance(a: Column, b: Column) -> Column:
    """Absolute distance of two yyyymmdd strings in days."""
    return F.abs(F.datediff(F.to_date(a, "yyyyMMdd"), F.to_date(b, "yyyyMMdd"))).cast("long")


def within_days(a: Column, b: Column, days: int) -> Column:
    """Whether two times are at most so many whole days apart."""
    return F.floor(F.abs(seconds(a) - seconds(b)) / DAY) <= days


def parse_date(c: Column) -> Column:
    """A time in any of the four accepted formats, else null."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(p)) for p in ("yyyy-MM-dd'T'HH:mm'Z'", "yyyy-MM-dd", "yyyy MM dd")), F.try_to_timestamp(c))


def duration_seconds(c: Column) -> Column:
    """h:m:s as seconds."""
    p = F.split(c, ":")
    return (p[0].cast("double") * 3600 + p[1].cast("double") * 60 + p[2].cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, scaled: bool = False) -> Column:
    """Cosine of two vectors: 1 if both are zero, 0 if one is; scaled: mapped to 0..1."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    c = F.when((na == 0) & (nb == 0), F.lit(1.0)).when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))
    return 0.5 + 0.5 * c if scaled else c


def pad(a: Column, n: Column | int, value: float) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(n - F.size(a), F.lit(0))))


def relation(nvd_types: Column, types: Column, nvd_impacts: Column, impacts: Column, impacts_of: Column) -> tuple[Column, Column, Column]:
    """Shares of equal, related and other pairs of types and impacts. impacts_of: map from a type to the impacts it has."""
    pairs = F.flatten(F.transform(nvd_types, lambda a: F.transform(types, lambda b: F.when(a == b, 1).otherwise(0))))
    one = F.aggregate(pairs, F.lit(0), lambda s, x: s + x)
    lists = lambda kinds, found: F.flatten(F.transform(kinds, lambda a: F.transform(found, lambda b: F.when(F.array_contains(impacts_of[a], b), 1).otherwise(0))))
    related = F.concat(lists(nvd_types, impacts), lists(types, nvd_impacts))
    two = F.aggregate(related, F.lit(0), lambda s, x: s + x)
    three = F.size(pairs) + F.size(related) - one - two
    total = one + two + three + F.lit(1.0)
    return one / total, two / total, (three + 1) / total


MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def url_date(c: Column) -> Column:
    """A date in a URL as /2020/05/06/, 2020-05-06 or 20200506, else null."""
    y, m, d = (F.regexp_extract(c, "(19[89][0-9]|20[0-4][0-9])[/-]?(0[1-9]|1[0-2])[/-]?(0[1-9]|[12][0-9]|3[01])(?:[^0-9]|$)", k) for k in (1, 2, 3))
    return F.to_date(F.try_to_timestamp(F.concat(y, m, d), F.lit("yyyyMMdd")))


def month_name_date(c: Column) -> Column:
    """A date as ``6 May 2020`` or ``May 6, 2020``, else null."""
    table = F.create_map(*(F.lit(x) for k, m in enumerate(MONTHS, 1) for x in (m[:3], k)))
    rule = "(?i)(?:([0-9]{1,2})(?:st|nd|rd|th)? )?(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[.]? (?:([0-9]{1,2})(?:st|nd|rd|th)?,? )?([0-9]{4})"
    day = F.coalesce(F.nullif(F.regexp_extract(c, rule, 1), F.lit("")), F.nullif(F.regexp_extract(c, rule, 3), F.lit("")))
    text = F.concat_ws("-", F.regexp_extract(c, rule, 4), F.lpad(table[F.lower(F.regexp_extract(c, rule, 2))].cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def compact_date(c: Column) -> Column:
    """A git date line as yyyymmdd, and 0 if it cannot be read."""
    p = F.split(F.trim(c), " +")
    text = F.concat_ws(" ", F.get(p, F.lit(1)), F.get(p, F.lit(2)), F.get(p, F.lit(4)))
    return F.coalesce(F.date_format(F.try_to_timestamp(text, F.lit("MMM d yyyy")), "yyyyMMdd"), F.lit("0"))
