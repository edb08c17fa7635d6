"""Functions in source files: nested blocks by depth over text without strings and comments, and which of them hold a line."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixmine.store import dealt

_MASKED = re.compile(r"(?m:^[ \t]*\#(?:\\\n|[^\n])*)|\b(?:public|private|protected)\s*:(?!:)|//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`", re.S)
_INKED = re.compile(r"[^\n]")
#: The name before the parentheses that a block's heading ends in, and what is no name.
_HEADING = r"([A-Za-z_~][A-Za-z0-9_]*)\s*\([^{};]*\)[^{};()=]*$"
NOT_NAMES = ("if", "for", "while", "switch", "return", "else", "catch", "sizeof", "do", "synchronized", "with", "new", "throw", "case")


@F.pandas_udf(T.StringType())
def masked(texts: pd.Series) -> pd.Series:
    """Source text with strings, characters, comments, preprocessor lines and access labels blanked out; every other character keeps its place."""
    return texts.map(lambda t: None if t is None else _MASKED.sub(lambda m: _INKED.sub(" ", m[0]), t))


def _lines_in(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def blocks(files: DataFrame, keys: Sequence[str], code: str) -> DataFrame:
    """(keys, heading, start, end, depth) of every block in braces that is closed: lines from 1, start where its heading begins.

    Files are dealt out whole, so many to a task. The text is cut at braces and semicolons. Depths are a running sum of braces in a file; an opening brace ends at the next
    closing one of its depth.
    """
    pieces = dealt(files.select(*keys, code), keys).select(*keys, F.posexplode(F.regexp_extract_all(masked(code), F.lit("[^{};]*[{};]"), F.lit(0))).alias("pos", "piece"))
    mark = F.substring("piece", -1, 1)
    order = Window.partitionBy(*keys).orderBy("pos")
    step = F.when(mark == "{", 1).when(mark == "}", -1).otherwise(0)
    at = pieces.withColumn("mark", mark).withColumn("line", F.sum(_lines_in(F.col("piece"))).over(order) + 1).withColumn("after", F.sum(step).over(order))
    # a closing brace belongs to the depth that it leaves
    braces = at.where("mark <> ';'").withColumn("depth", F.col("after") + (F.col("mark") == "}").cast("int"))
    nested = Window.partitionBy(*keys, "depth").orderBy("pos")
    pairs = braces.withColumn("end", F.lead("line").over(nested)).withColumn("closed", F.lead("mark").over(nested) == "}").where("mark = '{' AND closed")
    heading = F.trim(F.regexp_replace(F.regexp_replace("piece", "[{]$", ""), r"\s+", " "))
    start = F.col("line") - _lines_in(F.regexp_replace("piece", r"^\s+", ""))
    return pairs.select(*keys, heading.alias("heading"), start.alias("start"), "end", "depth")


def functions(files: DataFrame, keys: Sequence[str], code: str) -> DataFrame:
    """(keys, function, start, end): functions of languages with braces; a declaration without a block is none."""
    name = F.regexp_extract("heading", _HEADING, 1)
    return blocks(files, keys, code).withColumn("function", name).where((name != "") & ~name.isin(list(NOT_NAMES))).select(*keys, "function", "start", "end")


def indented_functions(files: DataFrame, keys: Sequence[str], code: str) -> DataFrame:
    """(keys, function, start, end) of a language whose blocks are indented: up to the last line before one that is not indented further.

    Blank lines and comments end nothing. The end of a function is a next smaller value: for each definition the first later line whose
    indentation is its own or less.
    """
    lines = files.select(*keys, F.posexplode(F.split(code, "\n")).alias("n", "line")).where(F.col("line").rlike(r"^\s*[^\s#]"))
    placed = lines.select(*keys, (F.col("n") + 1).alias("n"), F.length(F.regexp_extract("line", r"^(\s*)", 1)).alias("indent"), F.regexp_extract("line", r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)", 1).alias("function"))
    before = F.lag("n").over(Window.partitionBy(*keys).orderBy("n"))
    placed = placed.withColumn("before", before)
    starts = placed.where("function <> ''").select(*keys, "function", F.col("n").alias("start"), F.col("indent").alias("_i"))
    last = placed.groupBy(*keys).agg(F.max("n").alias("_last"))
    later = placed.select(*keys, F.col("n").alias("_n"), "indent", "before")
    ends = starts.join(later, list(keys)).where("_n > start AND indent <= _i").groupBy(*keys, "function", "start").agg(F.min_by("before", "_n").alias("end"))
    return starts.join(ends, [*keys, "function", "start"], "left").join(last, list(keys)).select(*keys, "function", "start", F.coalesce("end", "_last").alias("end"))


def functions_at(points: DataFrame, ranges: DataFrame, keys: Sequence[str], line: str, width: int = 64) -> DataFrame:
    """``points`` (keys, line and others) with the innermost function (keys, function, start, end) that holds the line, null if none does.

    Points and ranges meet on buckets of ``width`` lines of a file; of the ranges that hold a point the one that begins last is the innermost, of
    those the one that ends first.
    """
    p = points.withColumn("_b", F.expr(f"`{line}` div {width}"))
    r = ranges.select(*keys, "function", "start", "end", F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"end div {width}"))).alias("_b"))
    hit = p.join(r, [*keys, "_b"]).where(F.col(line).between(F.col("start"), F.col("end")))
    best = hit.groupBy(*keys, line).agg(F.max(F.struct("start", (-F.col("end")).alias("_e"), "function")).alias("_f")).select(*keys, line, "_f.function", "_f.start", (-F.col("_f._e")).alias("end"))
    return points.join(best, [*keys, line], "left")
