"""Parsing of unified diffs and git logs as windows over exploded lines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixmine.store import dealt


def diff_lines(df: DataFrame, key: str, diff: str) -> DataFrame:
    """(key, pos, file, hunk, kind, old, new, line) of every changed or context line of each diff.

    kind: add, del or ctx; old and new: line numbers, null where the line is missing. A hunk ends with the lines that its header
    counts, or before a line that cannot be in one, so changed lines may look like headers. The file is that of the last
    ``+++`` line outside hunks. The windows are partitioned by diff, and diffs are dealt out whole, so many to a task.
    """
    lines = dealt(df.select(key, diff), [key]).select(key, F.posexplode(F.split(diff, "\n")).alias("pos", "line"))
    w, line = Window.partitionBy(key).orderBy("pos"), F.col("line")
    header = line.rlike("^@@ -[0-9]+")
    at = r"^@@ -([0-9]+)(?:,([0-9]+))? [+]([0-9]+)(?:,([0-9]+))?"
    number = lambda k, none: F.coalesce(F.nullif(F.regexp_extract("line", at, k), F.lit("")), F.lit(none)).cast("long")
    marked = lines.withColumn("_h", F.sum(header.cast("long")).over(w)).withColumn("kind", F.when(header, None).when(line.startswith("+"), "add").when(line.startswith("-"), "del").when(line.startswith(" ") | (line == ""), "ctx"))
    hunk = Window.partitionBy(key, "_h").orderBy("pos")
    before = hunk.rowsBetween(Window.unboundedPreceding, -1)
    named = [("_o", number(1, "0")), ("_oc", number(2, "1")), ("_n", number(3, "0")), ("_nc", number(4, "1")), ("hunk", line)]
    for name, value in named:
        marked = marked.withColumn(name, F.first(F.when(header, value), True).over(hunk))
    count = lambda *kinds: F.coalesce(F.sum(F.col("kind").isin(*kinds).cast("long")).over(before), F.lit(0))
    marked = marked.withColumn("_old", count("del", "ctx")).withColumn("_new", count("add", "ctx"))
    stranger = F.coalesce(F.max(F.col("kind").isNull() & ~header & ~line.startswith("\\")).over(hunk), F.lit(False))
    body = (F.col("_h") > 0) & F.col("kind").isNotNull() & ~stranger & ((F.col("_old") < F.col("_oc")) | (F.col("_new") < F.col("_nc")))
    marked = marked.withColumn("_body", body)
    path = F.regexp_replace(F.regexp_replace(F.expr("substring(line, 5)"), "\t.*$", ""), "^b/", "")
    marked = marked.withColumn("file", F.last(F.when(~F.col("_body") & line.startswith("+++ "), path), True).over(w)).where("_body")
    old, new = F.when(F.col("kind") != "add", F.col("_o") + F.col("_old")), F.when(F.col("kind") != "del", F.col("_n") + F.col("_new"))
    return marked.select(key, F.col("pos").cast("long").alias("pos"), "file", "hunk", "kind", old.alias("old"), new.alias("new"), F.expr("substring(line, 2)").alias("line"))


def diff_counts(lines: DataFrame, key: str) -> DataFrame:
    """(key, added, deleted, files): lines and changed files per diff."""
    return lines.groupBy(key).agg(F.count_if(F.col("kind") == "add").alias("added"), F.count_if(F.col("kind") == "del").alias("deleted"), F.array_sort(F.collect_set("file")).alias("files"))


def reverse_apply(after: DataFrame, lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, line): the file before the change. after: keys, n, line of the file as it is now.

    Added lines go, deleted ones come back at their old numbers, and the others are numbered around them.
    """
    added = lines.where("kind = 'add'").select(*keys, F.col("new").alias("n"))
    stay = after.join(added, [*keys, "n"], "left_anti")
    back = lines.where("kind = 'del'").select(*keys, F.col("old").alias("n"), "line")
    # the k-th line that stays takes the k-th old number that no deleted line has
    rank = Window.partitionBy(*keys).orderBy("n")
    kept = stay.withColumn("k", F.row_number().over(rank))
    gaps = back.withColumn("g", F.col("n") - F.row_number().over(rank)).groupBy(*keys, "g").agg(F.count("*").alias("m"))
    shifted = kept.join(gaps, list(keys), "left").groupBy(*keys, "k", "line").agg(F.sum(F.when(F.col("g") < F.col("k"), F.col("m")).otherwise(0)).alias("s"))
    return shifted.select(*keys, (F.col("k") + F.col("s")).alias("n"), "line").unionByName(back.select(*keys, "n", "line"))


def git_log(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, hash, author, date, message, files) of the commits in the text of a log."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos")
    rows = lines.withColumn("c", F.sum(F.col("line").rlike("^commit [0-9a-f]{7,40}").cast("long")).over(w)).where("c > 0")
    pick = lambda rule: F.max(F.when(F.col("line").rlike(rule), F.regexp_extract("line", rule, 1)))
    # messages are indented by four blanks; a collected list is ordered by its position
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("line").startswith("    "), F.struct("pos", F.expr("substring(line, 5)").alias("t"))))), lambda x: x["t"])
    files = F.array_sort(F.collect_set(F.when(F.col("line").rlike("^diff --git a/"), F.regexp_extract("line", "^diff --git a/([^ ]+)", 1))))
    return rows.groupBy(key, "c").agg(pick("^commit ([0-9a-f]{7,40})").alias("hash"), pick("^Author: +(.*)$").alias("author"), pick("^Date: +(.*)$").alias("date"), F.array_join(body, "\n").alias("message"), files.alias("files")).drop("c")


_FUNCTION = {"py": r"^\s*def\s+(\w+)", "js": r"^\s*(?:export\s+)?function\s+(\w+)", "go": r"^func\s+(?:\([^)]*\)\s*)?(\w+)"}
_BRACED = r"^[A-Za-z_][\w\s*&:<>,~\[\]]*?\b([A-Za-z_]\w*)\s*\([^;]*$"
_NOT_NAMES = {"if", "for", "while", "switch", "return", "else", "catch", "sizeof", "do"}


def _function_name(line: Column, suffix: Column) -> Column:
    """The function whose header the line is, by the file's suffix; empty if it is none."""
    name = F.regexp_extract(line, _BRACED, 1)
    for ending, rule in _FUNCTION.items():
        name = F.when(suffix == ending, F.regexp_extract(line, rule, 1)).otherwise(name)
    return name


def changed_functions(lines: DataFrame, key: str) -> DataFrame:
    """(key, file, function, change): functions whose header is added or deleted, or that a change lies in.

    The function that a line lies in is the last header before it in the file's part of the diff, else the one that its hunk's heading names. A
    function is modified if a line in it is changed before any header of it, or if its headers are both added and deleted. Windows hold
    the lines of one file of one diff.
    """
    suffix = F.element_at(F.split(F.coalesce("file", F.lit("")), "[.]"), -1)
    name = _function_name(F.col("line"), suffix)
    heading = F.nullif(_function_name(F.element_at(F.split("hunk", "@@ "), -1), suffix), F.lit(""))
    header = (name != "") & ~name.isin(sorted(_NOT_NAMES))
    order = Window.partitionBy(key, "file").orderBy("pos")
    at = lines.withColumn("_header", header).withColumn("_inside", F.last(F.when(header, name), True).over(order)).where("kind <> 'ctx'")
    kind = F.when(~F.col("_header"), "modified").when(F.col("kind") == "add", "added").otherwise("deleted")
    events = at.select(key, "file", "pos", F.coalesce("_inside", F.when(~F.col("_header"), heading)).alias("function"), kind.alias("_k")).where("function IS NOT NULL")
    own = F.when(F.col("_k") != "modified", F.col("_k"))
    seen = events.groupBy(key, "file", "function").agg(F.min_by("_k", "pos").alias("_first"), F.min(own).alias("_a"), F.max(own).alias("_b"))
    change = F.when((F.col("_first") == "modified") | (F.col("_a") != F.col("_b")), "modified").otherwise(F.col("_a"))
    return seen.select(key, "file", "function", change.alias("change"))


def enclosing_braces(df: DataFrame, code: str, position: str, name: str = "span") -> DataFrame:
    """Add the (begin, end) of the outermost pair of braces around a position; null if there is none."""

    import re

    brace = re.compile("[{}]")

    @F.pandas_udf("begin long, end long")
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, places in batches:
            out = []
            for text, place in zip(texts, places, strict=True):
                depth, begin, span = 0, None, (None, None)
                for m in brace.finditer(text or ""):
                    i = m.start()
                    if m[0] == "{":
                        begin = i if depth == 0 else begin
                        depth += 1
                    elif depth:
                        depth -= 1
                        if depth == 0 and begin <= place <= i:
                            span = (begin, i)
                            break
                out.append(span)
            yield pd.DataFrame(out, columns=["begin", "end"]).astype("Int64")

    return df.withColumn(name, find(code, position))


def enclosing_function(lines: DataFrame, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """(keys, n, function): the last function header at or before each wanted line n, null before the first.

    lines: keys, n, line of whole files; wanted: keys, n. A running last value within a file.
    """
    name = F.regexp_extract("line", _BRACED, 1)
    w = Window.partitionBy(*keys).orderBy("n")
    named = dealt(lines, keys, 1 << 17).withColumn("function", F.last(F.when((name != "") & ~name.isin(list(_NOT_NAMES)), name), True).over(w))
    return wanted.select(*keys, "n").join(named.select(*keys, "n", "function"), [*keys, "n"])


def readable_diff(diff: Column, fallback: Column) -> Column:
    """The text if it is a diff, else that of the address with ``.diff``, if that is one."""
    from fixmine.operators.filters import is_diff

    return F.coalesce(F.when(is_diff(diff), diff), F.when(is_diff(fallback), fallback))


def commit_features(lines: DataFrame, key: str) -> DataFrame:
    """(key, files, paths, functions, tokens) of each change, lower-cased: names and paths of its files, the names in the headers of its hunks, and its changed tokens with counts."""
    from fixmine.functions.strings import camel_tokens

    low = lambda c: F.lower(F.col(c))
    heads = lines.groupBy(key).agg(
        F.array_sort(F.collect_set(F.lower(F.element_at(F.split("file", "/"), -1)))).alias("files"), F.array_sort(F.collect_set(low("file"))).alias("paths"),
        F.array_sort(F.collect_set(F.nullif(F.lower(F.regexp_extract("hunk", r"@@[^@]*@@.*?([A-Za-z_][A-Za-z0-9_]*) *[(]", 1)), F.lit("")))).alias("functions"),
    )
    tokens = lines.where("kind <> 'ctx'").select(key, F.explode(camel_tokens(F.col("line"))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    counts = tokens.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "n")))).alias("tokens"))
    return heads.join(counts, key, "left")


def token_stream(message: Column, paths: Column, functions: Column, code: Column) -> Column:
    """Tokens of a change in order: of its message, its paths, its functions and its code."""
    from fixmine.functions.strings import camel_tokens

    parts = [camel_tokens(F.coalesce(message, F.lit(""))), *(F.flatten(F.transform(F.coalesce(a, F.array().cast("array<string>")), camel_tokens)) for a in (paths, functions)), camel_tokens(F.coalesce(code, F.lit("")))]
    return F.concat(*parts)
