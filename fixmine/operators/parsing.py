"""Parsing of answers, nested feeds, logs and provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def answer_votes(df: DataFrame, keys: Sequence[str], entity: str, answer: str, label: str = "Patch Number") -> DataFrame:
    """(keys, vote): numbers after the label, on lines after the first that begins with the entity, or on all if none does."""
    lines = F.split(answer, "\n")
    # position of the header in the array itself, so no shuffle is needed
    head = F.coalesce(F.array_position(F.transform(lines, lambda x: x.startswith(F.col(entity))), F.lit(True)), F.lit(0))
    after = F.slice(lines, head + F.lit(1), F.greatest(F.size(lines), F.lit(1)))
    votes = F.transform(after, lambda x: F.regexp_extract(x, f"{label}: ([0-9]+)", 1))
    return df.select(*keys, F.explode(F.filter(votes, lambda v: v != "")).alias("vote")).withColumn("vote", F.col("vote").cast("long"))


def product_version(df: DataFrame, keys: Sequence[str], answer: str) -> DataFrame:
    """(keys, product, version): the first of each; the version is the last word of its line if that has a digit, else null."""
    version = F.element_at(F.split(F.regexp_extract(answer, "VERSION: ([^\n]*)", 1), " "), -1)
    return df.select(*keys, F.nullif(F.regexp_extract(answer, "PRODUCT: ([^\n]*)", 1), F.lit("")).alias("product"), F.when(version.rlike("[0-9]"), version).alias("version"))


def json_pairs(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, key, value) of the members of an object as text."""
    return df.select(key, F.explode(F.from_json(json, "map<string,string>")).alias("key", "value"))


MATCH = "array<struct<vulnerable:boolean,cpe23Uri:string>>"
FEED = f"cve string, nodes array<struct<cpe_match:{MATCH},children:array<struct<cpe_match:{MATCH}>>>>"


def vulnerable_products(df: DataFrame, key: str, feed: str, children_first: bool = False) -> DataFrame:
    """(key, vendor, product, version) of vulnerable names; those of a node, or of its children if it has none of its own.

    children_first: the other way round.
    """
    nodes = df.select(key, F.explode(F.from_json(feed, FEED)["nodes"]).alias("n"))
    own, below = F.col("n.cpe_match"), F.flatten(F.transform("n.children", lambda c: c["cpe_match"]))
    first, second = (below, own) if children_first else (own, below)
    chosen = F.when(F.size(first) > 0, first).otherwise(second)
    parts = F.split(F.col("m.cpe23Uri"), ":")
    named = nodes.select(key, F.explode(chosen).alias("m")).where("m.vulnerable").select(key, parts[3].alias("vendor"), parts[4].alias("product"), parts[5].alias("version"))
    return named.where("product NOT IN ('*', '-', '')").distinct()


RANGE = "array<struct<vulnerable:boolean,cpe23Uri:string,versionStartIncluding:string,versionEndExcluding:string>>"
RANGES = f"nodes array<struct<operator:string,cpe_match:{RANGE},children:array<struct<cpe_match:{RANGE}>>>>"


def product_set(df: DataFrame, key: str, feed: str) -> DataFrame:
    """(key, vendor, product): ``vulnerable_products`` where children come first, each pair once and without backslashes."""
    bare = lambda c: F.replace(F.col(c), F.lit(chr(92)), F.lit(""))
    return vulnerable_products(df, key, feed, children_first=True).select(key, bare("vendor").alias("vendor"), bare("product").alias("product")).distinct()


def version_triples(df: DataFrame, key: str, feed: str) -> DataFrame:
    """(key, operator, vendor, product, version): names with their version, or the end of their range; ``*``, ``-`` and nothing are no version.

    Names of a node's children come first, its own where there are none; operator: AND or OR of the node.
    """
    nodes = df.select(key, F.explode(F.from_json(feed, RANGES)["nodes"]).alias("n"))
    below = F.flatten(F.transform("n.children", lambda c: c["cpe_match"]))
    m = nodes.select(key, F.col("n.operator").alias("operator"), F.explode(F.when(F.size(below) > 0, below).otherwise(F.col("n.cpe_match"))).alias("m"))
    parts = F.split(F.col("m.cpe23Uri"), ":")
    own = F.when(~parts[5].isin("*", "-", ""), parts[5])
    triple = m.select(key, "operator", parts[3].alias("vendor"), parts[4].alias("product"), F.coalesce(own, "m.versionEndExcluding", "m.versionStartIncluding").alias("version"))
    return triple.where("version IS NOT NULL AND version NOT IN ('*', '-', '')").distinct()


def first_patches(df: DataFrame, keys: Sequence[str | Column], patch: str, order: str) -> DataFrame:
    """(keys, patch): the first non-empty patch of each version."""
    return df.where(F.length(patch) > 0).groupBy(*keys).agg(F.min_by(patch, order).alias(patch))


def highest_stage(df: DataFrame, key: str, done: dict[int, DataFrame], none: int = -1) -> DataFrame:
    """(key, stage): the highest stage whose table has the key."""
    marks = None
    for stage, keys in done.items():
        part = keys.select(key, F.lit(stage).cast("long").alias("stage"))
        marks = part if marks is None else marks.union(part)
    best = marks.groupBy(key).agg(F.max("stage").alias("stage"))
    return df.select(key).join(best, key, "left").select(key, F.coalesce("stage", F.lit(none)).cast("long").alias("stage"))


def log_states(df: DataFrame, line: str) -> DataFrame:
    """(id, state, last_finished): finished if any line of the id says so, else error; lines are ``[n] id=x state``."""
    rule = r"^\[([0-9]+)\] id=(\S+) (finished|error)"
    rows = df.select(F.regexp_extract(line, rule, 1).alias("n"), F.regexp_extract(line, rule, 2).alias("id"), F.regexp_extract(line, rule, 3).alias("state")).where("state <> ''")
    done = F.col("state") == "finished"
    return rows.groupBy("id").agg(F.when(F.bool_or(done), "finished").otherwise("error").alias("state"), F.max(F.when(done, F.col("n").cast("long"))).alias("last_finished"))


def issue_numbers(c: Column) -> Column:
    """First digits of the white-space tokens with a number sign."""
    return F.filter(F.transform(F.filter(F.split(c, r"\s+"), lambda x: F.contains(x, F.lit("#"))), lambda x: F.regexp_extract(x, "([0-9]+)", 1)), lambda x: x != "")


def table_cells(page: Column) -> Column:
    """Cells of the rows of HTML tables: an array of arrays of trimmed text, thousands separators kept out of numbers."""
    text = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), "(?<=[0-9]),(?=[0-9]{3})", ""))
    rows = F.regexp_extract_all(page, F.lit("(?is)<tr[^>]*>(.*?)</tr>"))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit("(?is)<t[dh][^>]*>(.*?)</t[dh]>")), text))


def change_history(df: DataFrame, key: str, entries: str) -> DataFrame:
    """(key, type, date, action, kind, old, new) of nested change records."""
    return df.select(key, F.explode(entries).alias("e")).select(key, "e.type", "e.date", F.explode("e.changes").alias("c")).select(key, "type", "date", "c.action", F.col("c.type").alias("kind"), "c.old", "c.new")
