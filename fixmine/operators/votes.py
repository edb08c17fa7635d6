"""Votes, frequency filters, histograms and grouped sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cross_branch_frequency(df: DataFrame, entity: Sequence[str], file: str, keys: tuple[str, str, str]) -> DataFrame:
    """Rows with a key that occurs in the most files of its entity; the first file of a distinct row is kept.

    A row is counted once per file, for each of its first two keys; a row stays if any of its three keys has the
    highest count of the entity.
    """
    a, b, _ = keys
    rows = df.select(*entity, file, *keys).distinct()
    counts = rows.select(*entity, F.explode(F.array(a, b)).alias("value")).where("value is not null").groupBy(*entity, "value").agg(F.count("*").alias("n"))
    most = counts.groupBy(*entity).agg(F.max("n").alias("n"))
    top = counts.join(most, [*entity, "n"]).select(*entity, "value")
    firsts = rows.groupBy(*entity, *keys).agg(F.min(file).alias(file))
    hit = firsts.select(*entity, *keys, file, F.explode(F.array_distinct(F.array(*keys))).alias("value")).join(top, [*entity, "value"], "left_semi")
    return hit.select(*entity, file, *keys).distinct()


def tally(df: DataFrame, item: str, candidate: str) -> DataFrame:
    """(item, candidate, n): votes; a null candidate is no vote."""
    return df.where(F.col(candidate).isNotNull()).groupBy(item, candidate).agg(F.count("*").alias("n"))


def modes(votes: DataFrame, item: str, candidate: str) -> DataFrame:
    """(item, modes, frequency): all candidates with the most votes, sorted, and that number."""
    n = tally(votes, item, candidate)
    lists = n.groupBy(item, "n").agg(F.array_sort(F.collect_list(candidate)).alias("modes"))
    return lists.groupBy(item).agg(F.max_by("modes", "n").alias("modes"), F.max("n").alias("frequency"))


def above(votes: DataFrame, item: str, candidate: str, frequency: int) -> DataFrame:
    """Candidates with strictly more votes than ``frequency``."""
    return tally(votes, item, candidate).where(F.col("n") > frequency)


def prefix_modes(votes: DataFrame, item: str, candidate: str, number: str, rounds: Sequence[int]) -> DataFrame:
    """``modes`` of the first r rounds for each r of ``rounds``, in one pass over the votes."""
    spread = votes.select("*", F.explode(F.array(*(F.lit(r).cast("long") for r in rounds))).alias("rounds")).where(F.col(number) <= F.col("rounds"))
    keyed = spread.select(F.struct("rounds", item).alias("_i"), candidate)
    return modes(keyed, "_i", candidate).select("_i.rounds", f"_i.{item}", "modes", "frequency")


def pivot_counts(df: DataFrame, row: str, column: str, values: Sequence, prefix: str = "n_") -> DataFrame:
    """Counts by two keys with a column for each of ``values`` and a total over them."""
    wide = df.where(F.col(column).isin(list(values))).groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(f"{prefix}{v}") for v in values))
    return wide.withColumn("total", sum((F.col(f"{prefix}{v}") for v in values[1:]), F.col(f"{prefix}{values[0]}")))


def main_share(df: DataFrame, entity: str, category: str, weight: str) -> DataFrame:
    """(entity, main, percent): the category with the largest weight (first by name on ties) and its share."""
    by = df.groupBy(entity, category).agg(F.sum(weight).alias("w"))
    names = by.groupBy(entity, "w").agg(F.min(category).alias("main"), F.count("*").alias("k"))
    return names.groupBy(entity).agg(F.max_by("main", "w").alias("main"), F.round(100 * F.max("w") / F.sum(F.col("w") * F.col("k")), 2).alias("percent"))


def grouped_sets(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """(outer, inner, values): sorted distinct values by two keys."""
    return df.groupBy(outer, inner).agg(F.array_sort(F.collect_set(value)).alias("values"))


def multi_map(parts: Sequence[DataFrame], key: str, value: str, prefix: str = "CVE-") -> DataFrame:
    """(key, values): the sorted distinct values of each key over several tables; empty values and other keys are skipped."""
    every = parts[0].select(key, value)
    for p in parts[1:]:
        every = every.unionByName(p.select(key, value))
    return every.where(F.col(key).startswith(prefix) & (F.length(value) > 0)).groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values"))


def nested_sum(df: DataFrame, key: str, items: str, field: str) -> DataFrame:
    """(key, total): the sum of a field over the lists of all rows of a key."""
    own = F.aggregate(F.col(items), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x[field].cast("long"), F.lit(0)))
    return df.groupBy(key).agg(F.sum(own).alias("total"))
