"""Ranks, top-k selection, rank fusion and deterministic samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixmine.store import checkpoints


def rank_within(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Add a 1-based rank without ties within each group; ``order`` has to end in a tie-break."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))


def numbered(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Add consecutive numbers from 0 in an order without ties, over any number of rows.

    Rows are dealt out by range and numbered within each range; the sum of the ranges before is a table of one row a range.
    """
    checkpoints(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    ahead = dealt.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_lead", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return within.join(F.broadcast(ahead.select("_part", "_lead")), "_part").withColumn(name, (F.col("_lead") + F.col("_nth") - 1).cast("long")).drop("_part", "_lead", "_nth")


def top_within(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return rank_within(df, group, order, "_top").where(F.col("_top") <= n).drop("_top")


def best_within(df: DataFrame, group: Sequence[str], score: str) -> DataFrame:
    """All rows that have their group's highest score, ties included."""
    best = df.groupBy(*group).agg(F.max(score).alias("_best"))
    return df.join(best, list(group)).where(F.col(score) == F.col("_best")).drop("_best")


def first_by(df: DataFrame, group: Sequence[str], order: Column, values: Sequence[str]) -> DataFrame:
    """``values`` of the row with the greatest ``order`` in each group, by one aggregation without a sort."""
    best = F.max_by(F.struct(*values), order)
    return df.groupBy(*group).agg(best.alias("_v")).select(*group, "_v.*")


def fuse_scores(df: DataFrame, scores: Sequence[str], how: str) -> DataFrame:
    """Add ``fused``: the max, min or sum of the scores, or with ``borda`` the sum of their ascending ranks."""
    cols = [F.col(s) for s in scores]
    if how in ("max", "min"):
        return df.withColumn("fused", (F.greatest if how == "max" else F.least)(*cols))
    if how in ("sum", "borda"):
        return df.withColumn("fused", sum(cols[1:], cols[0]))
    raise ValueError(how)


def fuse_by_vote(df: DataFrame, ranks: Sequence[str]) -> DataFrame:
    """Add ``closest`` and ``last`` of three ranks: the two that agree best are summed, the odd one breaks ties."""
    r = F.array_sort(F.array(*ranks))
    low, mid, high = r[0], r[1], r[2]
    upper = (mid - low) >= (high - mid)
    return df.withColumn("closest", F.when(upper, mid + high).otherwise(low + mid)).withColumn("last", F.when(upper, low).otherwise(high))


def hash_order(seed: str, *keys: str) -> Column:
    """A shuffle that is the same on every engine and machine."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in keys)))


def sample_negatives(df: DataFrame, group: Sequence[str], label: str, key: str, n: int, seed: str = "0") -> DataFrame:
    """All positive rows and, per group, the ``n`` negative rows that come first in hash order."""
    ranked = rank_within(df.withColumn("_h", hash_order(seed, key)), [*group, label], ["_h", key], "_n")
    return ranked.where((F.col(label) == 1) | (F.col("_n") <= n)).drop("_h", "_n")


def version_key(col: Column) -> Column:
    """Sort key of version tags: numbers compare as numbers, other runs as text."""
    parts = F.regexp_extract_all(F.lower(col), F.lit("([0-9]+|[a-z]+)"))
    # the number of digits, without leading zeros, goes before the digits
    digits = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("1"), F.lpad(F.length(digits(p)).cast("string"), 9, "0"), digits(p))).otherwise(F.concat(F.lit("0"), p)))


def predecessor(df: DataFrame, group: Sequence[str], tag: str, order: Sequence[Column | str]) -> DataFrame:
    """Add ``previous``: the tag before, or the one before that if it is a pre-release of this one."""
    w = Window.partitionBy(*group).orderBy(*order)
    one, two = F.lag(tag, 1).over(w), F.lag(tag, 2).over(w)
    inside = F.col("_one").contains(F.col(tag))
    return df.withColumn("_one", one).withColumn("_two", two).withColumn("previous", F.when(F.col("_one").isNotNull() & inside, F.col("_two")).otherwise(F.col("_one"))).drop("_one", "_two")
