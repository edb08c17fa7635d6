"""A cache of fetched texts as a bucketed table: looked up without moving it, and grown by appends.

Rows are bucketed and sorted by their key. A batch of keys is shuffled to the buckets and joined there; the cache itself has no
exchange, and one key's look-up by a filter reads one bucket. New rows are appended with the number of their batch, and of several rows of a key the one of the latest batch counts, of
one batch the largest row, column by column. ``compact`` writes the table anew with one row of each key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "batch"


def _write(rows: DataFrame, name: str, path: str, key: str, buckets: int) -> None:
    # one task a bucket, so that a batch adds one file to each
    rows.repartition(buckets, key).write.mode("append").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def create(rows: DataFrame, name: str, path: str, key: str, buckets: int = 64) -> None:
    """Make the table ``name`` in the folder ``path`` of the rows (key and values); there must be none of that name."""
    if rows.sparkSession.catalog.tableExists(name):
        raise ValueError(f"there is a table {name}")
    _write(rows.where(F.col(key).isNotNull()).withColumn(BATCH, F.lit(0).cast("long")), name, path, key, buckets)


def _layout(spark: SparkSession, name: str) -> tuple[str, int]:
    about = {r[0]: r[1] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    return about["Location"], int(about["Num Buckets"])


def put(rows: DataFrame, name: str, key: str) -> None:
    """Add a batch of rows; a key that is there gets them as its newer ones. One batch after the other: two at a time may share a number."""
    spark = rows.sparkSession
    table = spark.table(name)
    path, buckets = _layout(spark, name)
    last = table.agg(F.max(BATCH)).first()[0]
    new = rows.where(F.col(key).isNotNull()).withColumn(BATCH, F.lit(0 if last is None else last + 1).cast("long"))
    _write(new.select(*table.columns), name, path, key, buckets)


def _newest(rows: DataFrame, key: str) -> DataFrame:
    values = [c for c in rows.columns if c not in (BATCH, key)]
    best = rows.groupBy(key).agg(F.max(F.struct(BATCH, *values)).alias("_v"))
    return best.select(key, *[F.col(f"_v.{c}").alias(c) for c in values])


def get(wanted: DataFrame, name: str, key: str) -> DataFrame:
    """(key, values) of the wanted keys that the cache has, one row each."""
    asked = wanted.select(key).where(F.col(key).isNotNull()).distinct()
    return _newest(wanted.sparkSession.table(name).join(asked, key, "left_semi"), key)


def missing(wanted: DataFrame, name: str, key: str) -> DataFrame:
    """The wanted keys that the cache does not have."""
    asked = wanted.select(key).where(F.col(key).isNotNull()).distinct()
    return asked.join(wanted.sparkSession.table(name).select(key), key, "left_anti").select(key)


def compact(spark: SparkSession, name: str, to: str, path: str, key: str) -> None:
    """Write the newest row of each key as the table ``to`` in the folder ``path``; the buckets stay, so nothing is shuffled but within them."""
    create(_newest(spark.table(name), key), to, path, key, _layout(spark, name)[1])
