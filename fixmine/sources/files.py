"""Readers and sinks: guarded CSV, JSON and JSONL, feeds by year, HTML tables, logs, caches, verified files."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A headerless record of a candidate change.
CANDIDATES = "hash string, short string, subject string, body string, extra string"


def entity_csv(spark: SparkSession, folder: str, schema: str = CANDIDATES, skip: Sequence[str] = ("repo_config.csv",)) -> DataFrame:
    """Rows of every CSV under a folder per entity, with the entity and the file's name; bad rows are in ``_bad``."""
    full = f"{schema}, _bad string"
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(folder)
    path = F.split(F.input_file_name(), "/")
    out = rows.withColumn("entity", F.element_at(path, -2)).withColumn("file", F.element_at(path, -1))
    return out.where(~F.col("file").isin(list(skip)))


def guarded(rows: DataFrame, texts: Sequence[str], need: Sequence[str], most: int = 1000) -> DataFrame:
    """Rows with all needed columns whose texts are shorter than ``most`` characters."""
    ok = F.lit(True)
    for c in need:
        ok = ok & F.col(c).isNotNull()
    for c in texts:
        ok = ok & (F.coalesce(F.length(c), F.lit(0)) < most)
    return rows.where(ok)


def frame(spark: SparkSession, path: str, rename: dict[str, str] | None = None) -> DataFrame:
    """A table by the ending of its path, with columns renamed; other endings are refused."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("json", "jsonl"):
        out = spark.read.option("multiLine", kind == "json").json(path)
    elif kind == "parquet":
        out = spark.read.parquet(path)
    elif kind == "csv":
        out = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    elif kind == "orc":
        out = spark.read.orc(path)
    else:
        raise ValueError(f"no reader for .{kind}")
    return out.withColumnsRenamed(rename or {})


def documents(spark: SparkSession, folder: str, schema: T.StructType | str | None = None, ending: str = "json") -> DataFrame:
    """One JSON document per file, with the file's name as ``entity``."""
    reader = spark.read.option("multiLine", True).option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{ending}")
    rows = (reader.schema(schema) if schema else reader).json(folder)
    return rows.withColumn("entity", F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), "[.]json$", ""))


def feed(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(id, description, language) of every item of paged feeds; English ones have the language en. lines: a page on each line, not in each file."""
    schema = "vulnerabilities array<struct<cve:struct<id:string,descriptions:array<struct<lang:string,value:string>>>>>"
    rows = spark.read.option("multiLine", not lines).schema(schema).json(path)
    items = rows.select(F.explode("vulnerabilities.cve").alias("c"))
    return items.select("c.id", F.explode_outer("c.descriptions").alias("d")).select("id", F.col("d.value").alias("description"), F.col("d.lang").alias("language"))


def split_by_year(rows: DataFrame, key: str, path: str) -> None:
    """Write a feed by the year in its ids (CVE-<year>-<number>)."""
    rows.withColumn("year", F.regexp_extract(key, "^[A-Z]+-([0-9]{4})-", 1)).write.mode("append").partitionBy("year").json(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, split among tasks as they are read."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def verified(spark: SparkSession, path: str, digests: DataFrame) -> DataFrame:
    """(path, sha256, ok): files compared with expected digests (name, sha256)."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    return rows.join(digests, "name", "left").select("path", F.col("found").alias("sha256"), F.coalesce(F.col("found") == F.lower("sha256"), F.lit(False)).alias("ok"))


def meta(c: Column) -> Column:
    """Map of ``key:value`` lines."""
    return F.str_to_map(c, F.lit("\r?\n"), F.lit(":"))


def non_empty(spark: SparkSession, path: str) -> DataFrame:
    """Names of files that have content."""
    return spark.read.format("binaryFile").load(path).where("length > 0").select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def one_row(rows: DataFrame, key: str) -> DataFrame:
    """One row of each key: of several the largest, column by column in the order of the table."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(*others)).alias("_row")).select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def cached(wanted: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the cache that are wanted, wanted keys that are not there). The cache is keyed by the digest of the key; of a key's rows see ``one_row``."""
    digest = F.unhex(F.md5(F.col(key).cast("binary")))
    w = wanted.select(key).distinct().withColumn("url_hash", digest)
    hit = one_row(cache.join(w, ["url_hash", key], "left_semi").select(*cache.columns), key)
    return hit, w.join(cache.select("url_hash", key), ["url_hash", key], "left_anti").select(key)


def coalesced(wanted: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """Wanted keys with the cached value, null where there is none."""
    return wanted.join(one_row(cache.select(key, value), key), key, "left").select(key, value)


def upserted(cache: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The cache with rows put in; a row whose key is there replaces it. Both have the same columns."""
    return cache.join(rows.select(key).distinct(), key, "left_anti").select(*cache.columns).unionByName(one_row(rows.select(*cache.columns), key))


def changed(now: DataFrame, stored: DataFrame, key: str, meta: str) -> DataFrame:
    """Feeds that have to be read again: those whose META is not the one stored, or that are not stored."""
    old = stored.select(key, F.col(meta).alias("_old"))
    return now.join(old, key, "left").where(~F.col(meta).eqNullSafe(F.col("_old"))).drop("_old")


def collect_into(rows: DataFrame, ids: DataFrame, key: str, path: str) -> None:
    """Write the rows of chosen ids to a folder."""
    rows.join(ids.select(key).distinct(), key, "left_semi").write.mode("overwrite").parquet(path)


def append(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Append all rows whose key is not in the table yet, and return the table.

    A key comes with all its rows, equal ones too, in one delivery; a later delivery of it adds nothing, so a delivery may be run
    again. Rows without a key are always added. Spark commits the files of an append together, so one that fails adds nothing.
    Appends to one table run one after the other: two at the same time may both add a key.
    """
    spark = rows.sparkSession
    try:
        rows = rows.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _expanded(pool: list) -> str:
    """JSON text of the first value of an array whose containers hold places in the array; a place that leads back into itself is null.

    A stack instead of recursion, so nesting has no limit.
    """
    import json

    out: list[str] = []
    todo: list = [0]
    within: set[int] = set()
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            out.append(at)
        elif isinstance(at, tuple):
            within.discard(at[0])
        elif not isinstance(at, int) or isinstance(at, bool) or not 0 <= at < len(pool) or at in within:
            out.append("null")
        elif isinstance(pool[at], (dict, list)):
            value = pool[at]
            within.add(at)
            keys = [json.dumps(k) + ": " for k in value] if isinstance(value, dict) else [""] * len(value)
            items = list(value.values()) if isinstance(value, dict) else value
            parts: list = ["{" if isinstance(value, dict) else "["]
            for k, (name, item) in enumerate(zip(keys, items, strict=True)):
                parts += [(", " if k else "") + name, item if isinstance(item, int) and not isinstance(item, bool) else -1]
            parts += ["}" if isinstance(value, dict) else "]", (at,)]
            todo += reversed(parts)
        else:
            out.append(json.dumps(pool[at]))
    return "".join(out)


def expand_pointers(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    """Add the document that a pointer-compressed JSON array stands for, as JSON text; null if it is not one."""
    import json

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                pool = json.loads(t)
                return _expanded(pool) if isinstance(pool, list) else None
            except (TypeError, ValueError, RecursionError):
                return None

        return texts.map(one)

    return df.withColumn(name, run(column))


def lookup(spark: SparkSession, path: str, ids: DataFrame, key: str) -> DataFrame:
    """Items of a feed split by year (see ``split_by_year``) with the wanted ids; only the years that occur in the ids are read."""
    wanted = ids.select(key).distinct().withColumn("year", F.regexp_extract(key, "^[A-Z]+-([0-9]{4})-", 1).cast("int"))
    return spark.read.json(path).join(wanted, ["year", key], "left_semi")


def frame_or(spark: SparkSession, path: str, default: DataFrame) -> DataFrame:
    """The table at ``path``, or the default where there is none."""
    try:
        return frame(spark, path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return default


def file_info(spark: SparkSession, path: str) -> DataFrame:
    """(name, folder, length, modified) of all files below a folder, without reading them."""
    at = F.split("path", "/")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(at, -1).alias("name"), F.element_at(at, -2).alias("folder"), "length", F.col("modificationTime").alias("modified"))


def final_urls(urls: DataFrame, redirects: DataFrame, url: str) -> DataFrame:
    """``urls`` with ``final``, the end of the chain of redirects (source, target); one that leads back into itself has none.

    One round for each doubling of a chain's length.
    """
    from fixmine.store import checkpoints

    checkpoints(urls.sparkSession)
    hop = redirects.select("source", "target").groupBy("source").agg(F.min("target").alias("target")).checkpoint()
    ends = hop.count().bit_length() + 1
    for _ in range(ends):  # chains are no longer than there are redirects
        on = hop.select(F.col("source").alias("target"), F.col("target").alias("_t"))
        hop = hop.join(on, "target", "left").select("source", F.coalesce("_t", "target").alias("target")).checkpoint()
    loops = hop.join(hop.select(F.col("source").alias("target")), "target", "left_semi").select("source", F.lit(True).alias("_loop"))
    out = urls.join(hop.withColumnRenamed("source", url), url, "left").join(loops.withColumnRenamed("source", url), url, "left")
    return out.withColumn("final", F.when(F.col("_loop").isNull(), F.coalesce("target", url))).drop("target", "_loop")
