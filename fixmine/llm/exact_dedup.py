"""Exact deduplication of new batches against immutable snapshots, screened by binary-fuse filters.

A snapshot is a folder that is written once and never changed: exact buckets (digest, the row that stays, how many rows, its
text), dealt into shards by digest, and for each shard a static three-wise binary-fuse filter (two bytes a key, one
false positive in 65,536). A new batch is grouped by digest among itself first; its digests are then screened by the
filters, only positives join the exact buckets, and their texts are compared byte by byte. Nothing of the documents that
a snapshot was made of is read again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixmine.llm import text as X
from fixmine.llm.store import columns_for, delete, drop, fresh_path, keep

#: Distinct digests of a shard and bytes of their texts, on average; shards follow the number of digests and of bytes. A group of
#: digests of a new batch is of as many.
SHARD_KEYS, SHARD_BYTES = 50_000, 256 << 20
#: Bytes that the writer of a bucket file holds back.
_ROW_GROUP = 32 << 20
DIGEST = "doc_id long, text_hash long, digest binary, key long, size long"
BUCKET = "digest binary, doc_id long, n long, text string"
_NO_ID = -(2**63)


class BinaryFuse:
    """A static set of 64-bit keys: no false negatives, false positives with probability 2**-16."""

    def __init__(self, seed: int, segment: int, windows: int, prints: np.ndarray):
        self.seed, self.segment, self.windows, self.prints = seed, segment, windows, prints

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, windows: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            h = X.mix(keys + X.U64(seed))
            g = X.mix(h)
        first = ((h >> X.U64(32)) * X.U64(windows)) >> X.U64(32)
        offsets = np.stack([g, g >> X.U64(20), g >> X.U64(40)]) & X.U64(segment - 1)
        base = (first + np.arange(3, dtype=np.uint64)[:, None]) * X.U64(segment)
        return (base + offsets).astype(np.int64), (h & X.U64(0xFFFF)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        """Peel keys that are alone in a place, round by round; then set prints in reverse."""
        keys = np.unique(keys.astype(np.uint64))
        n = max(1, len(keys))
        segment = 1 << max(2, min(18, int(np.log(n) / np.log(3.33) + 2.25)))
        room = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + 16
        for seed in range(1, 200):
            windows = max(1, -(-room // segment) - 2)
            size = (windows + 2) * segment
            at, prints = cls._places(keys, seed, segment, windows)
            count = np.bincount(at.ravel(), minlength=size)
            sums = np.zeros(size, np.int64)
            for row in at:
                np.add.at(sums, row, np.arange(len(keys)))
            left, layers = len(keys), []
            alone = np.flatnonzero(count == 1)
            while len(alone):
                who, pick = np.unique(sums[alone], return_index=True)
                layers.append((who, alone[pick]))
                left -= len(who)
                for row in at:
                    np.subtract.at(count, row[who], 1)
                    np.subtract.at(sums, row[who], who)
                near = np.unique(at[:, who])
                alone = near[count[near] == 1]
            if left:
                room = int(room * 1.05) + 1
                continue
            out = np.zeros(size, np.uint16)
            for who, place in reversed(layers):
                out[place] = 0
                out[place] = prints[who] ^ out[at[0, who]] ^ out[at[1, who]] ^ out[at[2, who]]
            return cls(seed, segment, windows, out)
        raise RuntimeError("no seed peels these keys")

    def has(self, keys: np.ndarray) -> np.ndarray:
        at, prints = self._places(keys.astype(np.uint64), self.seed, self.segment, self.windows)
        return prints == self.prints[at[0]] ^ self.prints[at[1]] ^ self.prints[at[2]]


@X.trimmed
def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = X.buffers(batch["text"])
        # text by text, so that no second copy of a batch is made
        digests = [hashlib.sha256(X.LOWER[raw[a:b]]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        keys = [int.from_bytes(d[:8], "little", signed=True) for d in digests]
        yield pa.record_batch([batch["doc_id"], batch["text_hash"], pa.array(digests, pa.binary()), pa.array(keys, pa.int64()), pa.array(np.diff(offsets))], names=["doc_id", "text_hash", "digest", "key", "size"])


def _filters(key: tuple, table: pa.Table) -> pa.Table:
    made = BinaryFuse.build(table["key"].to_numpy().view(np.uint64))
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "seed": pa.array([made.seed], pa.int64()), "segment": pa.array([made.segment], pa.int64()), "windows": pa.array([made.windows], pa.int64()), "prints": pa.array([made.prints.tobytes()], pa.binary())})


def _screen(new: pa.Table, filters: pa.Table) -> pa.Table:
    if not new.num_rows or not filters.num_rows:
        return new.select(["digest"]).slice(0, 0)
    f = filters.slice(0, 1).to_pylist()[0]
    made = BinaryFuse(f["seed"], f["segment"], f["windows"], np.frombuffer(f["prints"], np.uint16))
    return new.select(["digest"]).filter(pa.array(made.has(new["key"].to_numpy().view(np.uint64))))


@X.trimmed
def _same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (new, at), (old, to) = X.buffers(batch["new_text"]), X.buffers(batch["old_text"])
        equal = [at[k + 1] - at[k] == to[k + 1] - to[k] and np.array_equal(X.LOWER[new[at[k] : at[k + 1]]], X.LOWER[old[to[k] : to[k + 1]]]) for k in range(batch.num_rows)]
        hit = pa.array(equal, pa.bool_())
        yield pa.record_batch([batch[c].filter(hit) for c in ("digest", "old_id", "old_n")], names=["digest", "old_id", "old_n"])


def _hashed(docs: DataFrame) -> DataFrame:
    return columns_for(docs, doc_id="long", text="string").withColumn("text_hash", F.xxhash64("text"))


def _buckets(digests: DataFrame) -> DataFrame:
    """(digest, key, top, n, size): the row that stays of each digest, how many there are, and the bytes of one."""
    return digests.groupBy("digest", "key").agg(F.max(F.struct("doc_id", "text_hash")).alias("top"), F.count("*").alias("n"), F.max("size").alias("size"))


def _shards(keys: int, size: int) -> int:
    """How many shards hold so many digests with texts of so many bytes."""
    return 1 + max(keys // SHARD_KEYS, size // SHARD_BYTES)


def _splits(keys: int, shards: int) -> int:
    """Into how many groups each shard's digests of a batch are split."""
    return 1 + keys // (shards * SHARD_KEYS)


def _with_texts(rows: DataFrame, tops: DataFrame) -> DataFrame:
    """``tops`` (digest, top and others) with the text of each top row; the tops are the hashed side of the join."""
    # a group of rows without an id has none to join on: the lowest number stands for it
    keyed = tops.withColumn("row_key", F.coalesce("top.doc_id", F.lit(_NO_ID))).withColumn("row_hash", F.col("top.text_hash")).hint("shuffle_hash")
    texts = rows.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("row_key"), F.col("text_hash").alias("row_hash"), "text")
    return texts.join(keyed, ["row_key", "row_hash"]).drop("row_key", "row_hash")


def write_snapshot(docs: DataFrame, path: str, digests: DataFrame | None = None) -> None:
    """Write the snapshot of ``docs`` (doc_id, text and any other columns) to the folder ``path``, which must not exist yet.

    digests: the rows of ``docs`` as this module digests them, if they are there already.
    """
    rows = _hashed(docs)
    own = keep(_buckets(rows.mapInArrow(_digest, DIGEST) if digests is None else digests), "buckets")
    shards = _shards(*own.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first())
    shard = F.pmod(F.col("key"), F.lit(shards)).cast("int").alias("shard")
    filters = own.select(shard.cast("long").alias("shard"), "key").groupBy("shard").applyInArrow(_filters, "shard long, seed long, segment long, windows long, prints binary")
    filters.withColumn("shards", F.lit(shards).cast("long")).write.parquet(f"{path}/filters")
    # rows that repeat both doc_id and text bring the same text
    texts = _with_texts(rows, own).select(shard, "digest", F.col("top.doc_id").alias("doc_id"), "n", "text")
    texts.repartition("shard").dropDuplicates(["shard", "digest"]).write.option("parquet.block.size", _ROW_GROUP).partitionBy("shard").parquet(f"{path}/buckets")
    drop(own)


def _against(own: DataFrame, rows: DataFrame, path: str) -> DataFrame:
    """(digest, old_id, old_n) of the batch's buckets ``own`` whose text the snapshot at ``path`` has."""
    spark = own.sparkSession
    filters = spark.read.parquet(f"{path}/filters")
    head = filters.select("shards").first()
    if head is None:
        return spark.createDataFrame([], "digest binary, old_id long, old_n long")
    shard = F.pmod(F.col("key"), F.lit(head["shards"])).cast("int").alias("shard")
    # a batch may be far larger than the snapshot: its digests are split further, and each part gets the shard's filter
    splits = _splits(own.count(), head["shards"])
    filters = filters.select(F.col("shard").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"), "seed", "segment", "windows", "prints")
    parts = own.select(shard, F.pmod(F.xxhash64("digest"), F.lit(splits)).cast("int").alias("split"), "digest", "key")
    positive = parts.groupBy("shard", "split").cogroup(filters.groupBy("shard", "split")).applyInArrow(_screen, "digest binary")
    hit = own.join(positive, "digest", "left_semi")
    pairs = _with_texts(rows, hit.select(shard, "digest", "top")).dropDuplicates(["shard", "digest"]).select("shard", "digest", F.col("text").alias("new_text"))
    # where the positives are few, they are broadcast and only their shards are read
    old = spark.read.schema(f"{BUCKET}, shard int").parquet(f"{path}/buckets").select("shard", "digest", F.col("doc_id").alias("old_id"), F.col("n").alias("old_n"), F.col("text").alias("old_text"))
    return pairs.join(old, ["shard", "digest"]).mapInArrow(_same, "digest binary, old_id long, old_n long")


def _rows(digests: DataFrame, result: DataFrame) -> DataFrame:
    """A row per document. One digest of many copies has one row on the right, so the adaptive join splits its copies."""
    return digests.join(result, "digest").select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _settled(own: DataFrame, met: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of buckets and what they met on the other side (digest, other_id, other_n)."""
    return own.join(met, "digest", "left").select("digest", F.greatest("top.doc_id", "other_id").alias("keep_id"), (F.col("n") + F.coalesce("other_n", F.lit(0))).alias("group_size"))


def against_snapshot(batch: DataFrame, path: str) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of a new batch, among itself and with the snapshot at ``path``."""
    rows = _hashed(batch)
    digests = keep(rows.mapInArrow(_digest, DIGEST), "digests")
    own = keep(_buckets(digests), "buckets")
    met = _against(own, rows, path).select("digest", F.col("old_id").alias("other_id"), F.col("old_n").alias("other_n"))
    result = keep(_settled(own, met), "kept")
    drop(own)
    return _rows(digests, result)


def exact_groups(docs: DataFrame, fresh: Column | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs`` (doc_id, text and any other columns).

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. fresh: true for rows of the new
    batch, of the others a snapshot is written (default: half of them, by a hash of doc_id, so that no outlier decides; the
    result is the same for any choice). Of equal texts the largest doc_id stays. Rows that repeat a doc_id count each in
    group_size, and kept is the same for all of them with that text. A null doc_id is never kept and counts; a group of only such
    rows has a null keep_id. An empty table gives an empty table.
    """
    if fresh is None:
        fresh = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(2)) == 1
    fresh = F.coalesce(fresh, F.lit(True))
    before, batch = docs.where(~fresh), docs.where(fresh)
    path = fresh_path(docs.sparkSession, "snapshot")
    old_digests, new_digests = (keep(_hashed(d).mapInArrow(_digest, DIGEST), "digests") for d in (before, batch))
    write_snapshot(before, path, old_digests)
    new = keep(_buckets(new_digests), "buckets")
    met = keep(_against(new, _hashed(batch), path), "met")
    theirs = new.join(met.select("digest"), "digest", "left_semi").select("digest", F.col("top.doc_id").alias("other_id"), F.col("n").alias("other_n"))
    old = docs.sparkSession.read.schema(f"{BUCKET}, shard int").parquet(f"{path}/buckets").select("digest", F.struct("doc_id").alias("top"), "n")
    results = [keep(_settled(own, other), "kept") for own, other in ((old, theirs), (new, met.select("digest", F.col("old_id").alias("other_id"), F.col("old_n").alias("other_n"))))]
    drop(new, met)
    delete(docs.sparkSession, path)
    return _rows(old_digests, results[0]).union(_rows(new_digests, results[1]))
