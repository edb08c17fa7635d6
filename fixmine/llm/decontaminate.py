"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number of shingles, each partition from a power of two to the next. For a partition
with items of fewer than ``b`` shingles every document is read as overlapping windows of ``2b`` shingles, ``b`` apart, so
that an item that a document holds in one place lies in one window and a containment of 0.8 is a Jaccard similarity of
0.8 / 4.2 at least, however long the document is. Windows and items that agree in one of ``SLOTS`` minima (all are missed
with probability (1 - 0.19)**64, about 1e-6) are candidates; each is verified by exact containment of the item's
shingle set in the set of the whole document. An item whose shingles lie apart has a smaller share in each of more windows,
and the chance that none of them agrees is about the same.

The index of up to ``BLOCK_ITEMS`` items (some 1.5 kB each) goes to every task, and documents are not shuffled. More items are a
table of minima by size class: one pass over the documents sends the minima that pass a bit table of at most 8 MB, and they
meet the items in a join. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixmine.llm import text as X
from fixmine.llm.store import columns_for, drop, keep

SLOTS, LEAST = 64, 0.8
#: Items whose index is sent to the tasks; of more, the index is a table.
BLOCK_ITEMS = 20_000
#: Bits of the table that minima of documents have to pass.
FILTER_BITS = 26
_FACTORS = X.mix(np.arange(31000, 31000 + SLOTS, dtype=np.uint64)) | X.U64(1)
_TABLE_BITS = 20


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each slot over a set."""
    with np.errstate(over="ignore"):
        return (shingles[:, None] * _FACTORS).min(axis=0)


def key_of(lows: np.ndarray, slot, size: int) -> np.ndarray:
    """Minima of all slots and size classes in one space of keys; mixed, as minima are small numbers."""
    with np.errstate(over="ignore"):
        return X.mix(lows + np.asarray(slot).astype(np.uint64) * X.U64(0x9E6C63D0876A9A47) + X.U64(size) * X.U64(0xC2B2AE3D27D4EB4F))


def size_class(n: int) -> int:
    return n.bit_length() - 1


def window_keys(hashed: np.ndarray, at: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size class, text of each window, key of each window) for each slot and class. at: where each text begins in ``hashed``."""
    own = np.diff(at)
    owner = np.flatnonzero(own)
    if not len(owner) or not sizes:
        return
    base = 2 << sizes[0]
    n_blocks = -(-own[owner] // base)
    first = np.cumsum(n_blocks) - n_blocks
    who = np.repeat(np.arange(len(owner)), n_blocks)
    nth = np.arange(len(who)) - first[who]
    starts = at[owner][who] + nth * base
    levels = []
    for size in sizes:
        group = np.flatnonzero(nth % ((2 << size) // base) == 0)  # where blocks of this width begin
        doc = who[group]
        pair = np.ones(len(group), bool)
        pair[:-1] = doc[1:] == doc[:-1]
        pair[-1:] = False
        levels.append((size, group, owner[doc], pair))
    for slot in range(SLOTS):
        with np.errstate(over="ignore"):
            lows = np.minimum.reduceat(hashed * _FACTORS[slot], starts)
        for size, group, doc, pair in levels:
            block = np.minimum.reduceat(lows, group) if len(group) < len(lows) else lows
            window = block.copy()
            window[:-1] = np.where(pair[:-1], np.minimum(block[:-1], block[1:]), block[:-1])
            yield size, doc, key_of(window, slot, size)


class Items:
    """The index of items: per size class, all minima with their items."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        sets = list(X.shingle_sets(*X.buffers(pa.array(texts, pa.large_string()))))
        self.ids = [i for i, s in zip(ids, sets, strict=True) if len(s)]
        self.sets = [s for s in sets if len(s)]
        sizes = np.array([size_class(len(s)) for s in self.sets], np.int64)
        self.parts = {}
        for k in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == k)
            keys = key_of(np.array([minima(self.sets[i]) for i in own]), np.arange(SLOTS), k).ravel()
            order = np.argsort(keys, kind="stable")
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[keys >> X.U64(64 - _TABLE_BITS)] = True
            self.parts[k] = keys[order], np.repeat(own, SLOTS)[order], table

    def candidates(self, hashed: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) of windows and items that share a minimum."""
        found: set[tuple[int, int]] = set()
        for size, doc, key in window_keys(hashed, at, sorted(self.parts)):
            keys, items, table = self.parts[size]
            hit = np.flatnonzero(table[key >> X.U64(64 - _TABLE_BITS)])
            if len(hit):
                a, b = np.searchsorted(keys, key[hit]), np.searchsorted(keys, key[hit], side="right")
                for h, x, y in zip(hit.tolist(), a.tolist(), b.tolist(), strict=True):
                    for i in range(x, y):
                        found.add((int(doc[h]), int(items[i])))
        return found

    def hits(self, column: pa.Array, least: float) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) where the row's text contains the item."""
        raw, offsets = X.buffers(column)
        for i, j in X.slices(offsets):
            hashed, at = X.shingles(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            sets: dict[int, np.ndarray] = {}
            for k, item in sorted(self.candidates(hashed, at)):
                if k not in sets:
                    sets[k] = np.unique(hashed[at[k] : at[k + 1]])
                both = X.shared(self.sets[item], sets[k])
                if both >= least * len(self.sets[item]):
                    yield i + k, item, both


HITS = "doc_id long, text_hash long, item long, n_shared long, n_item long"


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, size, key, shingles): a row for each slot of an item, and one with its shingles and no key."""
    for batch in batches:
        for item, own in zip(batch["item"].to_pylist(), X.shingle_sets(*X.buffers(batch["text"])), strict=True):
            if not len(own):
                continue
            size = size_class(len(own))
            keys = key_of(minima(own), np.arange(SLOTS), size).view(np.int64)
            n = len(keys) + 1
            yield pa.record_batch([pa.array([item] * n, pa.int64()), pa.array([size] * n, pa.int32()), pa.array([*keys.tolist(), None], pa.int64()), pa.array([None] * (n - 1) + [own.tobytes()], pa.binary())], names=["item", "size", "key", "shingles"])


def _probed(sizes: list[int], bits: int, words: np.ndarray):
    """(doc_id, text_hash, key) of windows whose key passes the bit table, each key once a document and batch."""
    table = np.zeros(1 << max(0, bits - 6), np.uint64)
    table[words[:, 0].astype(np.int64)] = words[:, 1].view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = X.buffers(batch["text"])
            for i, j in X.slices(offsets):
                hashed, at = X.shingles(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                docs, keys = [], []
                for _, doc, key in window_keys(hashed, at, sizes):
                    place = key >> X.U64(64 - bits)
                    hit = np.flatnonzero((table[(place >> X.U64(6)).astype(np.int64)] >> (place & X.U64(63))) & X.U64(1))
                    docs.append(doc[hit])
                    keys.append(key[hit])
                if not docs:
                    continue
                doc, key = np.concatenate(docs), np.concatenate(keys)
                take = pa.array(doc + i)
                yield pa.record_batch([batch["doc_id"].take(take), batch["text_hash"].take(take), pa.array(key.view(np.int64))], names=["doc_id", "text_hash", "key"])

    return run


def _contained(least: float):
    """Items (side 1) that the document before them (side 0) contains."""

    @X.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            rows, shared, sizes = [], [], []
            sets = X.shingle_sets(*X.buffers(batch["text"]))
            for k, (side, s, shingles) in enumerate(zip(batch["side"].to_pylist(), sets, batch["shingles"].to_pylist(), strict=True)):
                if side == 0:
                    own = s
                    continue
                item = np.frombuffer(shingles, np.uint64)
                both = X.shared(item, own)
                if both >= least * len(item):
                    rows.append(k)
                    shared.append(both)
                    sizes.append(len(item))
            take = pa.array(rows, pa.int64())
            yield pa.record_batch([*(batch[c].take(take) for c in ("doc_id", "text_hash", "item")), pa.array(shared, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "text_hash", "item", "n_shared", "n_item"])

    return run


def _hits_by_join(rows: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """Hits of distinct documents and items. rows: doc_id, text, text_hash; items: item (distinct), text."""
    indexed = keep(items.select("item", "text").mapInArrow(_indexed, "item long, size int, key long, shingles binary"), "items")
    sizes = sorted(r["size"] for r in indexed.select("size").distinct().collect())  # one for each power of two
    keys = indexed.where("key is not null").select("item", "key")
    bits = max(6, min(FILTER_BITS, (32 * max(1, keys.count())).bit_length()))
    place = F.shiftrightunsigned("key", 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    words = keys.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    table = words.toPandas().to_numpy(np.int64).reshape(-1, 2)  # 2 ** (FILTER_BITS - 6) words at most
    met = rows.mapInArrow(_probed(sizes, bits, table), "doc_id long, text_hash long, key long").join(keys, "key").select("doc_id", "text_hash", "item").distinct()
    met = keep(met, "candidates")
    wanted = met.select("doc_id", "text_hash").distinct()
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    texts = rows.join(wanted, same(rows, wanted), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    none = F.lit(None)
    sides = texts.select("doc_id", "text_hash", F.lit(0).alias("side"), none.cast("long").alias("item"), "text", none.cast("binary").alias("shingles")).union(
        met.join(indexed.where("key is null").select("item", "shingles"), "item").select("doc_id", "text_hash", F.lit(1), "item", none.cast("string"), "shingles")
    )
    found = sides.repartition("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "side").mapInArrow(_contained(least), HITS)
    found = keep(found, "hits")
    drop(indexed, met)
    return found


def _small_index(benchmark: DataFrame) -> Items | None:
    """The index of all items if they are few, else None."""
    rows = columns_for(benchmark, item_id="long", text="string").limit(BLOCK_ITEMS + 1).collect()
    return Items([r[0] for r in rows], [r[1] for r in rows]) if len(rows) <= BLOCK_ITEMS else None


def _hashed(docs: DataFrame) -> DataFrame:
    return columns_for(docs, doc_id="long", text="string").withColumn("text_hash", F.xxhash64("text"))


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for each row of ``docs`` and item that it contains.

    An item is contained if ``least`` of its distinct 5-word shingles are among the document's. Items of 1 to 4 words are one
    shingle, found only in documents of just these words; empty and null items and documents match nothing. Repeated
    documents and items give a row each, and null ids stay null. Empty tables give an empty table.
    """
    items = _small_index(benchmark)
    if items is None:
        named = columns_for(benchmark, item_id="long", text="string").groupBy("item_id", "text").agg(F.count("*").cast("int").alias("copies")).withColumn("item", F.xxhash64("item_id", "text"))
        hits = _hits_by_join(_hashed(docs), named, least)
        again = named.select("item", "item_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth"))
        rows, found = _hashed(docs).drop("text"), hits.withColumnsRenamed({"doc_id": "d", "text_hash": "h"}).join(again, "item")
        both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
        return both.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(items.hits(batch["text"], least))
            both = np.array([f[2] for f in found], np.int64)
            n = np.array([len(items.sets[f[1]]) for f in found], np.int64)
            yield pa.record_batch([batch["doc_id"].take(pa.array([f[0] for f in found], pa.int64())), pa.array([items.ids[f[1]] for f in found], pa.int64()), pa.array(both), pa.array(n), pa.array(both / np.maximum(n, 1), pa.float64())], names=["doc_id", "item_id", "n_shared", "n_item", "containment"])

    return columns_for(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, item_id long, n_shared long, n_item long, containment double")


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns; nulls, empty texts and tables as in ``leaks``."""
    items = _small_index(benchmark)
    if items is None:
        named = columns_for(benchmark, item_id="long", text="string").select(F.xxhash64("text").alias("item"), "text").dropDuplicates(["item"])
        dirty = _hits_by_join(_hashed(docs), named, least).select(F.col("doc_id").alias("_hit_id"), F.col("text_hash").alias("_hit_hash")).distinct()
        return docs.join(dirty, F.col("doc_id").cast("long").eqNullSafe(F.col("_hit_id")) & (F.xxhash64("text") == F.col("_hit_hash")), "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = np.ones(batch.num_rows, bool)
            stay[[f[0] for f in items.hits(batch["text"], least)]] = False
            yield batch.filter(pa.array(stay))

    return docs.mapInArrow(run, docs.schema)
