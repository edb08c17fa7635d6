"""Removal of lines that many documents share, as compressed keep bitmaps.

Hashes of line keys are dealt out by range and sorted within a partition by key, then document (largest first), then
position. A stream over each partition sees the first occurrence of a key and decides its later ones as they come: it holds one
line of the first document and, until enough documents are seen, those of the few after it. A key that
touches an end of a partition may go on in the next one; such keys, two a partition at most, are settled from their
counts over all partitions. As document and position are part of the range key, a frequent line spreads over many
partitions.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixmine.llm.store import columns_for, drop, keep, owner, present, spare

MIN_CHARS, MIN_DOCS = 20, 3
#: Lines of a range, on average, and ranges at most; beyond that many, ranges grow longer, which are sorted with spilling and streamed.
RANGE_LINES, MOST_RANGES = 1_000_000, 20_000
_STRIP = b" \t\n\x0b\x0c\r"
LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int64())])
OUT = pa.schema([("kind", pa.string()), *LINES])
#: What the stream says of an occurrence: it goes; its key touches an end and is open; it is the first of a key that is decided but may go on.
GOES, OPEN, FIRST = "goes", "open", "first"


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, at, pos = [], [], []
            seen = set()  # rows that repeat doc_id and text bring the same lines
            for k, (text, *row) in enumerate(zip(*(batch[c].to_pylist() for c in ("text", "doc_id", "text_hash")), strict=True)):
                if tuple(row) in seen:
                    continue
                seen.add(tuple(row))
                for p, line in enumerate((text or "").encode().split(b"\n")):
                    key = line.strip(_STRIP).lower()
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                        h.append(xxhash.xxh3_128_digest(key))
                        at.append(k)
                        pos.append(p)
            both = np.frombuffer(b"".join(h), np.int64).reshape(-1, 2)
            take = pa.array(at, pa.int64())
            yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1]), batch["doc_id"].take(take), batch["text_hash"].take(take), pa.array(pos, pa.int64())], schema=LINES)

    return run


class _Run:
    """Occurrences of one key in order: arrays h1, h2, doc_id (0 for null), text_hash, pos, and whether doc_id is null."""

    def __init__(self, cols: list[np.ndarray]):
        self.cols = cols

    def __len__(self) -> int:
        return len(self.cols[0])

    def distinct(self, before: tuple | None) -> _Run:
        """Without occurrences that equal the one before; ``before`` is the last of an earlier batch."""
        new = self.starts(*range(len(self.cols)))
        if before is not None and all(c[0] == b for c, b in zip(self.cols, before, strict=True)):
            new[0] = False
        return self if new.all() else self.part(new)

    def part(self, at) -> _Run:
        return _Run([c[at] for c in self.cols])

    def with_(self, other: _Run) -> _Run:
        return _Run([np.concatenate(x) for x in zip(self.cols, other.cols, strict=True)])

    def starts(self, *which: int) -> np.ndarray:
        """Where any of the columns changes."""
        new = np.zeros(len(self), bool)
        new[:1] = True
        for k in which:
            new[1:] |= self.cols[k][1:] != self.cols[k][:-1]
        return new

    def as_batch(self, kind: str) -> pa.RecordBatch:
        h1, h2, doc, text_hash, pos, null = self.cols
        return pa.record_batch([pa.array([kind] * len(self), pa.string()), pa.array(h1), pa.array(h2), pa.array(doc, mask=null), pa.array(text_hash), pa.array(pos)], schema=OUT)


def _stream(min_docs: int):
    """What becomes of the occurrences in a sorted partition, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = first_key = None  # the key at the end of what has been read, and the partition's first
        enough, held = False, None  # of that key: whether it has enough documents, and what is held if not
        before = None  # the last occurrence

        def feed(more: _Run) -> Iterator[pa.RecordBatch]:
            """Go on with the present key."""
            nonlocal enough, held
            if key == first_key:
                yield more.as_batch(OPEN)
                return
            if enough:
                yield more.as_batch(GOES)
                return
            whole = held.with_(more) if held is not None else more
            doc = np.cumsum(whole.starts(2, 3, 5))
            enough = doc[-1] >= min_docs
            later = doc > 1
            if enough:
                yield whole.part(later).as_batch(GOES)
            later[0] = True  # one occurrence stands for the first document
            held = whole.part(slice(0, 1)) if enough else whole.part(later)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _Run([*(batch[c].fill_null(0).to_numpy() for c in LINES.names), np.asarray(batch["doc_id"].is_null())])
            before, rows = tuple(c[-1] for c in rows.cols), rows.distinct(before)
            if not len(rows):
                continue
            begins = np.flatnonzero(rows.starts(0, 1))
            keys = [(rows.cols[0][i], rows.cols[1][i]) for i in (begins[0], begins[-1])]
            if first_key is None:
                first_key = key = keys[0]
            at = 0
            if keys[0] == key:
                at = begins[1] if len(begins) > 1 else len(rows)
                yield from feed(rows.part(slice(0, at)))
            if at == len(rows):
                continue
            last = begins[-1]
            if last > at:  # keys that begin and end here
                inner = rows.part(slice(at, last))
                new = inner.starts(0, 1)
                doc_new = inner.starts(0, 1, 2, 3, 5)
                of, doc, begin = np.cumsum(new) - 1, np.cumsum(doc_new), np.flatnonzero(new)
                goes = (doc > doc[begin][of]) & (np.add.reduceat(doc_new.astype(np.int64), begin)[of] >= min_docs)
                if goes.any():
                    yield inner.part(goes).as_batch(GOES)
            key, enough, held = keys[1], False, None
            yield from feed(rows.part(slice(last, None)))
        if held is not None and key != first_key:
            yield held.as_batch(FIRST if enough else OPEN)

    return run


BITMAP = "doc_id long, text_hash long, n_dropped long, bitmap binary"


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, sizes = [], []
        for drops in batch["pos"].to_pylist():
            at = np.unique(np.array(drops, np.int64))
            stay = np.ones(8 * (int(at.max()) // 8 + 1), bool)
            stay[at] = False
            maps.append(zlib.compress(np.packbits(stay).tobytes()))
            sizes.append(len(at))
        yield pa.record_batch([batch["doc_id"], batch["text_hash"], pa.array(sizes, pa.int64()), pa.array(maps, pa.binary())], names=["doc_id", "text_hash", "n_dropped", "bitmap"])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, n_dropped, bitmap) of each document that loses lines; a line beyond a bitmap's end stays.

    The key of a line: stripped of ``\\x20\\x09-\\x0D``, A-Z lower-cased. Keys of ``min_chars`` code points in ``min_docs``
    documents lose all lines but those in the largest doc_id. Rows with the same doc_id and text are one
    document; with the same doc_id and other texts they are documents of their own, of which one stays. A null doc_id is the
    smallest. Null and empty texts have no keys, and an empty table gives an empty table.
    """
    rows = columns_for(docs, doc_id="long", text="string").withColumn("text_hash", F.xxhash64("text"))
    lines = keep(rows.mapInArrow(_keys(min_chars), "h1 long, h2 long, doc_id long, text_hash long, pos long"), "lines")
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, 1 + lines.count() // RANGE_LINES))
    order = ["h1", "h2", F.desc("doc_id"), "text_hash", "pos"]
    swept = keep(lines.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_stream(min_docs), "kind string, h1 long, h2 long, doc_id long, text_hash long, pos long"), "swept")
    drop(lines)
    ends = swept.where(F.col("kind") != GOES)
    by_doc = ends.groupBy("h1", "h2", "doc_id", "text_hash").agg(F.bool_or(F.col("kind") == FIRST).alias("decided"))
    # desc order: null last, then the smallest text_hash of the largest doc_id is first
    top = F.min(F.struct(F.col("doc_id").isNull().alias("x"), (-F.col("doc_id")).alias("y"), F.col("text_hash").alias("z"))).alias("top")
    stats = by_doc.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.bool_or("decided").alias("decided"), top).where((F.col("docs") >= min_docs) | F.col("decided"))
    # two keys for each range partition at most, and the number of ranges is bounded: some 2 MB
    late = ends.where(F.col("kind") == OPEN).join(F.broadcast(stats), ["h1", "h2"]).where(~((F.col("doc_id").eqNullSafe(-F.col("top.y"))) & (F.col("text_hash") == F.col("top.z"))))
    drops = swept.where(F.col("kind") == GOES).select("doc_id", "text_hash", "pos").union(late.select("doc_id", "text_hash", "pos"))
    return drops.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("pos")).mapInArrow(_bitmaps, BITMAP)


def kept_lines(text: str | None, bitmap: bytes | None) -> tuple[str, int, int]:
    """(text that stays, lines before, lines dropped)."""
    lines = (text or "").split("\n")
    if bitmap is None:
        return text or "", len(lines), 0
    stay = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
    out = [x for k, x in enumerate(lines) if k >= len(stay) or stay[k]]
    return "\n".join(out), len(lines), len(lines) - len(out)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, name: str = "bitmap") -> DataFrame:
    """``docs`` with the bitmap of each row, null where all lines stay; the bitmaps are the hashed side of the join."""
    h, d, r = spare(docs, "text_hash"), spare(docs, "doc_key"), spare(docs, "hash_key")
    right = bitmaps.select(F.col("doc_id").alias(d), F.col("text_hash").alias(r), F.col("bitmap").alias(name)).hint("shuffle_hash")
    left = docs.withColumn(h, F.xxhash64("text"))
    return left.join(right, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(h) == F.col(r)), "left").select(*docs.columns, name)


def _kept_bitmaps(docs: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The bitmaps as a table; what led to them is deleted."""
    mine = present()
    with owner():
        return keep(keep_bitmaps(docs, **limits), "bitmaps", mine)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [kept_lines(t, b) for t, b in zip(batch["text"].to_pylist(), batch["bitmap"].to_pylist(), strict=True)]
        yield pa.record_batch([batch["doc_id"], pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64()), pa.array([hashlib.sha256(d[0].encode()).hexdigest() for d in done], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def line_report(docs: DataFrame, **limits: int) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row."""
    rows = columns_for(docs, doc_id="long", text="string")
    return with_bitmaps(rows, _kept_bitmaps(docs, limits)).mapInArrow(_report, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, **limits: int) -> DataFrame:
    """``docs`` with the texts that remain; all other columns as they were."""
    name = spare(docs, "bitmap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [kept_lines(t, b)[0] if b is not None else t for t, b in zip(batch["text"].to_pylist(), batch[name].to_pylist(), strict=True)]
            at = batch.schema.names.index("text")
            yield batch.set_column(at, "text", pa.array(done, batch.schema.field("text").type)).drop_columns([name])

    return with_bitmaps(docs, _kept_bitmaps(docs, limits), name).mapInArrow(run, docs.schema)
