"""Packing of token pieces into sequences by shortest-pack-first over the length histogram.

The histogram has at most ``window`` entries, whatever the input. Lengths are placed longest first, each into the
shortest pack so far if it fits there; a packing pattern is a list of (length, repeats) with
the number of sequences that follow it, so a step updates counts and not single sequences. Pieces find their place in
the patterns by their rank among pieces of equal length.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fixmine.llm import text as X
from fixmine.llm.store import columns_for, keep
from fixmine.llm.tokens import Encoder, default_path

WINDOW, END_ID = 2048, 1


def pack_histogram(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (sequences, [(length, repeats), ...]) that hold counts[length] pieces of each length exactly.

    Packs of equal fill are kept together with their number; the shortest pack takes the next piece if it has room, else a
    new one is begun.
    """
    open_packs: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    rooms: list[int] = []
    done: list[tuple[int, list[tuple[int, int]]]] = []

    def put(room: int, n: int, pattern: list[tuple[int, int]]) -> None:
        if room <= 0:
            done.append((n, pattern))
            return
        if room not in open_packs:
            open_packs[room] = []
            insort(rooms, room)
        open_packs[room].append((n, pattern))

    for length in sorted((x for x, c in counts.items() if c), reverse=True):
        left = counts[length]
        while left:
            if rooms and rooms[-1] >= length:
                room = rooms[-1]
                n, pattern = open_packs[room].pop()
                if not open_packs[room]:
                    del open_packs[rooms.pop()]
            else:
                room, n, pattern = window, left, []
            use = min(n, left)
            if pattern and use < n:
                put(room, n - use, pattern)
            left -= use
            last = pattern[-1] if pattern else (0, 0)
            put(room - length, use, [*pattern[:-1], (length, last[1] + 1)] if last[0] == length else [*pattern, (length, 1)])
    for room in rooms:
        done.extend(open_packs[room])
    return done


class Places:
    """Finds the sequence and offset of the piece with a given length and rank."""

    def __init__(self, patterns: list[tuple[int, list[tuple[int, int]]]]):
        rules, base, seen = [], 0, {}
        for n, pattern in patterns:
            offset = 0
            for length, times in pattern:
                first = seen.get(length, 0)
                rules.append((length, first, base, times, offset))
                seen[length] = first + n * times
                offset += length * times
            base += n
        rules.sort()
        self.length, self.first, self.base, self.times, self.offset = np.array(rules, np.int64).reshape(-1, 5).T
        lengths = np.unique(self.length)
        self.start = np.searchsorted(self.length, np.arange(lengths.max(initial=0) + 2))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.empty(len(length), np.int64)
        for x in np.unique(length):
            own = length == x
            a, b = self.start[x], self.start[x + 1]
            at[own] = a + np.searchsorted(self.first[a:b], rank[own], side="right") - 1
        step = rank - self.first[at]
        return self.base[at] + step // self.times[at], self.offset[at] + step % self.times[at] * length


PIECES = pa.schema([("part", pa.int64()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def _cut(path: str, window: int, end_id: int):
    """Pieces of each document, numbered within the task among pieces of equal length."""

    @X.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, encoder = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64), Encoder.of(path, special=True)
        end = np.array([end_id], "<u4")
        for batch in batches:
            who, start, size, crc, total, k = [], [], [], [], [], 0
            for ids, at in encoder.encode(batch["text"]):
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    whole = np.append(ids[a:b], end).astype("<u4")
                    n, raw = len(whole), whole.tobytes()
                    for s in range(0, n, window):
                        who.append(k)
                        start.append(s)
                        size.append(min(window, n - s))
                        crc.append(zlib.crc32(raw[4 * s : 4 * (s + window)]))
                        total.append(n)
                    k += 1
            length = np.array(size, np.int64)
            nth = np.empty(len(length), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                nth[own] = seen[x] + np.arange(len(own))
                seen[x] += len(own)
            yield pa.record_batch([pa.array(np.full(len(length), part)), pa.array(nth), batch["doc_id"].take(pa.array(who, pa.int64())), pa.array(start, pa.int64()), pa.array(length), pa.array(crc, pa.int64()), pa.array(total, pa.int64())], schema=PIECES)

    return run


def _placed(places: Places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.find(batch["length"].to_numpy(), batch["rank"].to_numpy())
            yield pa.record_batch([*(batch[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every row of ``docs``.

    A document is the ids of its text and then ``end_id``, so a null or empty text is one id. It is cut every
    ``window`` ids. Every row is packed, also rows that repeat a doc_id, and a null doc_id stays null. Ties in length
    are broken by place in the input. An empty table gives an empty table.
    """
    rows = columns_for(docs, doc_id="long", text="string")
    pieces = keep(rows.mapInArrow(_cut(tokenizer or default_path(), window, end_id), "part long, nth long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    held = keep(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "held")
    # one row per task and length at most, and at most `window` lengths reach the driver
    before = held.withColumn("lead", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranked = pieces.join(before.select("part", "length", F.coalesce("lead", F.lit(0)).alias("lead")).hint("shuffle_hash"), ["part", "length"]).withColumn("rank", F.col("lead") + F.col("nth"))
    places = Places(pack_histogram(counts, window))
    return ranked.mapInArrow(_placed(places), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
