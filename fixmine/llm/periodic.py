"""Periodic runs of words: phrases that a text repeats back to back, found by divide and conquer.

Words are interned as numbers. A text is halved again and again; at each midpoint two Z-functions (of the right half forwards and
of the left half backwards) tell for every period how far words that far apart agree on both sides, so which repetitions
cross the midpoint. A run lies whole in the largest segment whose midpoint it crosses: a repetition that goes on past its segment
is a piece of a run found there, and left out. Intervals that several periods cover keep the smallest.

Of a repetition that crosses a midpoint at least three words in a row, next to the midpoint, come again in the segment. One sort of all
word triples of a slice tells where each comes next, so that midpoints without such a triple need no Z-function. That
leaves out no run of ``MIN_WORDS`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixmine.llm import text as X
from fixmine.llm.store import columns_for

#: Words of a run at least; the test of triples rests on twelve.
MIN_WORDS = 12
RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def z_function(s: list[int]) -> list[int]:
    """For each place, how many items from there on equal the items from the beginning on."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        elif s[i] != s[0]:
            continue
        else:
            k = 1
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def _crossing(s: list[int], lo: int, hi: int, found: dict[tuple[int, int], int]) -> None:
    """Add the runs of ``s`` that cross the middle of ``s[lo:hi]`` and don't go on past its ends."""
    mid = (lo + hi) // 2
    u, v = s[lo:mid], s[mid:hi]
    ahead = np.array(z_function([*v, -1, *u, *v]))
    u.reverse()
    v.reverse()
    back = np.array(z_function([*u, -1, *v, *u]))
    nu, nv = len(u), len(v)
    p, q = np.arange(1, nu + 1), np.arange(1, nv + 1)
    # words p apart, the later one at the middle: agreement from there on and before it
    on, before = ahead[nv + 1 + nu - p], np.append(back[1:nu], 0)
    # words q apart, the earlier one at the middle
    on_, before_ = np.append(ahead[1:nv], 0), back[nu + 1 + nv - q]
    start = np.concatenate((mid - p - before, mid - before_))
    end = np.concatenate((mid + on, mid + q + on_))
    period = np.concatenate((p, q))
    for k in np.flatnonzero((end - start >= 2 * period) & (end - start >= MIN_WORDS)):
        a, b, d = int(start[k]), int(end[k]), int(period[k])
        if (a == lo and a and s[a - 1] == s[a - 1 + d]) or (b == hi and b < len(s) and s[b] == s[b - d]):
            continue
        found[a, b] = min(d, found.get((a, b), d))


def _suspects(ids: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, lo, hi) of the segments whose middle a run may cross; places count from the beginning of all texts."""
    lo, hi = bounds[:-1], bounds[1:]
    of = np.flatnonzero(hi - lo >= MIN_WORDS)
    lo, hi = lo[of], hi[of]
    if not len(of):
        return
    wide = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        triple = X.mix(X.mix(wide[:-2]) * X.U64(3) + X.mix(wide[1:-1]) * X.U64(5) + X.mix(wide[2:]) * X.U64(7))
    order = np.argsort(triple, kind="stable")
    again = triple[order][1:] == triple[order][:-1]
    later, earlier = np.full(len(triple), len(ids)), np.full(len(triple), -1)
    later[order[:-1][again]] = order[1:][again]
    earlier[order[1:][again]] = order[:-1][again]
    while len(of):
        mid = (lo + hi) // 2
        hit = (later[mid] <= hi - 3) | (earlier[mid] >= lo) | (later[mid - 3] <= hi - 3) | (earlier[mid - 3] >= lo)
        yield from zip(of[hit].tolist(), lo[hit].tolist(), hi[hit].tolist(), strict=True)
        of, lo, hi = np.concatenate((of, of)), np.concatenate((lo, mid)), np.concatenate((mid, hi))
        wide_enough = hi - lo >= MIN_WORDS
        of, lo, hi = of[wide_enough], lo[wide_enough], hi[wide_enough]


def runs_of(texts: list[list[int]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text of word numbers, by start, then period."""
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    found: dict[int, dict[tuple[int, int], int]] = {}
    for k, lo, hi in _suspects(np.fromiter((w for t in texts for w in t), np.int64, bounds[-1]), bounds):
        _crossing(texts[k], lo - int(bounds[k]), hi - int(bounds[k]), found.setdefault(k, {}))
    return [sorted((a, b - a, d) for (a, b), d in found.get(k, {}).items()) for k in range(len(texts))]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that repeat a run's first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(depth)[:-1] == 0)]


def _measure(column: pa.Array) -> Iterator[tuple[int, int, list[list[bytes]], list[list[tuple[int, int, int]]]]]:
    """Slices of a column of texts: (first, last, words, runs)."""
    raw, offsets = X.buffers(column)
    for i, j in X.slices(offsets):
        words = [raw[offsets[k] : offsets[k + 1]].tobytes().split() for k in range(i, j)]
        known: dict[bytes, int] = {}
        yield i, j, words, runs_of([[known.setdefault(w, len(known)) for w in text] for text in words])


@X.trimmed
def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, words, runs in _measure(batch["text"]):
            kept = [b" ".join(collapsed(w, r)).decode() for w, r in zip(words, runs, strict=True)]
            rows = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
            yield pa.record_batch(
                [batch["doc_id"].slice(i, j - i), pa.array([len(w) for w in words], pa.int64()), pa.array(rows, pa.list_(_RUN)), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs`` (doc_id, text and any other columns).

    Words are maximal runs outside ``\\x20\\x09-\\x0D`` and numbered from 0; they are compared byte by byte. A run is a stretch of words
    with smallest period q, of 12 and 2 q words at least, that no neighbouring word extends; runs are ordered by start, then
    period. collapsed: the words that no run contains after its first q words, joined by one space. A null, empty or wordless
    text has no words, no runs and an empty collapsed text; rows that repeat are rows of their own; a null doc_id stays
    null. Texts go on one by one, so one task holds a whole text (about 100 bytes a word) but never a group of them.
    """
    rows = columns_for(docs, doc_id="long", text="string")
    return rows.mapInArrow(_find, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def collapse_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts that hold a run collapsed; other texts keep their white space, other columns stay as they were."""

    @X.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for i, _, words, runs in _measure(batch["text"]):
                for k, (w, r) in enumerate(zip(words, runs, strict=True)):
                    if r:
                        texts[i + k] = b" ".join(collapsed(w, r)).decode()
            at = batch.schema.names.index("text")
            yield batch.set_column(at, "text", pa.array(texts, batch.schema.field("text").type))

    return docs.mapInArrow(run, docs.schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text), where a tenth of the documents, chosen by the crc32 of doc_id, repeat a stretch of words to the end."""
    rows = columns_for(docs, doc_id="long", text="string").withColumn("h", F.crc32(F.col("doc_id").cast("string")))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.coalesce(F.size("w"), F.lit(-1)))
    rows = rows.withColumn("g", F.expr("h div 10")).withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)")))
    rows = rows.withColumn("p", F.when(F.col("n") > 0, F.expr("cast(1 + (n - a) div (3 + g % 8) as int)")))
    planted = F.expr("concat_ws(' ', transform(w, (x, i) -> if(i >= a, element_at(w, a + (i - a) % p + 1), x)))")
    return rows.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def run_digest(runs: Column | str) -> Column:
    """SHA-256 of ``start,length,period`` and a line feed for every run."""
    lines = F.transform(runs, lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return F.sha2(F.array_join(lines, ""), 256)


def run_report(docs: DataFrame) -> DataFrame:
    """One row a document: the number of runs, the longest one (ties: smallest start, then period), digests of runs and collapsed text."""
    found = periodic_runs(docs)
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.s")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.p")).alias("period"),
        F.expr("1000 * top.length div (-top.p)").alias("exponent_milli"), run_digest("runs").alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
