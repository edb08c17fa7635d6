"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on every document. Expectation-maximisation over the counts of vote patterns
of all documents estimates how accurate each heuristic is and how common bad documents are; the posterior of a
pattern is a soft label. A linear scorer over hashed features (shapes of words, words and pairs of words, bins of
statistics) learns the soft labels, and scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixmine.llm import text as X
from fixmine.llm.store import bound, columns_for, drop, keep

#: Hashed features of the linear scorer: shapes of words and bins of statistics below, words and pairs of words above.
DIMS, SHAPES = 1 << 13, 1 << 12
#: Documents that the scorer is fitted on at most: the first by a hash of doc_id and text, of rows that repeat both one.
FIT_ROWS = 4500
#: Documents with a lower score are rejected.
LEAST_SCORE = 0.35

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|<>{}\\~^=_@+[]")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
_WIDE = np.arange(256) >= 0x80
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[0x80:] = ord("a"), ord("A"), ord("0"), ord("a")


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask)))
    return total[offsets[1:]] - total[offsets[:-1]]


def measure(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of each text in a slice, and the hashes of its words."""
    n = len(offsets) - 1
    starts, bounds = X.word_spans(raw, offsets)
    hashes = X.word_hashes(raw, starts)
    words = np.diff(bounds)
    doc = np.repeat(np.arange(n), words)
    solid = _per_text(~X.IS_SPACE[raw], offsets)
    again = np.bincount(doc[1:][(hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    shingled, at = X.shingles(raw, offsets)
    order = np.lexsort((shingled, np.repeat(np.arange(n), np.diff(at))))
    new = np.ones(len(shingled), bool)
    if len(shingled):
        new[1:] = shingled[order][1:] != shingled[order][:-1]
        new[at[:-1][at[:-1] < len(new)]] = True
    some = np.maximum(words, 1)
    bare = plain = np.zeros(len(starts), bool)
    if len(starts):
        end = np.append(starts[1:], len(raw))
        letters = np.concatenate(([0], np.cumsum(_ALPHA[raw] | _WIDE[raw] | ((raw >= 48) & (raw < 58)))))
        bare = letters[end] == letters[starts]
        marks = np.concatenate(([0], np.cumsum(~X.IS_SPACE[raw])))
        plain = ~bare & ((marks[end] - marks[starts]) - (letters[end] - letters[starts]) <= 1)
    return {
        "words": words,
        "symbol": _per_text(_SYMBOL[raw], offsets) / np.maximum(solid, 1),
        "upper": _per_text(_UPPER[raw], offsets) / np.maximum(_per_text(_ALPHA[raw], offsets), 1),
        "shout": _per_text(raw == 33, offsets) / some,
        "again": again / some,
        "distinct": np.add.reduceat(np.append(new, False).astype(np.int64), at[:-1]) / np.maximum(np.diff(at), 1) if n else np.zeros(0),
        "bare": np.bincount(doc[bare], minlength=n) / some,
        "plain": np.bincount(doc[plain], minlength=n) / some,
        "length": solid / some,
        "hashes": hashes,
    }


#: (statistic, good from, good to, bad below, bad above, words needed for a vote)
HEURISTICS = (
    ("symbol", 0.0, 0.02, -1.0, 0.08, 3),
    ("upper", 0.0, 0.25, -1.0, 0.6, 3),
    ("shout", 0.0, 0.1, -1.0, 0.3, 3),
    ("again", 0.0, 0.05, -1.0, 0.2, 12),
    ("distinct", 0.8, 1.0, 0.45, 2.0, 12),
    ("bare", 0.0, 0.05, -1.0, 0.2, 3),
    ("plain", 0.85, 1.0, 0.55, 2.0, 8),
    ("length", 2.5, 9.0, 1.5, 16.0, 12),
)


def votes(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Votes of each heuristic (columns) on each text: 0 none, 1 good, 2 bad."""
    out = []
    for name, low, high, under, over, words in HEURISTICS:
        x = stats[name]
        vote = np.where((x >= low) & (x <= high), 1, np.where((x < under) | (x > over), 2, 0))
        out.append(np.where(stats["words"] >= words, vote, 0))
    return np.stack(out, axis=1) if len(stats["words"]) else np.zeros((0, len(HEURISTICS)), int)


_POWERS = 3 ** np.arange(len(HEURISTICS))


class WeakLabels:
    """Two classes, one accuracy for each heuristic and class; heuristics err independently given the class."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 50):
        table = patterns[:, None] // _POWERS % 3
        # each heuristic knows one way of being bad, so one such vote outweighs good votes of the others at first
        post = np.clip(1 - 0.01 ** (table == 2).sum(axis=1), 0.01, 0.99)
        weight = counts.astype(float)
        for _ in range(rounds):
            self.prior = np.clip((post * weight).sum() / max(weight.sum(), 1), 1e-4, 0.5)
            self.table = np.empty((2, len(HEURISTICS), 3))
            for c, p in ((0, 1 - post), (1, post)):
                for v in range(3):
                    self.table[c, :, v] = ((table == v) * (p * weight)[:, None]).sum(axis=0) + (0.5 if v == c + 1 else 0.1)
                self.table[c] /= self.table[c].sum(axis=1, keepdims=True)
            post = self.posterior(table)

    def posterior(self, table: np.ndarray) -> np.ndarray:
        """Probability of bad; a heuristic that does not vote says nothing."""
        odds = np.full(len(table), np.log(self.prior / (1 - self.prior)))
        for k in range(len(HEURISTICS)):
            ratio = np.log(self.table[1, k] / self.table[0, k])
            ratio[0] = 0.0
            odds += ratio[table[:, k]]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def features(raw: np.ndarray, offsets: np.ndarray, stats: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hashed feature, value) triples: shares of word shapes, of words and of pairs of words, and a bin for each statistic."""
    n = len(offsets) - 1
    starts, bounds = X.word_spans(raw, offsets)
    shape = _SHAPE[raw]
    solid = ~X.IS_SPACE[raw]
    first = np.zeros(len(raw), bool)
    first[starts] = True
    stay = solid.copy()
    stay[1:] &= first[1:] | (shape[1:] != shape[:-1])
    at = np.flatnonzero(stay)
    begin = np.searchsorted(at, starts)
    place = np.minimum(np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at)))), 63).astype(np.uint64) if len(at) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        hashed = X.mix(np.add.reduceat(X.mix(shape[at].astype(np.uint64) + place * X.U64(256)), begin)) if len(at) else np.zeros(0, np.uint64)
    bucket = (hashed % X.U64(SHAPES - 128)).astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    words = stats["hashes"]
    with np.errstate(over="ignore"):
        pairs = X.mix(words[:-1] * X.U64(3) + words[1:])[doc[1:] == doc[:-1]] if len(words) else words
    named = [(x % X.U64(DIMS - SHAPES)).astype(np.int64) + SHAPES for x in (words, pairs)]
    code = np.concatenate((doc * DIMS + bucket, doc * DIMS + named[0], doc[1:][doc[1:] == doc[:-1]] * DIMS + named[1]))
    pair, count = np.unique(code, return_counts=True)
    rows, cols = [pair // DIMS], [pair % DIMS]
    values = [count / np.maximum(np.diff(bounds), 1)[pair // DIMS]]
    for k, (name, *_) in enumerate(HEURISTICS):
        scaled = np.minimum(stats[name] * (1 if name == "length" else 16), 15).astype(np.int64)
        rows.append(np.arange(n))
        cols.append(SHAPES - 128 + 16 * k + scaled)
        values.append(np.full(n, 0.5))
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(values)


def fit_scorer(sizes: np.ndarray, cols: np.ndarray, values: np.ndarray, target: np.ndarray, rounds: int = 120, decay: float = 1e-4) -> np.ndarray:
    """Weights and a bias (last) of a logistic model of soft targets, by gradients scaled with their history.

    sizes: how many of the features (cols, values) each row has, one at least.
    """
    n = len(target)
    w, seen = np.zeros(DIMS + 1), np.full(DIMS + 1, 1e-8)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    balance = np.where(target >= 0.5, 0.5 / max(target.mean(), 1e-3), 0.5 / max(1 - target.mean(), 1e-3)) if n else target
    for _ in range(rounds):
        z = np.add.reduceat(w[cols].astype(np.float32) * values, starts, dtype=np.float64) + w[-1]
        err = balance * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / max(n, 1)
        g = np.append(np.bincount(cols, weights=np.repeat(err.astype(np.float32), sizes) * values, minlength=DIMS), err.sum()) + decay * np.append(w[:-1], 0) / 10
        seen += g * g
        w -= 0.3 * g / np.sqrt(seen)
    return w


MEASURED = "pattern long, n long, place long, cols array<int>, vals array<float>"


def _measured(upto: int):
    """Counts of vote patterns, and the features of rows whose place is at most ``upto``; of equal places in a task the first."""

    @X.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: set[int] = set()
        for batch in batches:
            raw, offsets = X.buffers(batch["text"])
            places = batch["place"].to_pylist()
            total: dict[int, int] = {}
            for i, j in X.slices(offsets):
                own, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                stats = measure(own, at)
                patterns = votes(stats) @ _POWERS
                for k, c in zip(*np.unique(patterns, return_counts=True), strict=True):
                    total[int(k)] = total.get(int(k), 0) + int(c)
                new = [k for k in range(i, j) if places[k] <= upto and places[k] not in taken]
                taken.update(places[k] for k in new)
                if not new:
                    continue
                rows, cols, values = features(own, at, stats)
                order = np.argsort(rows, kind="stable")
                cut = np.searchsorted(rows[order], np.arange(j - i + 1))
                cols, values = cols[order].astype(np.int32), values[order].astype(np.float32)
                spans = [(cut[k - i], cut[k - i + 1]) for k in new]
                yield pa.record_batch([
                    pa.array(patterns[np.array(new) - i], pa.int64()), pa.nulls(len(new), pa.int64()), pa.array([places[k] for k in new], pa.int64()),
                    pa.array([cols[x:y] for x, y in spans], pa.list_(pa.int32())), pa.array([values[x:y] for x, y in spans], pa.list_(pa.float32())),
                ], names=["pattern", "n", "place", "cols", "vals"])
            n = len(total)
            yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.float32()))], names=["pattern", "n", "place", "cols", "vals"])

    return run


class Model:
    """The weak-label model's posteriors taught a hashed linear scorer."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def score(self, column: pa.Array) -> np.ndarray:
        """Probability of good for each text; 0 for null or wordless texts."""
        raw, offsets = X.buffers(column)
        out = np.zeros(len(column))
        for i, j in X.slices(offsets):
            own, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            stats = measure(own, at)
            rows, cols, values = features(own, at, stats)
            z = np.bincount(rows, weights=self.weights[cols] * values, minlength=j - i) + self.weights[-1]
            out[i:j] = np.where(stats["words"] > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)
        return out


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Vote patterns are counted over all rows of ``docs``; at most ``fit_rows`` of them teach the scorer. One pass over the texts."""
    rows = columns_for(docs, doc_id="long", text="string").select(F.xxhash64("doc_id", "text", F.lit("fit")).alias("place"), "text")
    # twice the rows needed on average, so that the limit below is nearly always met
    upto = bound(min(1.0, 2 * fit_rows / max(1, docs.count())))
    measured = keep(rows.mapInArrow(_measured(upto), MEASURED), "measured")
    # at most 3 ** len(HEURISTICS) patterns
    counts = measured.where("place is null").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toPandas()
    weak = WeakLabels(counts["pattern"].to_numpy(np.int64), counts["n"].to_numpy(np.int64))
    # the last place first, so that only the rows that are taken come to the driver
    last = measured.where("place is not null").select("place").distinct().orderBy("place").limit(fit_rows).agg(F.max("place")).first()[0]
    taken = measured.where(F.col("place") <= F.lit(last)).select("place", "pattern", "cols", "vals").dropDuplicates(["place"]).toArrow().sort_by("place")
    drop(measured)
    if not taken.num_rows:
        return Model(np.zeros(DIMS + 1))
    target = 1 - weak.posterior(taken["pattern"].to_numpy()[:, None] // _POWERS % 3)
    cols, vals = taken["cols"].combine_chunks(), taken["vals"].combine_chunks()
    del taken
    try:
        return Model(fit_scorer(cols.value_lengths().to_numpy(), cols.flatten().to_numpy(), vals.flatten().to_numpy(), target))
    finally:
        del cols, vals
        X.trim()


def classify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, score, kept) of every row of ``docs`` (doc_id, text and any other columns).

    score: probability of good quality; kept: a score of ``LEAST_SCORE`` or more. Null, empty and wordless texts
    score 0. Repeated rows score alike; a null doc_id stays. An empty table gives an empty table.
    """
    model = model or fit(docs)

    @X.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(batch["text"])
            yield pa.record_batch([batch["doc_id"], pa.array(scores), pa.array(scores >= LEAST_SCORE)], names=["doc_id", "score", "kept"])

    return columns_for(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double, kept boolean")


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    model = model or fit(docs)

    @X.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch["text"]) >= LEAST_SCORE))

    return docs.mapInArrow(run, docs.schema)
