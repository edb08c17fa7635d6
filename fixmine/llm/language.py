"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of bytes, three deep, from all its training texts. The probability of a byte after a
context is its count over the context's total and number of distinct followers; the rest is the probability of an escape to
the next shorter context, down to all bytes alike (escape method C). Statistics are frozen after training, so the code
length of a text under a language is a sum of table entries, and the language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixmine.llm import text as X
from fixmine.llm.store import columns_for, drop, keep

ORDER = 3
UNKNOWN = "und"
#: Distinct runs that a task holds while it counts.
FLUSH = 2_000_000


def grams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The four bytes that end at each byte, A-Z lower-cased; bytes before a text's begin are 0."""
    low = X.LOWER[raw].astype(np.uint32)
    out = low.copy()
    into = np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in range(1, ORDER + 1):
        prior = np.zeros_like(low)
        prior[back:] = low[:-back] if len(low) > back else low[:0]
        prior[into < back] = 0
        out |= prior << np.uint32(8 * back)
    return out


class Tree:
    """The frozen context tree of one language: what it has seen, sorted, and costs in bits."""

    def __init__(self, runs: list[np.ndarray], costs: list[np.ndarray], contexts: list[np.ndarray], escapes: list[np.ndarray]):
        self.runs, self.costs, self.contexts, self.escapes = runs, costs, contexts, escapes

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> Tree:
        """From the counts of runs of four bytes."""
        runs, costs, contexts, escapes = [], [], [], []
        for order in range(ORDER + 1):
            own, at = np.unique(_suffix(keys, order), return_inverse=True)
            n = np.bincount(at, weights=counts, minlength=len(own))
            above, context = np.unique(own >> np.uint32(8), return_inverse=True)
            total, kinds = np.bincount(context, weights=n, minlength=len(above)), np.bincount(context, minlength=len(above))
            runs.append(own)
            costs.append((-np.log2(n / (total + kinds)[context])).astype(np.float32))
            contexts.append(above)
            escapes.append((-np.log2(kinds / (total + kinds))).astype(np.float32))
        return cls(runs, costs, contexts, escapes)

    def cost(self, keys: np.ndarray) -> np.ndarray:
        """Cost of the last byte of each run of four."""
        out = np.zeros(len(keys), np.float32)
        left = np.arange(len(keys))
        for order in range(ORDER, -1, -1):
            own = _suffix(keys[left], order)
            at, seen = _find(self.runs[order], own)
            out[left[seen]] += self.costs[order][at[seen]]
            left, own = left[~seen], own[~seen] >> np.uint32(8)
            if not len(left):
                return out
            at, seen = _find(self.contexts[order], own)
            out[left[seen]] += self.escapes[order][at[seen]]
        out[left] += 8.0
        return out


def _suffix(keys: np.ndarray, order: int) -> np.ndarray:
    return keys if order == ORDER else keys & np.uint32((1 << (8 * (order + 1))) - 1)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each key in the sorted table, whether it is there)."""
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


class Ppm:
    """Frozen context trees of some languages, each with no more than its own training texts hold."""

    def __init__(self, trees: dict[str, Tree]):
        self.langs = sorted(trees)
        self.trees = [trees[lang] for lang in self.langs]

    def lengths(self, column: pa.Array) -> np.ndarray:
        """Code length in bits of each text under each language; each distinct run of a slice is looked up once a language."""
        raw, offsets = X.buffers(column)
        out = np.zeros((len(column), len(self.langs)))
        for i, j in X.slices(offsets, X.SLICE_BYTES // 2):
            own, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            for begin in range(0, len(own), X.SLICE_BYTES // 2):  # one long text is read in parts
                end = min(len(own), begin + X.SLICE_BYTES // 2)
                lead = max(0, begin - ORDER)
                inside = np.clip(at, lead, end) - lead
                distinct, place = np.unique(grams(own[lead:end], inside)[begin - lead :], return_inverse=True)
                inside = np.clip(at, begin, end) - begin
                full = np.flatnonzero(np.diff(inside) > 0)
                for k, tree in enumerate(self.trees if len(full) else ()):
                    out[i + full, k] += np.add.reduceat(tree.cost(distinct)[place], inside[:-1][full], dtype=np.float64)
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language, posterior) of each text; ``und`` and 0 without text or letters."""
        lengths = self.lengths(column)
        if not self.langs:
            return [UNKNOWN] * len(column), np.zeros(len(column))
        best = lengths.argmin(axis=1)
        score = 1 / np.exp2(np.maximum(lengths.min(axis=1, keepdims=True) - lengths, -1000)).sum(axis=1)
        raw, offsets = X.buffers(column)
        ascii_letters = np.concatenate(([0], np.cumsum(((raw | 32) >= 97) & ((raw | 32) <= 122))))
        sure = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
        langs = [self.langs[b] for b in best]
        for k in np.flatnonzero(~sure).tolist():
            if not any(c.isalpha() for c in column[k].as_py() or ""):
                langs[k], score[k] = UNKNOWN, 0.0
        return langs, score


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of four bytes of this partition's texts by language; starts anew beyond ``FLUSH`` runs to bound memory."""
    have: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, (keys, n) in have.items():
            for k in range(0, len(keys), 100_000):
                part = keys[k : k + 100_000]
                yield pa.record_batch([pa.array([lang] * len(part), pa.string()), pa.array(part.astype(np.int64)), pa.array(n[k : k + 100_000].astype(np.int64))], names=["lang", "gram", "n"])
        have.clear()

    def merge(lang: str, keys: np.ndarray, n: np.ndarray) -> None:
        if lang in have:
            keys, at = np.unique(np.concatenate((have[lang][0], keys)), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate((have[lang][1], n))).astype(np.int64)
        have[lang] = keys, n

    for batch in batches:
        langs = batch["lang"].to_numpy(zero_copy_only=False)
        for lang in set(langs):
            raw, offsets = X.buffers(batch["text"].filter(pa.array(langs == lang)))
            for i, j in X.slices(offsets):
                merge(lang, *np.unique(grams(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), return_counts=True))
        if sum(len(keys) for keys, _ in have.values()) > FLUSH:
            yield from rows()
    yield from rows()


_ARRAYS = ", ".join(f"{name}{order} binary" for name in ("runs", "costs", "contexts", "escapes") for order in range(ORDER + 1))


def _tree(key: tuple, table: pa.Table) -> pa.Table:
    tree = Tree.of(table["gram"].to_numpy().astype(np.uint32), table["n"].to_numpy().astype(float))
    arrays = {f"{name}{order}": pa.array([x.tobytes()], pa.binary()) for name in ("runs", "costs", "contexts", "escapes") for order, x in enumerate(getattr(tree, name))}
    return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), **arrays})


def fit(docs: DataFrame) -> Ppm:
    """Counts of all runs over all rows of ``docs`` (text, lang) with a lang and a text.

    Each language's tree is made by one task from its distinct runs (which a language has some hundreds of thousands of, however
    many its texts); driver and workers hold the trees, about 20 bytes a distinct run of a language.
    """
    rows = columns_for(docs, text="string", lang="string").where("lang is not null and text is not null")
    counts = keep(rows.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    trees = {}
    for r in counts.groupBy("lang").applyInArrow(_tree, f"lang string, {_ARRAYS}").toLocalIterator():
        arrays = ([np.frombuffer(r[f"{name}{order}"], kind) for order in range(ORDER + 1)] for name, kind in (("runs", np.uint32), ("costs", np.float32), ("contexts", np.uint32), ("escapes", np.float32)))
        trees[r["lang"]] = Tree(*arrays)
    drop(counts)
    return Ppm(trees)


def held_out(doc_id: str = "doc_id"):
    """True for the documents that training leaves out; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: Ppm | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs`` (doc_id, text, lang and any other columns).

    Without a model, one is learned from the rows with a lang, a text and a doc_id whose crc32 modulo 3 is not 1. Null texts and
    texts without letters are ``und`` with score 0, as is every text if there is nothing to learn from. Ties go to
    the first language by name. Repeated rows are alike; an empty table gives an empty table.
    """
    rows = columns_for(docs, doc_id="long", text="string").withColumn("held_out", held_out())
    if model is None:
        model = fit(columns_for(docs, doc_id="long", text="string", lang="string").where("doc_id is not null").where(~held_out()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score = model.predict(batch["text"])
            yield pa.record_batch([batch["doc_id"], batch["held_out"], pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
