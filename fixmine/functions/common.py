"""Longest common runs of long texts, from suffixes that all texts of an Arrow batch share.

All texts of a slice stand one after the other, each closed by a mark of its own. Runs of 1, 2, 4, ... items are named by doubling: two
runs have one name if they are equal, and names are in order. The last names order all suffixes; of the suffixes of two texts in
order, a longest common run begins two neighbours, one of each text. How far neighbours agree is read from the names, the longest
runs first. All steps are sorts and look-ups of arrays: n items take n log n for each doubling, whatever the texts repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items of a slice, besides one longer pair.
SLICE = 1 << 20
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _names(items: np.ndarray, longest: int) -> list[np.ndarray]:
    """Names of the runs of 1, 2, 4, ... items from each place, up to a run as long as the longest text; a run past the end has the least names."""
    now = np.unique(items, return_inverse=True)[1].astype(np.int64) + 1
    out, step = [now], 1
    while step < longest and now.max(initial=0) < len(now):
        after = np.zeros(len(now), np.int64)
        after[:-step] = now[step:]
        now = np.unique(now * (len(now) + 2) + after, return_inverse=True)[1] + 1
        out.append(now)
        step *= 2
    return out


def _agreement(names: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many items from x and y on are equal."""
    n, size = np.zeros(len(x), np.int64), len(names[0])
    x, y = x.copy(), y.copy()
    for k in range(len(names) - 1, -1, -1):
        inside = (x < size) & (y < size)
        same = np.zeros(len(x), bool)
        same[inside] = names[k][x[inside]] == names[k][y[inside]]
        n[same] += 1 << k
        x[same] += 1 << k
        y[same] += 1 << k
    return n


def longest_common(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
    """(length, begin in a, begin in b) of the longest common run of each pair of arrays of items from 0 on; of several the first in a, then in b; zeros if there is none."""
    texts = [t for p in pairs for t in p]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    if not len(texts):
        return []
    # a mark of its own at the end of each text, so that no run goes on past it
    items = np.concatenate([part for k, t in enumerate(texts) for part in (np.asarray(t, np.int64), np.array([-1 - k], np.int64))])
    names = _names(items, int(sizes.max()))
    text = np.repeat(np.arange(len(texts)), sizes)
    begin = np.cumsum(sizes) - sizes
    order = np.lexsort((names[-1], text // 2))
    x, y = order[:-1], order[1:]
    apart = (text[x] // 2 == text[y] // 2) & (text[x] != text[y])
    x, y = x[apart], y[apart]
    n = _agreement(names, x, y)
    pair = text[x] // 2
    best = np.zeros(len(pairs), np.int64)
    np.maximum.at(best, pair, n)
    out = []
    tops = np.flatnonzero((n == best[pair]) & (n > 0))
    bounds = np.searchsorted(pair[tops], np.arange(len(pairs) + 1))
    for p in range(len(pairs)):
        some = tops[bounds[p] : bounds[p + 1]]
        if not len(some):
            out.append((0, 0, 0))
            continue
        # a run of that length has two names: of the power of two at its beginning, and of that at its end
        length = int(best[p])
        k = length.bit_length() - 1
        head, tail = names[k], length - (1 << k)
        named = lambda at: head[at] * (len(items) + 2) + head[at + tail]  # noqa: B023, E731
        a, b = (np.arange(begin[t], begin[t] + max(0, sizes[t] - length)) for t in (2 * p, 2 * p + 1))
        runs = named(np.unique(np.concatenate((x[some], y[some]))))
        first = a[np.isin(named(a), runs)][0]
        out.append((length, int(first - begin[2 * p]), int(b[named(b) == named(first)][0] - begin[2 * p + 1])))
    return out


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(sizes):
        j, total = i + 1, sizes[i]
        while j < len(sizes) and total + sizes[j] <= SLICE:
            total += sizes[j]
            j += 1
        yield i, j
        i = j


def _found(a: pd.Series, b: pd.Series, words: bool) -> pd.DataFrame:
    rows = []
    sizes = (a.str.len().fillna(0) + b.str.len().fillna(0)).to_numpy(np.int64)
    for i, j in _slices(sizes):
        known: dict[str, int] = {}
        pairs = []
        for pair in zip(a.iloc[i:j], b.iloc[i:j], strict=True):
            if words:
                pairs.append(tuple(np.array([known.setdefault(w, len(known)) for w in _WORD.findall(t or "")], np.int64) for t in pair))
            else:
                pairs.append(tuple(np.frombuffer((t or "").encode("utf-32-le"), np.uint32).astype(np.int64) for t in pair))
        rows += longest_common(pairs)
    return pd.DataFrame(rows, columns=["length", "begin_a", "begin_b"]).astype("int64")


def longest_common_run(a: Column | str, b: Column | str, words: bool = False) -> Column:
    """A struct (length, begin_a, begin_b) of the longest run of characters, or of words, that two texts of any length share.

    Places count from 0; of several longest runs the first in a counts, then in b. Null texts are empty, and length 0 begins at 0.
    """

    @F.pandas_udf("length long, begin_a long, begin_b long")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return _found(x, y, words)

    return run(a, b)
