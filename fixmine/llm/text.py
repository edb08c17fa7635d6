"""Vectorised text kernels shared by the operators of this subpackage.

Everything here works on UTF-8 bytes of whole texts. Words are maximal runs of bytes outside
``\\x20\\x09-\\x0D`` (these bytes occur in UTF-8 only as those characters), A-Z are lower-cased first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
SHINGLE = 5
#: Bytes handled by one call of the vectorised kernels; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_GOLDEN = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator, element by element."""
    with np.errstate(over="ignore"):
        x = x + _GOLDEN
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE_KEY = mix(np.arange(256, dtype=U64))[LOWER]
_BYTE_KEY[IS_SPACE] = 0
_PLACE_KEY = mix(np.arange(1000, 1000 + 4096, dtype=U64)) | U64(1)
_ORDER_KEY = mix(np.arange(77, 77 + SHINGLE, dtype=U64)) | U64(1)


def place_keys(n: int) -> np.ndarray:
    """Odd multipliers of the places in a word; grows when a longer word comes."""
    global _PLACE_KEY
    if n > len(_PLACE_KEY):
        _PLACE_KEY = mix(np.arange(1000, 1000 + 2 * n, dtype=U64)) | U64(1)
    return _PLACE_KEY


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES, texts: int | None = None):
    """Ranges (i, j) of consecutive texts of at most ``most`` bytes together, or of one longer text; of at most so many ``texts``."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(i + 1, j), i + (texts or n))
        yield i, j
        i = j


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start byte of every word, and the number of words before each text (n texts + 1 entries)."""
    solid = ~IS_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(raw)]
    first[inner] = solid[inner]  # a text always begins a word of its own
    starts = np.flatnonzero(first)
    return starts, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word; case of A-Z does not count."""
    if not len(starts):
        return np.zeros(0, U64)
    body = raw[starts[0] :]
    begin = starts - starts[0]
    sizes = np.diff(np.append(begin, len(body)))
    place = np.arange(len(body)) - np.repeat(begin, sizes)
    keys = place_keys(int(sizes.max()))
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(_BYTE_KEY[body] * keys[place], begin))


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles of each text, in order and with repeats, and where each text begins.

    A text of 1 to ``size - 1`` words has its whole sequence as its one shingle, a text without words has none.
    """
    starts, bounds = word_spans(raw, offsets)
    words = word_hashes(raw, starts)
    counts = np.diff(bounds)
    n_of = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(n_of)))
    out = np.empty(at[-1], U64)
    keys = _ORDER_KEY if size <= SHINGLE else mix(np.arange(77, 77 + size, dtype=U64)) | U64(1)
    with np.errstate(over="ignore"):
        if len(words) >= size:
            rolled = words[: len(words) - size + 1] * keys[0]
            for k in range(1, size):
                rolled += words[k : len(words) - size + 1 + k] * keys[k]
            long = counts >= size
            # text i owns rolled[bounds[i] : bounds[i] + n_of[i]]
            src = np.repeat(bounds[:-1][long] - at[:-1][long], n_of[long]) + (np.arange(at[-1])[np.repeat(long, n_of)])
            out[np.repeat(long, n_of)] = rolled[src]
        for i in np.flatnonzero((counts > 0) & (counts < size)):
            w = words[bounds[i] : bounds[i + 1]]
            out[at[i]] = (w * keys[: len(w)]).sum(dtype=U64) + U64(len(w))
    return mix(out), at


def shingle_sets(raw: np.ndarray, offsets: np.ndarray):
    """Sorted distinct shingle hashes of each text in turn."""
    for i, j in slices(offsets):
        base = offsets[i]
        all_, at = shingles(raw[base : offsets[j]], offsets[i : j + 1] - base)
        for k in range(j - i):
            own = np.sort(all_[at[k] : at[k + 1]])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            yield own


def fingerprint(sorted_set: np.ndarray) -> bytes:
    """128 bits of a sorted array of hashes; empty for the empty set."""
    import xxhash

    return xxhash.xxh3_128_digest(sorted_set.tobytes()) if len(sorted_set) else b""


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def trim() -> None:
    """Give the C library's and Arrow's free memory back to the machine."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def trimmed(run):
    """A batch function that trims memory when a task ends."""
    from functools import wraps

    @wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return whole
