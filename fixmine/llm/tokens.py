"""Byte-level BPE over Arrow columns: ids of the ``tokenizers`` library, each distinct pre-token encoded once.

The splitting rule of the byte-level tokenizer is evaluated with array operations over code points; only the distinct
pre-tokens of a slice that are not in the cache go through the library. Texts with characters outside the tables
below go through the library whole, so the ids are always the library's own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from fixmine.llm.text import U64, buffers, mix, slices

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: Characters per slice; bounds the memory of the array operations.
SLICE = 1 << 19
#: Distinct pre-tokens kept by one worker before the cache starts anew.
CACHE = 1_000_000

# Blocks whose letters, numbers and white space are the same in every recent edition of Unicode.
_LIMIT = 0x2070
_LETTER, _NUMBER, _SPACE, _OTHER, _UNSURE = range(5)


def _classes() -> np.ndarray:
    import regex

    out = np.full(_LIMIT + 1, _UNSURE, np.uint8)
    for a, b in ((0x0000, 0x0530), (0x2000, 0x2070)):
        for c in range(a, b):
            x = chr(c)
            out[c] = _LETTER if regex.match(r"\p{L}", x) else _NUMBER if regex.match(r"\p{N}", x) else _SPACE if regex.match(r"\s", x) else _OTHER
    return out


def default_path(name: str = DEFAULT_TOKENIZER) -> str:
    """Place of a vocabulary file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes string columns with one tokenizer file; one instance serves one Python worker.

    special: a special token that a text spells out is that token, as in the library; without it, ordinary pieces.
    """

    _made: dict[tuple[str, bool], Encoder] = {}

    @classmethod
    def of(cls, path: str, special: bool = False) -> Encoder:
        if (path, special) not in cls._made:
            cls._made[path, special] = cls(path, special)
        return cls._made[path, special]

    def __init__(self, path: str, special: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.path, self.special, self.whole = path, special, None
        self.pieces = Tokenizer.from_file(path)  # for what is one pre-token already
        self.pieces.encode_special_tokens = True
        self.spelled = [t.content for t in self.pieces.get_added_tokens_decoder().values()] if special else []
        self.pieces.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.classes = _classes()
        self.keys = mix(np.arange(5000, 5256, dtype=U64)) | U64(1)
        self._reset()

    def _reset(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes of pre-tokens, and the place of each in the arrays below
        self.place = np.zeros(0, np.int32)
        self.first = np.zeros(1 << 16, np.int32)
        self.size = np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 17, np.uint32)
        self.used = 0

    @property
    def tokenizer(self):
        """The library's tokenizer for texts that the tables don't cover, or that spell out a special token."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
            self.whole.encode_special_tokens = not self.special
        return self.whole

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, hashes: np.ndarray, texts: list[str]) -> None:
        """Encode new pre-tokens; hashes are sorted."""
        n = len(self.known)
        for i in range(0, len(texts), 20_000):
            ids = [e.ids for e in self.pieces.encode_batch_fast(texts[i : i + 20_000], add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            total = int(sizes.sum())
            while n + len(ids) > len(self.first):
                self.first, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.size))
            while self.used + total > len(self.pool):
                self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
            self.size[n : n + len(ids)] = sizes
            self.first[n : n + len(ids)] = self.used + np.cumsum(sizes) - sizes
            self.pool[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
            self.used += total
            n += len(ids)
        at = np.searchsorted(self.known, hashes)
        self.place = np.insert(self.place, at, np.arange(len(self.known), n, dtype=np.int32))
        self.known = np.insert(self.known, at, hashes)

    def _split(self, points: np.ndarray, kind: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Flags of the characters that begin a pre-token. ends: the first character after each text."""
        n = len(points)
        inner = ends[ends < n]
        new = np.ones(n, bool)
        new[1:] = kind[1:] != kind[:-1]
        new[inner] = True
        border = np.zeros(n + 1, bool)
        border[0] = border[ends] = True
        space = kind == _SPACE
        # the last white space before other text stands alone, or goes with what follows if it is a blank
        last = np.zeros(n, bool)
        last[:-1] = space[:-1] & ~space[1:]
        last &= ~border[1:]
        new |= last
        blank = np.flatnonzero(last & (points == 32))
        new[blank + 1] = False
        # contractions, where the apostrophe begins a pre-token
        for at in np.flatnonzero((points == 39) & new & ~border[1:]):
            if at + 1 < n and kind[at + 1] == _LETTER:
                one = chr(points[at + 1])
                two = one + chr(points[at + 2]) if at + 2 < n and not border[at + 2] else one
                k = 1 if one in "stmd" else 2 if two in ("re", "ve", "ll") else 0
                if k:
                    new[at + 1 : at + 1 + k] = False
                    if at + 1 + k < n:
                        new[at + 1 + k] = True
        return new

    def _fast(self, text: str, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of joined texts and the number of ids before each bound; None if a character is not in the tables or a special token counts."""
        if any(t in text for t in self.spelled):
            return None
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.classes[np.minimum(points, _LIMIT)]
        if (kind == _UNSURE).any():
            return None
        n = len(points)
        starts = np.flatnonzero(self._split(points, kind, bounds[1:]))
        sizes = np.diff(np.append(starts, n))
        place = np.arange(n) - np.repeat(starts, sizes)
        most = int(sizes.max(initial=0))
        if most > len(self.keys):
            self.keys = mix(np.arange(5000, 5000 + 2 * most, dtype=U64)) | U64(1)
        with np.errstate(over="ignore"):
            hashed = mix(np.add.reduceat((points.astype(U64) + U64(7)) * self.keys[place], starts) + sizes.astype(U64))
        distinct, where, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > CACHE:
            self._reset()
        at = np.searchsorted(self.known, distinct)
        at[at == len(self.known)] = 0
        fresh = np.flatnonzero(self.known[at] != distinct) if len(self.known) else np.arange(len(distinct))
        index = self.place[at].astype(np.int64) if len(self.known) else np.zeros(len(distinct), np.int64)
        if len(fresh):
            a = starts[where[fresh]]
            b = a + sizes[where[fresh]]
            index[fresh] = len(self.known) + np.arange(len(fresh))
            self._add(distinct[fresh], [text[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)])
        index = index[inverse]
        n_ids = self.size[index].astype(np.int64)
        before = np.concatenate(([0], np.cumsum(n_ids)))
        source = np.repeat(self.first[index] - before[:-1], n_ids) + np.arange(before[-1])
        return self.pool[source], before[np.searchsorted(starts, bounds)]

    def encode(self, column: pa.Array):
        """(ids, first id of each text) per slice of consecutive texts; null texts are empty."""
        raw, offsets = buffers(column)
        for i, j in slices(offsets, SLICE):
            own = offsets[i : j + 1]
            text = raw[own[0] : own[-1]].tobytes().decode("utf-8", "surrogatepass")
            if len(text) == own[-1] - own[0]:
                bounds = own - own[0]
            else:  # code points before each bound
                lead = np.concatenate(([0], np.cumsum((raw[own[0] : own[-1]] & 0xC0) != 0x80)))
                bounds = lead[own - own[0]]
            if not text:
                yield np.zeros(0, np.uint32), np.zeros(j - i + 1, np.int64)
                continue
            done = self._fast(text, bounds)
            if done is None:
                ids: list[np.ndarray] = []
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    one = self._fast(text[a:b], np.array([0, b - a])) if b > a else (np.zeros(0, np.uint32), None)
                    ids.append(one[0] if one else np.array(self._plain([text[a:b]])[0], np.uint32))
                done = np.concatenate(ids), np.concatenate(([0], np.cumsum([len(x) for x in ids])))
            yield done
