"""Cutting texts into the pieces that byte-level BPE encodes one by one.

The pattern is the public one of byte-level vocabularies: contractions, an
optional space before a run of letters, of digits or of other marks, and runs
of white space that leave their last character to what follows.  A whole batch
is cut at once from the class of each character; equal pieces of a batch are
encoded once and a cache of bounded size serves the following batches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from . import _arrays as A

LETTER, DIGIT, SPACE = 1, 2, 3
CACHE, CACHE_BYTES = 400_000, 32 << 20


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point: other, letter, digit or white space."""
    chars = "".join("\x00" if 0xD800 <= i < 0xE000 else chr(i) for i in range(0x110000))
    table = np.zeros(len(chars), dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, chars):
            table[m.start() : m.end()] = kind
    return table


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the pieces of the texts between ``offsets``."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    place = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(cp)
    kind = classes()[cp]
    opens = np.zeros(n + 1, dtype=bool)
    opens[np.searchsorted(place, offsets)] = True
    opens[0] = opens[n] = True
    start = opens.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~opens[1:n]) + 1
    start[after - 1] = True
    start[after[cp[after - 1] == 32]] = False
    mark = np.flatnonzero((cp == 39) & start[:n])
    if len(mark):
        padded = np.concatenate([cp, np.zeros(2, np.uint32)])
        closed = np.concatenate([opens, np.ones(2, bool)])
        one, two = padded[mark + 1], padded[mark + 2]
        inside = ~closed[mark + 1]
        short = inside & np.isin(one, [ord(c) for c in "stmd"])
        pair = one.astype(np.int64) * 65536 + two
        long = inside & ~closed[mark + 2] & np.isin(pair, [ord(a) * 65536 + ord(b) for a, b in ("re", "ve", "ll")])
        start[mark[short | long] + 1] = False
        start[mark[short] + 2] = True
        start[mark[long] + 3] = True
    edges = np.append(place, len(data))[np.flatnonzero(start)]
    return edges[:-1], edges[1:]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + length), one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, the first place of each, and the number of each place's value.

    Each value's upper bits and its place are sorted as one number; where values
    share their upper bits only, which hashes hardly ever do, they are sorted whole.
    """
    bits = max(1, int(len(h) - 1).bit_length())
    low = A.U((1 << bits) - 1)
    order = (np.sort((h & ~low) | np.arange(len(h), dtype=A.U)) & low).astype(np.int64)
    ordered = h[order]
    step = ordered[1:] != ordered[:-1]
    if (step & (((ordered[1:] ^ ordered[:-1]) & ~low) == 0)).any():
        return np.unique(h, return_index=True, return_inverse=True)
    begins = np.concatenate([[True], step])
    inverse = np.empty(len(h), dtype=np.int64)
    inverse[order] = np.cumsum(begins) - 1
    return ordered[begins], order[begins], inverse


class Encoder:
    """Encodes batches of texts; ``encode(data, start, end)`` encodes distinct pieces.

    ``encode`` returns one flat array of ids and the number of ids of each piece.
    """

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> None:
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, A.U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.place, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.text = np.zeros(0, np.int32), np.zeros(0, np.uint8)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of the column, and the offsets of each text in them."""
        data, offsets, _ = A.flat(column)
        start, end = cut(data, offsets)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        n = end - start
        keys, first, inverse = groups(A.byte_hash(data, start, end))
        # a piece counts as another one only if their bytes agree, which for up to seven bytes their hashes tell
        lead = first[inverse]
        odd = n != n[lead]
        unsure = np.flatnonzero((n > 7) & ~odd & (lead != np.arange(len(n))))
        odd[unsure] = ~A.same_spans(data, start[unsure], start[lead[unsure]], n[unsure])
        if len(self.keys) > CACHE or len(self.text) > CACHE_BYTES:
            self.clear()
        spot = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[spot] != keys if len(self.keys) else np.ones(len(keys), bool)
        if len(self.keys):
            other = ~new & (self.size[spot] != n[first])
            unsure = np.flatnonzero(~new & ~other & (n[first] > 7))
            other[unsure] = ~A.same_spans(data, start[first[unsure]], self.place[spot[unsure]], n[first[unsure]], self.text)
            odd |= other[inverse]
        if new.any():
            at_new, n_new = start[first[new]], n[first[new]]
            ids, counts = self.encode(data, at_new, at_new + n_new)
            at = len(self.ids) + np.cumsum(counts) - counts
            place = len(self.text) + np.cumsum(n_new) - n_new
            merged = np.concatenate([self.keys, keys[new]])
            order = np.argsort(merged, kind="stable")
            self.keys = merged[order]
            self.at, self.n = np.concatenate([self.at, at])[order], np.concatenate([self.n, counts])[order]
            self.place, self.size = np.concatenate([self.place, place])[order], np.concatenate([self.size, n_new])[order]
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.text = np.concatenate([self.text, data[ragged(at_new, n_new)]])
            spot = np.searchsorted(self.keys, keys)
        spot = spot[inverse]
        at, lengths, ids = self.at[spot], self.n[spot], self.ids
        if odd.any():  # pieces that share their hash with another one, encoded one by one
            more, counts = self.encode(data, start[odd], end[odd])
            at[odd], lengths[odd] = len(ids) + np.cumsum(counts) - counts, counts
            ids = np.concatenate([ids, more.astype(np.int32)])
        ids = ids[ragged(at, lengths)]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        return ids, sums[np.searchsorted(start, offsets)]
