"""Texts cut into the pieces that a byte-level BPE merges within, and a cache of encoded pieces."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np

from marlstone.llm.common import equal_spans, span_hashes

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
#: Code points with the Unicode property White_Space (fixed values).
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: English endings that are pieces of their own behind an apostrophe (fixed values of the pattern).
_ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


@cache
def _classes() -> np.ndarray:
    out = np.full(0x110000, _OTHER, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            out[point] = _LETTER
        elif kind == "N":
            out[point] = _NUMBER
    out[_WHITE] = _SPACE
    return out


def split_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of every match of the byte-level BPE pattern, all texts at once.

    The pattern is: an apostrophe with an English ending, or letters, or
    digits, or other characters, each with one optional space before, or white
    space, of which the last character before a non-space is kept apart.
    """
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, offsets)] = True
    changed = np.r_[True, kind[1:] != kind[:-1]] | first[:-1]
    white = kind == _SPACE
    last_white = white & ~first[1:] & np.r_[~white[1:], False]
    behind_space = np.r_[False, points[:-1] == 0x20] & ~first[:-1]
    start = changed & (white | ~behind_space) | last_white
    quote = np.flatnonzero(start & (points == 0x27))
    if len(quote):
        padded = np.r_[points, 0, 0, 0]
        for ending in _ENDINGS:
            size = len(ending)
            ok = np.ones(len(quote), bool)
            for j, c in enumerate(ending, 1):
                ok &= (padded[quote + j] == ord(c)) & ~first[np.minimum(quote + j, n)]
            for j in range(1, size + 1):
                start[quote[ok] + j] = False
            behind = quote[ok] + size + 1
            start[behind[behind < n]] = True
            quote = quote[~ok]
    begin = at[start]
    return begin, np.r_[begin[1:], len(data)]


class PieceCache:
    """Token ids by piece; pieces not seen before go to ``encode`` together.

    ``encode`` takes a list of pieces as bytes and returns the ids of all, end
    to end, with their counts. Pieces are found by a hash and then compared
    byte by byte; a piece whose hash another one has is looked up by its bytes.
    ``split`` cuts texts into pieces, or into parts that are encoded apart. About ``limit`` pieces of ``most_bytes`` in all are kept beside a call's own, so memory is bounded whatever the texts hold.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 1_500_000, split: Callable = split_pieces, hashes_of: Callable = span_hashes, most_bytes: int = 64 << 20):
        self.encode, self.limit, self.split, self.hashes_of, self.most_bytes = encode, limit, split, hashes_of, most_bytes
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.slots = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.starts, self.counts, self.ids = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint32)
        self.bytes, self.places, self.sizes = np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int32)
        self.others: dict[bytes, int] = {}

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        """New slots for pieces."""
        ids, counts = self.encode(pieces)
        n, sizes = len(self.counts), np.array([len(p) for p in pieces], np.int32)
        self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(counts) - counts]
        self.counts, self.ids = np.r_[self.counts, counts.astype(np.int32)], np.r_[self.ids, ids.astype(np.uint32)]
        self.places, self.sizes = np.r_[self.places, len(self.bytes) + np.cumsum(sizes) - sizes], np.r_[self.sizes, sizes]
        self.bytes = np.r_[self.bytes, np.frombuffer(b"".join(pieces), np.uint8)]
        return np.arange(n, n + len(pieces))

    def ids_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts end to end, and n + 1 offsets of the texts in them."""
        begin, end = self.split(data, offsets)
        hashes, first, which = np.unique(self.hashes_of(data, begin, end), return_index=True, return_inverse=True)
        if len(self.counts) > self.limit or len(self.bytes) > self.most_bytes:
            self._clear()
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            slots = self._add([raw[a:b] for a, b in zip(begin[first[new]].tolist(), end[first[new]].tolist())])
            self.hashes, self.slots = np.insert(self.hashes, at[new], hashes[new]), np.insert(self.slots, at[new], slots)
            at = np.searchsorted(self.hashes, hashes)
        slot = self.slots[at][which]
        wrong = self.sizes[slot] != end - begin
        alike = np.flatnonzero(~wrong)
        wrong[alike] = ~equal_spans(data, begin[alike], self.bytes, self.places[slot[alike]], self.sizes[slot[alike]])
        for i in np.flatnonzero(wrong).tolist():
            piece = data[begin[i] : end[i]].tobytes()
            if piece not in self.others:
                self.others[piece] = int(self._add([piece])[0])
            slot[i] = self.others[piece]
        counts = self.counts[slot]
        ends = np.r_[0, np.cumsum(counts)]
        ids = self.ids[np.repeat(self.starts[slot] - ends[:-1], counts) + np.arange(int(ends[-1]))]
        return ids, ends[np.searchsorted(begin, offsets)]
