"""Sets of word shingles as 64-bit hashes, and their parity sketches."""

from __future__ import annotations

import numpy as np

from marlstone.llm.common import LOWER, byte_words, mixed, span_hashes

#: Bytes of words: all but white space.
WORD_BYTES = np.ones(256, bool)
WORD_BYTES[[0x20, *range(0x09, 0x0E)]] = False
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _shingles(word: np.ndarray, bounds: np.ndarray, words: int, inside: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Hashes of the shingles that start at ``inside`` words, then of the texts ``short`` as a whole."""
    m = len(word)
    whole = np.zeros(m, np.uint64)
    for j in range(min(words, m)):
        whole[: m - j] += word[j:] * _SALTS[j]
    few = np.empty(len(short), np.uint64)
    for i, d in enumerate(short):
        own = word[bounds[d] : bounds[d + 1]]
        few[i] = (own * _SALTS[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mixed(np.r_[whole[inside], few])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and n + 1 offsets.

    A shingle is ``words`` consecutive words, lower-cased in A-Z; a text with
    fewer words, but some, has all of them as its one shingle.
    """
    hashes, ends, _ = shingle_sets_twice(data, offsets, words, seed, None)
    return hashes, ends


def shingle_sets_twice(data: np.ndarray, offsets: np.ndarray, words: int, seed: int, other: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """``shingle_sets``, and each member's hash by a second seed, which knows nothing of the first."""
    starts, ends = byte_words(data, offsets, WORD_BYTES)
    lower = LOWER[data]
    bounds = np.searchsorted(starts, offsets)
    counts = np.diff(bounds)
    doc = np.repeat(np.arange(len(counts)), counts)
    inside = np.flatnonzero(np.arange(len(starts)) + words <= bounds[doc + 1])
    short = np.flatnonzero((counts > 0) & (counts < words))
    docs, hashes = np.r_[doc[inside], short], _shingles(span_hashes(lower, starts, ends, seed), bounds, words, inside, short)
    second = None if other is None else _shingles(span_hashes(lower, starts, ends, other), bounds, words, inside, short)
    o = np.argsort(hashes)
    o = o[np.argsort(docs[o].astype(np.uint16 if len(counts) < 1 << 16 else np.int64), kind="stable")]
    docs, hashes = docs[o], hashes[o]
    new = np.r_[True, (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])][: len(docs)]
    return hashes[new], np.searchsorted(docs[new], np.arange(len(offsets))), None if second is None else second[o[new]]


def set_prints(hashes: np.ndarray, ends: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set: XOR of scrambled members, sum of the second hashes of members (or of the first, scrambled otherwise); 0 for the empty set."""
    a, b = np.zeros(len(hashes) + 1, np.uint64), np.zeros(len(hashes) + 1, np.uint64)
    np.bitwise_xor.accumulate(mixed(hashes), out=a[1:]) if len(hashes) else None
    np.cumsum(mixed((hashes if second is None else second) ^ _SALTS[0]), out=b[1:])
    return a[ends[1:]] ^ a[ends[:-1]], b[ends[1:]] - b[ends[:-1]]


def parity_sketches(hashes: np.ndarray, ends: np.ndarray, words: int) -> np.ndarray:
    """A row of ``words`` 64-bit words for each set: every member flips one bit, so the Hamming distance of two rows is at most the number of members that only one set has."""
    bit = (mixed(hashes ^ _SALTS[5]) >> np.uint64(13)) % np.uint64(64 * words)
    out = np.zeros((len(ends) - 1, words), np.uint64)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    np.bitwise_xor.at(out, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out
