"""Byte-level BPE by DuckDB's recursive queries, one database per task."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marlstone.llm.common import row_slices, string_buffer, trimmed
from marlstone.llm.pieces import PieceCache, split_pieces

#: Bytes of text at once, and of those that are cut into parts at once; bytes of words in a query, ids in a query that decodes.
#: A query scans the merge table in every step, whatever its words; so a slice is larger than what is cut at once, and a query has the new words of all of it.
_SLICE, _CUT, _QUERY, _IDS = 1 << 20, 1 << 19, 1 << 18, 1 << 17
#: Ids that an ordered aggregate joins; fewer would cost a group more than its ids.
_STRETCH = 1 << 10
#: Parts of words longer than this are encoded in windows of as many bytes, which are then joined.
_WINDOW = 64
#: Parts of words, bytes (of parts, and of decoded runs), pairs of tokens and runs of ids that a task process remembers.
_PARTS, _CACHE_BYTES, _PAIRS, _RUNS = 600_000, 8 << 20, 1 << 18, 300_000

#: Rows are tokens of words by their first byte ``i`` and the byte behind them.
#: Each step joins the tokens of words that still change to the tokens behind
#: them and to the merge table, and contracts every word's pair of least rank:
#: the leftmost, and the later ones that don't overlap it (of places that
#: overlap, every second one from the left). One by one from the left gives
#: the same: a contraction never makes a pair of lower rank than its own. That
#: holds where no token, encoded alone, takes a step of a higher rank than its
#: own, which ``ranks_rise`` verifies for a vocabulary. Rows are kept by key,
#: so the table never holds more than one row for each byte.
_ENCODE = """
WITH RECURSIVE state(word, i, e, token) USING KEY (word, i) AS (
  SELECT word, i, i + 1, token FROM bytes_of_words
  UNION
  (WITH live AS (
    SELECT * FROM recurring.state WHERE token >= 0 AND word IN (SELECT word FROM state)
  ), pairs AS (
    SELECT s.word, s.i, s.e, t.i AS next, t.e AS e2, m.rank
    FROM live s JOIN live t ON s.word = t.word AND s.e = t.i JOIN merges m ON s.token = m.a AND t.token = m.b
  ), least AS (
    SELECT word, i, e, next, e2, rank, coalesce(lag(e) OVER w <> i, true) AS apart, row_number() OVER w AS n
    FROM pairs JOIN (SELECT word, min(rank) AS rank FROM pairs GROUP BY word) USING (word, rank)
    WINDOW w AS (PARTITION BY word ORDER BY i)
  ), contracted AS (
    SELECT * FROM (SELECT *, n - max(CASE WHEN apart THEN n END) OVER (PARTITION BY word ORDER BY n) AS nth FROM least) WHERE nth % 2 = 0
  )
  SELECT word, i, e2, rank FROM contracted UNION ALL SELECT word, next, e2, -1 FROM contracted)
)
SELECT word, token FROM state WHERE token >= 0 ORDER BY word, i
"""

_DECODE = """
SELECT r.doc, string_agg(v.chars, '' ORDER BY r.i) AS chars
FROM ids r JOIN vocabulary v ON v.id = r.id GROUP BY r.doc ORDER BY r.doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def ranks_rise(ranks: dict[bytes, int]) -> bool:
    """Whether every token, encoded alone by its leftmost pair of least rank, becomes itself and takes no step of a higher rank than its own.

    Then a contraction to T with rank r never stands beside an x so that T + x
    has a rank below r: the tokens of that stretch of bytes were contracted
    just as in T + x alone, which would have taken the step of rank r too.
    """
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            least, i = min((ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if least > rank:
                return False
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return True


class SqlBpe:
    """A vocabulary in DuckDB: tokens by id, and every pair of tokens that makes a token, with its rank."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.db = duckdb.connect(":memory:")
        self.db.execute("SET threads = 1")
        self.db.execute("SET memory_limit = '400MB'")
        self.db.execute("SET temp_directory = ''")
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        merges = pa.table([pa.array(x, pa.int32()) for x in zip(*pairs)], ["a", "b", "rank"])  # noqa: F841 (read by name below)
        # bytes as characters of the same number: SQL's ordered string_agg then joins bytes
        chars = pa.table([pa.array(list(ranks.values()), pa.int32()), pa.array([t.decode("latin-1") for t in ranks])], ["id", "chars"])  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM chars")
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.twos, threes = np.zeros(1 << 16, bool), np.zeros(1 << 24, bool)
        for t in ranks:
            if len(t) == 2:
                self.twos[t[0] << 8 | t[1]] = True
            for i in range(len(t) - 2):
                threes[t[i] << 16 | t[i + 1] << 8 | t[i + 2]] = True
        self.threes = np.packbits(threes, bitorder="little")
        self.tokens, self.sizes = [b""] * (max(ranks.values()) + 1), np.zeros(max(ranks.values()) + 1, np.int64)
        for t, r in ranks.items():
            self.tokens[r], self.sizes[r] = t, len(t)
        self.spaced = np.array([t[:1] == b" " for t in self.tokens])
        self.apart: dict[tuple[int, int], bool] = {}
        self._clear_runs()
        self.cache = PieceCache(self.encode, limit=_PARTS, split=self._split, most_bytes=_CACHE_BYTES)

    def _split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, a = [np.empty(0, np.int64)], 0
        while a < len(offsets) - 1:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _CUT, side="right")) - 1)
            some = data[offsets[a] : offsets[b]]
            found.append(self._parts(some, split_pieces(some, offsets[a : b + 1] - offsets[a])[0]) + offsets[a])
            a = b
        parts = np.concatenate(found)
        return parts, np.r_[parts[1:], len(data)]

    def _parts(self, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """First bytes of the parts of words that start at ``begin``: words, cut where no token can lie across.

        Such a token would be the two bytes at the cut, or hold them with the
        byte before or behind.
        """
        wide = data.astype(np.int32)
        two = wide[:-1] << 8 | wide[1:]
        at = two[:-1] << 8 | wide[2:]
        three = (self.threes[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        whole = np.ones(len(data), bool)  # whether a byte belongs to the part of the one before
        whole[1:] = self.twos[two] | np.r_[False, three][: len(two)] | np.r_[three, False][: len(two)]
        whole[begin] = False
        return np.flatnonzero(~whole)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and their number in each."""
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum([0, *map(len, words)])
        parts = self._parts(data, begin[:-1])
        sizes = np.diff(np.r_[parts, len(data)])
        windows = -(-sizes // _WINDOW)
        first = np.cumsum(windows) - windows
        starts = np.repeat(parts, windows) + (np.arange(int(windows.sum())) - np.repeat(first, windows)) * _WINDOW
        ids, counts = self._encode_spans(data, starts, np.r_[starts[1:], len(data)])
        if (windows > 1).any():
            ids = self._joined(ids, counts, parts)
        return ids, np.diff(np.searchsorted(np.cumsum(self.sizes[ids]), begin, side="right"))

    def _encode_spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some spans of bytes, each encoded alone, end to end, and their number in each; a query for each ``_QUERY`` bytes."""
        sizes, ids, counts, a = ends - starts, [np.empty(0, np.int32)], [np.empty(0, np.int64)], 0
        filled = np.cumsum(sizes)
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(filled, filled[a] - sizes[a] + _QUERY, side="right")))
            size = sizes[a:b]
            word = np.repeat(np.arange(b - a, dtype=np.int32), size)
            i = (np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
            tokens = self.byte_ids[data[np.repeat(starts[a:b], size) + i]]
            self.db.register("bytes_of_words", pa.table([pa.array(word), pa.array(i), pa.array(tokens)], ["word", "i", "token"]))
            out = self.db.sql(_ENCODE).to_arrow_table()
            self.db.unregister("bytes_of_words")
            ids.append(out["token"].to_numpy())
            counts.append(np.bincount(out["word"].to_numpy(), minlength=b - a))
            a = b
        return np.concatenate(ids), np.concatenate(counts)

    def _stand_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens, encoded together, stays these two."""
        if len(self.apart) > _PAIRS:
            self.apart.clear()
        pairs = list(zip(left.tolist(), right.tolist()))
        new = [p for p in dict.fromkeys(pairs) if p not in self.apart]
        if new:
            spans = [self.tokens[a] + self.tokens[b] for a, b in new]
            ends = np.cumsum([len(x) for x in spans])
            ids, counts = self._encode_spans(np.frombuffer(b"".join(spans), np.uint8), np.r_[0, ends[:-1]], ends)
            first = np.cumsum(counts) - counts
            self.apart.update((p, bool(n == 2 and ids[k] == p[0] and ids[k + 1] == p[1])) for p, n, k in zip(new, counts.tolist(), first.tolist()))
        return np.array([self.apart[p] for p in pairs], bool)

    def _joined(self, ids: np.ndarray, counts: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """Ids of parts from those of their windows.

        A row of tokens is the encoding of its bytes just if each two
        neighbours, encoded together, stay as they are. Inside a window that
        holds; so only pairs at seams are looked at. Around a seam whose pair
        doesn't stay, some tokens on either side are encoded anew together, and the
        ends of that stretch are the next seams; from round to round it is
        twice as many.
        """
        seam = np.zeros(len(ids) + 1, bool)  # whether the pair before a token has to be looked at
        seam[np.cumsum(counts) - counts] = True
        whole = np.r_[np.cumsum(self.sizes[ids]) - self.sizes[ids], int(self.sizes[ids].sum())]
        reach = 2
        while True:
            edge = np.searchsorted(whole, np.r_[parts, whole[-1]])  # first tokens of parts
            seam[edge] = False
            at = np.flatnonzero(seam)
            at = at[~self._stand_apart(ids[at - 1], ids[at])] if len(at) else at
            if not len(at):
                return ids
            part = np.searchsorted(edge, at, side="right") - 1
            low, high = np.maximum(at - reach, edge[part]), np.minimum(at + reach, edge[part + 1])
            apart = np.r_[True, low[1:] >= np.maximum.accumulate(high)[:-1]]
            low, high = low[apart], np.maximum.reduceat(high, np.flatnonzero(apart))
            data = np.frombuffer(b"".join(self.tokens[t] for a, b in zip(low, high) for t in ids[a:b].tolist()), np.uint8)
            ends = np.cumsum(whole[high] - whole[low])
            new, n = self._encode_spans(data, np.r_[0, ends[:-1]], ends)
            taken, pieces, marks, done = np.cumsum(n) - n, [], [], 0
            for a, b, k, m in zip(low.tolist(), high.tolist(), taken.tolist(), n.tolist()):
                pieces += [ids[done:a], new[k : k + m]]
                marks += [np.zeros(a - done, bool), np.r_[True, np.zeros(m - 1, bool)]]
                done = b
            seam = np.concatenate([*marks, np.zeros(len(ids) - done + 1, bool)])
            ids = np.concatenate([*pieces, ids[done:]])
            seam[np.searchsorted(np.cumsum(self.sizes[ids]), whole[high], side="right")] = True  # the tokens behind the stretches
            whole = np.r_[np.cumsum(self.sizes[ids]) - self.sizes[ids], whole[-1]]
            reach *= 2

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Bytes of each row of ids."""
        raw, ends = self.decoded(ids, offsets)
        raw, ends = raw.tobytes(), ends.tolist()
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def decoded(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows of ids, end to end, and n + 1 offsets of the rows in them.

        Rows are taken as short runs of ids that begin where a token begins with a
        space. A run that wasn't decoded before goes to a query with the other new ones.
        """
        first, size, key = self._runs(ids, offsets)
        keys, one, which = np.unique(key, return_index=True, return_inverse=True)
        if len(self.run_keys) > _RUNS or len(self.run_bytes) > _CACHE_BYTES:
            self._clear_runs()
        at = np.searchsorted(self.run_keys, keys)
        new = np.flatnonzero(np.r_[self.run_keys, np.uint64(0)][at] != keys)  # no run has the number 0
        if len(new):
            one, n = first[one[new]], size[one[new]]
            ends = np.r_[0, np.cumsum(n)]
            own = ids[np.repeat(one - ends[:-1], n) + np.arange(ends[-1])]
            texts = [self._decode_rows(x, _cuts(len(x), _STRETCH)) for x in np.split(own, _cuts(len(own), _IDS)[1:-1])]
            ends = np.r_[0, np.cumsum(self.sizes[own])][ends]
            self.run_starts = np.insert(self.run_starts, at[new], ends[:-1] + len(self.run_bytes))
            self.run_sizes = np.insert(self.run_sizes, at[new], np.diff(ends))
            self.run_keys = np.insert(self.run_keys, at[new], keys[new])
            self.run_bytes = np.frombuffer(b"".join([self.run_bytes.tobytes(), *texts]), np.uint8)
            at = np.searchsorted(self.run_keys, keys)
        at = at[which]
        starts, sizes = self.run_starts[at], self.run_sizes[at]
        ends = np.r_[0, np.cumsum(sizes)]
        raw, cuts = np.empty(ends[-1], np.uint8), _cuts(len(at), _IDS >> 2)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            raw[ends[a] : ends[b]] = self.run_bytes[np.repeat(starts[a:b] - ends[a:b], sizes[a:b]) + np.arange(ends[a], ends[b])]
        return raw, ends[np.searchsorted(first, offsets)]

    def _clear_runs(self) -> None:
        self.run_keys, self.run_starts, self.run_sizes, self.run_bytes = (np.empty(0, kind) for kind in (np.uint64, np.int64, np.int32, np.uint8))

    def _runs(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First places, sizes and numbers of runs of ids; a run is so short that its ids, side by side, are one number of 64 bits."""
        bits = 16 if len(self.tokens) < 1 << 16 else 32
        begins = self.spaced[ids]
        begins[offsets[offsets < len(ids)]] = True
        word = np.flatnonzero(begins)
        begins |= (np.arange(len(ids)) - np.repeat(word, np.diff(np.r_[word, len(ids)]))) & (64 // bits - 1) == 0
        first = np.flatnonzero(begins)
        size, key = np.diff(np.r_[first, len(ids)]), np.zeros(len(first), np.uint64)
        for j in range(64 // bits):
            live = np.flatnonzero(size > j)
            key[live] |= ids[first[live] + j].astype(np.uint64) + np.uint64(1) << np.uint64(bits * j)
        return first, size, key

    def _decode_rows(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """Bytes of rows of ids, none of them empty, end to end; one query."""
        counts = np.diff(offsets)
        doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        rows = pa.table([pa.array(doc), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids.astype(np.int32))], ["doc", "i", "id"])
        self.db.register("ids", rows)
        out = self.db.sql(_DECODE).to_arrow_table()
        self.db.unregister("ids")
        return "".join(out["chars"].to_pylist()).encode("latin-1")


def _cuts(n: int, each: int) -> np.ndarray:
    """0, each, 2 * each and so on, and n."""
    return np.r_[np.arange(0, n, each), n]


def _binary(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow column, without a copy of them."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])


@cache
def _sound(path: str) -> bool:
    return ranks_rise(read_ranks(path))


_open: dict[str, SqlBpe] = {}


def _bpe(path: str) -> SqlBpe:
    """The task process's own database for a vocabulary file."""
    if path not in _open:
        _open[path] = SqlBpe(path)
    return _open[path]


def encode_and_decode(docs: DataFrame, ranks_path: str, slice_bytes: int = _SLICE) -> DataFrame:
    """Adds ids (little-endian unsigned 32-bit integers, packed) and decoded (bytes) to every document.

    Whole texts of any length are encoded, each piece of the pattern
    separately and without special tokens, so their strings are ordinary text;
    null and empty texts have no ids; repeated rows are encoded alike; an empty
    table gives no rows. Different pieces of a slice of rows are encoded once,
    and different runs of ids decoded once; both are kept (up to a bound of their number and bytes) for the task process's next
    slices. A query holds a row for each byte of 0.25 MB of words; words longer than
    that are encoded in windows, so that a task needs memory for its text and
    ids, some numbers for each byte of them, and those rows. ``ranks_path`` is a
    vocabulary file that driver and executors have; one for which ``ranks_rise``
    doesn't hold is an error. Columns of these two names are replaced,
    others pass through; nothing is shuffled.
    """
    docs = docs.drop("ids", "decoded")
    if not _sound(ranks_path):
        raise ValueError(f"{ranks_path}: a token is reached by a step of a higher rank than its own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(ranks_path)
        for batch in batches:
            for part in row_slices(batch, "text", slice_bytes):
                data, offsets = string_buffer(part["text"])
                ids, ends = bpe.cache.ids_of(data, offsets)
                packed = _binary(ids.astype("<u4"), ends * 4)
                decoded = _binary(*bpe.decoded(ids, ends))
                yield pa.RecordBatch.from_arrays([*part.columns, packed, decoded], names=[*part.schema.names, "ids", "decoded"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema)
    return docs.mapInArrow(trimmed(run), f"{kept}ids binary, decoded binary")
