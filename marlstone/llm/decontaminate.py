"""Benchmark passages in documents, found by an FM-index over each shard's words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import LOWER, byte_words, checkpointed, equal_spans, span_hashes, string_buffer, trimmed

#: Bytes of text under one index, bytes of benchmark text in a block.
SHARD_BYTES, PHRASE_BYTES = 4 << 20, 8 << 20
#: Blocks of benchmark text that one stage holds at most.
_AT_ONCE = 4

#: Bytes of words: digits, letters after lower-casing, everything beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x41:0x5B] = WORD_BYTES[0x61:0x7B] = True
WORD_BYTES[0x80:] = True


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector with running counts per bit of the alphabet."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for b in reversed(range(bits)):
            bit = (seq >> b) & 1
            count = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(seq) - int(count[-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        start = np.zeros(len(at), np.int64)
        at = at.astype(np.int64)
        for b, count, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros):
            one = (symbol >> b) & 1 == 1
            start = np.where(one, zeros + count[start], start - count[start])
            at = np.where(one, zeros + count[at], at - count[at])
        return at - start

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for count, zeros in zip(self.ones, self.zeros):
            one = count[at + 1] > count[at]
            symbol = symbol << 1 | one
            at = np.where(one, zeros + count[at], at - count[at])
        return symbol


class FMIndex:
    """Index of a word sequence in which 0 separates runs; each 0 sorts by place, so no match crosses one."""

    def __init__(self, seq: np.ndarray, symbols: int, every: int = 16):
        n = len(seq)
        gaps = seq == 0
        key = np.where(gaps, np.cumsum(gaps) - 1, seq + int(gaps.sum())).astype(np.uint64)
        sa = np.argsort(key, kind="stable")
        ks = key[sa]
        head, width, places = np.r_[True, ks[1:] != ks[:-1]], 1, np.arange(n, dtype=np.uint64)
        while True:
            tied = np.flatnonzero(~(head & np.r_[head[1:], True]))
            if not len(tied):
                break
            group = np.maximum.accumulate(np.where(head, places, np.uint64(0)))
            rank = np.empty(n, np.uint64)
            rank[sa] = group
            at = sa[tied]
            key = (group[tied] << np.uint64(32)) | rank[(at + width) % n]
            o = np.argsort(key)
            sa[tied], ks = at[o], key[o]
            head[tied[1:]] |= ks[1:] != ks[:-1]
            width *= 2
        self.before = np.r_[0, np.cumsum(np.bincount(seq, minlength=symbols + 1))]
        self.bwt = WaveletMatrix(seq[sa - 1], max(1, int(symbols).bit_length()))
        kept = (sa % every == 0) | (seq[sa - 1] == 0)  # at run starts too: a walk never steps over a separator
        self.kept, self.at, self.n = np.r_[0, np.cumsum(kept)], sa[kept], n

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first rank, end of ranks) of the rows of ``phrases`` (equally long) that occur."""
        who, lo, hi = np.arange(len(phrases)), np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in reversed(range(phrases.shape[1])):
            c = phrases[who, j]
            lo, hi = self.before[c] + self.bwt.rank(c, lo), self.before[c] + self.bwt.rank(c, hi)
            there = lo < hi
            who, lo, hi = who[there], lo[there], hi[there]
        return who, lo, hi

    def locate(self, rank: np.ndarray) -> np.ndarray:
        """Places of ranks: steps backwards to the next sampled place."""
        out, steps, who = np.empty(len(rank), np.int64), 0, np.arange(len(rank))
        while len(who):
            known = self.kept[rank + 1] > self.kept[rank]
            out[who[known]] = self.at[self.kept[rank[known]]] + steps
            who, rank = who[~known], rank[~known]
            c = self.bwt.access(rank)
            rank = self.before[c] + self.bwt.rank(c, rank)
            steps += 1
        return out


def _occurrences(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class Phrases:
    """The windows of some benchmark items: places in the items' sequences of word numbers, with the items of each different window."""

    def __init__(self, items: list, texts: list[str | None], window: int):
        data, offsets = string_buffer(pa.array(texts, pa.large_string()))
        starts, ends = byte_words(data, offsets, WORD_BYTES)
        data, sizes = LOWER[data], ends - starts
        for self.seed in range(1, 9):
            self.hashes, first, which = np.unique(span_hashes(data, starts, ends, self.seed), return_index=True, return_inverse=True)
            same = sizes == sizes[first[which]] if len(sizes) else np.ones(0, bool)
            if same.all() and equal_spans(data, starts, data, starts[first[which]], sizes).all():
                break
        else:
            raise ValueError("different words share a hash under every seed")
        self.sizes = sizes[first] if len(sizes) else sizes
        self.text = data[_occurrences(starts[first], self.sizes)] if len(sizes) else data[:0]
        self.places = np.cumsum(self.sizes) - self.sizes
        self.words, bounds = (which + 1).astype(np.int32), np.searchsorted(starts, offsets)
        counts = np.diff(bounds)
        at = _occurrences(bounds[:-1], np.where(counts > 0, np.maximum(counts - window, 0) + 1, 0))
        item = np.searchsorted(bounds, at, side="right") - 1
        length, ids = np.minimum(counts[item], window), np.array(items, np.int64)
        #: By window length: a place of each different window, and its items: ends, ids.
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(length).tolist():
            mine = at[length == size]
            _, one, of = np.unique(self.windows(mine, size), axis=0, return_index=True, return_inverse=True)
            pairs = np.unique(np.stack([of.ravel(), ids[item[length == size]]], axis=1), axis=0)
            self.by_length[size] = mine[one].astype(np.int32), np.searchsorted(pairs[:, 0], np.arange(len(one) + 1)), pairs[:, 1]

    def windows(self, at: np.ndarray, size: int) -> np.ndarray:
        return self.words[at[:, None] + np.arange(size)]

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """1, 2, ... for the items' words among those of lower-cased ``data``, 0 for any other; bytes are compared."""
        out = np.zeros(len(starts), np.int64)
        if len(self.hashes):
            hashes = span_hashes(data, starts, ends, self.seed)
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            found = np.flatnonzero((self.hashes[at] == hashes) & (self.sizes[at] == ends - starts))
            word = at[found]
            same = equal_spans(data, starts[found], self.text, self.places[word], self.sizes[word])
            out[found[same]] = word[same] + 1
        return out


def _hits(numbers: np.ndarray, bounds: np.ndarray, phrases: Phrases, each: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words) of every occurrence of a window in one shard, and (first word, item) pairs; windows are searched ``each`` at a time.

    A window can't cross a word that no item has, so runs of items' words that
    are shorter than the shortest window stay out of the index.
    """
    where, many, places, items = ([np.empty(0, np.int64)] for _ in range(4))
    joins = np.zeros(len(numbers) + 1, bool)
    joins[1:-1] = (numbers[1:] > 0) & (numbers[:-1] > 0)
    joins[bounds] = False
    first, end = np.flatnonzero((numbers > 0) & ~joins[:-1]), np.flatnonzero((numbers > 0) & ~joins[1:]) + 1
    long = end - first >= min(phrases.by_length, default=0)
    first, end = first[long], end[long]
    if len(first):
        sizes = end - first + 1  # with a separator behind each run
        at = _occurrences(first, sizes)
        seq = np.where(at == np.repeat(end, sizes), 0, numbers[np.minimum(at, len(numbers) - 1)])
        index = FMIndex(seq, len(phrases.hashes))
        for size, (windows, ends, ids) in phrases.by_length.items():
            for a in range(0, len(windows), each):
                who, lo, hi = index.search(phrases.windows(windows[a : a + each], size))
                counts, who = hi - lo, who + a
                found = at[index.locate(_occurrences(lo, counts))]
                where.append(found)
                many.append(np.full(len(found), size))
                of = np.repeat(who, counts)
                places.append(np.repeat(found, ends[of + 1] - ends[of]))
                items.append(ids[_occurrences(ends[of], ends[of + 1] - ends[of])])
    return tuple(np.concatenate(x) for x in (where, many, places, items))


_SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
_ADDED = {"n_words": pa.int64(), "spans": _SPANS, "items": pa.list_(pa.int64())}
_DDL = "n_words bigint, spans array<struct<first_word: bigint, end_word: bigint, start: bigint, end: bigint>>, items array<bigint>"


def _shard(table: pa.Table, phrases: Phrases) -> pa.Table:
    data, offsets = string_buffer(table["text"])
    starts, ends = byte_words(data, offsets, WORD_BYTES)
    bounds = np.searchsorted(starts, offsets)
    where, many, places, items = _hits(phrases.numbers(LOWER[data], starts, ends), bounds, phrases)
    depth = np.zeros(len(starts) + 1, np.int64)
    np.add.at(depth, where, 1)
    np.add.at(depth, where + many, -1)
    of = np.searchsorted(bounds, places, side="right") - 1
    if "items" in table.column_names:  # what an earlier block of items has found
        old = table["spans"].combine_chunks()
        base = np.repeat(bounds[:-1], old.value_lengths().to_numpy(zero_copy_only=False))
        np.add.at(depth, base + old.flatten().field("first_word").to_numpy(), 1)
        np.add.at(depth, base + old.flatten().field("end_word").to_numpy(), -1)
        old = table["items"].combine_chunks()
        of, items = np.r_[of, np.repeat(np.arange(len(old)), old.value_lengths().to_numpy(zero_copy_only=False))], np.r_[items, old.flatten().to_numpy()]
        table = table.drop_columns(list(_ADDED))
    pairs = np.unique(np.stack([of, items], axis=1), axis=0)
    hit = np.cumsum(depth)[:-1] > 0
    edge = np.zeros(len(starts) + 1, bool)
    edge[bounds] = True
    joins = np.zeros(len(starts) + 1, bool)
    joins[1:-1] = hit[1:] & hit[:-1] & ~edge[1:-1]
    first, end = np.flatnonzero(hit & ~joins[:-1]), np.flatnonzero(hit & ~joins[1:]) + 1
    doc = np.searchsorted(bounds, first, side="right") - 1
    cells = [first - bounds[doc], end - bounds[doc], starts[first] - offsets[doc], ends[end - 1] - offsets[doc]]
    spans = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in cells], fields=list(_SPANS.value_type))
    per_doc = pa.array(np.searchsorted(doc, np.arange(table.num_rows + 1)).astype(np.int32))
    ids = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[:, 0], np.arange(table.num_rows + 1)).astype(np.int32)), pa.array(pairs[:, 1]))
    added = [pa.array(np.diff(bounds).astype(np.int64)), pa.ListArray.from_arrays(per_doc, spans), ids]
    for name, column in zip(_ADDED, added):
        table = table.append_column(name, column)
    return table


def shards_of(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.Table]:
    """Consecutive rows with about ``shard_bytes`` of text each; at least one row."""
    for batch in batches:
        _, offsets = string_buffer(batch["text"])
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + shard_bytes)))
            yield pa.Table.from_batches([batch.slice(a, b - a)])
            a = b


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_bytes: int = SHARD_BYTES, phrase_bytes: int = PHRASE_BYTES) -> DataFrame:
    """Adds n_words, spans and items to every document.

    ``spans``: maximal runs of words inside any occurrence of an item's window
    of ``window`` consecutive words (an item with fewer is one window), as
    first_word, end_word and byte offsets start, end. ``items``: ids of the
    items whose windows occur. Words are runs of letters, digits and
    non-ASCII characters, lower-cased in A-Z, and compared byte by byte. Null
    and empty texts have no words; repeated rows are searched alike; an empty
    benchmark hits nothing; an empty table gives no rows; columns of these
    three names are replaced, others pass through.

    Each task indexes its own shards of documents, long texts as shards of
    their own: nothing is shuffled. Items go to all tasks in blocks of about
    ``phrase_bytes`` of text, as packed arrays of some five times that. A
    stage has four blocks at most; for more, documents with what was found in
    them are written before the next four.
    """
    docs = docs.drop(*_ADDED)
    items = benchmark.select(F.col("item_id").cast("long"), "text").filter("item_id is not null and text is not null")
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(n_bytes / phrase_bytes))
    for i in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).toArrow()
        sent = docs.sparkSession.sparkContext.broadcast(Phrases(rows["item_id"].to_pylist(), rows["text"].to_pylist(), window))

        def index(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for shard in shards_of(batches, shard_bytes):
                yield from _shard(shard, sent.value).to_batches()

        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop(*_ADDED).schema)
        docs = docs.mapInArrow(trimmed(index), f"{kept}, {_DDL}")
        if (i + 1) % _AT_ONCE == 0 and i + 1 < blocks:
            docs = checkpointed(docs)
    return docs


def without_spans(docs: DataFrame) -> DataFrame:
    """``contamination``'s documents with the spans' bytes cut out of their texts."""
    raw = F.encode("text", "UTF-8")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    ends = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.octet_length("text").cast("long")))
    pieces = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.decode(F.substring(raw, p["a"] + 1, p["b"] - p["a"]), "UTF-8"))
    return docs.withColumn("text", F.when(F.size("spans") > 0, F.array_join(pieces, "")).otherwise(F.col("text")))
