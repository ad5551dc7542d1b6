"""Removal of byte strings that an earlier document holds too, by intervals of a Burrows-Wheeler transform."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import MESSAGE_DDL, messages, mixed, packed, pieces_for, powers, shuffle_partitions, string_buffer, text_bytes, unpacked

#: Bytes of text in a block (one task's unit), behind a group of anchors, and in one transform.
BLOCK_BYTES, GROUP_BYTES, CHUNK_BYTES = 8 << 20, 32 << 20, 1 << 20
_STEP = 0x9E3779B97F4A7C15 | 1
_LOWEST = np.iinfo(np.int64).min


def expanded(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), starts[1], ..."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()), dtype=starts.dtype)


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, tile: int = 1 << 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of ``length`` bytes with one minimum hash of their ``gram``-byte strings.

    Returns (first window, end of windows, minimum); no window crosses a
    document. Equal windows have equal minima wherever they stand, which is
    all that the routing of windows needs.
    """
    starts, ends, keys = [], [], []
    n, inner = len(data), length - gram + 1
    up, down = powers(_STEP, tile + length + 1), powers(pow(_STEP, -1, 1 << 64), tile + length + 1)
    for a in range(0, max(0, n - length + 1), tile):
        part = data[a : a + tile + length - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1]
        have = 1
        while have < inner:
            step = min(have, inner - have)
            h = np.minimum(h[: len(h) - step], h[step:])
            have += step
        cut = np.flatnonzero(h[1:] != h[:-1]) + 1
        edge = np.r_[0, cut]
        starts.append(edge + a)
        ends.append(np.r_[cut, len(h)] + a)
        keys.append(h[edge])
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    s, e, k = np.concatenate(starts), np.concatenate(ends), np.concatenate(keys)
    # split at documents' ends, then drop windows that cross one
    inside = offsets[1:-1]
    edges = np.unique(np.r_[s, inside[inside < e[-1]]])
    of = np.searchsorted(s, edges, side="right") - 1
    s, e, k = edges, np.r_[edges[1:], e[-1]], k[of]
    doc = np.searchsorted(offsets, s, side="right") - 1
    e = np.minimum(e, offsets[doc + 1] - length + 1)
    ok = e > s
    return s[ok], e[ok], k[ok]


def repeat_heads(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of a cyclic text (sorted by ``length`` bytes at least) and, per rank, whether it starts a group of equal ``length``-byte prefixes.

    Common prefixes come by increasing value: intervals of all strings of
    1, 2, ... bytes are extended backwards on the transform, breadth first. An
    interval whose right edge is new has that edge's common prefix; others are
    dropped. Edges still open after ``length`` levels are those inside groups.
    """
    n = len(data)
    wide = np.concatenate([data, np.resize(data, 7)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | wide[i : i + n]
    sa = np.argsort(key)
    ks = key[sa]
    head, width, places = np.r_[True, ks[1:] != ks[:-1]], 8, np.arange(n, dtype=np.uint64)
    while width < length:  # double the sorted width where ranks are tied
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
    bwt = data[sa - 1]
    order = np.argsort(bwt, kind="stable").astype(np.int32)
    lf = np.empty(n, np.int32)
    lf[order] = np.arange(n, dtype=np.int32)
    same = bwt[order[1:]] == bwt[order[:-1]]
    after, before = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    after[order[:-1][same]] = order[1:][same]
    before[order[1:][same]] = order[:-1][same]
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    lo, hi = np.zeros(1, np.int32), np.full(1, n, np.int32)
    for _ in range(length):
        if not len(lo):
            break
        size = hi - lo
        p = expanded(lo, size)
        last = after[p] >= np.repeat(hi, size)
        first = before[p] < np.repeat(lo, size)
        right, left = lf[p[last]] + 1, lf[p[first]]
        right.sort()
        left.sort()
        new = ~known[right]
        lo, hi = left[new], right[new]
        known[hi] = True
    return sa, known[:n]


def _earliest(segments: list[bytes], docs: np.ndarray, length: int) -> np.ndarray:
    """For every window of every segment, the smallest document that holds its bytes; segments end to end, ``length`` - 1 windows short."""
    sizes = np.array([len(x) for x in segments], np.int64)
    data = np.frombuffer(b"".join(segments), np.uint8)
    sa, head = repeat_heads(data, length)
    seg = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = within <= np.repeat(sizes, sizes) - length
    doc = np.where(whole, docs[seg], np.iinfo(np.int64).max)[sa]
    first = np.minimum.reduceat(doc, np.flatnonzero(head))
    out = np.empty(len(data), np.int64)
    out[sa] = first[np.cumsum(head) - 1]
    return out[whole]


def _earliest_alone(windows: np.ndarray, prints: np.ndarray, docs: np.ndarray, chunk_bytes: int) -> np.ndarray:
    """Like _earliest, for rows of ``length`` bytes; equal rows have equal ``prints``, by which they are dealt to transforms of about ``chunk_bytes``."""
    n, length = windows.shape
    out, o = np.empty(n, np.int64), np.argsort(prints, kind="stable")
    ends = np.flatnonzero(np.r_[prints[o][1:] != prints[o][:-1], True]) + 1
    a = 0
    while a < n:
        at = min(np.searchsorted(ends, a + max(1, chunk_bytes // length), side="right") - 1, len(ends) - 1)
        b = int(ends[at]) if at >= 0 and ends[at] > a else int(ends[np.searchsorted(ends, a, side="right")])
        out[o[a:b]] = _earliest([x.tobytes() for x in windows[o[a:b]]], docs[o[a:b]], length)
        a = b
    return out


def _ordered(docs: pa.Table) -> pa.Table:
    """Rows in one order, however the shuffle delivered them: places in a block are spoken of between steps."""
    return docs.sort_by([("rank", "ascending"), ("text", "ascending")])


class _Block:
    """The documents of one block, ordered, with their runs of windows."""

    def __init__(self, docs: pa.Table, length: int, gram: int):
        docs = _ordered(docs)
        self.order = docs["rank"].to_numpy()
        self.data, self.offsets = string_buffer(docs["text"])
        self.starts, self.ends, self.keys = window_runs(self.data, self.offsets, length, gram)
        self.doc = np.searchsorted(self.offsets, self.starts, side="right") - 1

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct minima, which of them several documents have, and each run's place among them."""
        o = np.lexsort((self.doc, self.keys))
        ks, ds = self.keys[o], self.doc[o]
        new = np.r_[True, ks[1:] != ks[:-1]][: len(ks)]
        at = np.cumsum(new) - 1
        place = np.empty(len(o), np.int64)
        place[o] = at
        first = np.flatnonzero(new)
        shared = ds[first] != ds[np.r_[first[1:], len(ds)][: len(first)] - 1]
        return ks[new], shared, place

    def amounts(self, place: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and windows of the different runs of each of ``n`` distinct minima; runs over 2 * ``length`` bytes all count as different."""
        size = self.ends - self.starts + length - 1
        total = np.bincount(place, size, n)
        mine = np.flatnonzero(total[place] > 2 * length)  # one usual run is below that
        s, b = self.starts[mine], size[mine]
        h = b.astype(np.uint64) + np.where(b > 2 * length, mine + 1, 0).astype(np.uint64) * np.uint64(_STEP)
        for i in range(2 * length):
            h = h * np.uint64(_STEP) + self.data[s + np.minimum(i, b - 1)]
        h = mixed(h)
        o = np.lexsort((h, place[mine]))
        new = np.r_[True, (h[o][1:] != h[o][:-1]) | (place[mine[o][1:]] != place[mine[o][:-1]])][: len(o)]
        different = np.ones(len(place), bool)
        different[mine[o[~new]]] = False
        return np.bincount(place[different], size[different], n).astype(np.int64), np.bincount(place[different], (self.ends - self.starts)[different], n).astype(np.int64)

    def windows(self, runs: np.ndarray, length: int, each: int = 1 << 17) -> Iterator[tuple[np.ndarray, ...]]:
        """Windows of runs, ``each`` at a time: (place, its run, its different window), (different windows' bytes, hashes, keys)."""
        sizes = self.ends[runs] - self.starts[runs]
        filled = np.cumsum(sizes)
        for a in range(0, int(filled[-1]) if len(runs) else 0, each):
            nth = np.arange(a, min(a + each, int(filled[-1])))
            r = np.searchsorted(filled, nth, side="right")
            at = self.starts[runs[r]] + nth - (filled[r] - sizes[r])
            rows = np.lib.stride_tricks.sliding_window_view(self.data, length)[at]
            h = np.zeros(len(at), np.uint64)
            for i in range(length):
                h = h * np.uint64(_STEP) + rows[:, i] + np.uint64(1)
            h = mixed(h)
            o = np.argsort(h, kind="stable")
            # two different windows of one hash may alternate: then some come twice, which does no harm
            new = np.r_[True, (h[o][1:] != h[o][:-1]) | (rows[o][1:] != rows[o][:-1]).any(1)]
            of = np.empty(len(at), np.int64)
            of[o] = np.cumsum(new) - 1
            yield at, runs[r], of, rows[o[new]], h[o[new]], self.keys[runs[r[o[new]]]]


def _by_group(keys: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray]]:
    """(group, places of its keys in order) for every group that has keys."""
    group = (mixed(keys) >> np.uint64(32)) % np.uint64(groups)
    o = np.argsort(group, kind="stable")
    cut = np.flatnonzero(np.r_[True, group[o][1:] != group[o][:-1]][: len(o)])
    for a, b in zip(cut, np.r_[cut[1:], len(o)]):
        yield int(group[o[a]]), o[a:b]


def repeated_spans(docs: DataFrame, length: int = 50, gram: int = 20, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, spans (maximal removed runs of bytes: start, end), kept (the bytes left).

    A byte goes if a ``length``-byte string that covers it also starts in a
    document with a smaller doc_id, whatever is removed there. Texts are UTF-8
    bytes; null is empty; a text below ``length`` loses nothing. Rows with one
    doc_id are documents of their own that don't remove from each other; a
    null doc_id counts as the smallest. Other columns are ignored; an empty
    table gives no rows.

    Four steps, with documents in blocks of a bounded size:
    1. each block tells groups, dealt by hash, the 32-bit fingerprints of its
       windows' minimum grams and how much its different runs hold; a group
       answers which ones several documents have (a wrong yes costs time, a
       wrong no cannot be) and which are frequent: those with different runs
       of more than ``chunk_bytes`` in all blocks;
    2. each block sends the bytes of such windows' runs, each different run
       once; windows with a frequent minimum go one by one, each different
       one once, dealt by a hash of all their bytes;
    3. each group builds transforms over its different runs, bounded in size
       and never splitting a minimum that isn't frequent, or over its single
       windows, and answers the smallest document of each window;
    4. each block covers its documents' bytes with the windows that a smaller
       document has.
    All shuffles but that of the texts (one exchange, used three times) carry
    packed arrays; a run that many documents share is sent once by each block.
    """
    spark = docs.sparkSession
    least = shuffle_partitions(spark)
    n_bytes = text_bytes(docs)
    blocks, groups = pieces_for(n_bytes, block_bytes, least), pieces_for(n_bytes, group_bytes, least)
    # windows of frequent minima have groups of their own behind the others
    singles, single_bytes = pieces_for(n_bytes * length, group_bytes, least), max(1, group_bytes // 4)
    if not 0 < gram <= length:
        raise ValueError("gram must be between 1 and length")
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))
    dealt = docs.select("doc_id", rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).alias("to"))

    def tell(table: pa.Table) -> pa.Table:
        block, to = _Block(table, length, gram), table["to"][0].as_py()
        keys, shared, place = block.distinct()
        held, wins = block.amounts(place, len(keys), length)
        rows = []
        for g, at in _by_group(keys, groups):
            much = np.flatnonzero(held[at] > 2 * length)
            rows.append((g, to, packed(mixed(keys[at]).astype(np.uint32), np.packbits(shared[at]), much.astype(np.uint32), held[at[much]], wins[at[much]])))
        return messages(rows)

    def find_shared(table: pa.Table) -> pa.Table:
        told = [unpacked(x, np.uint32, np.uint8, np.uint32, np.int64, np.int64) for x in table["body"].to_pylist()]
        prints = np.concatenate([x[0] for x in told])
        sizes = [len(x[0]) for x in told]
        several = np.concatenate([np.unpackbits(x[1], count=n) for x, n in zip(told, sizes)]).astype(bool)
        o = np.argsort(prints, kind="stable")
        ps = prints[o]
        new = np.r_[True, ps[1:] != ps[:-1]]
        at = np.cumsum(new) - 1
        yes = (np.bincount(at) > 1) | (np.bincount(at, several[o]) > 0)
        held, wins = np.full(len(o), 2 * length, np.int64), np.full(len(o), length - gram + 1, np.int64)
        for x, before in zip(told, np.cumsum([0, *sizes])):
            held[x[2] + before], wins[x[2] + before] = x[3], x[4]
        # 0 for a minimum that isn't frequent, else to how many groups its windows go
        shares = np.where(np.bincount(at, held[o]) > chunk_bytes, np.ceil(np.bincount(at, wins[o]) * length / single_bytes), 0) * yes
        answer, share = np.empty(len(o), bool), np.empty(len(o), np.uint32)
        answer[o], share[o] = yes[at], shares[at]
        me, rows = table["to"][0].as_py(), []
        for to, part, own in zip(table["sender"].to_pylist(), np.split(answer, np.cumsum(sizes)[:-1]), np.split(share, np.cumsum(sizes)[:-1])):
            if part.any():
                rows.append((to, me, packed(np.packbits(part), np.flatnonzero(own).astype(np.uint32), own[own > 0])))
        return messages(rows)

    def send_runs(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs_.num_rows or not answers.num_rows:
            return messages([])
        block, to = _Block(docs_, length, gram), docs_["to"][0].as_py()
        keys, _, place = block.distinct()
        answer, shared = dict(zip(answers["sender"].to_pylist(), answers["body"].to_pylist())), np.zeros(len(keys), bool)
        shares = np.zeros(len(keys), np.uint32)
        for g, at in _by_group(keys, groups):
            if g in answer:
                bits, frequent, share = unpacked(answer[g], np.uint8, np.uint32, np.uint32)
                shared[at] = np.unpackbits(bits, count=len(at))
                shares[at[frequent]] = share
        runs, rows = np.flatnonzero(shared[place] & (shares[place] > 0)), []
        runs = runs[np.argsort(block.keys[runs], kind="stable")]
        for at, run, of, bytes_, h, key in block.windows(runs, length):
            rank = block.order[block.doc[run]]
            first, last = np.full(len(h), np.iinfo(np.int64).max), np.full(len(h), _LOWEST)
            np.minimum.at(first, of, rank)
            np.maximum.at(last, of, rank)
            part = h % shares[np.searchsorted(keys, key)].astype(np.uint64)
            group = (mixed(mixed(key) + part * np.uint64(_STEP)) % np.uint64(singles)).astype(np.int64)
            by, of_by = np.argsort(group, kind="stable"), np.argsort(group[of], kind="stable")
            cut = np.flatnonzero(np.r_[True, group[by][1:] != group[by][:-1]])
            starts = np.searchsorted(group[of][of_by], group[by[cut]])
            places = np.empty(len(h), np.int64)
            for a, b, c, d in zip(cut, np.r_[cut[1:], len(by)], starts, np.r_[starts[1:], len(of)]):
                mine, all_ = by[a:b], of_by[c:d]
                places[mine] = np.arange(len(mine))
                rows.append((groups + int(group[mine[0]]), to, packed(at[all_].astype(np.uint32), places[of[all_]].astype(np.uint32), h[mine], first[mine], last[mine], bytes_[mine])))
        runs = np.flatnonzero(shared[place] & (shares[place] == 0))
        raw = block.data.tobytes()
        for g, at in _by_group(block.keys[runs], groups):
            mine, seen, of = runs[at], {}, np.empty(len(at), np.uint32)
            for i, (s, e) in enumerate(zip(block.starts[mine].tolist(), (block.ends[mine] + length - 1).tolist())):
                of[i] = seen.setdefault(raw[s:e], len(seen))
            first = np.full(len(seen), np.iinfo(np.int64).max)
            np.minimum.at(first, of, block.order[block.doc[mine]])
            last = np.full(len(seen), _LOWEST)
            np.maximum.at(last, of, block.order[block.doc[mine]])
            key = np.empty(len(seen), np.uint32)
            key[of] = mixed(block.keys[mine]).astype(np.uint32)
            sizes = np.array([len(x) for x in seen], np.uint32)
            rows.append((g, to, packed(mine.astype(np.uint32), of, key, first, last, sizes, np.frombuffer(b"".join(seen), np.uint8))))
        return messages(rows)

    def find_earliest_alone(table: pa.Table) -> pa.Table:
        told = [unpacked(x, np.uint32, np.uint32, np.uint64, np.int64, np.int64, np.uint8) for x in table["body"].to_pylist()]
        h, first, last = (np.concatenate([x[i] for x in told]) for i in (2, 3, 4))
        _, at, many = np.unique(h, return_inverse=True, return_counts=True)
        # a window that only one document of one block has needs no answer
        wanted = np.flatnonzero((many[at] > 1) | (first < last))
        rows_ = np.concatenate([x[5] for x in told]).reshape(len(h), length)[wanted]
        m = np.full(len(h), np.iinfo(np.int64).max)
        m[wanted] = _earliest_alone(rows_, h[wanted], first[wanted], chunk_bytes)
        useful, begin = m < last, np.cumsum([0, *(len(x[2]) for x in told)])
        rows, me = [], table["to"][0].as_py()
        for to, (places, of, *_), a in zip(table["sender"].to_pylist(), told, begin):
            mine = useful[of + a]
            if mine.any():
                rows.append((to, me, packed(places[mine], m[of[mine] + a])))
        return messages(rows)

    def find_earliest(table: pa.Table) -> pa.Table:
        if table["to"][0].as_py() >= groups:
            return find_earliest_alone(table)
        ids: dict[bytes, int] = {}
        keys, firsts, lasts, sent = [], [], [], []
        for to, body in zip(table["sender"].to_pylist(), table["body"].to_pylist()):
            runs, of, key, first, last, sizes, raw = unpacked(body, np.uint32, np.uint32, np.uint32, np.int64, np.int64, np.uint32, np.uint8)
            raw, at, mine = raw.tobytes(), np.r_[0, np.cumsum(sizes.astype(np.int64))].tolist(), np.empty(len(sizes), np.int64)
            for i in range(len(sizes)):
                mine[i] = ids.setdefault(raw[at[i] : at[i + 1]], len(ids))
            keys.append((mine, key))
            firsts.append((mine, first))
            lasts.append((mine, last))
            sent.append((to, runs, mine[of]))
        n = len(ids)
        key, first, last = np.empty(n, np.uint32), np.full(n, np.iinfo(np.int64).max), np.full(n, _LOWEST)
        for (m, k), (_, f), (_, la) in zip(keys, firsts, lasts):
            key[m] = k
            np.minimum.at(first, m, f)
            np.maximum.at(last, m, la)
        segments = list(ids)
        del ids, keys, firsts, lasts
        o = np.argsort(key, kind="stable")
        size = np.array([len(x) for x in segments], np.int64)
        # a chunk ends at the first change of the minimum behind chunk_bytes
        filled, chunk, cuts = np.cumsum(size[o]), 0, [0]
        change = np.flatnonzero(np.r_[key[o][1:] != key[o][:-1], True]) + 1
        while cuts[-1] < n:
            base = filled[cuts[-1] - 1] if cuts[-1] else 0
            chunk = int(np.searchsorted(filled, base + chunk_bytes))
            cuts.append(int(change[min(np.searchsorted(change, chunk), len(change) - 1)]))
            if cuts[-1] <= cuts[-2]:
                cuts[-1] = int(change[np.searchsorted(change, cuts[-2], side="right")])
        seg_, lo_, len_, min_ = [], [], [], []
        for a, b in zip(cuts, cuts[1:]):
            at = o[a:b]
            m = _earliest([segments[i] for i in at], first[at], length)
            wins = size[at] - length + 1
            seg = np.repeat(at, wins)
            within = expanded(np.zeros(len(at), np.int64), wins)
            edge = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (seg[1:] != seg[:-1])])
            span = np.diff(np.r_[edge, len(m)])
            useful = m[edge] < last[seg[edge]]
            edge, span = edge[useful], span[useful]
            seg_.append(seg[edge])
            lo_.append(within[edge])
            len_.append(span)
            min_.append(m[edge])
        seg, lo, span, m = (np.concatenate(x) for x in (seg_, lo_, len_, min_))
        by = np.argsort(seg, kind="stable")
        seg, lo, span, m = seg[by], lo[by], span[by], m[by]
        begin, count = np.searchsorted(seg, np.arange(n)), np.bincount(seg, minlength=n)
        rows, me = [], table["to"][0].as_py()
        for to, runs, of in sent:
            many = count[of]
            if many.sum():
                at = expanded(begin[of], many)
                rows.append((to, me, packed(np.repeat(runs, many), lo[at].astype(np.uint32), span[at].astype(np.uint32), m[at])))
        return messages(rows)

    out_schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def cover(docs_: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs_.num_rows:
            return out_schema.empty_table()
        docs_ = _ordered(docs_)
        data, offsets = string_buffer(docs_["text"])
        depth = np.zeros(len(data) + 1, np.int32)
        if answers.num_rows:
            block = _Block(docs_, length, gram)
            for sender, body in zip(answers["sender"].to_pylist(), answers["body"].to_pylist()):
                if sender >= groups:
                    places, m = unpacked(body, np.uint32, np.int64)
                    runs = np.searchsorted(block.starts, places, side="right") - 1
                    lo, span = places - block.starts[runs], np.ones(len(places), np.int64)
                else:
                    runs, lo, span, m = unpacked(body, np.uint32, np.uint32, np.uint32, np.int64)
                mine = m < block.order[block.doc[runs]]
                at = block.starts[runs[mine]] + lo[mine]
                np.add.at(depth, at, 1)
                np.add.at(depth, at + span[mine] + (length - 1), -1)
        gone = np.cumsum(depth[:-1]) > 0
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(gone & np.r_[True, ~gone[:-1] | edge[1:-1]][: len(gone)])
        ends = np.flatnonzero(gone & np.r_[~gone[1:] | edge[1:-1], True][: len(gone)]) + 1
        doc = np.searchsorted(offsets, starts, side="right") - 1
        spans = pa.StructArray.from_arrays([pa.array(starts - offsets[doc]), pa.array(ends - offsets[doc])], ["start", "end"])
        left = np.r_[0, np.cumsum(~gone)][offsets]
        kept = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(left.astype(np.int32)), pa.py_buffer(data[~gone])])
        return pa.table(
            [docs_["doc_id"].combine_chunks().cast(pa.int64()), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(offsets))).astype(np.int32)), spans), kept],
            schema=out_schema,
        )

    shared = dealt.groupBy("to").applyInArrow(tell, MESSAGE_DDL).groupBy("to").applyInArrow(find_shared, MESSAGE_DDL)
    runs = dealt.groupBy("to").cogroup(shared.groupBy("to")).applyInArrow(send_runs, MESSAGE_DDL)
    earliest = runs.groupBy("to").applyInArrow(find_earliest, MESSAGE_DDL)
    return dealt.groupBy("to").cogroup(earliest.groupBy("to")).applyInArrow(cover, "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")
