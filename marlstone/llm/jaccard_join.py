"""Documents whose word-shingle sets are similar, by a join of parity sketches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import MESSAGE_DDL, checkpointed, fresh_names, messages, mixed, packed, pieces_for, row_slices, shuffle_partitions, string_buffer, trimmed, trimmed_group, unpacked
from marlstone.llm.graph import components
from marlstone.llm.shingles import parity_sketches, set_prints, shingle_sets_twice

#: Bytes of text at once; signatures that a task holds before it passes them on, and in a group; bytes of sets, and sets, in a verified block.
_SLICE, _HELD, _GROUP, BLOCK_BYTES, BLOCK_SETS = 1 << 20, 500_000, 1_000_000, 8 << 20, 2000
#: Bits of the filter that keeps texts which aren't candidates out of a shuffle (2**20 rows of words, for 2**25 keys).
FILTER_BITS = 1 << 26
_LOWEST = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Similarity:
    """Sets link when ``den`` * intersection >= ``num`` * union."""

    words: int = 5
    num: int = 80
    den: int = 100

    def most_apart(self, sizes):
        """The largest symmetric difference of linked sets whose sizes add up to ``sizes``."""
        return sizes * (self.den - self.num) // (self.den + self.num)

    def bands(self, largest: int) -> tuple[np.ndarray, np.ndarray]:
        """First sizes of the bands, and the largest difference of a linked pair whose smaller set is in the band.

        A set can link with sets of its own and the two adjacent bands only.
        """
        first = [1]
        while first[-1] <= largest:
            first.append(first[-1] * self.den // self.num + 1)
        first = np.array(first + [first[-1] * self.den // self.num + 1], np.int64)
        return first[:-1], (first[1:] - 1) * (self.den - self.num) // self.num


#: Of a key's lowest 40 bits, one tells apart the two schemes that a set takes part in; another marks frequent keys.
_SCHEME, _FREQUENT = np.uint64(1 << 39), np.uint64(1 << 38)
#: Different sets of one task, of one group, from which on a key is frequent.
_OFTEN_HERE, _OFTEN = 256, 4096


def signed(hashes: np.ndarray, ends: np.ndarray, similarity: Similarity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, key, spare) rows such that linked, different sets have more than ``spare`` keys in common.

    In the scheme of a band, shingles fall into d + 1 + e segments, where d is
    the largest symmetric difference of the band's links. A segment's key is
    the XOR of its shingles' hashes: the segments are a parity sketch whose
    words differ in at most d places where sets link, so e + 1 are the same
    in both. A set with z <= e empty segments leaves these out and has more
    than e - z others in common with whatever it links with. A set with more
    has all its keys, its ``spare`` is 0, and so is what it surely shares.
    """
    sizes = np.diff(ends)
    out_set, out_key, out_spare = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.uint8)]
    if not len(sizes) or not sizes.max():
        return out_set[0], out_key[0], out_spare[0]
    first, apart = similarity.bands(int(sizes.max()))
    own = np.searchsorted(first, sizes, side="right") - 1
    for back in (0, 1):
        scheme = own - back
        use = np.flatnonzero((scheme >= 0) & (sizes > 0))
        use = use[apart[scheme[use]] > 0]  # else only equal sets link
        if not len(use):
            continue
        d = apart[scheme[use]]
        spare = 2 + d * 8 // 100
        segments = d + 1 + spare
        base = np.cumsum(segments) - segments
        count = ends[use + 1] - ends[use]
        at = np.repeat(ends[use] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        h = hashes[at]
        of = np.repeat(np.arange(len(use)), count)
        place = base[of] + ((mixed(h) >> np.uint64(11)) % segments[of].astype(np.uint64)).astype(np.int64)
        word, filled = np.zeros(int(segments.sum()), np.uint64), np.zeros(int(segments.sum()), bool)
        np.bitwise_xor.at(word, place, mixed(h ^ np.uint64(0x5851F42D4C957F2D)))
        filled[place] = True
        row = np.repeat(np.arange(len(use)), segments)
        number = np.arange(len(word)) - base[row]
        empty = np.bincount(row[~filled], minlength=len(use))
        keep = filled | (empty > spare)[row]
        salt = mixed(number.astype(np.uint64) + (scheme[use][row].astype(np.uint64) << np.uint64(32)))
        out_set.append(use[row[keep]])
        bit = np.where(scheme[use][row[keep]] & 1 == 1, _SCHEME, np.uint64(0))
        out_key.append(mixed(word[keep] + salt[keep]) & ~(_SCHEME | _FREQUENT) | bit)
        out_spare.append(np.clip(spare - empty, 0, 255).astype(np.uint8)[row[keep]])
    return np.concatenate(out_set), np.concatenate(out_key), np.concatenate(out_spare)


def signatures(hashes: np.ndarray, ends: np.ndarray, similarity: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) rows such that linked, different sets have a key in common."""
    return signed(hashes, ends, similarity)[:2]


def _met(keys: np.ndarray, nodes: np.ndarray, spare: np.ndarray, often: int):
    """Different (key, node, spare) rows in order, how many nodes each row's key has, whether the row is its key's first, and which keys are frequent."""
    plain = keys & ~_FREQUENT
    o = np.lexsort((nodes, plain))
    plain, nodes, marked, spare = plain[o], nodes[o], (keys[o] & _FREQUENT) > 0, spare[o]
    new = np.r_[True, plain[1:] != plain[:-1]][: len(plain)]
    other = new | np.r_[True, nodes[1:] != nodes[:-1]][: len(plain)]
    key = np.cumsum(new) - 1
    count, mark = np.bincount(key[other]), np.zeros(int(new.sum()), bool)
    mark[key[marked]] = True
    frequent = mark | (count > often)
    return plain[other], nodes[other], spare[other], count[key[other]], new[other], frequent[key[other]]


def _spokes(nodes: np.ndarray, first: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different edges from each frequent key's first node to its other nodes."""
    least = nodes[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(nodes) else nodes
    pairs = np.unique(np.stack([least, nodes], axis=1)[frequent & ~first], axis=0)
    return pairs[:, 0], pairs[:, 1]


def _seeds(salt: int) -> tuple[int, int]:
    return salt, salt + 1000


def _sets_of(part: pa.RecordBatch, similarity: Similarity, salt: int):
    """Sets of a slice as sorted hashes and ends, each set's two fingerprints by independent hashes of words, and its name."""
    hashes, ends, second = shingle_sets_twice(*string_buffer(part["text"]), similarity.words, *_seeds(salt))
    a, b = set_prints(hashes, ends, second)
    return hashes, ends, a, b, (mixed(a ^ np.uint64(salt)) + np.uint64(salt)).view(np.int64)


def _named_documents(docs: DataFrame, similarity: Similarity, also: list[str]) -> tuple[DataFrame, int]:
    """doc_id, rank, n_shingles and node of every document, with a salt under which no two different sets share a node.

    Nodes come from one hash of the words and are checked by sizes and by
    fingerprints from another, so equal nodes are equal sets.
    """
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in also)
    for salt in range(1, 9):

        def name(batches: Iterator[pa.RecordBatch], salt=salt) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in row_slices(batch, "text", _SLICE):
                    _, ends, a, b, node = _sets_of(part, similarity, salt)
                    cells = [part["doc_id"], part["rank"], pa.array(np.diff(ends)), pa.array(node), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))]
                    yield pa.RecordBatch.from_arrays([*cells, *(part[c] for c in also)], names=["doc_id", "rank", "n_shingles", "node", "a", "b", *also])

        named = checkpointed(docs.mapInArrow(trimmed(name), f"doc_id bigint, rank bigint, n_shingles bigint, node bigint, a bigint, b bigint{kept}"))
        different = F.struct("n_shingles", "a", "b")
        if named.groupBy("node").agg(F.min(different).alias("lo"), F.max(different).alias("hi")).filter("lo <> hi").isEmpty():
            return named, salt
    raise ValueError("different sets share a name under every salt")


_KEY_BYTES = 5


def _to_groups(keys: np.ndarray, nodes: np.ndarray, spare: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """(group, message) of (key, node, spare) rows: each node once with the number of its keys, and five bytes and the spare of each key.

    The group and those bytes tell 2**39 keys apart in every group, and groups
    are of a bounded size; two keys taken for one make a needless candidate.
    """
    group = ((keys >> np.uint64(40)) % np.uint64(groups)).astype(np.int64)
    o = np.lexsort((nodes, group))
    group, keys, nodes, spare = group[o], keys[o], nodes[o], spare[o]
    cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
    for i, j in zip(cut, np.r_[cut[1:], len(group)]):
        own = nodes[i:j]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        short = np.ascontiguousarray(keys[i:j]).view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES]
        yield int(group[i]), packed(own[first], np.diff(np.r_[first, j - i]).astype(np.uint32), short.ravel(), spare[i:j])


def _from_message(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nodes, counts, short, spare = unpacked(body, np.int64, np.uint32, np.uint8, np.uint8)
    wide = np.zeros((len(short) // _KEY_BYTES, 8), np.uint8)
    wide[:, :_KEY_BYTES] = short.reshape(-1, _KEY_BYTES)
    return wide.view(np.uint64).ravel(), np.repeat(nodes, counts), spare


def _candidates(docs: DataFrame, similarity: Similarity, salt: int, n_shingles: int) -> DataFrame:
    """Edges (a, b) between nodes that connect whatever links connect.

    Keys are dealt to groups of about ``_GROUP`` signatures as packed arrays. A
    group tells the nodes that share a key how many these are (a second
    exchange, by node); the keys that nodes keep meet again in a third. Linked nodes have more than ``spare`` keys in common, so each node may
    leave out as many: its most frequent ones (in one order of all keys, the
    rarest common key then stays on both sides). What documents share by a
    common passage alone is mostly left out so, and connects nothing. Of the
    keys that stay, the smallest node is joined to the others.

    A key that many nodes of one task have is frequent; it is never left out,
    and reaches the shuffle once for some millions of signatures, with edges
    to the task's other nodes. So is a key that many nodes of a group have.
    """
    per_shingle = 2 * (similarity.den - similarity.num) / similarity.num + 0.05
    groups = pieces_for(int(n_shingles * per_shingle), _GROUP, shuffle_partitions(docs.sparkSession))

    def home(nodes: np.ndarray) -> np.ndarray:
        return (mixed(nodes.view(np.uint64)) % np.uint64(groups)).astype(np.int64)

    def dealt(to: np.ndarray, kind: int, *arrays: np.ndarray) -> list[tuple[int, int, bytes]]:
        """A message for each group with its part of the arrays."""
        o = np.argsort(to, kind="stable")
        cut = np.flatnonzero(np.r_[True, to[o][1:] != to[o][:-1]][: len(o)])
        return [(int(to[o[i]]), kind, packed(*(x[o[i:j]] for x in arrays))) for i, j in zip(cut, np.r_[cut[1:], len(o)])]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def passed() -> Iterator[pa.RecordBatch]:
            keys, nodes, spare, _, first, frequent = _met(*(np.concatenate(x) for x in zip(*held)), _OFTEN_HERE)
            a, b = _spokes(nodes, first, frequent)
            sent = first | ~frequent
            rows = [(g, 0, body) for g, body in _to_groups((keys | np.where(frequent, _FREQUENT, np.uint64(0)))[sent], nodes[sent], spare[sent], groups)]
            yield from messages(rows + dealt(home(b), 1, a, b)).to_batches()  # edges are dealt by their second node

        for batch in batches:
            for part in row_slices(batch, "text", _SLICE):
                hashes, ends, _, _, node = _sets_of(part, similarity, salt)
                which, key, spare = signed(hashes, ends, similarity)
                held.append((key, node[which], spare))
                if sum(len(k) for k, _, _ in held) > _HELD:
                    yield from passed()
                    held.clear()
        if held:
            yield from passed()

    def meet(table: pa.Table) -> pa.Table:
        kinds, bodies, me = table["sender"].to_pylist(), table["body"].to_pylist(), np.uint64(table["to"][0].as_py())
        told = [_from_message(x) for k, x in zip(kinds, bodies) if k == 0] or [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint8))]
        keys, nodes, spare, count, first, frequent = _met(*(np.concatenate(x) for x in zip(*told)), _OFTEN)
        edges = [_spokes(nodes, first, frequent), *(unpacked(x, np.int64, np.int64) for k, x in zip(kinds, bodies) if k == 1)]
        pairs = np.unique(np.stack([np.concatenate([x for x, _ in edges]), np.concatenate([y for _, y in edges])], axis=1), axis=0)
        shared = (count > 1) & ~frequent
        keys = me << np.uint64(40) | keys[shared]
        rows = dealt(home(nodes[shared]), 0, keys, nodes[shared], count[shared].astype(np.int32), spare[shared])
        return messages(rows + dealt(home(pairs[:, 1]), 1, pairs[:, 0], pairs[:, 1]))

    def leave_out(table: pa.Table) -> pa.Table:
        told = [unpacked(x, np.uint64, np.int64, np.int32, np.uint8) for k, x in zip(table["sender"].to_pylist(), table["body"].to_pylist()) if k == 0]
        rows = [(t, k, x) for t, k, x in zip(table["to"].to_pylist(), table["sender"].to_pylist(), table["body"].to_pylist()) if k == 1]
        if told:
            keys, nodes, count, spare = (np.concatenate(x) for x in zip(*told))
            scheme = keys & _SCHEME
            o = np.lexsort((keys, count, scheme, nodes))
            keys, nodes, spare, scheme = keys[o], nodes[o], spare[o], scheme[o]
            new = np.r_[True, (nodes[1:] != nodes[:-1]) | (scheme[1:] != scheme[:-1])]
            first = np.flatnonzero(new)
            of, size = np.cumsum(new) - 1, np.diff(np.r_[first, len(o)])
            kept = np.arange(len(o)) - first[of] < size[of] - spare  # the rarest come first
            rows += dealt((keys[kept] >> np.uint64(40)).astype(np.int64), 0, keys[kept], nodes[kept])
        return messages(rows)

    def join(table: pa.Table) -> pa.Table:
        told = [(k, unpacked(x, np.uint64 if k == 0 else np.int64, np.int64)) for k, x in zip(table["sender"].to_pylist(), table["body"].to_pylist())]
        edges = [x for k, x in told if k == 1]
        if kept := [x for k, x in told if k == 0]:
            keys, nodes = (np.concatenate(x) for x in zip(*kept))
            o = np.lexsort((nodes, keys))
            edges.append(_spokes(nodes[o], np.r_[True, keys[o][1:] != keys[o][:-1]], np.ones(len(o), bool)))
        a, b = (np.concatenate(x) for x in zip(*edges)) if edges else (np.empty(0, np.int64),) * 2
        pairs = np.unique(np.stack([a, b], axis=1), axis=0)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    met = docs.mapInArrow(trimmed(sign), MESSAGE_DDL).groupBy("to").applyInArrow(trimmed_group(meet), MESSAGE_DDL)
    kept = met.groupBy("to").applyInArrow(trimmed_group(leave_out), MESSAGE_DDL)
    return kept.groupBy("to").applyInArrow(trimmed_group(join), "a bigint, b bigint")


def _forest(sets: list[np.ndarray], sides: np.ndarray, inner: bool, similarity: Similarity) -> list[tuple[int, int]]:
    """Links that connect whatever links connect among some sets: those across the two sides, and with ``inner`` inside side 0.

    Sketches give each pair's smallest possible difference; pairs that could
    still link and aren't connected yet are verified on their sets, nearest first.
    """
    n = len(sets)
    order = sorted(range(n), key=lambda i: len(sets[i]))
    size = np.array([len(sets[i]) for i in order])
    words = max(32, -(-int(size[-1]) // 64))
    ends = np.r_[0, np.cumsum(size)]
    sketch = parity_sketches(np.concatenate([sets[i] for i in order]), ends, words)
    side = sides[order]
    label, links = np.arange(n), []
    for i in range(1, n):
        low = int(np.searchsorted(size, -(-size[i] * similarity.num // similarity.den)))
        j = np.arange(low, i)
        j = j[label[j] != label[i]]
        j = j[(side[j] != side[i]) | (inner and side[i] == 0)]
        if not len(j):
            continue
        apart = np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        ok = apart <= similarity.most_apart(size[j] + size[i])
        j, apart = j[ok], apart[ok]
        mine = sets[order[i]]
        for k in j[np.argsort(apart, kind="stable")].tolist():
            if label[k] != label[i]:
                both = len(np.intersect1d(mine, sets[order[k]], assume_unique=True))
                if similarity.den * both >= similarity.num * (len(mine) + len(sets[order[k]]) - both):
                    links.append((order[i], order[k]))
                    label[label == label[k]] = label[i]
    return links


def likely_rows(rows: DataFrame, wanted: DataFrame, key: str, most_bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose ``key`` (never null) is in ``wanted``, and a few others: what is worth joining."""
    return split_likely(rows, wanted, key, most_bits)[0]


def split_likely(rows: DataFrame, wanted: DataFrame, key: str, most_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose ``key`` (never null) may be in ``wanted``, and all others (None: no others can be told).

    Two bits are set for each wanted key, and each row looks its two up, all
    by joins with the filter's words, a table of ``most_bits`` / 64 rows at most whatever the
    input: it is broadcast, and no Python runs. With so many keys that such a filter
    would pass most rows, one shuffle of all rows is cheaper than passes for a part of the
    keys each; then all rows are likely and the join does the work.
    """
    n = wanted.count()
    bits = min(most_bits, 1 << max(6, (16 * n - 1).bit_length()))
    if n == 0:
        return rows.filter("false"), rows
    if 2 * n > bits:
        return rows, None

    def place(i: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits))

    at = wanted.select(F.explode(F.array(place(1), place(2))).alias("at"))
    words = checkpointed(at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")))
    marked, there = rows, F.lit(True)
    for i in (1, 2):
        names = fresh_names(marked, "word", "bits", "at")
        word, bit, own = names["word"], names["bits"], names["at"]
        marked = marked.withColumn(own, place(i)).join(F.broadcast(words.toDF(word, bit)), F.shiftright(own, 6) == F.col(word), "left")
        there = there & (F.expr(f"coalesce(shiftright({bit}, CAST({own} & 63 AS INT)) & 1, 0)") == 1)
    kept = [F.col(f"`{c}`") for c in rows.columns]
    return marked.filter(there).select(*kept), marked.filter(~there).select(*kept)


def _units(placed: DataFrame, packs: int) -> DataFrame:
    """Every node with the units of work that it takes part in: g, unit, side, inner.

    A unit compares two blocks of a cluster: blocks are bands of set sizes,
    cut by hash where a band is large, and only blocks of one band or of
    adjacent ones hold sets that can link. A band that is one block is
    compared with itself in the unit that compares it with the next band.
    Small clusters are one unit, many to a group.
    """
    i = lambda x: x.cast("int") if not isinstance(x, int) else F.lit(x)

    def unit(lo: Column, u: Column, hi: Column, v: Column, side: Column, inner: Column) -> Column:
        return F.struct(F.array(i(lo), i(u), i(hi), i(v)).alias("unit"), i(side).alias("side"), inner.alias("inner"))

    def each(n: Column, make) -> Column:
        return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), make)

    band = F.col("band")
    here, up, down = (F.coalesce(F.element_at("subs", band + k), F.lit(0)) for k in (0, 1, -1))
    u = F.pmod(F.xxhash64("node"), here).cast("int")
    alone = (here == 1) & (up > 0)
    own = each(F.when(alone, 0).otherwise(here), lambda v: unit(band, F.least(u, v), band, F.greatest(u, v), F.when(u > v, 1).otherwise(0), u == v))
    above = each(up, lambda v: unit(band, u, band + 1, v, F.lit(0), alone & (v == 0)))
    below = each(down, lambda v: unit(band - 1, v, band, u, F.lit(1), F.lit(False)))
    small = F.array(unit(F.lit(-1), F.lit(0), F.lit(-1), F.lit(0), F.lit(0), F.lit(True)))
    units = F.when(F.col("large"), F.concat(own, above, below)).otherwise(small)
    g = F.when(F.col("large"), F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(packs)))
    return placed.withColumn("w", F.explode(units)).select(g.alias("g"), "w.unit", "w.side", "w.inner", "component", "node", "text")


def _links(docs: DataFrame, firsts: DataFrame, clusters: DataFrame, similarity: Similarity, salt: int, block_bytes: int, block_sets: int) -> DataFrame:
    """Verified links (a, b) that connect the nodes of each cluster of candidates as all its links do.

    A cluster with more than ``block_bytes`` or ``block_sets`` of sets is cut
    into blocks by set size and hash, so every unit of work is bounded.
    """
    least = shuffle_partitions(docs.sparkSession)
    largest = firsts.agg(F.max("n_shingles")).first()[0] or 0
    first, _ = similarity.bands(int(largest))
    band = F.size(F.filter(F.lit(first.tolist()), lambda x: x <= F.col("n_shingles"))) - 1
    members = clusters.join(firsts, "node").select("node", "component", "rank", "n_shingles", band.alias("band"))
    blocks = F.ceil(F.greatest(F.sum("n_shingles") * 8 / block_bytes, F.count("*") / block_sets)).cast("int")
    bands = members.groupBy("component", "band").agg(blocks.alias("blocks"), F.sum("n_shingles").alias("s"), F.count("*").alias("n"))
    large = (F.sum("s") * 8 > block_bytes) | (F.sum("n") > block_sets)
    stats = bands.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("band", "blocks"))).alias("subs"), large.alias("large"))
    stats = stats.withColumn("subs", F.when(F.col("large"), F.col("subs")))
    placed = checkpointed(members.join(stats, "component").select("node", "component", "rank", "n_shingles", "band", "subs", "large"))
    packs = max(least, -(-(placed.agg(F.sum("n_shingles")).first()[0] or 0) * 8 // block_bytes))
    dealt = _units(likely_rows(docs.select("rank", "text"), placed, "rank").join(placed, "rank"), packs)

    def verify(table: pa.Table) -> pa.Table:
        component, node, side = (table[c].to_numpy() for c in ("component", "node", "side"))
        inner = pc.any(table["inner"]).as_py()
        o = np.lexsort((node, component))
        found = []
        for rows in np.split(o, np.flatnonzero(component[o][1:] != component[o][:-1]) + 1):
            sets: dict[int, tuple[int, np.ndarray]] = {}  # other documents of the same id have other nodes
            part = pa.record_batch([table["text"].take(pa.array(rows)).combine_chunks()], names=["text"])
            at = 0
            for some in row_slices(part, "text", _SLICE):
                hashes, ends, _, _, own = _sets_of(some, similarity, salt)
                for i in np.flatnonzero(own == node[rows[at : at + some.num_rows]]).tolist():
                    sets[int(own[i])] = int(side[rows[at + i]]), hashes[ends[i] : ends[i + 1]].copy()
                at += some.num_rows
            if len(sets) > 1:
                names = list(sets)
                links = _forest([sets[x][1] for x in names], np.array([sets[x][0] for x in names]), inner, similarity)
                found += [(names[i], names[k]) for i, k in links]
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return dealt.groupBy("g", "unit").applyInArrow(trimmed_group(verify), "a bigint, b bigint")


def similar_documents(docs: DataFrame, similarity: Similarity = Similarity(), block_bytes: int = BLOCK_BYTES, block_sets: int = BLOCK_SETS, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, node (class of equal sets), component (its smallest node) and component_id (smallest doc_id reachable by links) of every document.

    Texts are lower-cased in A-Z and cut at white space; a text with fewer
    words than a shingle is one shingle; null and empty texts have none, and
    link with nothing, each other included. A null doc_id counts as the
    smallest; rows with one doc_id are documents of their own. Equal sets are
    one node from the start, so groups of copies cost nothing further. The
    columns ``also`` are returned too; others are ignored; an empty table
    gives no rows. Texts are whole however long they are.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("rank"), "text", *also)
    named, salt = _named_documents(docs, similarity, list(also))
    docs = docs.select("doc_id", "rank", "text")
    firsts = checkpointed(named.filter("n_shingles > 0").groupBy("node").agg(F.min("rank").alias("rank"), F.first("n_shingles").alias("n_shingles")))
    clusters = components(_candidates(docs, similarity, salt, named.agg(F.sum("n_shingles")).first()[0] or 0))
    linked = components(_links(docs, firsts, clusters, similarity, salt, block_bytes, block_sets))
    of_node = firsts.select("node", "rank").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = of_node.groupBy("component").agg(F.min("rank").alias("component_rank"))
    named_nodes = checkpointed(of_node.join(smallest, "component").select("node", "component", "component_rank"))
    out = named.join(named_nodes, "node", "left")
    rank = F.when(F.col("n_shingles") > 0, F.col("component_rank")).otherwise(F.col("rank"))
    return out.select("doc_id", "n_shingles", "node", F.coalesce("component", "node").alias("component"), F.when(rank != _LOWEST, rank).alias("component_id"), *also)
