import hashlib
import random
import re
import uuid

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from marlstone.llm import suffix_dedup
from marlstone.llm.decontaminate import FMIndex, contamination, without_spans
from marlstone.llm.graph import components
from marlstone.llm.jaccard_join import Similarity, likely_rows, signatures, similar_documents
from marlstone.llm.shingles import shingle_sets
from marlstone.llm.suffix_dedup import repeat_heads, repeated_spans

LOWER = {c: c + 32 for c in range(65, 91)}


def test_repeat_heads_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(100):
        n, length = int(rng.integers(2, 60)), int(rng.integers(1, 20))
        data = rng.integers(97, 97 + int(rng.integers(1, 4)), n).astype(np.uint8)
        sa, head = repeat_heads(data, length)
        ring = np.resize(data, n + length).tobytes()
        prefixes = [ring[i : i + length] for i in sa]
        assert prefixes == sorted(prefixes)
        assert list(head) == [i == 0 or prefixes[i] != prefixes[i - 1] for i in range(n)]


@pytest.mark.parametrize("sizes", [dict(), dict(block_bytes=2000, group_bytes=3000, chunk_bytes=300)])
def test_repeated_spans_brute_force(spark, odd_docs, sizes):
    docs = odd_docs.select("doc_id", "text", "lang", F.lit(1).alias("to"), F.lit(2).alias("rank"))
    got = sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in repeated_spans(docs, 50, 20, **sizes).collect()), key=str)
    rows = sorted([tuple(r) for r in odd_docs.select("doc_id", "text").collect()], key=lambda r: (r[0] is not None, r[0] or 0))
    first, want = {}, []
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] != d:
                gone[i : i + 50] = b"\1" * 50
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        want.append((d, len(b), spans, bytes(c for c, g in zip(b, gone) if not g)))
    assert got == sorted(want, key=str)


def test_repeated_spans_of_a_frequent_passage(spark, tmp_path, monkeypatch):
    """However many documents share a passage, no transform is much larger than chunk_bytes."""
    rng, chunk_bytes, earliest = random.Random(11), 4000, suffix_dedup._earliest
    passage, tails = rng.randbytes(80).hex(), [rng.randbytes(40).hex() for _ in range(150)]
    rows = [(i, rng.randbytes(40).hex() + passage + rng.choice(tails)) for i in rng.sample(range(10**6), 500)]

    def noted(segments, docs, length):
        with open(f"{tmp_path}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(sum(map(len, segments))))
        return earliest(segments, docs, length)

    monkeypatch.setattr(suffix_dedup, "_earliest", noted)
    cloudpickle.register_pickle_by_value(suffix_dedup)
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: [tuple(s) for s in r.spans] for r in repeated_spans(docs, 50, 20, block_bytes=20000, chunk_bytes=chunk_bytes).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(suffix_dedup)
    first = {}
    for d, t in sorted(rows):
        for i in range(len(t) - 49):
            first.setdefault(t[i : i + 50], d)
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] != d:
                gone[i : i + 50] = b"\1" * 50
        assert got[d] == [m.span() for m in re.finditer(b"\1+", bytes(gone))]
    sizes = [int(x.read_text()) for x in tmp_path.iterdir()]
    assert sizes and max(sizes) <= 2 * chunk_bytes + 100


def test_repeated_spans_of_nothing(no_docs):
    assert repeated_spans(no_docs).count() == 0


def test_fm_index_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        seq = rng.integers(0, 4, int(rng.integers(5, 120)))
        seq[-1] = 0
        index = FMIndex(seq, 3, every=5)
        phrases = rng.integers(1, 4, (20, int(rng.integers(1, 4))))
        found = {}
        for who, lo, hi in zip(*index.search(phrases)):
            found[who] = sorted(index.locate(np.arange(lo, hi)).tolist())
        for i, p in enumerate(phrases):
            assert found.get(i, []) == [k for k in range(len(seq) - len(p) + 1) if list(seq[k : k + len(p)]) == list(p)]


@pytest.mark.parametrize("limits", [dict(), dict(shard_bytes=500, phrase_bytes=200), dict(shard_bytes=500, phrase_bytes=40)])
def test_contamination_brute_force(spark, odd_docs, limits):
    texts = [r.text for r in odd_docs.filter("doc_id in (2, 4)").collect()]
    items = [(7, texts[0][100:300]), (8, texts[1][:150]), (9, "one two"), (10, None), (11, ""), (12, "?!"), (13, "one"), (None, "alpha"), (14, texts[0][100:300])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = find(t)
        if i is not None and w:
            for a in range(max(len(w) - 10, 0) + 1):
                windows.setdefault(tuple(w[a : a + 10]), set()).add(i)
    got = sorted(((r.text, r.n_words, sum(s.end_word - s.first_word for s in r.spans), r.items, r.spans) for r in contamination(odd_docs, bench, 10, **limits).collect()), key=str)
    for text, n_words, n_hit, ids, spans in got:
        w, hit, own = find(text), set(), set()
        for p, who in windows.items():
            for a in range(len(w) - len(p) + 1):
                if tuple(w[a : a + len(p)]) == p:
                    hit.update(range(a, a + len(p)))
                    own |= who
        assert (n_words, n_hit, ids) == (len(w), len(hit), sorted(own))
        assert sum(len(find((text or "").encode()[s.start : s.end].decode())) for s in spans) == n_hit


def thue_morse(n):
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_structured_words_are_not_confused(spark):
    """Words that polynomial hashes take for one are different words to the benchmark and to shingles."""
    a, b = thue_morse(10)
    docs = spark.createDataFrame([(1, f"{a} x"), (2, f"{b} x"), (3, f"{a.upper()} x")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, a), (6, f"{a} {b}")], "item_id long, text string")
    assert {r.doc_id: r["items"] for r in contamination(docs, bench).collect()} == {1: [5], 2: [], 3: [5]}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_documents(docs, Similarity(1, 90, 100)).collect()}
    assert got == {1: (2, 1), 2: (2, 2), 3: (2, 1)}


def test_cut_passages(spark):
    docs = spark.createDataFrame([(1, "Été a b c d fin"), (2, None), (3, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "A b. C d")], "item_id long, text string")
    got = {r.doc_id: r.text for r in without_spans(contamination(docs, bench)).collect()}
    assert got == {1: "Été  fin", 2: None, 3: "clean"}


def test_clean_without_items(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(odd_docs, none).filter("size(spans) > 0").count() == 0
    assert contamination(no_docs, none).count() == 0


def sets_of(rows, words):
    out = {}
    for k, (d, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out[k] = frozenset(tuple(w[a : a + words]) for a in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    return out


@pytest.mark.parametrize("words,num,limits", [(3, 90, ()), (5, 80, ()), (2, 50, (2000, 5)), (5, 80, (1 << 20, 3)), (2, 50, (1 << 20, 8))])
def test_similar_documents_brute_force(spark, odd_docs, words, num, limits):
    rng = random.Random(3)
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    long = [r[1] for r in rows if r[0] in (3, 4, 5)]
    for i in range(40):  # near copies at many distances
        w = rng.choice(long).split(" ")
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
        rows.append((500 + i, " ".join(w)))
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, node int, component int")
    sets, root = sets_of(rows, words), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    smallest = {}
    for k, (d, _) in enumerate(rows):
        low = -1 if d is None else d
        smallest[find(k)] = min(smallest.get(find(k), low), low)
    want = sorted(((d, len(sets[k]), None if smallest[find(k)] == -1 else smallest[find(k)]) for k, (d, _) in enumerate(rows)), key=str)
    got = similar_documents(docs, Similarity(words, num, 100), *limits)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == want


@pytest.mark.parametrize("words", [1, 3, 5, 8])
def test_shingles_of_slices_with_few_words(words):
    for n in range(1, 8):
        text = " ".join("abcdefg"[:n]).encode()
        long = text + b" " + b"x y z " * 10
        alone, ends = shingle_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), words)
        beside, at = shingle_sets(np.frombuffer(text + long, np.uint8), np.array([0, len(text), len(text) + len(long)]), words)
        assert list(ends) == [0, max(n - words + 1, 1)] and list(alone) == list(beside[: at[1]])


@pytest.mark.parametrize("text", ["a b", "a b c"])
def test_similar_documents_of_one_short_text(spark, text):
    got = similar_documents(spark.createDataFrame([(7, text)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got] == [(7, 1, 7)]


def test_similar_documents_of_nothing(no_docs):
    assert similar_documents(no_docs).count() == 0


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(5)
    for num in (80, 90):
        s = Similarity(3, num, 100)
        for _ in range(200):
            n = int(rng.integers(2, 200))
            a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            drop = int(rng.integers(0, s.most_apart(2 * len(a)) + 1))
            b = np.unique(np.r_[a[drop // 2 :], rng.integers(0, 1 << 62, drop - drop // 2).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            if drop and 100 * both >= num * (len(a) + len(b) - both):
                which, keys = signatures(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]), s)
                assert set(keys[which == 0].tolist()) & set(keys[which == 1].tolist())


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (200, 200), (102, 100), (7, 55)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in [*range(31), 55]}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_digest_is_of_kept_bytes(spark, odd_docs):
    row = repeated_spans(odd_docs.select("doc_id", "text")).select(F.sha2("kept", 256).alias("h"), "kept").first()
    assert row.h == hashlib.sha256(bytes(row.kept)).hexdigest()


@pytest.mark.parametrize("most_bits", [64, 1 << 12, 1 << 26])
def test_likely_rows_lose_none(spark, most_bits):
    rows = spark.range(-2000, 2000).withColumnRenamed("id", "rank")
    wanted = [-(1 << 63), -1999, -64, -1, 0, 1, 63, 64, 1500]
    got = {r[0] for r in likely_rows(rows, spark.createDataFrame([(x,) for x in wanted], "rank long"), "rank", most_bits).collect()}
    assert set(wanted[1:]) <= got
    if most_bits == 1 << 26:
        assert len(got) < 2000
    none = spark.createDataFrame([], "rank long")
    assert likely_rows(rows, none, "rank", most_bits).count() == 0
    assert likely_rows(none, rows, "rank", most_bits).count() == 0
