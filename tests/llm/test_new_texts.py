"""Importance resampling, fill-in-the-middle and personal data, against plain Python."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import queries
from marlstone.llm.common import string_buffer
from marlstone.llm.fill_middle import FimConfig, MultibyteIndex, fill_in_middle, restored
from marlstone.llm.importance import ImportanceConfig, feature_buckets, fit_gains, importance_ranks, importance_sample, importance_scores
from marlstone.llm.pii import KINDS, Parser, personal_data
from marlstone.llm.radix_sort import radix_ranks

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# importance resampling


def plain_ranks(docs, target, config):
    """doc_id, n_features, weight, score, rank of (doc_id, text) rows."""

    def features(text):
        words = WORD.findall(lowered(text))
        return [zlib.crc32(" ".join(words[i : i + n]).encode()) % config.buckets for n in range(config.shortest, config.longest + 1) for i in range(len(words) - n + 1)], len(words)

    s, t = (Counter(b for _, text in rows for b in features(text)[0]) for rows in (docs, target))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + config.buckets) / ((s[b] + 1) * (n_t + config.buckets)))) for b in s}
    out = []
    for doc_id, text in docs:
        found, words = features(text)
        h = int(hashlib.sha256(f"{config.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words])
    able = sorted((r for r in out if r[4] >= config.min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(able[: config.percent * len(able) // 100])}
    return sorted((tuple(r[:4]) + (drawn.get(id(r)),) for r in out), key=repr)


@pytest.mark.parametrize("config", [ImportanceConfig(), ImportanceConfig(1, 3, 64, 5, 3, 37), ImportanceConfig(2, 2, 1000, 1, 0, 100)])
def test_importance_matches_plain_python(spark, odd_docs, config):
    target = spark.createDataFrame([("alpha gamma Été 42",), (None,), ("",), ("delta " * 50,)], "text string")
    docs = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    want = plain_ranks(docs, [(0, r.text) for r in target.collect()], config)
    scored = importance_scores(odd_docs.select("doc_id", "text", "name"), fit_gains(odd_docs, target, config), config)
    got = importance_ranks(scored.drop("text"), config, digit_bits=5, block_rows=7)
    assert "name" in got.columns
    assert sorted(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == want
    sample = importance_sample(odd_docs, target, config)
    assert set(odd_docs.columns) <= set(sample.columns)
    assert Counter(r.doc_id for r in sample.select("doc_id").collect()) == Counter(r[0] for r in want if r[4])


def test_importance_of_empty_tables(spark, odd_docs, no_docs):
    config = ImportanceConfig()
    assert fit_gains(no_docs, no_docs, config).tolist() == [0] * config.buckets
    assert importance_ranks(importance_scores(no_docs.select("doc_id", "text"), fit_gains(no_docs, odd_docs), config)).count() == 0
    assert importance_sample(no_docs, odd_docs).count() == 0


def test_features_of_long_words_and_texts():
    texts = ["x" * 100_000, "ä" * 50 + " b " + "c" * 31 + " " + "d" * 32 + " " + "e" * 33, None, "", "one"]
    config = ImportanceConfig(1, 2, 1 << 30)
    text, bucket, words = feature_buckets(*string_buffer(pa.array(texts)), config)
    want = []
    for i, t in enumerate(texts):
        w = WORD.findall(lowered(t))
        want += [(i, zlib.crc32(" ".join(w[a : a + n]).encode()) % (1 << 30)) for n in (1, 2) for a in range(len(w) - n + 1)]
    assert sorted(zip(text.tolist(), bucket.tolist())) == sorted(want)
    assert words.tolist() == [1, 5, 0, 0, 1]


@pytest.mark.parametrize("digit_bits, block_rows", [(1, 100), (3, 4), (14, 1), (16, 1000)])
def test_radix_ranks_sort(spark, digit_bits, block_rows):
    rng = random.Random(digit_bits)
    rows = [(rng.choice([0, 0, 0, -5, 7, rng.randint(-40, 40)]), rng.randint(-3, 3), i) for i in range(60)]
    ranked = radix_ranks(spark.createDataFrame(rows, "a long, b long, place long").repartition(5), ["a", "b", "place"], digit_bits, block_rows)
    got = {tuple(r)[:3]: r["rank"] for r in ranked.collect()}
    assert got == {r: k + 1 for k, r in enumerate(sorted(rows))}


def test_radix_ranks_of_extreme_and_equal_keys(spark):
    rows = [(-(2**63),), (2**63 - 1,), (0,), (-1,), (0,)]
    ranked = radix_ranks(spark.createDataFrame(rows, "a long"), ["a"]).collect()
    assert [r.a for r in sorted(ranked, key=lambda r: r["rank"])] == [-(2**63), -1, 0, 0, 2**63 - 1]
    assert sorted(r["rank"] for r in ranked) == [1, 2, 3, 4, 5]
    same = radix_ranks(spark.range(20).selectExpr("7L as a"), ["a"]).collect()
    assert sorted(r["rank"] for r in same) == list(range(1, 21))
    with pytest.raises(Exception, match="null in a key column"):
        radix_ranks(spark.createDataFrame([(1,), (None,)], "a long"), ["a"]).collect()


# fill-in-the-middle


def plain_example(doc_id, text, config):
    text = text or ""
    units = re.findall("[^\n]*\n|[^\n]+", text) if config.unit == "line" else list(text)
    digest = hashlib.sha256(f"{config.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    one, two, three = config.markers
    if not text or any(x in text for x in config.markers) or h[2] % 100 >= config.rate:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < config.spm:
        return doc_id, len(units), "spm", len(p), len(m), two + s + one + p + three + m
    return doc_id, len(units), "psm", len(p), len(m), one + p + two + s + three + m


@pytest.mark.parametrize("config", [FimConfig(), FimConfig("char", 1, 80, 30), FimConfig("char", 2, 100, 100, ("[(", "{|", "*."))])
def test_fill_in_middle_matches_plain_python(spark, odd_docs, config):
    rng = random.Random(3)
    chars = ["a", "b", "é", "中", "🙂", "\n", "\n", "\r", "\u2028", "<", ">", "P", "S", "M", "[", "(", "{", "|", "*", ".", "\\"]
    docs = [(1000 + i, "".join(rng.choice(chars) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    docs += [(2000, "x<P>y\n"), (2001, "\n\n\n"), (2002, "no end"), (2003, "🙂" * 30_000 + "\n" + "é" * 70_000)]
    table = odd_docs.select("doc_id", "text", "h", "name").unionByName(spark.createDataFrame(docs, "doc_id long, text string"), True)
    made = fill_in_middle(table, config)
    assert made.columns == ["doc_id", "text", "h", "name", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = made.withColumn("back", restored("output", "form", config)).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")) for r in rows), key=repr) == sorted((plain_example(r.doc_id, r.text, config) for r in rows), key=repr)
    assert all(r.back == (r.text or "") for r in rows)
    assert {"plain", "spm"} <= {r.form for r in rows}


def test_fill_in_middle_of_an_empty_table_and_bad_markers(no_docs):
    assert fill_in_middle(no_docs).count() == 0
    for markers in (("<P>", "<P>", "<M>"), ("<P", "P>", "<M>"), ("", "<S>", "<M>"), ("abab", "<S>", "<M>"), ("<P>", "x<P>y", "<M>")):
        with pytest.raises(ValueError, match="overlap"):
            FimConfig(markers=markers)
    with pytest.raises(ValueError, match="unit"):
        FimConfig(unit="word")


def test_multibyte_index():
    rng = random.Random(4)
    for text in ["", "plain", "".join(rng.choice("aéß中🙂\n") for _ in range(500))]:
        index = MultibyteIndex(np.frombuffer(text.encode(), np.uint8))
        points = np.arange(len(text) + 1)
        places = np.array([len(text[:i].encode()) for i in points])
        assert index.to_bytes(points).tolist() == places.tolist()
        assert index.to_points(places).tolist() == points.tolist()
        assert len(index.at_byte) == sum(ord(c) > 127 for c in text)


# personal data


def base_spans(text):
    """The fixed patterns, as written."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def base_of(text):
    return [s for s in Parser().spans(lowered(text)) if s[1] < 4]


def test_base_spans_match_the_patterns():
    rng = random.Random(5)
    parser = Parser()
    soups = ["a.@-b%+é🙂 ", "0123.", "0123456789 -", "+1234567890 ().-", "+19.@aB-_% \n255:/", "٣1.2@a+é"]
    for k in range(30_000):
        text = "".join(rng.choice(soups[k % len(soups)]) for _ in range(rng.randint(0, 40)))
        assert [s for s in parser.spans(lowered(text)) if s[1] < 4] == base_spans(text), text


@pytest.mark.parametrize("text", ["A.b@C.de@f.gh", "a@b", "@a.b", "a@b..c", "a@-.-", "1.2.3.4.5.6.7.8.9", "256.1.1.1.1.1.1", "0001.2.3.000255", "4111 1111-1111 1111", "4111  1111 1111 1111", "4111111111111112", "+1 (555) 555-0100.", "+12", "+1 2345678", "+1 23456789", "+1234567890123456", "++49 (0)30 1234567-", "9" * 4000 + ".1.1.1"])
def test_base_spans_at_edges(text):
    assert base_of(text) == base_spans(text)


def kinds(text):
    return [(KINDS[k], text[a:b]) for a, k, b in Parser().spans(lowered(text)) if k > 3]


def test_spans_beyond_the_base():
    assert kinds("schreib an jörg.müller@bücher.example.de, bitte") == [("mailbox", "jörg.müller@bücher.example.de")]
    assert kinds("see https://User:pa55@Host.example.com/x?y=1). Then") == [("url", "https://User:pa55@Host.example.com/x?y=1")]
    assert kinds("see https://host.example.com/a@b and http://www.example.org/") == []
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00 is mine") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("IBAN GB82WEST12345698765432.") == [("iban", "GB82WEST12345698765432")]
    assert kinds("iban de89 3704 0044 0532 0130 01") == []
    assert kinds("Account no: 1234-5678 and discount 12345678") == [("account", "1234-5678")]
    assert kinds("SSN 078-05-1120") == [("account", "078-05-1120")]
    assert kinds('token = "04dbebab91ab85687d33" and api_key=Zx9-abc_1234') == [("secret", "04dbebab91ab85687d33"), ("secret", "Zx9-abc_1234")]
    assert kinds("the token economy = something, mistoken = a1b2c3d4e5, password: hunters") == []


def test_spans_take_linear_time():
    n, parser, start = 200_000, Parser(), time.perf_counter()
    for unit in ("@", "a@", "a", "1", "1.", "1 ", "+1", "://", "a://b@c", "+1(", "token=", "iban ", "account 1", "é@", "a.b@c.d", "1-@"):
        text = (unit * n)[:n]
        parser.spans(text)
    assert time.perf_counter() - start < 20


def test_personal_data_of_tables(spark, odd_docs, no_docs):
    assert personal_data(no_docs).count() == 0
    extra = [(900, "Mail É a@b.cd, a@b.cd!"), (901, "é" * 100_000 + " +1 (555) 555-0100"), (902, None), (903, ""), (900, "Mail É a@b.cd, a@b.cd!")]
    found = personal_data(odd_docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), True))
    assert found.columns == [*odd_docs.columns, "pii", "redacted"]
    rows = found.collect()
    assert len(rows) == odd_docs.count() + len(extra)
    for r in rows:
        assert [(s.start, KINDS.index(s.kind), s.end) for s in r.pii if s.base] == base_spans(r.text or "")
    by_id = {r.doc_id: r for r in rows}
    assert by_id[900].redacted == "Mail É <EMAIL>, <EMAIL>!"
    assert by_id[901].redacted == "é" * 100_000 + " <PHONE>"
    assert by_id[902].redacted is None and by_id[902].pii == [] and by_id[903].redacted == ""


def test_registered_pii_query_is_whole(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op13_pii(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        spans = base_spans(d.text or "")
        row = got[d.doc_id]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]
        told = [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
        assert row.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert set(told) <= set(row.spans.split(","))


def test_redaction_joins_overlaps(spark):
    row = personal_data(spark.createDataFrame([(1, "at https://a:b@host.example.com/x now")], "doc_id long, text string")).first()
    assert row.redacted == "at <URL> now"
    assert {s.kind for s in row.pii} == {"url", "email"}
