import base64
import math
import random
import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marlstone.llm.bpe_sql import SqlBpe, encode_and_decode, ranks_rise, read_ranks
from marlstone.llm.common import equal_spans, span_hashes, string_buffer
from marlstone.llm.crc32c import crc32c_of
from marlstone.llm import html_text, toxicity
from marlstone.llm.html_text import main_text, with_main_text
from marlstone.llm.pieces import PieceCache, split_pieces
from marlstone.llm.token_files import LibraryBpe, framed, read_token_files, unframed, write_token_files
from marlstone.llm.toxicity import ToxicityConfig, fit_toxicity, toxicity_scores
from marlstone.llm.url_filter import UrlRule, url_verdicts


def test_pieces_match_the_pattern():
    rng = random.Random(1)
    chars = ["a", "b", "é", "1", "²", " ", " ", "\n", "\t", " ", "'", "'", "s", "t", "re", "ll", "d", ".", ",", "中", "🙂", "\x1c", " ", "A"]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    data, offsets = string_buffer(pa.array(texts))
    raw, (begin, end) = data.tobytes(), split_pieces(data, offsets)
    assert [raw[a:b].decode() for a, b in zip(begin, end)] == [p for t in texts for p in regex.findall(public_tokenizers.PATTERN, t)]


def thue_morse(n: int) -> tuple[str, str]:
    """Two different strings that every polynomial hash modulo a power of two takes for one."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_different_spans_have_different_hashes():
    for n in range(1, 13):
        a, b = thue_morse(n)
        data = np.frombuffer((a + b + a).encode(), np.uint8)
        starts = np.array([0, len(a), 2 * len(a)])
        for seed in (0, 1, 5):
            h = span_hashes(data, starts, starts + len(a), seed)
            assert h[0] == h[2] != h[1]
        assert equal_spans(data, starts, data, starts * 0, starts * 0 + len(a)).tolist() == [True, False, True]


def test_pieces_with_one_hash_are_told_apart():
    """With a hash that knows only a piece's size, every text still gets its own ids."""
    coding, rng = _tiktoken(), random.Random(2)
    bpe = SqlBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    weak = PieceCache(bpe.encode, hashes_of=lambda data, begin, end: (end - begin).astype(np.uint64))
    for _ in range(3):
        texts = ["".join(rng.choice("ab 1") for _ in range(rng.randint(0, 60))) for _ in range(50)] + list(thue_morse(10))
        ids, ends = weak.ids_of(*string_buffer(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [coding.encode_ordinary(t) for t in texts]


_LONG = """
import resource, sys
import numpy as np, public_tokenizers, pyarrow as pa, random
from marlstone.llm.bpe_sql import SqlBpe
from marlstone.llm.common import string_buffer
bpe, n = SqlBpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), 4_000_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for text in ("a" * n, " " * n, "ab-" * (n // 3)):
    data, offsets = string_buffer(pa.array([text]))
    ids, ends = bpe.cache.ids_of(data, offsets)
    assert bpe.decode(ids, ends) == [text.encode()]
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_memory_of_pieces_of_4_mb():
    """A task process's peak over that of the loaded vocabulary, in MB."""
    done = subprocess.run([sys.executable, "-c", _LONG], capture_output=True, text=True, cwd=Path(__file__).parents[2], timeout=300)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 500


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_long_pieces_match_tiktoken(vocabulary):
    rng, n = random.Random(6), 60_000
    path = public_tokenizers.path(vocabulary)
    coding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    bpe = SqlBpe(path)
    letters = ["a", "ab", "aab", " ", "-", "=", "é", "中", "etaoinshrdlu", "abcdefghijklmnopqrstuvwxyz", "0123456789", "-=*#.", "的一是不了人我在", "\n", "\t", "aaaaaaab"]
    texts = [chars * (n // len(chars) + k) for k, chars in enumerate(letters)]
    texts += ["".join(rng.choice(chars) for _ in range(n)) for chars in letters] + ["x" * k for k in range(60, 140)]
    texts += ["".join(rng.choice("ab") * rng.randint(1, 90) for _ in range(800))]
    data, offsets = string_buffer(pa.array(texts))
    ids, ends = bpe.cache.ids_of(data, offsets)
    for text, a, b in zip(texts, ends[:-1], ends[1:]):
        want = [i for piece in regex.findall(public_tokenizers.PATTERN, text) for i in coding._core_bpe.encode_single_piece(piece.encode())]
        assert ids[a:b].tolist() == want, text[:50]
    assert bpe.decode(ids, ends) == [t.encode() for t in texts]


def test_a_piece_of_4_mb_matches_tiktoken():
    coding, bpe = _tiktoken(), SqlBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text in ("a" * 4_000_000, " " * 4_000_000, "".join(random.Random(7).choice("etaoin") for _ in range(400_000))):
        data, offsets = string_buffer(pa.array([text]))
        assert bpe.cache.ids_of(data, offsets)[0].tolist() == coding._core_bpe.encode_single_piece(text.encode())


def test_a_run_of_ids_is_decoded_once():
    bpe, asked = SqlBpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), []
    rows = bpe._decode_rows
    bpe._decode_rows = lambda ids, offsets: (asked.append(len(ids)), rows(ids, offsets))[1]
    texts = ["a word that stands in every text, und noch ein längeres " * 50, ""] * 20
    for _ in range(2):
        ids, ends = bpe.cache.ids_of(*string_buffer(pa.array(texts)))
        assert bpe.decode(ids, ends) == [t.encode() for t in texts]
    assert sum(asked) < 100 < len(ids)


@pytest.mark.parametrize("wide", [False, True])
def test_any_ids_are_decoded(tmp_path, wide):
    """Rows that no text has, before and after the remembered runs are forgotten; with ids of more than 16 bits, too."""
    path, rng = public_tokenizers.path("byte_bpe_50k.tiktoken"), random.Random(9)
    if wide:
        path = tmp_path / "wide.tiktoken"
        path.write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for t, r in ({bytes([b]): b for b in range(256)} | {b" a": 65_535, b" aa": 65_536, b"bb": 70_000}).items()))
    tokens = {r: t for t, r in read_ranks(str(path)).items()}
    bpe, known = SqlBpe(str(path)), sorted(tokens)
    for again in range(3):
        rows = [[rng.choice(rng.choice([known, known[-3:], known[:2], [32]])) for _ in range(rng.choice([0, 1, 2, 5, 9, 3000]))] for _ in range(60)]
        ids, ends = np.array([x for r in rows for x in r], np.uint32), np.cumsum([0, *map(len, rows)])
        assert bpe.decode(ids, ends) == [b"".join(tokens[x] for x in r) for r in rows]
        if again:
            bpe._clear_runs()
    assert bpe.decode(np.empty(0, np.uint32), np.zeros(3, np.int64)) == [b"", b""]


def test_parts_of_a_file_stay_in_the_cache():
    """A file of the driver's half gigabyte has some 440,000 different parts in 54 MB; a part that comes again isn't encoded again."""
    bpe, rng, asked = SqlBpe(public_tokenizers.path("byte_bpe_50k.tiktoken")), random.Random(10), []
    bpe.cache.encode = lambda parts: (asked.append(len(parts)), (np.zeros(len(parts), np.int32), np.ones(len(parts), np.int64)))[1]
    slices = [pa.array([" ".join("".join(rng.choices("etaoinshr", k=8)) for _ in range(50_000))]) for _ in range(8)]
    for text in [*slices, slices[0]]:
        bpe.cache.ids_of(*string_buffer(text))
    assert sum(asked[:8]) > 350_000 and len(asked) == 8


def test_a_vocabulary_whose_ranks_fall_is_an_error(spark, tmp_path):
    path = tmp_path / "falling.tiktoken"
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 290}
    path.write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for t, r in ranks.items()))
    with pytest.raises(ValueError, match="higher rank"):
        encode_and_decode(spark.createDataFrame([(1, "x")], "doc_id long, text string"), str(path))


def test_ranks_rise():
    """The vocabulary's tokens take no step above their own rank, so places of one pair may be contracted together."""
    assert ranks_rise(read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    assert not ranks_rise({b"a": 0, b"b": 1, b"c": 2, b"bc": 9, b"abc": 5})


def test_long_words():
    coding, rng = _tiktoken(), random.Random(8)
    bpe = SqlBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["a" * 5000, "ab" * 3000, "aab" * 999 + "a", *("".join(rng.choice(letters) for _ in range(n)) for n in (1, 2, 3, 65, 20000)), "".join(rng.choice("ACGT") for _ in range(30000)), "=" * 77 + "-" * 300, *thue_morse(11)]
    words += ["".join(rng.choice(rng.choice(["abc", letters, letters.upper(), "01", "é日🙂ß"])) for _ in range(rng.randint(1, 300))) for _ in range(300)]
    ids, counts = bpe.encode([w.encode() for w in words])
    ends = np.r_[0, np.cumsum(counts)]
    for w, a, b in zip(words, ends, ends[1:]):
        assert ids[a:b].tolist() == coding._core_bpe.encode_single_piece(w.encode())


def test_added_tokens_are_read_as_the_library_does():
    path = public_tokenizers.path("byte_bpe_50k.json")
    end, rng = "<|endoftext|>", random.Random(6)
    texts = ["", end, f"a{end}b", f"{end}{end} {end}x", "<|endof", "text|>", f"it's {end}'s", "plain", f"{end[:-1]}{end}", *("".join(rng.choice([end, "word ", "<|", "é", "'s", "\n"]) for _ in range(rng.randint(0, 9))) for _ in range(200))]
    ids, ends = LibraryBpe(path).ids_of(*string_buffer(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def _tiktoken():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_tiktoken(spark, odd_docs, no_docs):
    extra = spark.createDataFrame([(900, "say <|endoftext|> it's " + "ab" * 700 + " " * 300 + "\x00\n"), (901, " ".join(thue_morse(10)))], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(extra).withColumn("ids", F.lit(1))
    coding = _tiktoken()
    for r in encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == coding.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert encode_and_decode(no_docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


def test_token_files(spark, odd_docs, no_docs, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = write_token_files(odd_docs, path, f"file://{tmp_path}/a", end_id=2, file_bytes=2000)
    tokenizer = Tokenizer.from_file(path)
    rows = sorted(read_token_files(manifest).collect(), key=lambda r: r.start)
    docs = sorted(([r.doc_id, r.text or ""] for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r.doc_id for r in rows] == [d for d, _ in docs]
    start = 0
    for r, (_, text) in zip(rows, docs):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert (r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()) == (start, ids)
        start += len(ids)
    assert manifest.agg(F.sum("tokens")).first()[0] == start and manifest.count() > 1
    assert read_token_files(write_token_files(no_docs, path, f"file://{tmp_path}/b")).count() == 0


def test_records():
    first, second = framed([b"payload", b""])
    record = first + second
    assert unframed(record, [0, 23]) == [b"payload", b""] and unframed(record, []) == [] == framed([])
    for i in (0, 9, 14, 20):
        with pytest.raises(ValueError):
            unframed(record[:i] + bytes([record[i] ^ 1]) + record[i + 1 :], [0])


def test_checksums():
    table = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (0x82F63B78 if i & 1 else 0)
        table.append(i)

    def plain(data):
        crc = 0xFFFFFFFF
        for b in data:
            crc = table[(crc ^ b) & 255] ^ (crc >> 8)
        return crc ^ 0xFFFFFFFF

    rng = random.Random(0)
    strings = [b"123456789", b"", *(rng.randbytes(rng.choice([1, 8, 63, 64, 65, 128, 1000, 5000])) for _ in range(60))]
    assert crc32c_of(strings).tolist() == [plain(x) for x in strings] and plain(b"123456789") == 0xE3069283


RULES = [UrlRule("allow", "com", "/"), UrlRule("block", "example.com", "/en/"), UrlRule("allow", "www.example.com", "/en/"), UrlRule("block", "net", "/es/")]
URLS = {
    "https://WWW.Example.com/en/x?q#f": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
    "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "http://com": ("com", "", None, "allow"),
    "http://x.net/es/1#/fr/": ("x.net", "/es/1", "net/es/", "block"),
    "http://x.net/ES/": ("x.net", "/ES/", None, "allow"),
    "http://x.net?u=http://y.net/es/": ("x.net", "", None, "allow"),
    "nothing": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "://ÉX.com/é/": ("Éx.com", "/é/", "com/", "allow"),
}


@pytest.mark.parametrize("limit", [1 << 20, 1])
def test_url_rules(spark, limit):
    df = spark.createDataFrame([(i, u, "old", 1, 2, 3, 4, 5) for i, u in enumerate(URLS)] * 2, "page_id int, url string, host string, rule int, _keys int, _rest int, _sides int, _best int")
    got = url_verdicts(df, RULES, max_keys=limit).collect()
    assert len(got) == 2 * len(URLS) and all((r._keys, r._rest, r._sides, r._best) == (2, 3, 4, 5) for r in got)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == URLS[r.url]
    assert url_verdicts(df.filter("false"), RULES).count() == 0


def test_url_cascade_with_many_rules(spark):
    rules = [UrlRule("block" if i % 3 else "allow", f"h{i}.org", "/") for i in range(2000)]
    df = spark.createDataFrame([(f"http://h{i}.org/p",) for i in range(6000)], "url string")
    got = {r.url: (r.rule, r.verdict) for r in url_verdicts(df, rules).collect()}
    assert got == {f"http://h{i}.org/p": (f"h{i}.org/", "block" if i % 3 else "allow") if i < 2000 else (None, "allow") for i in range(6000)}


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header><a href=x>Site</a></header>
<nav><ul><li><a href=1>Menu</a></ul></nav><div class="ad">Buy now, a long advert that goes on and on for the reader of this page</div>
<article><h1>Head &amp; line</h1><p>First   para with <b>bold</b>&nbsp;text<br>and more.<p>Short.</p><div class="share">Share this</div><p></p><form>Name</form></article>
<aside>Side</aside><div id="comments"><p>A reader's long comment about the article that should not be taken for the article</p></div><footer>&copy; x</footer></body></html>"""


def test_main_text(spark):
    want = "Head & line\nFirst para with bold text and more.\nShort."
    assert main_text(PAGE) == want
    pages = [PAGE, None, "", "plain words", "<p>a<p>b", "<nav>m<article>x &lt; y</article>", "<body><div class=menu>m</div>", "<script>x", "<p>" + "w " * 50000 + "</p>"]
    df = spark.createDataFrame([(i, p, 1) for i, p in enumerate(pages)], "page_id int, html string, text int")
    got = [r.text for r in with_main_text(df).orderBy("page_id").collect()]
    assert got == [want, "", "", "plain words", "a\nb", "x < y", "", "", ("w " * 50000).strip()]
    assert with_main_text(df.filter("false")).count() == 0


def test_main_text_of_sibling_articles():
    long = "A paragraph of one article that is long enough to count as content."
    html = f"<body><nav><a href=1>m</a></nav><article><h2>One</h2><p>{long} {long}</p></article><div class=ad>Buy</div><article><h2>Two</h2><p>{long}</p></article></body>"
    assert main_text(html) == f"One\n{long} {long}\nTwo\n{long}"


@pytest.mark.parametrize("body", ["<body><article><p>The text.</p></article></body>", "<article><p>The text.</p></article>", "<p>The text.", "The text."])
@pytest.mark.parametrize("head", ["<head><title>T</title>", "<head><meta charset=utf-8><script>x</script>\n", "<head><title>T</title><noscript><img src=x>no</noscript>", "<head></head>", ""])
def test_main_text_behind_an_open_head(head, body):
    assert main_text(f"<!DOCTYPE html><html>{head}{body}</html>") == "The text."


def test_main_text_without_article():
    html = "<body><div class='top'><a href=1>one</a> <a href=2>two</a></div><div><h2>Title of it</h2><p>A paragraph of the main text that is long enough to count.</p><p>And another one, which is also rather long, for good measure.</p></div><div><a href=3>x</a></div></body>"
    assert main_text(html) == "Title of it\nA paragraph of the main text that is long enough to count.\nAnd another one, which is also rather long, for good measure."


def _slow_content(lines):
    """The smoothed ratios' threshold in plain Python."""
    ratio = [0 if x.skipped else max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines]
    smooth = []
    for i in range(len(ratio)):
        near = [(math.exp(-((i - j) ** 2) / 2), ratio[j]) for j in range(max(0, i - 2), min(len(ratio), i + 3))]
        smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    mean = sum(smooth) / len(smooth)
    std = math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
    return [x >= min(std, mean) and not line.skipped and any(ratio) or len(lines) == 1 and not line.skipped and any(ratio) for x, line in zip(smooth, lines)]


def test_content_lines_brute_force():
    rng = random.Random(12)
    for _ in range(300):
        lines = [html_text.Line("x" * rng.choice([1, 5, 40, 300]), rng.randint(0, 4), rng.choice([0, 0, 5, 300]), -1, rng.random() < 0.2) for _ in range(rng.randint(1, 15))]
        assert html_text.content_lines(lines).tolist() == _slow_content(lines)


LONG = "A paragraph of the text that is long enough to count as content, and then some more of it."
LINKS = "".join(f"<li><a href={i}>Another story of the day {i}</a></li>" for i in range(6))
UNMARKED = {
    "links in an article": (f"<article><h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p><ul>{LINKS}</ul></article>", f"Title\n{LONG}\nShort.\n{LONG}"),
    "a link between paragraphs": (f"<article><p>{LONG}</p><p><a href=1>See this</a></p><p>{LONG}</p></article>", f"{LONG}\nSee this\n{LONG}"),
    "boxes around a text": (f"<div><ul>{LINKS}</ul></div><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div><p>ab</p><p>cd</p><p>ef</p><p>gh</p></div>", "\n".join([LONG] * 3)),
}


@pytest.mark.parametrize("name", UNMARKED)
def test_the_ratio_decides_where_nothing_is_marked(name, monkeypatch):
    html, want = UNMARKED[name]
    assert main_text(f"<body>{html}</body>") == want
    if name != "a link between paragraphs":
        monkeypatch.setattr(html_text, "content_lines", lambda lines: np.array([not x.skipped for x in lines]))
        assert main_text(f"<body>{html}</body>") != want
    else:
        monkeypatch.setattr(html_text, "smoothed", lambda ratios: ratios)
        assert main_text(f"<body>{html}</body>") != want


def test_readers_articles_are_not_the_article():
    html = f"<main><article><p>{LONG}</p></article><section id=comments><article class=comment><p>{LONG} I say.</p></article></section></main><article class='teaser related'><p>{LONG} More.</p></article>"
    assert main_text(html) == LONG


def test_deep_pages_take_linear_time():
    for tag in ("div", "b", "li", "ul", "p"):
        start = time.perf_counter()
        text = main_text(f"<body>{f'<{tag}>' * 20000}<p>{LONG}</p>{f'<{tag}>' * 20000}{f'</{tag}>' * 40000}</body>")
        assert LONG in text and time.perf_counter() - start < 10


def test_toxicity_held_out(spark, odd_docs):
    rng = random.Random(4)
    clean = [" ".join(rng.choice("lorem ipsum dolor sit amet consectetur elit sed".split()) for _ in range(rng.randint(3, 60))) for _ in range(600)]
    rows = [(i, t + (rng.choice([" you IDIOT", " such scum", " moronic"]) if i % 4 == 0 else ""), int(i % 4 == 0)) for i, t in enumerate(clean)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(5, None), (None, 1)], "doc_id long, label int")
    model = fit_toxicity(docs, labels, ToxicityConfig(max_rows=300))
    got = {r.doc_id: r for r in toxicity_scores(docs, model).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if not i % 3]
    assert sum(p == y for p, y in held) / len(held) > 0.98
    odd = toxicity_scores(odd_docs.withColumn("score", F.lit("x")), model).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd) and len(odd) == odd_docs.count()


def test_toxicity_brute_force(spark):
    """Features by their log-count ratios, and scores by the fitted weights, in plain Python."""
    rng, config = random.Random(9), ToxicityConfig(sizes=(2, 3), bits=12, max_features=60, min_docs=2)
    texts = [" ".join(rng.choice("lorem IPSUM dolor Été 日本 bad vile sed".split()) for _ in range(rng.randint(0, 9))) for _ in range(80)]
    labels = [int("bad" in t or "vile" in t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = fit_toxicity(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, label int"), config)

    def buckets(text):
        points = [ord(c) + 32 if "A" <= c <= "Z" else ord(c) for c in text]
        found = set()
        for n in config.sizes:
            for i in range(len(points) - n + 1):
                h = sum((points[i + j] + 1) * pow(toxicity._STEP, j, 1 << 64) for j in range(n)) * (0xBF58476D1CE4E5B9 ^ (n << 1)) % (1 << 64)
                found.add(h >> (64 - config.bits))
        return found

    of = [buckets(t) for t in texts]
    size = [labels.count(0), labels.count(1)]
    strength = {}
    for b in set().union(*of):
        n = [sum(b in x for x, label in zip(of, labels) if label == y) for y in (0, 1)]
        if sum(n) >= config.min_docs:
            ratio = math.log(((n[1] + 1) / (size[1] + 2)) / ((n[0] + 1) / (size[0] + 2)))
            strength[b] = round(ratio**2 * sum(n), 9)
    best = sorted(strength, key=lambda b: (-strength[b], b))
    least = strength[best[config.max_features - 1]]
    assert {b for b in best if strength[b] > least} <= set(model.buckets.tolist()) <= {b for b in best if strength[b] >= least} and len(model.buckets) == config.max_features
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    for r in toxicity_scores(docs, model).collect():
        z = model.intercept + sum(weight.get(b, 0) for b in of[r.doc_id])
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-5


def test_toxicity_without_labels(spark, odd_docs, no_docs):
    model = fit_toxicity(odd_docs, spark.createDataFrame([], "doc_id long, label int"))
    assert {r.predicted for r in toxicity_scores(odd_docs, model).collect()} == {0}
    assert toxicity_scores(no_docs, model).count() == 0


def test_urls_with_very_many_labels(spark):
    rules = [UrlRule("block", "b.c", "/"), UrlRule("allow", "a.b.c", "/x"), UrlRule("block", "d", "/")]
    hosts = ["l." * 20_000 + "b.c", "l." * 20_000 + "a.b.c", "l." * 20_000 + "d", "c", "b.c", "xb.c", "." * 50, "l." * 5000]
    start = time.perf_counter()
    got = [(r.rule, r.verdict) for r in url_verdicts(spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(hosts)], "i long, url string"), rules).orderBy("i").collect()]
    assert got == [("b.c/", "block"), ("a.b.c/x", "allow"), ("d/", "block"), (None, "allow"), ("b.c/", "block"), (None, "allow"), (None, "allow"), (None, "allow")]
    assert time.perf_counter() - start < 60
