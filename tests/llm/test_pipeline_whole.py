"""The whole pipeline against plain Python on a small corpus; only the classifier's verdicts come from the operator."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from marlstone.llm import queries
from marlstone.llm.toxicity import ToxicityConfig, fit_toxicity, toxicity_scores

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
VOCABULARY = [a + b for a in "ba ke li mo nu sé 日 ZO wa tri".split() for b in "la REN mi do pu shi ne go".split()]


def _prose(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(VOCABULARY) for _ in range(n)]


def _corpus():
    """(doc_id, text) rows, benchmark texts and labels with copies, near copies, chains, passages and odd texts."""
    rng = random.Random(11)
    base = [_prose(rng, n) for n in (30, 60, 60, 90, 150, 240, 400, 12, 25)]
    items = [_prose(rng, n) for n in (10, 14, 40, 3)] + [[]]
    texts = [" ".join(w) for w in base]
    texts += [texts[1], texts[1].translate(UPPER), texts[2], texts[2] + " "]
    for words in base[2:7]:
        for changes in (1, 2, len(words) // 12, len(words) // 5):
            other = list(words)
            for at in rng.sample(range(len(words)), changes):
                other[at] = rng.choice(VOCABULARY)
            texts.append(" ".join(other))
    chain = list(base[6])
    for at in range(0, 200, 8):
        chain[at] = f"step{at}"
        texts.append(" ".join(chain))
    texts += [" ".join(base[i][:9] + item + base[i + 1][:8]) for i, item in enumerate(items)]
    texts += [" ".join(items[2][5:17]), "; ".join(items[0]).upper(), " ".join(items[0][:9]), ", ".join(items[1] + items[1])]
    texts += [None, "", "", "  ", "one", "ONE", "one two", "a b c d e", "x" * 3000, " ".join(_prose(rng, 9000))]
    texts += [" ".join(_prose(rng, rng.randint(3, 30)) + ["vilest", "idiotic", "scum"]) for _ in range(40)]
    texts += [" ".join(_prose(rng, rng.randint(3, 30))) for _ in range(60)]
    rng.shuffle(texts)
    rows = [(3 * i - 20, t) for i, t in enumerate(texts)]
    labels = [(i, int("scum" in (t or ""))) for i, t in rows if i % 2]
    return rows, [" ".join(w) for w in items], labels


def _kept_of_copies(rows):
    last = {}
    for i, t in rows:
        key = (t or "").translate(UPPER)
        last[key] = max(last.get(key, i), i)
    return [(i, t) for i, t in rows if last[(t or "").translate(UPPER)] == i]


def _kept_of_near_copies(rows):
    sets = {}
    for i, t in rows:
        words = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(UPPER))
        if words:
            sets[i] = {tuple(words[a : a + 5]) for a in range(max(len(words) - 4, 1))}
    least = {i: i for i, _ in rows}
    links = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    moved = True
    while moved:
        moved = False
        for i, j in links:
            if least[i] != least[j]:
                least[i] = least[j] = min(least[i], least[j])
                moved = True
    return [(i, t) for i, t in rows if least[i] == i], len(links)


def _without_benchmark(text, items):
    """``text`` without the runs of its words that lie in an item's window of ten words."""
    spans = lambda t: [m.span() for m in re.finditer("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)]
    low = text.translate(UPPER)
    at = spans(low)
    words, hit = [low[a:b] for a, b in at], [False] * len(at)
    for item in items:
        theirs = [item.translate(UPPER)[a:b] for a, b in spans(item.translate(UPPER))]
        size = min(len(theirs), 10)
        for a in range(len(theirs) - size + 1 if theirs else 0):
            for k in range(len(words) - size + 1):
                if words[k : k + size] == theirs[a : a + size]:
                    hit[k : k + size] = [True] * size
    out, end, k = [], 0, 0
    while k < len(at):
        if hit[k]:
            first = k
            while k + 1 < len(at) and hit[k + 1]:
                k += 1
            out.append(text[end : at[first][0]])
            end = at[k][1]
        k += 1
    return "".join(out) + text[end:]


def test_run_matches_plain_python(spark, tmp_path):
    rows, items, labels = _corpus()
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    model = fit_toxicity(docs, queries.training_labels(spark, str(tmp_path)), ToxicityConfig())
    toxic = {r.doc_id for r in toxicity_scores(docs, model).filter("predicted = 1").collect()}
    # how well it learns is tested elsewhere; here some documents have to go and most to stay
    assert 10 < len(toxic) < len(rows) / 3

    left = _kept_of_copies([(i, t) for i, t in rows if i not in toxic])
    left, n_links = _kept_of_near_copies(left)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want, n_cut = {}, 0
    for i, t in left:
        text = _without_benchmark(t or "", items)
        n_cut += text != (t or "")
        ids = coding.encode_ordinary(text)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert n_links > 20 and n_cut > 5

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want
