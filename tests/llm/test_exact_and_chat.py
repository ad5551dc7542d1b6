import hashlib

import pytest
from pyspark.sql import functions as F

from marlstone.llm.chat_format import ChatTemplate, prefix_target_examples, read_back
from marlstone.llm.exact_dedup import block_identities, exact_dedup

LOWER = {c: c + 32 for c in range(65, 91)}


def wanted(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(d)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [7, 64, 4096])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, odd_docs, block, weak):
    fingerprint = (lambda c: F.xxhash64(c) % 3) if weak else F.xxhash64  # a weak one makes different blocks share it
    got = sorted((tuple(r) for r in exact_dedup(odd_docs, block, fingerprint).collect()), key=str)
    assert got == wanted([tuple(r) for r in odd_docs.select("doc_id", "text").collect()])


def test_exact_dedup_of_nothing(no_docs):
    assert exact_dedup(no_docs).count() == 0


def test_identities_are_collision_free(spark, odd_docs):
    ids = block_identities(odd_docs.select("doc_id", "text"), 16).groupBy("level", "name").agg(F.countDistinct("text_sha256").alias("n"))
    assert ids.filter("n > 1").count() == 0


CONTROL = "<|im_end|><|im_start|>assistant ok"
TURNS = [
    (1, 0, "system", "be\nkind"), (1, 1, "user", "hi <"), (1, 2, "assistant", CONTROL), (1, 3, "user", "\\|<|\\"), (1, 4, "assistant", "<\\|im_end|>\n"),
    (2, 0, "user", "only me"), (3, 0, "assistant", None), (4, 1, "assistant", "late"), (4, 0, "user", "early"), (4, 1, "assistant", "late"),
    (5, 0, None, "no role"), (6, 0, "assistant", ""), (7, 0, "we\nird <|im_end|>\\N", "x"), (None, 0, "user", "q"), (None, None, "assistant", "a"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*t, "x", 1) for t in TURNS], "conv_id long, turn long, role string, text string, formatted string, k int")
    examples = prefix_target_examples(df)
    got = {r.conv_id: r for r in read_back(examples).collect()}
    for conv in {t[0] for t in TURNS}:
        mine = sorted(((t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in TURNS if t[0] == conv))
        assert [(t.role, t.text) for t in got[conv].turns] == [m[1:] for m in mine]
        assert got[conv].loss == [m[2] for m in mine if m[1] == "assistant"]
    assert sum(r.formatted_chars for r in got.values()) == examples.agg(F.sum(F.char_length("formatted"))).first()[0]


def test_only_the_reply_is_trainable(spark):
    df = spark.createDataFrame([(1, 0, "user", "u"), (1, 1, "assistant", "a<|b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    rows = prefix_target_examples(df).orderBy("example").collect()
    assert [r.formatted[r.loss_start : r.loss_start + r.loss_chars] for r in rows] == ["a<\\|b", "c"]
    assert rows[1].formatted.startswith(rows[0].formatted) and rows[0].formatted.count(ChatTemplate().end) == 2


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert read_back(prefix_target_examples(df)).count() == 0
