import random

import pytest

WORDS = ["alpha", "Beta", "gamma", "Été", "straße", "delta", "naïve", "x", "42", "foo-bar", "don't", "日本", "🙂", "Über"]


def prose(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", ". ", "\n", "  ", ", "]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empties, ties, repeats, copies, near copies, a long text and columns with clashing names."""
    rng = random.Random(7)
    base = [prose(rng, n) for n in (5, 40, 80, 120, 200, 400)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(10, base[3]), (11, base[3].replace("alpha", "ALPHA")), (12, base[4] + " tail words here"), (13, base[5][:900] + " cut " + base[5][960:])]
    rows += [(20, None), (21, ""), (22, ""), (23, "   "), (24, "one"), (25, "one two"), (26, "ONE TWO"), (27, "a" * 5000), (28, "a" * 200)]
    rows += [(30, base[2]), (30, base[2]), (31, base[1] + base[0]), (None, base[4]), (None, None)]
    rows += [(40, prose(rng, 6000))]
    copies = [(100 + i, base[1]) for i in range(30)]
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 1.0, "n", "x") for i, t in rows + copies], "doc_id long, text string, lang string, source string, n_chars long, name double, h string, spans string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")
