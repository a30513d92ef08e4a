import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows, ties and columns of clashing names."""
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    say = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 30)) for _ in range(n))
    base = say(60)
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, base.replace("alpha", "omega", 1), "de", "b"), (3, base.replace("alpha", "omega", 1), "de", "b"), (4, None, None, None), (5, "", "en", "a"), (6, "   \n\t ", "fr", "b"), (7, "x", "en", None), (None, say(20), "de", "a"), (None, None, None, None), (8, say(3000), "en", "c"), (9, "é" * 400 + "z" * 3000, "fr", "c"), (10, base + " " + say(20), "en", "a"), (11, "word " * 500, "en", "a"), (12, "1.2.3.4 +1 (555) 123-4567 a@b.co", None, "b")]
    rows = [(i, t, lang, s, None if t is None else len(t), 7, "x", "y", 1) for i, t, lang, s in rows]
    return spark.createDataFrame(rows, DOCS + ", node long, skey string, g string, bucket int")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


def invented(rng, n, stems):
    return " ".join(rng.choice(stems) + rng.choice(stems) for _ in range(n))
