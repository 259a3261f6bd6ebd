import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASH = ("n", "h", "at", "idx", "first", "node", "label", "quality", "toxic", "key", "part", "depth", "cell", "score", "kept", "items", "pos", "rest", "sig", "own", "maybe", "hh", "id", "__h", "__idx", "__items", "__id", "__hh")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: documents(spark, rows)


@pytest.fixture(scope="session")
def clash():
    return lambda df: df.withColumns({c: F.lit("x") for c in CLASH})


WORDS = [a + b for a in ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha") for b in ("at", "es", "ing", "ou", "ly", "ble", "sh", "ti")]


def prose(rng, n):
    out = []
    while len(out) < n:
        s = rng.choices(WORDS, k=rng.randint(4, 12))
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
    return " ".join(out)


@pytest.fixture(scope="session")
def corpus():
    """Prose with exact and near copies, shared passages, repeated lines, empty and odd texts."""
    rng = random.Random(5)
    rows = [prose(rng, rng.randint(1, 150)) for _ in range(60)]
    passage = prose(rng, 60)
    rows += [prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 30) for _ in range(5)]
    base = prose(rng, 200).split()
    for k in range(12):
        own = list(base)
        for _ in range(k // 3):
            own[rng.randrange(len(own))] = rng.choice(WORDS)
        rows.append(" ".join(own))
    lines = [prose(rng, 8) for _ in range(60)]
    rows += ["\n".join(lines[a : a + 30]) for a in (0, 3, 9, 16)]
    rows += ["", " \n\t", "a", "one two three", "one two three", "a b c d e", "A B C d e", "x " * 50, "é ñ " * 20, "same line\nsame line\nsame line\nsame line"]
    rows += rows[3:6]
    return list(enumerate(rows)) + [(900, None), (None, rows[0]), (None, None)]
