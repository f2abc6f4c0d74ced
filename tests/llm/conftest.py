import random

import pytest

AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a"), (2, "the  quick brown fox\tjumps over the lazy dog", "en", None), (2, "the  quick brown fox\tjumps over the lazy dog", "en", None),
    (3, None, None, "a"), (None, "an orphan of no id at all", None, None), (4, "", "en", "b"), (5, " \t\n", "fr", "b"), (6, "word", "en", "b"), (7, "THE QUICK brown fox jumps over the lazy dog", "en", "a"),
    (8, "été à la plage, où l'on mange 日本語 😀 " * 40, "fr", "c"), (9, "x" * 60_000, None, "c"), (10, "mail bob@example.com or +1 (555) 010-9999, ip 10.0.0.1, card 4532 0151 1283 0366", "en", "a"), (11, "1234 5678", None, "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Extra columns whose names the operators use themselves.
CLASH = ["row", "size", "n", "key", "fp", "name", "score", "kept", "norm", "recipe", "t1", "place", "media", "payload", "best", "component", "target", "held_out", "__id", "slice", "pass"]


@pytest.fixture(scope="session")
def awkward(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(AWKWARD, SCHEMA).withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def prose():
    """Texts with copies, near copies, shared passages and runs, made from a seed."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    out = []
    for i in range(120):
        t = [rng.choice(words) for _ in range(rng.randrange(1, 200))]
        if i % 5 == 0 and out:
            t = out[rng.randrange(len(out))].split(" ")
            if i % 10 == 0:
                t[rng.randrange(len(t))] = "changed"
        text = " ".join(t)
        out.append(text + (" " + passage[rng.randrange(50) :] if i % 4 == 0 else "") + ("ab" * rng.randrange(200) if i % 9 == 0 else ""))
    return out
