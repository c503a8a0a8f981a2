import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, bucket string, label string, node string, key string, level string, body string, marked_id long, marked_digest string, `a ``b` struct<`x y`:int>, copy_0_ string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeéö") for _ in range(rng.randrange(1, 9))) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def make_rows(seed: int = 1) -> list[tuple]:
    """Texts with shared passages, copies, repeated ids and rows, nulls, and one very long text."""
    rng = random.Random(seed)
    shared = [prose(rng, 70) for _ in range(4)]
    texts: list[tuple] = []
    for i in range(36):
        parts = [prose(rng, rng.randrange(0, 60)) for _ in range(3)]
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            cut = rng.randrange(0, 40)
            parts.insert(rng.randrange(len(parts)), s[cut : len(s) - rng.randrange(0, 100)])
        texts.append((i * 3, "\n".join(parts)))
    texts += [
        (200, texts[3][1]), (201, texts[3][1]), (7, None), (8, ""), (9, " \t\n "), (10, "one"), (11, "two words"),
        (None, texts[5][1]), (None, None), (12, texts[12][1]), (12, texts[13][1]), (500, "aaaa " * 400), (501, "aaaa " * 300),
        (502, "x" * 400), (503, "é" * 300), (504, "y" + "é" * 200)
    ]
    texts += [(600, prose(rng, 60_000) + shared[0]), (3, texts[1][1]), (3, texts[1][1])]
    return [(d, t, "en", "s", None if t is None else len(t), "c", "b", "l", "n", "k", "v", "x", 5, "m", (1,), "z") for d, t in texts]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
