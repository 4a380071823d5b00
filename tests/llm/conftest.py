"""Rows shared by the tests of the training-data operators: nulls, empty and long texts, ties, copies."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, _found string"


def made_texts():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        texts.append(" ".join(base))
        for _ in range(3):
            other = list(base)
            for _ in range(rng.randint(0, 3)):
                other[rng.randrange(len(other))] = rng.choice(words)
            texts.append(" ".join(other))
    texts += [texts[0].upper(), texts[0], texts[0]]
    texts += [None, "", " \n\t", "one two", "ONE  two", "é" * 10, " ".join(rng.choice(words) for _ in range(30_000)),
              "x" * 200_000, "a\n\n b  c\n"]
    return texts


@pytest.fixture(scope="session")
def doc_rows():
    return [(k, t, "en", None if k % 7 == 0 else f"s{k % 3}", None if t is None else len(t), 0.5, "clash")
            for k, t in enumerate(made_texts())]


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
