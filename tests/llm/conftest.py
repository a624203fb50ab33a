from __future__ import annotations

import random

import pytest

CLASHING = ("chunk_id", "bucket", "fp", "task", "best", "text_sha256", "component_id", "gone_id", "gone_text", "twice_id", "__digest", "other_id", "other_text", "digest", "key", "class", "tree", "lang", "source", "n_chars")


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty and long texts, copies, near copies, shared passages, ties and repeated rows."""
    rng = random.Random(17)
    words = [f"w{k}é" if k % 9 == 0 else f"word{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(3, 90))] for _ in range(40)]
    rows = []
    for k in range(260):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            text[rng.randrange(len(text))] = rng.choice(words)
        joined = " ".join(text)
        rows.append((k, joined.replace(" ", "\n ", 1) if k % 11 == 0 else joined.upper() if k % 13 == 0 else joined))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "It's <|endoftext|> 'll we're  x\r\n  <|startoftext|>"), (904, "naïve ÅNG 日本語 😀 ½ ١٢     x"), (905, "ab " * 6000), (906, "z" * 3000), (907, "A b"), (908, "a B")]
    return rows + [(907, "A b"), (None, "nobody's text here at all"), (None, None)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The rows as a table with further columns whose names clash with those inside the operators."""
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING[:-1]) + ", n_chars long"
    return spark.createDataFrame([(i, t, *[None] * (len(CLASHING) - 1), len(t or "")) for i, t in corpus], schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def labels(spark, corpus):
    rows = [(i, 1, int("word7" in (t or ""))) for i, t in corpus if i is not None and i < 400]
    return spark.createDataFrame([*rows, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
