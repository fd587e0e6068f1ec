from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, size string, node string, score string, key string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, columns whose names operators use themselves."""
    long_ = " ".join(f"w{i % 977}" for i in range(30_000))
    texts = [(1, "a b c d e f"), (2, "a  b\tc\nd e f"), (3, None), (4, ""), (5, " "), (6, long_), (7, long_ + " x"), (7, "same id. other text"),
             (8, "a b c d e f"), (8, "a b c d e f"), (None, "a b c d e f"), (None, None), (9, "x" * 5000), (10, "Zoë ▁ ﬁ 日本 "), (11, "one"), (12, "one two")]
    return spark.createDataFrame([(i, t, None, None if n % 5 == 0 else f"s{n % 3}", None, "r", "s", "n", None, "k") for n, (i, t) in enumerate(texts)], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def near_docs(spark):
    """Groups of near copies around base texts, with a group that is large against the rest and a passage that many share."""
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 80, 160]))]
        if g % 3 == 0:
            base = base[:10] + passage + base[10:]
        for _ in range(120 if g == 0 else rng.choice([1, 2, 5])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 + 1, " ".join(words)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string")
