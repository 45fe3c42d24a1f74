import random

import pytest
from pyspark.sql import functions as F

WORDS = [a + b for a in ("ka", "lo", "mi", "ser", "tu", "van") for b in ("ra", "den", "po", "li", "sko", "num", "")]


def prose(seed, n, words=WORDS):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty and very long texts, repeated rows, and columns whose names operators use inside."""
    rows = [
        (1, prose(1, 120)),
        (2, None),
        (3, ""),
        (4, " \t\n "),
        (None, prose(5, 80)),
        (None, None),
        (6, prose(6, 90)),
        (6, prose(6, 90)),
        (7, "word"),
        (8, prose(8, 30_000)),
        (9, "é́ 日本 \U0001f600 <|endoftext|> \x00 " + prose(9, 60)),
        (10, "\n".join([prose(10, 12)] * 9)),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for name in ("row", "node", "rid", "key", "score", "part", "spans", "label", "words", "s", "m", "n_words", "kept"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
