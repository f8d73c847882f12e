from __future__ import annotations

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()),
    StructField("n_chars", LongType()),
    # Names that the operators use for their own results.
    StructField("score", StringType()), StructField("rank", StringType()), StructField("size", StringType()), StructField("kept", StringType()),
])

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix strong potions under pale moonlight near old stone bridges".split()


def prose(seed: int, words: int) -> str:
    import random

    chooser = random.Random(seed)
    return " ".join(chooser.choice(WORDS) + str(chooser.randint(0, 40)) for _ in range(words))


@pytest.fixture(scope="session")
def make_documents(spark):
    def make(texts: dict[int | None, str | None] | list, lang: str | None = "en"):
        pairs = list(texts.items()) if isinstance(texts, dict) else texts
        rows = [(doc_id, text, lang, "s", None, "x", "y", "z", None) for doc_id, text in pairs]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empties, blanks, short, repeated and very long texts, ties and repeated rows."""
    long = prose(1, 4000)
    return [
        (5, None), (3, ""), (9, "  \n\t "), (1, "a"), (2, "two words"), (7, prose(2, 60)), (8, prose(2, 60)), (8, prose(2, 60)), (None, prose(2, 60)),
        (11, long), (12, long + " end"), (13, "é" * 300), (14, "\u0000\u001f   日本語 text"), (15, "%%% $$$ 123"), (16, "x " * 900),
    ]
