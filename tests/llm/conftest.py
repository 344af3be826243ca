from __future__ import annotations

import pytest
from pyspark.sql import functions as F


def documents(spark, rows, extra=True):
    """(doc_id, text, lang, source, n_chars) of ``rows``; ``extra`` adds columns whose names operators use inside."""
    made = spark.createDataFrame(
        [(i, t, *(rest or ("en",))) for i, t, *rest in rows], "doc_id long, text string, lang string"
    ).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    if extra:
        for name in ("row", "key", "id", "value", "h", "items", "ranges", "score", "place", "gone", "comp", "n"):
            made = made.withColumn(name, F.lit(name))
    return made


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows, extra=True: documents(spark, rows, extra)


@pytest.fixture(scope="session")
def prose():
    """Reproducible invented sentences."""
    import random

    def text(seed: int, words: int, stock: int = 2000) -> str:
        rng = random.Random(seed)
        said = [f"w{rng.randrange(stock)}x" for _ in range(words)]
        return "\n".join(" ".join(said[k : k + 12]) for k in range(0, words, 12))

    return text
