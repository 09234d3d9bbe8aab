from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

EDGES = [None, "", " \t\n", "one", "two words", "same line\nsame line\n\nsame line", "é ü ß Ω", "x" * 5000, "word " * 300]


def words(rng: random.Random, n: int, pool: int = 400) -> str:
    return " ".join(f"w{rng.randrange(pool)}x{rng.randrange(3)}" for _ in range(n))


@pytest.fixture
def make(spark):
    """Documents from texts or (id, text) pairs, with columns whose names operators might use themselves."""

    def build(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        clash = ["id", "h", "fp", "u", "v", "n", "doc", "part", "bytes", "_text", "label", "host", "lot", "_spans", "x", "y"]
        return df.withColumns({c: F.lit("clash") for c in clash})

    return build


@pytest.fixture
def corpus():
    """Texts with exact and near copies, shared passages, and the edge cases."""
    rng = random.Random(5)
    base = [words(rng, rng.randrange(20, 260)) for _ in range(30)]
    passage = words(rng, 70)
    near = []
    for t in base[:8]:
        w = t.split()
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    shared = [f"{words(rng, 30)} {passage} {words(rng, 25)}" for _ in range(12)]
    return base + near + base[3:6] + shared + EDGES + EDGES
