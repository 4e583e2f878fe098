"""Rows that every operator has to bear, and plain versions of what the operators compute."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

SF = "/root/testdata/sf0.001"
EXTRA = "id long, key string, `check` int, spans string, value double, component string, signature string, label int, n long, shard int, "
EXTRA += "token_ids string, rank string, score string, place string, part string, row string, before string, weight string, n_words string, period string"
CLASH = (1, "k", 2, "s", 0.5, "c", "x", 3, 4, 5, *"abcdefghij")


def words(n, seed=0, stock=5000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(stock)}" for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Null and empty texts and ids, repeated rows, a very long text, and columns named as the operators name theirs."""
    long = words(60_000, 9)
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (None, "a text without an id"), (None, None), (4, "one"), (5, words(30, 1)), (5, words(30, 1)),
        (6, words(30, 1)), (7, long), (8, "é ü 日本語 😀 <|endoftext|>"), (9, "mail me@example.com or +1 (555) 123-4567"), (10, words(30, 2)),
    ]
    return spark.createDataFrame([(i, t, *CLASH) for i, t in rows], f"doc_id long, text string, {EXTRA}")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], f"doc_id long, text string, {EXTRA}")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def document_rows(documents):
    return [tuple(r) for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
