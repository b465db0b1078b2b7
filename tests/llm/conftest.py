import random

import duckdb
import pytest

from conftest import SF

TABLES = "documents embeddings pages benchmark labels conversations".split()
AWKWARD = [
    None, "", " ", "\n", "one", "one two", "one two three four five six seven eight nine ten",
    "one two three four five six seven eight nine ten", "ONE two three four five six seven eight nine ten",
    "x" * 5000, "ab " * 4000, "é ñ 日本語 🙂 " * 20, "<|endoftext|> <|im_end|>", "a@b.co 1.2.3.4 +1 (555) 555-1234 4111 1111 1111 1111",
]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from texts, with more columns that clash with those of the operators."""
    def make(texts, first=0):
        rows = [(first + i, t, "en", "s", 0, "x", 1, 2.0) for i, t in enumerate(texts)]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long, key string, spans int, score double")
    return make


@pytest.fixture(scope="session")
def words():
    """Prose of a small vocabulary, from a seed."""
    def make(n, seed, vocabulary=400):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))
    return make


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con
