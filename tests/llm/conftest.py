import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, blank, very long and repeated texts and rows, and columns whose names clash."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeéñ") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    long = " ".join(rnd.choice(words) for _ in range(60_000))
    body = " ".join(rnd.choice(words) for _ in range(80))
    rows = [
        (1, body, "en", "a", 10), (2, body, "en", "a", 10), (2, body, "en", "a", 10), (3, None, "fr", None, None), (4, "", None, "a", 0),
        (None, body, None, None, None), (5, long, "de", "b", 5), (6, " \n\t ", "es", "b", 3), (7, "é", "fr", "b", 1), (8, "12 34 !?", "en", "b", 8),
        (9, body.replace(" ", "  ", 5), "en", "c", 1), (None, None, None, None, None), (10, "x" * 5000, "en", "c", 5000), (11, "\x00\x01 a\x1fb 🙂 <|endoftext|>", "en", "c", 9),
    ]
    rows = [(*r, 7, "clash", 0.5, True) for r in rows]
    return spark.createDataFrame(rows, DOCS + ", fp bigint, key string, score double, ambiguous boolean")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
