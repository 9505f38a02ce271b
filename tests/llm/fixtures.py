import random

import pytest
from pyspark.sql import Row

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score double, k long, digest string, row long"


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use themselves."""
    r = random.Random(8)
    long = words(r, 30_000)
    base = words(r, 60)
    texts = ["", None, " ", "...", "one two", "one  two", "one\ttwo ", base, base, base + " tail", base.replace("a", "a", 1), long, long + " x", words(r, 12), "ünï çödé 12345", "mail a.b@c.de now", "Mail A.B@C.DE now", "x" * 20_000]
    rows = [Row(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, len(t or ""), "z", 0.5, 1, "d", i) for i, t in enumerate(texts)]
    rows += [rows[7], rows[0], Row(7, "another text under a known id", None, None, None, None, None, None, None, None), Row(None, base, None, None, None, None, None, None, None, None), Row(None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return spark.createDataFrame(messy_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
