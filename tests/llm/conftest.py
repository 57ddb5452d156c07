import random

import pandas as pd
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA):
    """Documents from (doc_id, text) or full rows, over several partitions."""
    full = [r if len(r) > 2 else (r[0], r[1], "en", f"src{(r[0] or 0) % 3}", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, schema).repartition(3)


@pytest.fixture
def odd_rows():
    """Nulls, empty and blank texts, a very long one, repeated rows, a repeated id."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "Delta!", "épsilon"]) for _ in range(30_000))
    return [(1, "some words of a short text"), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, "some words of a short text"),
            (7, "one"), (7, "one"), (7, "two other words"), (None, "a text without any number"), (None, None)]


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def documents(sf):
    return pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id").reset_index(drop=True)
