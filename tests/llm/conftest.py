import os

import pytest

DATA = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest documents table, as DataFrame and as rows."""
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    return df, sorted(df.collect(), key=lambda r: r.doc_id)


#: Names that operators use inside, as a user's columns.
CLASHES = ["chunk", "key", "rank", "bucket", "comp", "rep", "kept", "length", "base", "spans", "file", "component_id"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and columns whose names operators use inside."""
    from pyspark.sql import functions as F

    long = " ".join(f"wörd{k % 5000}" for k in range(60_000)) + "."
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", None, 4), (4, "same text here twice", "en", "s", 20), (4, "same text here twice", "en", "s", 20),
        (5, "same text here twice", None, "s", 20), (6, long, "de", "s", len(long)), (7, long + " end", "de", "s", len(long) + 4), (None, "no id at all", "en", "s", 12), (8, "x", "fr", "s", 1),
        (9, "12345 !!! \x00   \U0001f600", "fr", "s", 18), (10, "<|endoftext|> and <|startoftext|>'s  \n'll", "en", "s", 40),
    ]
    return spark.createDataFrame(rows, DOC_SCHEMA).select("*", *[F.lit(7).alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
