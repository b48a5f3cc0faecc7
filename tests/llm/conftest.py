import pytest
from pyspark.sql import functions as F

BASE = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "mail bob.smith@mail.example.com or call +1 (234) 555-6789 now, host 10.0.0.256 and 10.1.2.3"),
    (7, "É ß Ελλάς 中文字 😀 naïve ’quoted’ 's don't we'll 12,345.67"),
    (8, "word " * 3000),
    (None, "a row without an id"),
    (9, "x"),
    (10, 'token = "0641917ea4e9feb9cda83477b57ac2654884f485" and 4111 1111 1111 1111'),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank, long, repeated and id-less rows, with further columns of clashing names."""
    df = spark.createDataFrame(BASE, "doc_id long, text string")
    clash = ["id", "fp", "row", "part", "size", "train", "query", "range", "end", "token", "batch", "spans", "slot", "which", "start", "label"]
    return df.withColumns({c: F.lit(f"clash {c}") for c in clash}).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
