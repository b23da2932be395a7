import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


@pytest.fixture
def documents(spark):
    """A table of (doc_id, text[, source]) rows."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def odd_texts():
    """Null, empty and blank texts, few words, other scripts, a very long text and repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One TWO"), (6, "one two"), (None, "no id here"), (8, "été ü 日本語 🎉 x"),
        (9, long), (9, long), (10, long + " more"), (None, None), (11, "it's <|endoftext|> a\x1cb"),
    ]


