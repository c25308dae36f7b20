import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None, sources=None):
        ids = list(range(len(texts))) if ids is None else ids
        sources = ["src0"] * len(texts) if sources is None else sources
        rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def edge_docs(spark, make_docs):
    """Nulls, empty and very long texts, repeated rows, a column whose name clashes with operators' own."""
    texts = [None, "", "one", "the same text twice over here", "the same text twice over here", "x " * 60_000, "\x00\x01 \t\n", "naïve Ünïcode 世界 text", "!!! $$$ ###"]
    docs = make_docs(texts, [0, 1, 2, 3, 3, 5, 6, None, 8], ["a", None, "a", "b", "b", "c", "c", "c", None])
    from pyspark.sql import functions as F

    return docs.withColumn("fp", F.lit("clash")).withColumn("score", F.lit(7)).withColumn("name", F.lit(None).cast("string")).withColumn("spans", F.lit(1)).withColumn("h", F.lit(2))


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs(["x"]).limit(0)
