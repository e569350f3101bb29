import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs_of(spark):
    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture()
def odd_docs(docs_of):
    """Nulls, empty, white space only, very long, repeated rows, a null id."""
    long_text = " ".join(f"word{k % 997}" for k in range(60_000))
    return docs_of([(1, None), (2, ""), (3, " \n\t "), (4, long_text), (5, "a b c d"), (5, "a b c d"), (None, "x y z"), (6, "é😀 日本 ok")])


@pytest.fixture()
def clashing(odd_docs):
    """Extra columns with the names operators use."""
    from pyspark.sql import functions as F

    names = ("score", "predicted", "fp", "_fp", "rank", "_rank", "component_id", "ids", "spans", "_spans", "stats", "_stats", "h", "bad_id", "text_hash")
    return odd_docs.select("*", *[F.lit("keep").alias(n) for n in names])
