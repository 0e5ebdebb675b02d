import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes documents of texts; ids, languages and sources may be given."""

    def make(texts, ids=None, langs=None, sources=None):
        n = len(texts)
        rows = zip(ids or range(n), texts, langs or ["en"] * n, sources or ["s0"] * n, [None if t is None else len(t) for t in texts], strict=True)
        return spark.createDataFrame(list(rows), DOCS)

    return make


@pytest.fixture
def odd(docs, spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30000))
    texts = [None, "", " \n\t", "a", long, "same words here", "same words here", "héllo wörld 日本語 😀 end", "x" * 5000, None]
    df = docs(texts, ids=[0, 1, 2, 3, 4, 5, 5, 6, None, None], langs=["en", None, "fr", "en", None, "en", "en", "de", "fr", None], sources=["a", None, "b", "a", "a", "b", "b", None, "a", None])
    return df.withColumns({c: F.lit(7) for c in ("id", "n", "row", "bucket", "position", "epoch", "n_tokens", "toxic", "h", "i", "piece", "v", "gram", "__tm_x", "key", "stream", "root", "keep", "language")})
