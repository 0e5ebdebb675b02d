"""Columns that bear the operators' own names change no result; results have one defined value for odd rows."""

import pytest
from pyspark.sql import functions as F

from tidemill.llm import ctw, langid, minhash, mixing, neighbours, packing, passages, toxicity, transport, url_filter

NAMES = ["id", "n", "row", "bucket", "position", "epoch", "n_tokens", "toxic", "h", "i", "j", "a", "b", "piece", "v", "gram", "__tm_x", "__tm_id", "__tm_u", "__tm_text", "key", "stream", "root", "keep", "language", "units", "pid", "start", "end", "repeats", "code_bits", "bin_id", "salt", "url_clean"]


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(3, 0), (4, 1), (5, 0), (6, 1)], "doc_id long, toxic int")


OPERATORS = {
    "transport": lambda d, _: transport.demultiplexed(transport.multiplexed(d)),
    "langid": lambda d, _: langid.identify(d),
    "passages": lambda d, _: passages.find(d),
    "without_repeats": lambda d, _: passages.without_repeats(d).select("doc_id", "text"),
    "packing": lambda d, _: packing.pack(d),
    "ctw": lambda d, _: ctw.score(d).withColumn("code_bits", F.round("code_bits", 3)).withColumn("bits_per_byte", F.round("bits_per_byte", 5)),
    "mixing": lambda d, _: mixing.mix(d).select("doc_id", "n_tokens", "epoch", "position"),
    "toxicity": lambda d, y: toxicity.classify(d, y),
    "without_toxic": lambda d, y: toxicity.without_toxic(d, y).select("doc_id", "text"),
    "minhash": lambda d, _: minhash.groups(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_results_are_the_same_values(odd, labels, name):
    f = OPERATORS[name]
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    clash = plain.withColumns({c: F.lit("clash") for c in NAMES})
    rows = [sorted(map(str, f(d, labels).collect())) for d in (plain, clash)]
    assert rows[0] == rows[1] and len(rows[0]) == f(plain, labels).count()


def test_neighbours_and_urls(spark):
    x = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i)]) for i in range(30)], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([(1, "http://a.example/x"), (1, "http://a.example/x"), (None, None), (2, "")], "page_id long, url string")
    for f, d in ((neighbours.nearest, x), (url_filter.filter_urls, pages)):
        rows = [sorted(map(str, f(t).collect())) for t in (d, d.withColumns({c: F.lit("clash") for c in NAMES}))]
        assert rows[0] == rows[1] and rows[0]
