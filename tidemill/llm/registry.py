"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from tidemill.llm import ctw, langid, minhash, mixing, neighbours, packing, passages, toxicity, transport, url_filter

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_transport": transport.query,
    "op3_langid": langid.query,
    "op4_passages": passages.query,
    "op5_packing": packing.query,
    "op6_ctw": ctw.query,
    "op7_mixing": mixing.query,
    "op8_neighbours": neighbours.query,
    "op9_toxicity": toxicity.query,
    "op10_minhash": minhash.query,
}
ORACLE = {
    "op1_url_filter": url_filter.oracle(),
    "op7_mixing": mixing.oracle(),
}
