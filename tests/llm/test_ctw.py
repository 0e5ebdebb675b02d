import math

import numpy as np
import pyarrow as pa

from tidemill.llm import ctw as C
from tidemill.llm.kernels import flat


def brute(texts, depth):
    """Code lengths of the texts by context trees in dictionaries, straight from the definition."""
    count = {}
    for t in texts:
        for i, x in enumerate(t):
            ctx = bytes(t[i - k] if i - k >= 0 else 0 for k in range(1, depth + 1))  # nearest first
            for bit in range(8):
                node = (bit, x >> (8 - bit))
                for d in range(depth + 1):
                    count.setdefault((node, ctx[:d]), [0, 0])[x >> (7 - bit) & 1] += 1
    below = {}
    for node, ctx in count:
        if ctx:
            below.setdefault((node, ctx[:-1]), set()).add(ctx)

    def pe(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def pw(node, ctx, gone, bit):
        """log P_w; gone: the context of an occurrence of `bit` that is taken out, or None."""
        n = list(count[node, ctx])
        if gone is not None and gone[: len(ctx)] == ctx:
            n[bit] -= 1
        else:
            gone = None
        if gone is None and (node, ctx) in whole:
            return whole[node, ctx]
        e = pe(*n)
        out = e if len(ctx) == depth else np.logaddexp(math.log(0.5) + e, math.log(0.5) + sum(pw(node, c, gone, bit) for c in below[node, ctx]))
        if gone is None:
            whole[node, ctx] = out
        return out

    whole = {}
    out = []
    for t in texts:
        bits = 0.0
        for i, x in enumerate(t):
            ctx = bytes(t[i - k] if i - k >= 0 else 0 for k in range(1, depth + 1))
            for b in range(8):
                node, bit = (b, x >> (8 - b)), x >> (7 - b) & 1
                bits -= (pw(node, b"", None, bit) - pw(node, b"", ctx, bit)) / math.log(2)
        out.append(bits)
    return out


TEXTS = ["the cat sat on the mat. the cat", "le chat déjà", "the mat", "", "aaaaaaaaaaaaaaaaaaaa", "zq"]


def test_same_as_brute_force(docs):
    want = brute([t.encode() for t in TEXTS], C.DEPTH)
    got = {r.doc_id: r for r in C.score(docs(TEXTS), buckets=3).collect()}
    for i, w in enumerate(want):
        assert abs(got[i].code_bits - w) < 1e-3 * max(1, w)
        assert got[i].n_bytes == len(TEXTS[i].encode())
    assert got[3].bits_per_byte is None and got[4].bits_per_byte < got[5].bits_per_byte


def test_lgamma_and_keys():
    x = np.array([0.5, 1.0, 3.5, 100.0, 1e6])
    assert np.allclose(C.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)
    k = C.gram_keys(*flat(pa.array(["abc", "xy"])), 2)
    assert [hex(v) for v in k.tolist()] == ["0x61", "0x610062", "0x626163", "0x78", "0x780079"]


def test_cases(docs, odd):
    got = C.score(odd).collect()
    assert len(got) == 10
    assert {r.doc_id: r.n_bytes for r in got}[0] == 0
    assert C.score(odd.limit(0)).count() == 0 and C.score(docs(["", None])).count() == 2
    a, b = (C.score(docs(["x" * 10, "y"]), buckets=n).orderBy("doc_id").collect() for n in (1, 7))
    assert [round(r.code_bits, 4) for r in a] == [round(r.code_bits, 4) for r in b]


def test_repetition_is_cheaper_than_noise(docs):
    rng = np.random.default_rng(0)
    noise = "".join(chr(c) for c in rng.integers(33, 127, 4000))
    got = {r.doc_id: r.bits_per_byte for r in C.score(docs(["the same old words again " * 160, noise])).collect()}
    assert got[0] < 0.5 < got[1]


def test_what_occurs_once_is_not_known(docs):
    """A text that stands alone in the corpus codes worse than one that another row repeats."""
    rng = np.random.default_rng(1)
    texts = ["".join(chr(c) for c in rng.integers(33, 127, 200)) for _ in range(30)]
    got = {r.doc_id: r.bits_per_byte for r in C.score(docs([*texts, texts[0]])).collect()}
    assert got[0] == got[30] and got[0] < min(got[i] for i in range(1, 30)) - 0.3
    assert min(got[i] for i in range(1, 30)) > 6.5  # log2 94 bits are the least
    assert abs(C.score(docs(["q"])).first().code_bits - 8) < 1e-6


def test_buckets_by_bytes(docs, monkeypatch):
    texts = [f"text {i} of some words {i * i}" for i in range(40)]
    want = sorted((r.doc_id, round(r.code_bits, 3)) for r in C.score(docs(texts), buckets=1).collect())
    monkeypatch.setattr(C, "BUCKET_BYTES", 100)
    assert sorted((r.doc_id, round(r.code_bits, 3)) for r in C.score(docs(texts)).collect()) == want
