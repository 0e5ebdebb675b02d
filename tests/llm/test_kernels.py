import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import kernels as K


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ9 é.ñ日😀\n", max_size=12)), max_size=6))
def test_words_same_as_regular_expression(texts):
    buf, off = K.flat(pa.array(texts, pa.string()))
    s, e, row = K.words(buf, off)
    got = [(r, bytes(buf[a:b]).decode()) for a, b, r in zip(s.tolist(), e.tolist(), row.tolist())]
    want = [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[A-Za-z0-9\u0080-߿]+|[ࠀ-\U0010ffff]", t or "")]
    assert got == want


def test_hashes_do_not_depend_on_place():
    h, *_ = K.word_hashes(*K.flat(pa.array(["ab cd", "xx AB", "cd"])))
    assert h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 3


def test_slices_keep_every_row():
    b = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 0, 3000, 1, 2)]), pa.array(range(5))], names=["t", "i"])
    got = list(K.slices(iter([b, b.slice(0, 0), b.slice(2)]), "t", 10))
    assert [i for x in got for i in x.column("i").to_pylist()] == [0, 1, 2, 3, 4, 2, 3, 4] and len(got) > 3
    assert K.flat(b.column("t").slice(3))[1].tolist() == [0, 1, 3]
