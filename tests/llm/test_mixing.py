import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import mixing as M


def brute(rows, max_epochs):
    """(id, epoch) -> position by numerical integration and search."""
    by = {}
    for i, (d, text, s) in enumerate(rows):
        n = len((text or "").split())
        by.setdefault(s, []).append(("" if d is None else hashlib.md5(str(d).encode()).hexdigest(), d, n, i))
    total = sum(n for v in by.values() for *_, n, _ in v)
    grid = np.linspace(0, 1, 200001)
    w, area = {}, {}
    for s, v in by.items():
        knots = M.SHAPES[(ord(s[-1]) if s else 0) % 3]
        y = np.interp(grid, *zip(*knots))
        cum = np.r_[0, np.cumsum((y[1:] + y[:-1]) / 2 * np.diff(grid))]
        area[s] = cum
        w[s] = sum(n for *_, n, _ in v) ** 0.75 * cum[-1]
    out = {}
    for s, v in by.items():
        supply = sum(n for *_, n, _ in v)
        demand = total * w[s] / sum(w.values())
        for e in range(max_epochs):
            c = e * supply
            for _, d, n, _ in sorted(v, key=lambda x: (x[0], -1 if x[1] is None else x[1])):
                if supply and c < demand:
                    out.setdefault((d, s, e), []).append(np.interp(c / demand, area[s] / area[s][-1], grid))
                c += n
    return out


def rows_of(n):
    r = np.random.default_rng(4)
    return [(i, " ".join(["w"] * int(r.integers(1, 60))), ["src0", "src1", "b", "b"][int(r.integers(0, 4))]) for i in range(n)]


@pytest.mark.parametrize("epochs", [1, 4])
def test_same_as_brute_force(docs, epochs):
    rows = rows_of(200)
    got = M.mix(docs([t for _, t, _ in rows], sources=[s for *_, s in rows]), max_epochs=epochs).collect()
    want = brute(rows, epochs)
    assert {(r.doc_id, r.source, r.epoch) for r in got} == set(want)
    for r in got:
        assert abs(r.position / M.SCALE - want[r.doc_id, r.source, r.epoch][0]) < 1e-4
    assert [r.position for r in got] == sorted(r.position for r in got)


def test_weights_are_met(docs):
    texts = ["a b c d"] * 400
    sources = ["b1"] * 300 + ["b4"] * 100  # two flat sources
    got = M.mix(docs(texts, sources=sources)).collect()
    share = sum(r.source == "b1" for r in got) / len(got)
    assert abs(share - 300**0.75 / (300**0.75 + 100**0.75)) < 0.02
    half = [r for r in got if r.position < M.SCALE // 2]
    assert abs(sum(r.source == "b1" for r in half) / len(half) - share) < 0.03


def test_cases(odd, docs):
    got = M.mix(odd)
    assert got.columns[-3:] == ["n_tokens", "epoch", "position"]
    assert {r.doc_id for r in got.collect() if r.epoch == 0 and r.n_tokens} >= {4, 5}
    assert M.mix(odd, only_docs=True).columns == odd.columns
    assert M.mix(odd.limit(0)).count() == 0 and M.mix(docs([None, ""])).count() == 0
    assert M.mix(docs(["a", "a"], ids=[1, 1])).count() == 2


def test_small_sources_are_repeated_until_they_meet_their_weight(docs):
    """One source of nearly all tokens: another would need 10 passes."""
    texts = ["a b c d e f g h i j " * 1000] * 10 + ["x y"] * 5
    got = M.mix(docs(texts, sources=["b1"] * 10 + ["b4"] * 5)).collect()
    supply = {"b1": 100000, "b4": 10}
    weight = {s: n**0.75 for s, n in supply.items()}
    small = [r for r in got if r.source == "b4"]
    want = 100010 * weight["b4"] / sum(weight.values())
    assert want / 10 > 9 and 0 <= 2 * len(small) - want < 2
    assert {r.epoch for r in small} == set(range(math.ceil(want / 10)))
    assert max(r.position for r in small) > 0.98 * M.SCALE


def test_null_ids_come_first_and_ties_are_ordered(docs):
    rows = [(None, "n n"), *[(i, "w " * (i % 5 + 1)) for i in range(40)], (7, "w"), (7, "w w w w w w w")]
    got = M.mix(docs([t for _, t in rows], ids=[i for i, _ in rows], sources=["b1"] * len(rows))).collect()
    assert [(r.doc_id, r.position) for r in got][0] == (None, 0)
    assert [r.n_tokens for r in got if r.doc_id == 7] == sorted(r.n_tokens for r in got if r.doc_id == 7)
    key = [(r.position, r.source, r.doc_id if r.doc_id is not None else -1, r.epoch) for r in got]
    assert key == sorted(key) and len(got) == len(rows)


def test_columns_of_any_name_keep_their_values(docs):
    names = ["__tm_x", "__tm_n", "r", "n", "k", "b", "s", "in", "sum", "shape", "before", "supply", "demand", "e", "x", "p", "w"]
    df = docs(["a b", "c", "d e f"], sources=["b1", "b1", "b2"])
    df = df.withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id")) for c in names})
    for r in M.mix(df).collect():
        assert all(r[c] == f"{c}-{r.doc_id}" for c in names)
    assert {tuple(r[c] for c in names) for r in M.mix(df, only_docs=True).collect()} == {tuple(f"{c}-{i}" for c in names) for i in range(3)}
