import bisect

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import packing as P


def brute(counts, cap):
    """Bins as sorted lists of lengths: greedy pairs of large items, then best fit, item by item."""
    items = sorted((s for s in range(1, cap + 1) for _ in range(counts[s])), reverse=True)
    large = [s for s in items if 3 * s > cap]
    bins = []
    while large:
        s = large.pop(0)
        i = next((k for k, x in enumerate(large) if x <= cap - s), None)
        bins.append([s] if i is None else [s, large.pop(i)])
    gaps = sorted((cap - sum(b), i) for i, b in enumerate(bins) if sum(b) < cap)
    for s in (s for s in items if 3 * s <= cap):
        k = bisect.bisect_left(gaps, (s, -1))
        if k < len(gaps):
            gap, i = gaps.pop(k)
        else:
            bins.append([])
            gap, i = cap, len(bins) - 1
        bins[i].append(s)
        if gap > s:
            bisect.insort(gaps, (gap - s, i))
    return bins


def expand(rows):
    bins = {}
    for s, r0, r1, b0, per, off in rows.tolist():
        for r in range(r0, r1):
            k = r - r0
            bins.setdefault(b0 + k // per, []).append((off + k % per * s, s))
    return bins


@settings(max_examples=150, deadline=None)
@given(st.integers(3, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(0, 9), min_size=c, max_size=c))))
def test_plan_same_as_item_by_item(case):
    cap, n = case
    counts = np.array([0, *n])
    got = expand(P.plan(counts, cap))
    for b in got.values():  # items neither overlap nor leave the bin
        at = 0
        for off, s in sorted(b):
            assert off == at
            at += s
        assert at <= cap and sum(3 * s > cap for _, s in b) <= 2
    assert sorted(got) == list(range(len(got)))
    want = brute(counts, cap)
    # bins of equal gaps may change places, which leaves all gaps the same
    assert sorted(sum(s for _, s in b) for b in got.values()) == sorted(map(sum, want))


def test_documents(docs, odd):
    texts = [" ".join(["w"] * n) for n in (3, 25, 10, 7, 7, 6, 2, 0, 40)]
    got = P.pack(docs(texts), capacity=10).collect()
    assert sum(r.n_tokens for r in got) == 100
    by = {}
    for r in got:
        if r.bin_id is not None:
            by.setdefault(r.bin_id, []).append((r.bin_offset, r.n_tokens))
    for b in by.values():
        assert sum(n for _, n in b) <= 10 and all(x[0] + x[1] == y[0] for x, y in zip(sorted(b), sorted(b)[1:]))
    assert len(by) == 11  # seven full ones; 7 + 3, 7 + 2, 6, 5
    assert [r for r in got if r.doc_id == 7][0].bin_id is None
    assert [r.n_tokens for r in sorted(got, key=lambda r: r.piece) if r.doc_id == 8] == [10] * 4
    o = P.pack(odd, capacity=100).collect()
    assert sum(r.n_tokens for r in o if r.doc_id == 4) == 30000 and sum(r.doc_id == 5 for r in o) == 2
    places = [(r.bin_id, r.bin_offset) for r in o if r.bin_id is not None]
    assert len(places) == len(set(places))
    assert P.pack(odd.limit(0)).count() == 0
