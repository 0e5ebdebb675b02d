import itertools
import random

import numpy as np
import pyarrow as pa

from tidemill.llm import minhash as M


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(4000)}" for _ in range(n)]


def grams(t):
    w = t.lower().split()
    return {tuple(w[i : i + M.WIDTH]) for i in range(max(1, len(w) - M.WIDTH + 1))}


def edited(base, share, seed):
    r = random.Random(seed)
    return [f"e{r.randrange(10**6)}" if r.random() < share else w for w in base]


def test_estimates(docs):
    base = words(400, 1)
    texts = [" ".join(base)] + [" ".join(edited(base, s, i)) for i, s in enumerate((0.01, 0.03, 0.06, 0.1, 0.2, 0.4))] + [" ".join(words(400, 2))]
    m, some = M.minima(pa.array(texts))
    assert some.all()
    sig = M.packed(m)
    for t, s in zip(texts, sig):
        true = len(grams(t) & grams(texts[0])) / len(grams(t) | grams(texts[0]))
        assert abs(M.similarity(sig[0], s) - true) < 0.17


def test_bucket_edges_same_as_all_pairs():
    r = np.random.default_rng(5)
    protos = r.integers(0, 1 << 63, (5, M._WORDS), dtype=np.uint64)
    sig = protos[r.integers(0, 5, 60)].copy()
    for i in range(60):
        for _ in range(int(r.integers(0, 30))):
            k = int(r.integers(0, 384))
            sig[i, k // 64] ^= np.uint64(1) << np.uint64(k % 64)
    key = r.integers(0, 4, 60)
    uid = r.permutation(1000)[:60].astype(np.int64)
    a, b = M.bucket_edges(key, uid, sig, 0.7)

    def comps(edges):
        root = {int(u): int(u) for u in uid}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in edges:
            p, q = sorted((find(int(x)), find(int(y))))
            root[q] = p
        return {u: find(u) for u in root}

    for k in range(4):
        mine = [i for i in range(60) if key[i] == k]
        want = [(uid[i], uid[j]) for i, j in itertools.combinations(mine, 2) if M.similarity(sig[i], sig[j]) >= 0.7]
        got = [(x, y) for x, y in zip(a, b) if key[list(uid).index(x)] == k and key[list(uid).index(y)] == k]
        assert comps(want) == comps(got)


def test_planted_copies(docs):
    texts, want = [], {}
    for g in range(6):
        base = words(200, 50 + g)
        for c in range(8):
            want[len(texts)] = g * 8
            texts.append(" ".join(base if c < 3 else edited(base, 0.03, 1000 * g + c)))
    texts += [" ".join(words(200, 500 + i)) for i in range(30)]
    got = {r.doc_id: r for r in M.groups(docs(texts)).collect()}
    assert all(got[i].group_id == w for i, w in want.items())
    assert all(got[i].group_id == i and got[i].keep for i in range(48, 78))
    assert sum(r.keep for r in got.values()) == 36


def test_components_long_chain(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (200, 205)]
    got = {r.id: r.root for r in M.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[102] == 100 and got[205] == 200 and len(got) == 66


def test_cases(odd, docs):
    got = M.groups(odd).collect()
    assert len(got) == 10 and all(r.keep for r in got)
    assert M.groups(odd.limit(0)).count() == 0
    short = {r.doc_id: r.keep for r in M.groups(docs(["one", "one", "two", "!!", "!!", ""])).collect()}
    assert short == {0: True, 1: False, 2: True, 3: True, 4: True, 5: True}


def test_ids_of_other_types(spark):
    base = words(100, 3)
    rows = [("k9", " ".join(base)), ("k2", " ".join(base)), ("k5", " ".join(words(100, 4))), (None, " ".join(base))]
    got = {r.doc_id: (r.group_id, r.keep) for r in M.groups(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"k9": ("k2", False), "k2": ("k2", True), "k5": ("k5", True), None: (None, True)}
