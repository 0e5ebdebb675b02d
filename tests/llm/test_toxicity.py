import hashlib
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemill.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def test_held_out_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    got = T.classify(d, lab.where(F.col("doc_id") % 3 != 0)).join(lab.where(F.col("doc_id") % 3 == 0).withColumnRenamed("toxic", "truth"), "doc_id").select("toxic", "truth").toPandas()
    assert got[got.truth == 1].toxic.mean() > 0.85
    assert got[got.truth == 0].toxic.mean() < 0.03


def planted(n=400):
    r = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(300)]
    texts, y = [], []
    for i in range(n):
        t = list(r.choice(vocab, 60))
        if i % 2:
            for k in r.integers(0, 60, 4):
                t[k] = str(r.choice(["vileword", "nastyword"]))
        texts.append(" ".join(t))
        y.append(i % 2)
    return texts, y


def test_planted_words_and_new_forms(spark, docs):
    texts, y = planted()
    lab = spark.createDataFrame([(i, v) for i, v in enumerate(y[:300])], "doc_id long, toxic int")
    new = "w1 w2 w3 vilewordy w4 w5 nastywords w6 " * 3
    got = {r.doc_id: r.toxic for r in T.classify(docs([*texts, new, "w1 w2 w3"]), lab).collect()}
    wrong = [i for i in range(300, 400) if got[i] != bool(y[i])]
    assert len(wrong) <= 2 and got[400] and not got[401]
    kept = T.without_toxic(docs([*texts, new, "w1 w2 w3"]), lab)
    assert {r.doc_id for r in kept.collect()} == {i for i, x in got.items() if not x}


def plain_models(texts, langs, toxic):
    """The models of the module's docstring in dictionaries; returns P_c(word | before, language)."""
    D, Z, Z2 = T.DISCOUNT, T.DEVIATIONS, T.PAIR_DEVIATIONS
    seen = [defaultdict(set), defaultdict(set)]
    pairs = [defaultdict(set), defaultdict(set)]
    for t, la, x in zip(texts, langs, toxic):
        c, w = (0 if x else 1), t.split()
        for i, a in enumerate(w):
            u = w[i - 1] if i else None
            seen[c][la, a].add(u)
            pairs[c][u, a].add(w[i - T.FAR] if i >= T.FAR else None)

    def above(n, hist, z):
        hists = {hist(k) for c in n for k in c}
        total = [{h: sum(v for k, v in c.items() if hist(k) == h) for h in hists} for c in n]
        pooled = {h: total[0][h] + total[1][h] for h in hists}
        r = [{}, {}]
        for k in set(n[0]) | set(n[1]):
            h = hist(k)
            for c in (0, 1):
                e = total[c][h] * (n[0].get(k, 0) + n[1].get(k, 0)) / pooled[h]
                r[c][k] = max(n[c].get(k, 0) - e - z * math.sqrt(e * (1 - total[c][h] / pooled[h]) + 1), 0) / max(total[c][h], 1)
        return r, [{h: 1 - sum(v for k, v in r[c].items() if hist(k) == h) for h in hists} for c in (0, 1)], pooled

    first = lambda k: k[0]
    n = [{k: len(v) for k, v in s.items()} for s in seen]
    m = [defaultdict(int), defaultdict(int)]
    for c in (0, 1):
        for (la, a), v in n[c].items():
            m[c][la, a[: T.LETTERS]] += v
    r, lam, pooled = above(n, first, Z)
    rp, lamp, _ = above(m, first, Z)
    r2, lam2, _ = above([{k: len(v) for k, v in s.items()} for s in pairs], first, Z2)
    kept = {k: max(n[0].get(k, 0) + n[1].get(k, 0) - D, 0) for k in r[0]}
    all_kept = {la: sum(v for k, v in kept.items() if k[0] == la) for la in pooled}
    S = {k: v / all_kept[k[0]] for k, v in kept.items()}
    Sp = defaultdict(float)
    for (la, a), v in S.items():
        Sp[la, a[: T.LETTERS]] += v
    d = {la: all_kept[la] / pooled[la] for la in pooled}
    weight = {la: pooled[la] / sum(pooled.values()) for la in pooled}
    V = len({a for _, a in S})

    def f(c, la, p):
        return rp[c].get((la, p), 0) + lamp[c][la] * Sp.get((la, p), 0)

    def own(c, la, a):
        k, p = (la, a), a[: T.LETTERS]
        return r[c][k] + lam[c][la] * d[la] * S[k] * f(c, la, p) / Sp[la, p] if k in S else 0.0

    def anywhere(c, a):
        new = (1 - T.NEW_LETTERS) * sum(weight[la] * f(c, la, a[: T.LETTERS]) for la in pooled) + T.NEW_LETTERS / V
        return sum(weight[la] * (own(c, la, a) + lam[c][la] * (1 - d[la]) * new / V) for la in pooled)

    def prob(c, u, a, la):
        low = own(c, la, a) + lam[c][la] * (1 - d[la]) * anywhere(c, a) if la in pooled else anywhere(c, a)
        return r2[c].get((u, a), 0) + lam2[c].get(u, 1) * low

    return prob, S, f, pooled, r2, lam2


def small_corpus():
    r = np.random.default_rng(4)
    texts, langs, toxic = [], [], []
    for i in range(50):
        la, x = ("en", "de")[i % 2], i % 4 < 2
        w = [f"{la}word{k}" for k in r.integers(0, 25, 40)]
        for k in r.integers(0, 38, 3) if x else ():
            w[k] = f"vile{r.integers(0, 4)}"
            w[k + 1 : k + 2] = ["enword1"] * (k % 2)
        texts.append(" ".join(w))
        langs.append(la)
        toxic.append(x)
    return texts, langs, np.array(toxic)


def test_scores_equal_plain_models(monkeypatch):
    monkeypatch.setattr(T, "DEVIATIONS", 1.0)
    monkeypatch.setattr(T, "PAIR_DEVIATIONS", 0.5)
    texts, langs, toxic = small_corpus()
    model = T.fit_counts(pa.array(texts), pa.array(langs), toxic)
    prob, *_, r2, lam2 = plain_models(texts, langs, toxic)
    assert max(r2[0].values()) > 0 and min(lam2[0].values()) < 1  # pairs take part
    more = ["vilest deword3 new vile1 words", "enword1 vile2 enword1", ""]
    asked = [(t, la) for t in [*texts, *more] for la in ("en", "de", "fr", None)]
    n, *got = T.score(model, pa.array([t for t, _ in asked]), pa.array([la for _, la in asked]))
    for i, (t, la) in enumerate(asked):
        w = t.split()
        assert n[i] == len(w)
        for c in (0, 1):
            want = sum(math.log(prob(c, w[k - 1] if k else None, a, la)) for k, a in enumerate(w)) / max(len(w), 1)
            assert abs(got[c][i] - want) < 1e-9, (t, la, c)


def test_probabilities_sum_to_one(monkeypatch):
    monkeypatch.setattr(T, "DEVIATIONS", 1.0)
    texts, langs, toxic = small_corpus()
    _, S, f, pooled, r2, lam2 = plain_models(texts, langs, toxic)
    for c in (0, 1):
        for la in pooled:
            assert abs(sum(v for k, v in S.items() if k[0] == la) - 1) < 1e-9
            assert abs(sum(f(c, la, p) for p in {a[: T.LETTERS] for _, a in S}) - 1) < 1e-9
        for u, lam in lam2[c].items():
            assert abs(sum(v for k, v in r2[c].items() if k[0] == u) + lam - 1) < 1e-9
    model = T.fit_counts(pa.array(texts), pa.array(langs), toxic)
    seen = sorted({w for t in texts for w in t.split()})
    for la in ("en", "de"):
        u = T.units(pa.array(seen), pa.array([la] * len(seen)))
        u.left[:] = 1  # a history without pairs
        p = T.word_probabilities(model, u).sum(1)
        assert (p < 1).all() and (p > 0.9).all()  # the rest is for new words


def test_null_and_wrong_languages(spark, docs):
    texts, y = planted()
    lab = spark.createDataFrame([(i, v) for i, v in enumerate(y[:300])], "doc_id long, toxic int")
    langs = [["en", "de"][(i // 2) % 2] for i in range(300)] + [None, "xx", "de", "en"] * 25
    got = {r.doc_id: r.toxic for r in T.classify(docs(texts, langs=langs), lab).collect()}
    assert sum(got[i] != bool(y[i]) for i in range(300, 400)) <= 4


def test_ties_and_copies(docs, spark):
    texts, y = planted(200)
    lab = spark.createDataFrame([(i, v) for i, v in enumerate(y)], "doc_id long, toxic int")
    model = T.train(docs(texts), lab)
    t, la = pa.array(texts[:1]), pa.array(["en"])
    model.threshold = float(T.margin(model, t, la)[0])
    assert not (T.margin(model, t, la) > model.threshold).any()  # equal to the threshold: not toxic
    twice = T.train(docs([*texts, *texts], ids=[*range(200), *range(200)]), lab)
    assert (twice.in_language.values == T.train(docs(texts), lab).in_language.values).all()


def test_cases(spark, docs, odd):
    lab = spark.createDataFrame([(5, 1), (6, 0), (6, None), (None, 1)], "doc_id long, toxic int")
    got = T.classify(odd, lab).collect()
    assert len(got) == 10 and not any(r.toxic for r in got if r.n_words == 0)
    assert T.without_toxic(odd, lab).columns == odd.columns
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert not any(r.toxic for r in T.classify(odd, none).collect()) and T.without_toxic(odd, none).count() == 10
    assert T.classify(odd.limit(0), lab).count() == 0


def test_counts_of_tasks_equal_those_of_one_process(spark, docs, monkeypatch):
    """The driver takes counts alone: the model is the one of the same texts counted here, and no text is collected."""
    monkeypatch.setattr(T, "PAIR_DEVIATIONS", 0.5)
    texts, langs, toxic = small_corpus()
    lab = spark.createDataFrame([(i, int(v)) for i, v in enumerate(toxic)], "doc_id long, toxic int")
    keep = sorted(i for la in ("en", "de") for c in (True, False) for i in sorted((i for i in range(50) if langs[i] == la and toxic[i] == c), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:12])
    taken = []
    collect = type(lab).toArrow
    monkeypatch.setattr(type(lab), "toArrow", lambda df: taken.append(df.columns) or collect(df))
    model = T.train(docs(texts, langs=langs).repartition(5), lab)
    want = T.fit_counts(pa.array([texts[i] for i in keep]), pa.array([langs[i] for i in keep]), toxic[keep])
    assert len(want.pairs.keys)
    for name in ("in_language", "anywhere", "down", "letters", "pairs", "history"):
        a, b = getattr(model, name), getattr(want, name)
        assert (a.keys == b.keys).all() and np.allclose(a.values, b.values, atol=1e-12), name
    assert model.size == want.size and taken and not any("text" in c for c in taken)
