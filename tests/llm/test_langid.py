import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemill.llm import langid as L

SF = "/root/testdata/sf0.01"


def test_presence_counts_each_gram_once():
    x = L.presence(pa.array(["abab", "", "abababab", "zz"]))
    assert x[0].sum() == 2 + 2 + 2 + 1 and x[1].sum() == 0  # a b, ab ba, aba bab, abab
    assert x[2].sum() == 2 + 2 + 2 + 2
    a, b = (set(s[i : i + k] for k in range(1, 5) for i in range(len(s) - k + 1)) for s in ("abab", "abababab"))
    assert x[0] @ x[2] == len(a & b)


def test_held_out_accuracy(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    test = d.where(F.col("doc_id") % 4 == 0)
    train = d.where(F.col("doc_id") % 4 != 0)
    model = L.train(train)
    t = test.select("lang", F.lower("text").alias("text")).toArrow()
    s = L.score(model, t.column("text").combine_chunks())
    got = np.array(model.languages)[s.argmax(1)]
    assert (got == np.array(t.column("lang").to_pylist())).mean() > 0.98


def test_cases(spark, docs, odd):
    got = {r.doc_id: r for r in L.identify(docs(["le la les des une", "the and of to in", None, ""], langs=["fr", "en", None, "en"])).collect()}
    assert got[0].language == "fr" and got[1].language == "en" and got[2].language is None and got[3].margin is None
    rows = L.identify(odd).collect()
    assert len(rows) == 10
    assert [r.language for r in L.identify(docs(["a b"], langs=[None])).collect()] == [None]
    assert L.identify(odd.limit(0)).count() == 0
    assert [r.language for r in L.identify(docs(["a b"], langs=["en"])).collect()] == ["en"]


def slot(gram):
    """Place of a gram in the hashed space, in plain integers."""
    x, k, m = int.from_bytes(gram, "big"), len(gram), 0xFFFFFFFF
    h = ((x + k * 0x9E3779B1) * 0x85EBCA6B & m) ^ ((x >> 15) * 0x27D4EB2F & m)
    return (h * 0x9E3779B1 & m) >> 17


def plain_ridge(train, lang, test, landmarks):
    """The same classifier by sets and plain kernel matrices: Nystroem approximation of the kernel, dual ridge solution."""
    grams = lambda t: {slot(t.encode()[i : i + k]) for k in range(1, L.MAX_N + 1) for i in range(len(t.encode()) - k + 1)}
    a, m, b = ([grams(t) for t in x] for x in (train, landmarks, test))
    kernel = lambda x, y: np.array([[len(p & q) / np.sqrt(len(p) * len(q)) for q in y] for p in x])
    c, inv = kernel(a, m), np.linalg.pinv(kernel(m, m), rcond=1e-6)
    names = sorted(set(lang))
    y = np.where(np.array(lang)[:, None] == np.array(names), 1.0, -1.0)
    alpha = np.linalg.solve(c @ inv @ c.T + L.RIDGE * len(train) * np.eye(len(train)), y)
    return kernel(b, m) @ inv @ c.T @ alpha, names


def test_scores_equal_plain_kernel_matrices(monkeypatch):
    r = np.random.default_rng(6)
    letters = {"en": "etaoinsh", "fr": "elaisuéà", "de": "enirstüß"}
    make = lambda la: " ".join("".join(r.choice(list(letters[la]), r.integers(2, 6))) for _ in range(r.integers(4, 15)))
    lang = [list(letters)[i % 3] for i in range(90)]
    text = [make(x) for x in lang]
    test = [make(x) for x in lang[:30]]
    monkeypatch.setattr(L, "LANDMARKS", 12)
    model = L.fit(pa.array(text), lang)
    want, names = plain_ridge(text, lang, test, text[:12])  # languages take turns in these texts
    assert names == model.languages
    got = L.score(model, pa.array(test))
    assert np.abs(got - want).max() < 1e-3 and (got.argmax(1) == want.argmax(1)).all()


def test_hashing_hardly_changes_the_kernel(spark):
    t = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(150).select(F.lower("text").alias("t")).toArrow().column("t").combine_chunks()
    x = L.normed(L.presence(t))
    sets = [{s[i : i + k] for k in range(1, L.MAX_N + 1) for i in range(len(s) - k + 1)} for s in (v.encode() for v in t.to_pylist())]
    exact = np.array([[len(p & q) / np.sqrt(max(len(p), 1) * max(len(q), 1)) for q in sets] for p in sets])
    err = np.abs(x @ x.T - exact)
    assert err.mean() < 0.05 and np.corrcoef((x @ x.T).ravel(), exact.ravel())[0, 1] > 0.99


def test_ties_go_to_the_first_name_and_rows_keep_their_ids(docs):
    same = L.identify(docs(["a b c", "a b c", "a b c"], ids=[1, 2, 2], langs=["fr", "de", "de"])).collect()
    assert len(same) == 3
    model = L.fit(pa.array(["a b c", "a b c"]), ["fr", "de"])
    assert model.languages == ["de", "fr"] and np.allclose(*L.score(model, pa.array(["a b c"]))[0])
    tie = L.identify(docs(["a b c", "a b c"], ids=[1, 2], langs=["fr", "de"]).selectExpr("*", "'z' as language", "9 as margin", "8 as id")).collect()
    assert {(r.doc_id, r.language) for r in tie} == {(1, "de"), (2, "de")}
