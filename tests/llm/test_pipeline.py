"""The pipeline against plain Python versions of its stages."""

import random

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from tests.llm.test_minhash import edited
from tests.llm.test_mixing import brute as brute_mix

from tidemill.llm import minhash, packing

SOURCES = ["src0", "src1", "b"]


def words(n, r):
    return [f"w{r.randrange(4000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean documents, toxic ones, copies of two kinds, a shared passage, odd rows."""
    r = random.Random(7)
    rows, kind, toxic = [], {}, {}

    def add(t, k, source=None):
        i = len(rows)
        rows.append((i, t if t is None else " ".join(t), "en", source or r.choice(SOURCES)))
        kind[i] = k
        return i

    for _ in range(60):
        add(words(r.randrange(80, 200), r), "clean")
    for _ in range(40):
        t = words(120, r)
        for k in range(5):
            t[r.randrange(120)] = r.choice(["vileword", "nastyword"])
        add(t, "toxic")
    base = words(150, r)
    group = [add(base, "copy"), add(base, "copy"), add(edited(base, 0.02, 1), "copy"), add(edited(base, 0.02, 2), "copy")]
    p = words(80, r)
    shared = [add(words(40, r) + p + words(40, r), "passage") for _ in range(6)]
    add([], "empty")
    rows.append((len(rows), None, None, None))
    rows.append((None, "some text without id", "en", "b"))
    d = spark.createDataFrame([(*x, None if x[1] is None else len(x[1])) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(k == "toxic")) for i, k in kind.items() if i % 4 != 1], "doc_id long, quality int, toxic int")
    folder = tmp_path_factory.mktemp("sf")
    d.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder), kind, group, shared, " ".join(p)


def stages(spark, folder, tmp_path):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in P.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = out[name] = spark.read.parquet(f"{tmp_path}/{name}")
    return out


def test_stages(spark, corpus, tmp_path):
    folder, kind, group, shared, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = stages(spark, folder, tmp_path)
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "mixing", "packing"]
    for name in list(out)[:-1]:
        assert out[name].columns == docs.columns
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in out.items()}
    everything = {r.doc_id for r in docs.select("doc_id").collect()}
    # 1: all toxic documents go, no other one does
    assert everything - ids["toxicity"] == {i for i, k in kind.items() if k == "toxic"}
    # 2: of the copies the first stays
    assert ids["toxicity"] - ids["near_dedup"] == set(group[1:])
    # 3: the passage stays in the first document alone, all else is untouched
    before = {r.doc_id: r.text for r in out["near_dedup"].collect()}
    after = {r.doc_id: r for r in out["substring_dedup"].collect()}
    assert set(after) == set(before)
    for i, t in before.items():
        want = t if i not in shared[1:] else t.replace(passage, "")
        assert after[i].text == want and (t is None or after[i].n_chars == len(want))
    # 4: as a plain version schedules them
    rows = [(r.doc_id, r.text, r.source) for r in after.values()]
    want = brute_mix([(d, t, s or "") for d, t, s in rows], 4)
    counts = {}
    for d, s, _ in want:
        counts[d, s] = counts.get((d, s), 0) + 1
    got = {}
    for r in out["mixing"].collect():
        got[r.doc_id, r.source or ""] = got.get((r.doc_id, r.source or ""), 0) + 1
    assert {k: v for k, v in got.items() if after[k[0]].text} == {k: v for k, v in counts.items() if after[k[0]].text}
    # 5: every token has one place in a bin
    tokens = out["mixing"].agg(F.sum(F.size(F.split(F.trim("text"), "[ ]+")))).first()[0]
    packed = out["packing"].where("bin_id is not null")
    load = packed.groupBy("bin_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("bin_offset") + F.col("n_tokens")).alias("end")).collect()
    assert all(r.n == r.end <= packing.CAPACITY for r in load) and abs(sum(r.n for r in load) - tokens) <= 2


def test_run_is_the_stages(spark, corpus, tmp_path):
    folder = corpus[0]
    last = list(stages(spark, folder, tmp_path).values())[-1]
    key = lambda df: sorted(map(str, df.select("doc_id", "piece", "n_tokens").collect()))
    assert key(P.run(spark, folder)) == key(last)


def test_rows_that_repeat_an_id_and_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = P.near_dedup(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.where("doc_id = 5").count() == 1 and kept.count() == 9
    assert P.run(spark, str(tmp_path)).count() > 0
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert minhash.groups(empty).count() == 0


def test_near_dedup_judges_rows_of_one_id_by_their_texts(spark, docs):
    r = random.Random(3)
    a, b, c = (" ".join(words(100, r)) for _ in range(3))
    df = docs([None, a, b, b, c, a, c], ids=[7, 7, 7, 7, 8, 8, None])
    kept = sorted(((x.doc_id, x.text) for x in P.near_dedup(spark, df, "").collect()), key=str)
    # of a, held by 7 and 8, one row stays; b's copy goes; c stays for 8, and where the id is null
    assert [t for _, t in kept].count(a) == 1 and sorted(map(str, kept)) == sorted(map(str, [(7, None), (7, b), (8, c), (None, c), *[x for x in kept if x[1] == a]]))


def test_ids_of_other_types(spark, corpus, tmp_path):
    folder, kind, *_ = corpus
    name = F.concat(F.lit("id"), F.lpad(F.col("doc_id").cast("string"), 5, "0")).alias("doc_id")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.select(name, "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").select(name, "quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    named = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for stage in ("near_dedup", "substring_dedup"):
        one, two = (sorted(r.text or "" for r in dict(P.STAGES)[stage](spark, d, f).collect()) for d, f in ((docs, folder), (named, str(tmp_path))))
        assert one == two
    toxic = {f"id{i:05d}" for i, k in kind.items() if k == "toxic"}
    got = {r.doc_id for r in P.run(spark, str(tmp_path)).collect()}
    assert got and not got & toxic


HELD = """
import random
import pyarrow as pa
from tidemill.llm import minhash

class Texts:
    where = select = lambda self, *a: self
    mapInArrow = lambda self, run, kind: run

def held():
    return int(next(x for x in open("/proc/self/status") if x.startswith("VmRSS")).split()[1]) / 1024

def batch(n, words):
    r = random.Random(1)
    texts = [" ".join(f"w{r.randrange(9999)}" for _ in range(words)) for _ in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(texts)], names=["id", "text"])

run = minhash.signatures(Texts())
list(run(iter([batch(2, 50)])))
large = batch(900, 600)
before = held()
list(run(iter([large])))
print(held() - before)
"""


def test_a_worker_keeps_no_memory_of_the_task_before():
    """The workers of near_dedup stand beside those of other stages, so what they hold when idle counts."""
    import subprocess
    import sys
    from pathlib import Path

    got = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True, cwd=Path(__file__).resolve().parents[2])
    assert float(got.stdout) < 20  # MB
