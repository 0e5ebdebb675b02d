"""Language identification with string kernels.

The blended-spectrum presence kernel counts the byte n-grams, n = 1 to
``MAX_N``, that two texts share, each once; k(x, y) / sqrt(k(x, x) k(y, y)) is
its normed form. n-grams are kept as presence bits of a hashed space of
``SLOTS`` places, so a batch of texts is a 0/1 matrix and its kernel with the
``LANDMARKS`` landmark texts one matrix product. Nyström features
K_nm K_mm^(-1/2) of the training texts go into a kernel ridge regression per
language against the rest; its weights fold into one landmarks x languages
matrix, so scoring a batch is two products.

The classifier is fitted on a bounded sample: ``MAX_TRAIN`` documents with a
language, first by md5 of their ids. All documents are scored, whole.

Cases: a null or empty text has no language and a null margin; rows with a null
language are scored but not learned from; with no labelled row every language
is null; ties go to the first language by name; null ids and repeated rows are
scored one by one. Only id, text and language are read, so other columns cannot
clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import read
from tidemill.llm.kernels import flat, slices

MAX_N, SLOTS, LANDMARKS, MAX_TRAIN, RIDGE = 4, 1 << 15, 128, 2000, 1e-3
ROWS = 256  # texts per matrix product
_SHIFT = np.uint32(32 - 15)


@dataclass
class Model:
    landmarks: np.ndarray  # presence bits, normed
    weights: np.ndarray  # landmarks x languages
    languages: list[str]


def presence(text: pa.Array) -> np.ndarray:
    """0/1 matrix: which slots' n-grams stand in which text."""
    buf, off = flat(text)
    out = np.zeros((len(text), SLOTS), np.float32)
    n = len(buf)
    if n == 0:
        return out
    row = np.repeat(np.arange(len(text), dtype=np.int64) * SLOTS, np.diff(off))
    end = np.repeat(off[1:], np.diff(off))
    place = np.arange(n)
    x = buf.astype(np.uint32)
    gram = np.zeros(n, np.uint32)
    cells = out.reshape(-1)
    with np.errstate(over="ignore"):
        for k in range(1, MAX_N + 1):
            if k > n:
                break
            gram[: n - k + 1] = (gram[: n - k + 1] << np.uint32(8)) | x[k - 1 :]
            slot = ((gram + np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) ^ ((gram >> np.uint32(15)) * np.uint32(0x27D4EB2F))
            ok = place + k <= end
            cells[row[ok] + ((slot[ok] * np.uint32(0x9E3779B1)) >> _SHIFT)] = 1
    return out


def normed(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def fit(text: pa.Array, lang: list[str]) -> Model | None:
    """Nyström kernel ridge regression, one language against the rest."""
    if not len(lang):
        return None
    names = sorted(set(lang))
    y = np.where(np.array(lang)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    nth = np.zeros(len(lang), np.int64)  # landmarks: from each language in turn
    for k in range(len(names)):
        mine = y[:, k] > 0
        nth[mine] = np.arange(mine.sum())
    marks = normed(presence(text.take(pa.array(np.argsort(nth, kind="stable")[:LANDMARKS]))))
    kmm = (marks @ marks.T).astype(float)
    val, vec = np.linalg.eigh(kmm)
    good = val > 1e-6 * val.max()
    root = vec[:, good] / np.sqrt(val[good])
    feats = np.concatenate([(normed(presence(text.slice(i, ROWS))) @ marks.T) @ root for i in range(0, len(lang), ROWS)])
    w = np.linalg.solve(feats.T @ feats + RIDGE * len(lang) * np.eye(feats.shape[1]), feats.T @ y)
    return Model(marks, (root @ w).astype(np.float32), names)


def score(model: Model, text: pa.Array) -> np.ndarray:
    return (normed(presence(text)) @ model.landmarks.T) @ model.weights


def train(docs: DataFrame, id_col: str = "doc_id", max_train: int = MAX_TRAIN) -> Model | None:
    known = docs.where(F.col("lang").isNotNull() & F.col(id_col).isNotNull())
    picks = known.select(F.col(id_col).alias("__tm_id"), F.md5(F.col(id_col).cast("string")).alias("__tm_h")).distinct().orderBy("__tm_h", "__tm_id").limit(max_train)
    rows = known.join(F.broadcast(picks), docs[id_col] == picks["__tm_id"]).select("__tm_h", F.lower("text").alias("text"), docs["lang"].alias("lang")).where("text is not null").toArrow()
    rows = rows.sort_by([("__tm_h", "ascending"), ("text", "ascending")])
    return fit(rows.column("text").combine_chunks(), rows.column("lang").to_pylist()) if rows.num_rows else None


def identify(docs: DataFrame, id_col: str = "doc_id", max_train: int = MAX_TRAIN) -> DataFrame:
    """id, language, margin (best score less second): one row per row of docs."""
    model = train(docs, id_col, max_train)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(model.languages if model else [], pa.string())
        for whole in slices(batches, "text"):
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                none = np.diff(flat(b.column("text"))[1]) == 0
                if model is None:
                    best, margin, none = np.zeros(len(none), np.int64), np.zeros(len(none)), np.ones(len(none), bool)
                else:
                    s = score(model, b.column("text"))
                    best = s.argmax(1)
                    two = np.partition(s, -2, axis=1) if s.shape[1] > 1 else np.c_[s * 0, s]
                    margin = two[:, -1] - two[:, -2]
                yield pa.RecordBatch.from_arrays([b.column("id"), names.take(pa.array(best, mask=none)), pa.array(margin.astype(float), mask=none)], names=[id_col, "language", "margin"])

    return docs.select(F.col(id_col).alias("id"), F.lower("text").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, language string, margin double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
