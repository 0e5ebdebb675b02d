"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions, 255 nodes of a code tree; each node has its
own context tree over the ``DEPTH`` bytes before. Every context of every depth
keeps the counts (a, b) of both outcomes over the whole corpus, estimates them
by Krichevsky-Trofimov, and is mixed with its longer contexts:

    P_w(s) = P_e(s) / 2 + (prod over longer contexts P_w) / 2,  P_w = P_e at full depth.

Each byte is coded by the trees of all other bytes of the corpus: its own
occurrence is taken out, so a context that occurs once predicts nothing of
itself. The probability of a bit is P_w(all) / P_w(all but it) at the root, and
from the deepest context up

    p = beta KT' + (1 - beta) (p of the longer context),

KT' and P_e' being without the occurrence, beta = P_e' / (P_e' + the product of
the longer contexts' P_w'). The score of a document is its code length in bits
and per byte.

Distribution. Only grams (context and byte) that occur matter. Documents are
hashed to buckets of about ``BUCKET_BYTES`` of text; each bucket counts its grams once, the
corpus counts are their sums, and the code length of each gram goes back to
the buckets that asked for it; so nothing that grows with the corpus is ever
collected or broadcast. Trees are built per pair of last context bytes: those
subtrees are independent. Only the two topmost levels, 256 x 255 nodes at
most, pass through the driver.

Cases: null and empty texts have 0 bytes, 0 bits and a null rate; null ids and
repeated rows are scored one by one (and counted as often as they occur); long
texts are scored whole; equal texts have equal scores; bytes before a text read
as 0; the only byte of a corpus costs 8 bits. Only id and text are read, so other columns cannot
clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import cut, read
from tidemill.llm.kernels import U64, flat, slices

DEPTH = 4
BUCKET_BYTES = 32 << 20
HALF = np.log(0.5)


def gram_keys(buf: np.ndarray, off: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each byte x: the depth bytes before it, nearest first, and x last, as one integer."""
    n = len(buf)
    key = np.zeros(n, U64)
    at = np.arange(n) - np.repeat(off[:-1], np.diff(off))
    for k in range(1, depth + 1):
        key <<= U64(8)
        if k < n:
            key[k:] |= np.where(at[k:] >= k, buf[:-k], 0).astype(U64)
    return (key << U64(8)) | buf.astype(U64)


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0 (Stirling's series after a shift by 8)."""
    x = np.asarray(x, float)
    shift = np.ones_like(x)
    for i in range(8):
        shift *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of a zeros and b ones."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1.0) - np.log(np.pi)


class _Level:
    """Nodes of all contexts of one depth, for one bit position: keys, counts, log P_e, log P_w.

    gain: log of the product of the longer contexts' P_w, less log P_e.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, bit: int):
        node = grams >> U64(8 - bit)
        start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        one = (grams >> U64(7 - bit)) & U64(1) == 1
        self.key = node[start]
        self.n1 = np.add.reduceat(np.where(one, counts, 0), start).astype(float)
        self.n0 = np.add.reduceat(np.where(one, 0, counts), start).astype(float)
        self.pe = log_kt(self.n0, self.n1)
        self.pw = self.pe
        self.gain = np.zeros(0)

    def find(self, node: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.key, node)


def _shorter(node: np.ndarray, bit: int) -> np.ndarray:
    """The node of the context without its farthest byte."""
    low = U64((1 << bit) - 1)
    return (((node >> U64(bit)) >> U64(8)) << U64(bit)) | (node & low)


def build(grams: np.ndarray, counts: np.ndarray, lowest: int, depth: int = DEPTH) -> list[list[_Level]]:
    """levels[d - lowest][bit] of contexts of d bytes, d from lowest to depth, from sorted distinct grams."""
    out: list[list[_Level]] = []
    for d in range(depth, lowest - 1, -1):
        here = ((grams >> U64(8 * (depth - d + 1))) << U64(8)) | (grams & U64(255))
        if d < depth:
            here, inv = np.unique(here, return_inverse=True)
            n = np.bincount(inv, counts).astype(np.int64)
        else:
            n = counts
        level = [_Level(here, n, bit) for bit in range(8)]
        if out:
            for bit in range(8):
                below = out[-1][bit]
                s = np.bincount(level[bit].find(_shorter(below.key, bit)), below.pw, minlength=len(level[bit].key))
                level[bit].pw = np.logaddexp(HALF + level[bit].pe, HALF + s)
                level[bit].gain = s - level[bit].pe
        out.append(level)
    return out[::-1]


class Top:
    """Depths 0 and 1: arrays over (last byte, node of the code tree)."""

    def __init__(self, n0: np.ndarray, n1: np.ndarray, below: np.ndarray):
        self.n = [np.stack([n0.sum(0), n1.sum(0)]), np.stack([n0, n1])]
        pe1 = log_kt(n0, n1)
        pw1 = np.where(n0 + n1 > 0, np.logaddexp(HALF + pe1, HALF + below), 0.0)
        self.gain = [pw1.sum(0) - log_kt(*self.n[0]), below - pe1]


def _without(own: np.ndarray, other: np.ndarray, gain: np.ndarray | None, p: np.ndarray | None) -> np.ndarray:
    """Probability of the bit that occurs `own` times here, one of them taken out; p: that of the longer context."""
    kt = (own - 0.5) / (own + other)
    if p is None:
        return kt
    beta = 1 / (1 + np.exp(np.clip(gain + np.log(kt) - np.log(p), -700, 700)))
    return beta * kt + (1 - beta) * p


def code_lengths(grams: np.ndarray, counts: np.ndarray, top: Top, depth: int = DEPTH) -> np.ndarray:
    """Bits of each gram's byte after its context; grams: sorted, distinct, whole subtrees of two bytes."""
    levels = build(grams, counts, 2, depth)
    bits = np.zeros(len(grams))
    x = (grams & U64(255)).astype(np.int64)
    last = (grams >> U64(8 * depth)).astype(np.int64)
    for bit in range(8):
        one = ((x >> (7 - bit)) & 1).astype(bool)
        node = grams >> U64(8 - bit)
        p = None
        for d in range(depth, 1, -1):
            lv = levels[d - 2][bit]
            i = lv.find(node)
            n0, n1 = lv.n0[i], lv.n1[i]
            p = _without(np.where(one, n1, n0), np.where(one, n0, n1), lv.gain[i] if d < depth else None, p)
            node = _shorter(node, bit)
        t = (1 << bit) | (x >> (8 - bit))
        for d, at in ((1, (last, t)), (0, (t,))):
            n0, n1 = top.n[d][0][at], top.n[d][1][at]
            p = _without(np.where(one, n1, n0), np.where(one, n0, n1), top.gain[d][at], p)
        bits -= np.log2(p)
    return bits


def _top_rows(grams: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(last byte * 256 + node, zeros, ones, sum of log P_w of depth 2) of one partition."""
    levels = build(grams, counts, 1, depth)
    ids, n0, n1, below = [], [], [], []
    for bit in range(8):
        lv, deep = levels[0][bit], levels[1][bit]
        s = np.bincount(lv.find(_shorter(deep.key, bit)), deep.pw, minlength=len(lv.key))
        ids.append((lv.key >> U64(bit)).astype(np.int64) * 256 + ((1 << bit) | (lv.key & U64((1 << bit) - 1)).astype(np.int64)))
        n0.append(lv.n0)
        n1.append(lv.n1)
        below.append(s)
    return tuple(np.concatenate(x) for x in (ids, n0, n1, below))


def _grams_of(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    g, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(g)
    return g[order].view(U64), n[order]


def _sum(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams)
    grams, counts = grams[order], counts[order]
    start = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, int)
    return grams[start], np.add.reduceat(counts, start) if len(start) else counts[:0]


def score(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", buckets: int | None = None, owner: str = "query") -> DataFrame:
    """id, n_bytes, code_bits, bits_per_byte: one row per row of docs.

    buckets: into how many parts the texts are hashed (default: one for each
    BUCKET_BYTES); a part must fit in a worker's memory.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(1, -(-size // BUCKET_BYTES))
    texts = docs.select(F.col(id_col).alias("id"), "text", F.pmod(F.xxhash64(F.col(id_col), F.col("text")), F.lit(buckets)).cast("int").alias("bucket"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: list[tuple[np.ndarray, np.ndarray]] = []  # of the bucket at hand: rows come sorted by it
        now = -1

        def done() -> Iterator[pa.RecordBatch]:
            if not mine:
                return
            g, n = _sum(*(np.concatenate(x) for x in zip(*mine, strict=True)))
            mine.clear()
            for i in range(0, len(g), 1 << 18):
                part = g[i : i + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), now, np.int32)), pa.array(part.view(np.int64)), pa.array(n[i : i + (1 << 18)].astype(np.int64))], names=["bucket", "gram", "n"])

        for b in slices(batches, "text", 2 << 20):
            each = b.column("bucket").to_numpy()
            for k in np.unique(each):
                if k != now:
                    yield from done()
                    now = int(k)
                buf, off = flat(b.column("text").filter(pa.array(each == k)))
                g, n = np.unique(gram_keys(buf, off, depth), return_counts=True)
                mine.append((g, n))
                while len(mine) > 1 and len(mine[-2][0]) < 2 * len(mine[-1][0]):
                    (g2, n2), (g1, n1) = mine.pop(), mine.pop()
                    mine.append(_sum(np.concatenate([g1, g2]), np.concatenate([n1, n2])))
        yield from done()

    by_bucket = texts.where(F.octet_length("text") > 0).repartition("bucket").sortWithinPartitions("bucket")
    asked = cut(by_bucket.mapInArrow(count, "bucket int, gram long, n long"), owner)
    corpus = cut(asked.groupBy("gram").agg(F.sum("n").alias("n")), owner)
    subtree = corpus.repartition(F.shiftright("gram", 8 * (depth - 1)))

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, n = _grams_of(batches)
        if len(g):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _top_rows(g, n, depth)], names=["node", "n0", "n1", "below"])

    n0, n1, below = (np.zeros((256, 256)) for _ in range(3))
    found = subtree.mapInArrow(tops, "node long, n0 double, n1 double, below double").groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")]).toArrow()
    at = found.column("node").to_numpy()  # 256 x 255 rows at most
    for a, c in ((n0, "n0"), (n1, "n1"), (below, "below")):
        a[at // 256, at % 256] = found.column(c).to_numpy()
    top = Top(n0, n1, below)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, n = _grams_of(batches)
        if len(g):
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(code_lengths(g, n, top, depth).astype(np.float32))], names=["gram", "bits"])

    answers = asked.select("bucket", "gram").join(subtree.mapInArrow(lengths, "gram long, bits float"), "gram")

    def rate(text: pa.Table, answer: pa.Table) -> pa.Table:
        known = answer.column("gram").combine_chunks()
        bits = np.append(answer.column("bits").to_numpy(), np.float32(0)).astype(float)
        out = []
        for b in slices(iter(text.to_batches()), "text", 2 << 20):
            buf, off = flat(b.column("text"))
            total = np.zeros(len(off) - 1)
            if len(buf):
                i = pc.index_in(pa.array(gram_keys(buf, off, depth).view(np.int64)), value_set=known).to_numpy()
                some = np.diff(off) > 0
                total[some] = np.add.reduceat(bits[i], off[:-1][some])
            size = np.diff(off)
            out.append(pa.RecordBatch.from_arrays([b.column("id"), pa.array(size), pa.array(total), pa.array(total / np.maximum(size, 1), mask=size == 0)], names=[id_col, "n_bytes", "code_bits", "bits_per_byte"]))
        return pa.Table.from_batches(out)

    return texts.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(rate, f"`{id_col}` {kind}, n_bytes long, code_bits double, bits_per_byte double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
