"""Near-duplicate documents by b-bit MinHash.

Documents are sets of word trigrams. ``HASHES`` minima per document make
``BANDS`` band keys, which only propose candidates; for the comparison the low
``BITS`` bits of each minimum are packed into a few 64-bit words. Two
signatures agree in a share p of their fields, counted with xor and popcount,
and as unequal minima still agree in their low bits with chance C = 2**-BITS,
the similarity is estimated as (p - C) / (1 - C).

Documents of equal minima are first folded into one. Inside a band bucket every
pair that is not yet connected is compared, so large buckets cost no more than
they must and no candidate is capped; a bucket sends on one edge per connected
member. Buckets stream out of sorted partitions, so a task holds its largest
bucket and one batch. Connected components of all edges (alternating large-star and
small-star rounds, each written to the shared folder) are the groups, of which
the least id stays.

Cases: null and empty texts, and texts without a word, are in no group and
stay; texts shorter than a shingle are compared as a whole; rows of one id are
one document, whose minima are those of all its rows; rows of null id are each
kept and in no group; very long texts are treated whole; an empty table gives an
empty result. Ids may be of any type that can be ordered. Only id and text
are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import Numbers, cut, read
from tidemill.llm.kernels import U64, flat, mix, shingles, slices, tidy, whole_groups, word_hashes

HASHES, BANDS, BITS, WIDTH = 96, 32, 4, 3
THRESHOLD = 0.5  # copies with about a tenth of their words changed
_RNG = np.random.default_rng(7)
_XOR = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MUL = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_WORDS = HASHES * BITS // 64


def minima(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(minima[row, hash], has words[row]) of each text."""
    buf, off = flat(text)
    h, _, _, row = word_hashes(buf, off)
    g, row, _ = shingles(h, row, len(text), WIDTH)
    out = np.zeros((len(text), HASHES), np.uint32)
    some = np.bincount(row, minlength=len(text)) > 0
    if len(g):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        x = (g >> U64(32)).astype(np.uint32)
        with np.errstate(over="ignore"):
            for k in range(HASHES):
                out[some, k] = np.minimum.reduceat((x ^ _XOR[k]) * _MUL[k], first)
    return out, some


def band_keys(m: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band."""
    rows = HASHES // BANDS
    x = m.reshape(len(m), BANDS, rows).astype(U64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64), x.shape[:2])
        for i in range(rows):
            key = mix(key * U64(31) + x[:, :, i])
    return key


def packed(m: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum in HASHES * BITS / 64 words."""
    per = 64 // BITS
    x = (m & np.uint32((1 << BITS) - 1)).astype(U64).reshape(len(m), _WORDS, per)
    return np.bitwise_or.reduce(x << (np.arange(per, dtype=U64) * U64(BITS)), axis=2)


_LOW = U64(sum(1 << i for i in range(0, 64, BITS)))


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected estimates from packed signatures, row by row."""
    z = a ^ b
    s = 1
    while s < BITS:
        z = z | (z >> U64(s))
        s *= 2
    equal = 1 - np.bitwise_count(z & _LOW).sum(-1) / HASHES
    c = 2.0**-BITS
    return (equal - c) / (1 - c)


def bucket_edges(key: np.ndarray, uid: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(least uid of its component, uid) for the connected members of each bucket."""
    order = np.lexsort((uid, key))
    key, uid, sig = key[order], uid[order], sig[order]
    n = len(key)
    if n < 2:
        return uid[:0], uid[:0]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.append(start, n))
    group = np.repeat(np.arange(len(start)), sizes)
    end = np.repeat(start + sizes, sizes)
    label = np.arange(n)
    live = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    d = 1
    while len(live):
        i = live[live + d < end[live]]
        if not len(i):
            break
        live = i  # what is too near the end at this distance is so at any larger one
        i = i[label[i] != label[i + d]]
        i = i[similarity(sig[i], sig[i + d]) >= threshold] if len(i) else i
        if len(i):
            a, b = label[i], label[i + d]
            while (a != b).any():  # hook the larger root to the smaller, then shortcut
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label[label] != label).any():
                    label = label[label]
                a, b = label[a], label[b]
            label = label[label]
            whole = np.ones(len(start), bool)  # groups of one label need no more comparison
            whole[group[label != start[group]]] = False
            live = live[~whole[group[live]]]
        d += 1
    at = np.flatnonzero(label != np.arange(n))
    return uid[label[at]], uid[at]


def components(edges: DataFrame, owner: str = "query") -> DataFrame:
    """(id, root) for every node of the edges (a, b): root is the least id of its component."""
    pairs = cut(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct(), owner)
    state = None
    while True:
        both = pairs.union(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")))
        m = F.least(F.min("u").over(Window.partitionBy("v")), F.col("v"))
        large = both.withColumn("m", m).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        least = large.withColumn("m", F.min("u").over(Window.partitionBy("v")))
        small = least.select("v", F.col("m").alias("u")).union(least.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))).distinct()
        pairs = cut(small, owner)
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum("u"), F.sum("v")).first())
        if now == state:
            return pairs.select(F.col("v").alias("id"), F.col("u").alias("root")).union(pairs.select(F.col("u").alias("id"), F.col("u").alias("root")).distinct())
        state = now


def signatures(texts: DataFrame) -> DataFrame:
    """(id, whole, keys, sig) of each document with words: hash of all minima, band keys, packed bits."""
    src = texts.where("id is not null and text is not null").select("id", "text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            m, some = minima(b.column("text"))
            m = m[some]
            keys = band_keys(m)
            with np.errstate(over="ignore"):
                whole = np.zeros(len(m), U64)
                for j in range(BANDS):
                    whole = mix(whole + keys[:, j])
            flat_keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(m) * BANDS + 1, BANDS), pa.int32()), pa.array(keys.ravel().view(np.int64)))
            sig = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_WORDS * 8), len(m), [None, pa.py_buffer(packed(m).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(some)), pa.array(whole.view(np.int64)), flat_keys, sig], names=["id", "whole", "keys", "sig"])

    return src.mapInArrow(run, "id long, whole long, keys array<long>, sig binary")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", owner: str = "query", numbers: Numbers | None = None) -> DataFrame:
    """(id, root) of every document that is in a group of two or more, by their numbers."""
    numbers = numbers or Numbers(docs, id_col, owner)
    sigs = cut(signatures(numbers.number(docs.select(F.col(f"`{id_col}`"), "text"), id_col, "id")), owner)
    folded = sigs.groupBy("whole").agg(F.min("id").alias("id"), F.min_by("keys", "id").alias("keys"), F.min_by("sig", "id").alias("sig"))
    banded = folded.select("id", "sig", F.explode("keys").alias("key")).repartition("key").sortWithinPartitions("key")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "key"):
            buf, _ = flat(t.column("sig"))
            a, b = bucket_edges(t.column("key").to_numpy(), t.column("id").to_numpy(), buf.view(U64).reshape(-1, _WORDS), threshold)
            if len(a):
                ab = np.unique(np.stack([a, b]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ab[0]), pa.array(ab[1])], names=["a", "b"])

    near = banded.mapInArrow(run, "a long, b long")
    first = F.min("id").over(Window.partitionBy("whole"))
    same = sigs.select("id", first.alias("rep")).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    return components(near.union(same), owner)


def groups(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", owner: str = "query") -> DataFrame:
    """id, group_id (least id of its group), keep: one row per row of docs."""
    numbers = Numbers(docs, id_col, owner)
    found = near_duplicates(docs, threshold, id_col, owner, numbers)
    ids = numbers.number(docs.select(F.col(f"`{id_col}`")), id_col, "id")
    out = ids.join(found, "id", "left").select(F.col(f"`{id_col}`"), "id", F.coalesce("root", "id").alias("root"))
    out = out.withColumn("keep", F.col("id").isNull() | (F.col("root") == F.col("id")))
    return numbers.name(out, "root", "group_id", plain=True).select(id_col, "group_id", "keep")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents"))
