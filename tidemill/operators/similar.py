"""Perceptual similarity: 64-bit gradient signatures, banded candidates, verification, groups."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_DISTANCE = 15
WIDE_BAND = 12  # bits that make a band selective
BLOCK = 16384  # signatures in a block of the all-pairs comparison


def gradient_signature(v: Column, bits: int = 64) -> Column:
    """Bit i is set when element i is above its successor (the last one's is the first)."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        bit = F.when(v[i] > v[(i + 1) % bits], F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        out = out.bitwiseOR(F.shiftleft(bit, i))
    return out


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def banded_pairs(sigs: DataFrame, distance: int) -> DataFrame:
    """(a, b, distance) with a < b for all (id, sig) rows within the distance; rows with a null are in no pair.

    Two signatures that differ in so few bits agree in one of distance + 1 bands.
    Where such bands have WIDE_BAND bits or more, rows are joined by band. Narrower
    ones have so few keys that a join by them is nearly the product of all rows,
    and the keys are crowded; there all pairs are compared in blocks by exclusive
    or and bit count, each pair once, spread evenly over tasks. No pair is passed
    over either way, but the second is quadratic.
    """
    distance = min(distance, MAX_DISTANCE)
    sigs = sigs.where("id is not null and sig is not null")
    if 64 // (distance + 1) < WIDE_BAND:
        return block_pairs(sigs, distance)
    bands = distance + 1
    width = 64 // bands
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("sig", i * width).bitwiseAND((1 << width) - 1).alias("key")) for i in range(bands)])
    rows = sigs.select("id", "sig", F.explode(keys).alias("k")).select("id", "sig", "k.band", "k.key")
    other = rows.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"), "band", "key")
    near = rows.join(other, ["band", "key"]).where((F.col("id") < F.col("b")) & (hamming(F.col("sig"), F.col("sig_b")) <= distance))
    return near.select(F.col("id").alias("a"), "b", hamming(F.col("sig"), F.col("sig_b")).alias("distance")).distinct()


def block_pairs(sigs: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """banded_pairs by comparing blocks of rows, each with itself and with all later ones."""
    kind = sigs.schema["id"].dataType.simpleString()
    n = max(4, -(-sigs.count() // block))
    home = sigs.select("id", F.col("sig").cast("long").alias("sig"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("home"))
    first = home.select("id", "sig", F.col("home").alias("p"), F.explode(F.sequence("home", F.lit(n - 1))).alias("q"))
    second = home.select("id", "sig", F.explode(F.sequence(F.lit(0), "home")).alias("p"), F.col("home").alias("q"))

    def compare(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        u, v = (t.column("sig").to_numpy().view(np.uint64) for t in (x, y))
        i, j, d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(u), 128):
            far = np.bitwise_count(u[at : at + 128, None] ^ v[None, :])
            r, c = np.nonzero(far <= distance)
            i.append(r + at)
            j.append(c)
            d.append(far[r, c].astype(np.int64))
        i, j, d = (np.concatenate(z) for z in (i, j, d))
        return pa.table({"x": x.column("id").take(pa.array(i)), "y": y.column("id").take(pa.array(j)), "distance": pa.array(d.astype(np.int32))})

    both = first.groupBy("p", "q").cogroup(second.groupBy("p", "q")).applyInArrow(compare, f"x {kind}, y {kind}, distance int")
    # a block with itself gives each pair both ways
    return both.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance").distinct()


def mean_difference(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def aspect_close(wa: Column, ha: Column, wb: Column, hb: Column) -> Column:
    ra, rb = wa / ha, wb / hb
    return F.abs(ra - rb) <= 0.1 * F.greatest(ra, rb)


def verified(pairs: DataFrame, prints: DataFrame, limit: float) -> DataFrame:
    """Pairs but for those whose two prints are both known and differ by more than the limit.

    prints: (id, v). A pair of which a print is missing is kept.
    """
    a = prints.select(F.col("id").alias("a"), F.col("v").alias("va"))
    b = prints.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    j = pairs.join(a, "a", "left").join(b, "b", "left")
    bad = F.col("va").isNotNull() & F.col("vb").isNotNull() & (mean_difference(F.col("va"), F.col("vb")) > limit)
    return j.where(~F.coalesce(bad, F.lit(False))).select(pairs.columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one of this machine only where Spark is local."""
    import tempfile

    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (where or f"file://{tempfile.gettempdir()}").rstrip("/")


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, root) of every node of (a, b): root is the least id that it is connected with.

    Each round hooks roots to the least neighbouring root and shortcuts; the
    labels are written to the shared folder, so that lineage stays short and
    survives lost executors.
    """
    spark = edges.sparkSession
    base = f"{shared_folder(spark)}/tidemill-components-{uuid.uuid4().hex}"
    edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().write.parquet(f"{base}/edges")
    sym = spark.read.parquet(f"{base}/edges")
    sym.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")).write.parquet(f"{base}/0")
    for k in range(1, max_rounds):
        lab = spark.read.parquet(f"{base}/{k - 1}")
        near = sym.join(lab.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = lab.join(near, "id").select("id", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = lab.select(F.col("id").alias("root"), F.col("root").alias("up"))
        step.join(jump, "root", "left").select("id", F.least("root", F.coalesce("up", "root")).alias("root"), "old").write.parquet(f"{base}/{k}")
        now = spark.read.parquet(f"{base}/{k}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{k - 1}")
        if now.where("root <> old").isEmpty():
            return now.select("id", "root")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    raise RuntimeError("components: no fixed point in the allowed rounds")


def groups(pairs: DataFrame) -> DataFrame:
    """root, n, members (sorted) of each component."""
    return components(pairs).groupBy("root").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("members"))
