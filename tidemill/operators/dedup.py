"""Exact duplicates: size, partial and full identity of content.

Content is hashed inside the scan and never enters a shuffle; what is grouped
are slim (path, size, hash) rows. Groups are found behind two gates: only files
whose size another file has, and of large ones only those whose head and tail
another one of that size has, are hashed whole. What passes a gate is named by
sizes or by (size, head and tail), so content never meets a join but a broadcast
of few rows; where these are more than GATE_ROWS, all is hashed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP_GROUPS = 50
WINDOW = 65536
GATE_ROWS = 1_000_000


def scan_metrics(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"), F.min("size").alias("min_size"), F.max("size").alias("max_size"))


def size_gate(files: DataFrame, min_size: int = 1) -> DataFrame:
    """Files whose size another file shares; empty files are never candidates."""
    slim = files.where(F.col("size") >= max(1, min_size)).select("path", "size")
    return slim.withColumn("n_same_size", F.count("*").over(Window.partitionBy("size"))).where("n_same_size > 1")


def partial_key(window: int):
    """First and last `window` bytes; null for files too small to be worth it."""
    big = F.col("size") >= 4 * window
    both = F.concat(F.substring("content", 1, window), F.expr(f"substring(content, -{window}, {window})"))
    return F.when(big, F.sha2(both, 256))


def partial_gate(files: DataFrame, window: int = 65536) -> DataFrame:
    """Candidates after the partial gate: small ones pass, others need an equal head and tail."""
    k = files.where("size >= 1").select("path", "size", partial_key(window).alias("pk"))
    sized = k.withColumn("n_size", F.count("*").over(Window.partitionBy("size"))).where("n_size > 1")
    both = sized.withColumn("n_part", F.count("*").over(Window.partitionBy("size", "pk")))
    return both.where("pk is null or n_part > 1").select("path", "size")


def gated(files: DataFrame, window: int = WINDOW, limit: int = GATE_ROWS) -> DataFrame:
    """Rows of files that can have a duplicate: those that pass the size gate and the partial gate."""
    files = files.where("size >= 1")
    sizes = files.groupBy("size").count().where("count > 1").select("size")
    if sizes.limit(limit + 1).count() > limit:
        return files
    files = files.join(F.broadcast(sizes), "size", "left_semi")
    if files.where(F.col("size") >= 4 * window).isEmpty():
        return files
    keyed = files.withColumn("__pk", F.coalesce(partial_key(window), F.lit("")))
    parts = keyed.where("__pk <> ''").groupBy("size", "__pk").count().where("count = 1").select("size", "__pk")
    if parts.limit(limit + 1).count() > limit:
        return files
    return keyed.join(F.broadcast(parts), ["size", "__pk"], "left_anti").drop("__pk")


def hashed(files: DataFrame) -> DataFrame:
    return files.where("size >= 1").select("entry_idx", "path", "size", "dev", F.sha2("content", 256).alias("hash"))


def groups(files: DataFrame, window: int = WINDOW) -> DataFrame:
    """size, hash, n_files, reclaimable, first_path of each duplicate group; its members are rows of ``members``."""
    g = hashed(gated(files, window)).groupBy("size", "hash").agg(F.count("*").alias("n_files"), F.min("path").alias("first_path")).where("n_files > 1")
    return g.select("size", "hash", "n_files", ((F.col("n_files") - 1) * F.col("size")).alias("reclaimable"), "first_path")


def ranked(frame: DataFrame) -> DataFrame:
    return frame.orderBy(F.desc("reclaimable"), "first_path")


def members(files: DataFrame) -> DataFrame:
    """One row per member of a duplicate group, with its rank by path."""
    by = Window.partitionBy("size", "hash")
    return hashed(files).withColumn("n_files", F.count("*").over(by)).where("n_files > 1").withColumn("rn", F.row_number().over(by.orderBy("path")))


def physical_groups(files: DataFrame) -> DataFrame:
    """Groups with (dev, ino) identities: hard links are one copy, unknown ids one each.

    files needs dev and ino; reclaimable is (distinct copies - 1) x size.
    """
    h = files.where("size >= 1").select("path", "size", F.sha2("content", 256).alias("hash"), F.when(F.col("ino").isNotNull(), F.struct("dev", "ino")).alias("id"))
    g = h.groupBy("size", "hash").agg(F.count("*").alias("n_files"), (F.count_distinct("id") + F.count_if(F.col("id").isNull())).alias("copies"), F.min("path").alias("first_path"))
    return g.where("n_files > 1").withColumn("reclaimable", F.greatest(F.lit(0), F.col("copies") - 1) * F.col("size"))


def summary(files: DataFrame) -> DataFrame:
    g = groups(files)
    return g.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n_files"), F.lit(0)).alias("n_members"), F.coalesce(F.sum(F.col("n_files") - 1), F.lit(0)).alias("redundant_files"), F.coalesce(F.sum("reclaimable"), F.lit(0)).alias("reclaimable"))


def bytes_hashed(files: DataFrame, window: int = 65536) -> DataFrame:
    """Bytes that gated hashing reads: head and tail of big candidates, all of what passes on."""
    cand = size_gate(files)
    part = cand.where(F.col("size") >= 4 * window).agg(F.coalesce(F.sum(F.lit(2 * window)), F.lit(0)).cast("long").alias("partial_bytes"))
    full = partial_gate(files, window).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("full_bytes"))
    return part.crossJoin(full).crossJoin(files.agg(F.sum("size").alias("scanned_bytes")))


def collapse_roots(roots: DataFrame) -> DataFrame:
    """Roots that no other root contains; equal roots once."""
    r = roots.distinct()
    outer = r.select(F.col("root").alias("outer"))
    # the ancestors of a root are few: an equi-join on them, not a comparison of all pairs
    parts = F.split("root", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    inside = r.where(F.size(parts) > 1).select("root", F.explode(up).alias("outer")).join(outer, "outer", "left_semi").select("root")
    return r.join(inside, "root", "left_anti")


def is_scratch(name):
    """Names that interrupted replacements of this engine leave: hidden, with its mark and a number."""
    return name.rlike("^\\.(.*\\.)?tidemill-(link|old)-[0-9]+$")
