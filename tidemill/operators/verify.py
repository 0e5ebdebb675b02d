"""Integrity: verdicts, skips, collisions, validation, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def verdicts(entries: DataFrame) -> DataFrame:
    """index, status for (index, size, sum, got_size, got_sum): size is checked first; a null sum is not checked."""
    s = F.when(F.col("got_size") != F.col("size"), "size mismatch").when(F.col("sum").isNotNull() & (F.col("got_sum") != F.col("sum")), "checksum mismatch").otherwise("ok")
    return entries.withColumn("status", s).withColumn("verified", (s == "ok") & F.col("sum").isNotNull())


def report(judged: DataFrame) -> DataFrame:
    ok = F.col("status") == "ok"
    r = judged.agg(F.count_if(ok).alias("checked"), F.count_if("verified").alias("sum_verified"), F.coalesce(F.sum(F.when(ok, F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(~ok).alias("failed"))
    return r.withColumn("content_unverified", (F.col("checked") > 0) & (F.col("sum_verified") == 0))


def failures(judged: DataFrame) -> DataFrame:
    return judged.where("status <> 'ok'").select("index", "status").orderBy("index")


def already_correct(entries: DataFrame, existing: DataFrame) -> DataFrame:
    """index of entries whose destination exists with equal size and checksum; no checksum, no skip."""
    e = existing.select(F.col("path"), F.col("size").alias("have_size"), F.col("sum").alias("have_sum"))
    j = entries.join(e, "path", "left")
    return j.select("index", "path", F.coalesce((F.col("have_size") == F.col("size")) & (F.col("have_sum") == F.col("sum")), F.lit(False)).alias("skip"))


def collisions(entries: DataFrame) -> DataFrame:
    """Destinations that several entries fold to; the last one in order wins."""
    return entries.groupBy(F.lower("path").alias("dest")).agg(F.count("*").alias("n"), F.max("index").alias("winner")).where("n > 1")


def work_order(entries: DataFrame) -> DataFrame:
    """index, rank: clusters of one locality key by weight, heaviest first; inside, heaviest first.

    entries: (index, size, key); ties go to the first occurrence.
    """
    k = F.coalesce(F.col("key").cast("string"), F.concat(F.lit("#"), F.col("index").cast("string")))
    w = Window.partitionBy("k")
    c = entries.withColumn("k", k).withColumns({"weight": F.sum("size").over(w), "first": F.min("index").over(w)})
    return c.select("index", "size", "k", "weight", "first")


def ordered(work: DataFrame) -> DataFrame:
    return work.orderBy(F.desc("weight"), "first", F.desc("size"), "index")


def totals(entries: DataFrame) -> DataFrame:
    """(bytes, files), saturated at 2^64 - 1; directories do not count."""
    size = F.when(F.col("kind") != "dir", F.col("size").cast("decimal(20,0)"))
    return entries.agg(F.least(F.coalesce(F.sum(size).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")), F.lit("18446744073709551615").cast("decimal(38,0)")).alias("bytes"), F.count_if(F.col("kind") != "dir").alias("files"))


def rules(packs: DataFrame, chunks: DataFrame, entry_chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """(rule, n) of the index rules that are violated, n violations each."""
    bounds = chunks.join(packs, "pack_id", "left").agg(F.count_if(F.col("raw_len").isNull()).alias("chunk_without_pack"), F.count_if(F.col("offset") + F.col("length") > F.col("raw_len")).alias("chunk_outside_pack"), F.count_if(F.col("length") <= 0).alias("empty_chunk"))
    sums = entry_chunks.join(chunks, "chunk_id", "left").groupBy("entry_idx").agg(F.sum("length").alias("got"), F.count_if(F.col("length").isNull()).alias("lost"))
    per = entries.join(sums, "entry_idx", "left").agg(F.count_if(F.col("lost") > 0).alias("unknown_chunk"), F.count_if(F.coalesce("got", F.lit(0)) != F.col("size")).alias("size_not_sum"))
    dup = packs.groupBy("pack_id").count().agg(F.count_if(F.col("count") > 1).alias("pack_twice"))
    one = bounds.crossJoin(per).crossJoin(dup)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("n")) for c in one.columns])).alias("r")).select("r.rule", "r.n").where("n > 0")


def within_budget(packs: DataFrame, output_bytes: int, floor: int = 256 << 20, factor: int = 16) -> DataFrame:
    """Decoded bytes, the budget they must keep, and whether they do."""
    budget = max(floor, factor * output_bytes)
    return packs.agg(F.coalesce(F.sum("raw_len"), F.lit(0)).alias("decoded")).select("decoded", F.lit(budget).cast("long").alias("budget"), (F.col("decoded") <= budget).alias("ok"))
