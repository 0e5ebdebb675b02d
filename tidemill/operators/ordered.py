"""Ordered folds over event rows: watermarks, smoothed rates, benched sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALPHA = 0.3


def watermark(parts: DataFrame) -> DataFrame:
    """file, frontier for (file, idx, done): parts before the first that is not done or missing.

    One aggregation: the first gap is the least unfinished index, or the least
    finished one whose rank differs from it.
    """
    w = Window.partitionBy("file").orderBy("idx")
    done = parts.groupBy("file", "idx").agg(F.max("done").alias("done"))
    r = done.withColumn("rn", F.row_number().over(w) - 1)
    bad = F.when(~F.col("done") | (F.col("idx") != F.col("rn")), F.least(F.col("idx"), F.col("rn")))
    return r.groupBy("file").agg(F.coalesce(F.min(bad), F.max("idx") + 1).cast("long").alias("frontier"))


def ewma(samples: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """key, n, rate for (key, ts, seq, value): the first sample seeds, then alpha * value + (1 - alpha) * rate."""
    g = samples.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "value"))).alias("s"))
    fold = F.aggregate(F.slice("s", 2, F.size("s")), F.col("s")[0]["value"], lambda acc, x: F.lit(alpha) * x["value"] + F.lit(1 - alpha) * acc)
    return g.select("key", F.size("s").alias("n"), fold.alias("rate"))


def benched(attempts: DataFrame, strikes: int = 3) -> DataFrame:
    """key, failures (current run), cooldown seconds for (key, seq, ok): benched after three strikes."""
    last = attempts.groupBy("key").agg(F.max(F.when(F.col("ok"), F.col("seq"))).alias("last_ok"))
    j = attempts.join(last, "key").where("not ok and (last_ok is null or seq > last_ok)").groupBy("key").agg(F.count("*").alias("failures"))
    return attempts.select("key").distinct().join(j, "key", "left").select("key", F.coalesce("failures", F.lit(0)).alias("failures"), F.when(F.col("failures") >= strikes, 2 * F.least(F.col("failures"), F.lit(6))).otherwise(F.lit(0)).cast("long").alias("cooldown"))


def pick(sources: DataFrame) -> DataFrame:
    """The source of least (inflight + 1) / rate for each file, among those not benched."""
    s = sources.where("cooldown = 0 and rate > 0").withColumn("score", (F.col("inflight") + 1) / F.col("rate"))
    return s.groupBy("file").agg(F.min_by("source", F.struct("score", "source")).alias("source"))


def mirror_ok(mirrors: DataFrame) -> DataFrame:
    """file, source of mirrors that agree with the anchor (least source) in size and sample hash."""
    anchor = F.first(F.struct("size", "sample")).over(Window.partitionBy("file").orderBy("source"))
    return mirrors.withColumn("a", anchor).where("ranges and size = a.size and sample = a.sample").select("file", "source")
