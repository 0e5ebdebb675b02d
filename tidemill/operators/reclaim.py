"""Reclaim planning: which copy stays, what happens to the others, is the plan sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators import paths


def keeper_order(policy: str) -> list[Column]:
    """Sort keys of a keep policy; all end in path order."""
    path = F.col("path")
    if policy == "first":
        return [path]
    if policy == "shortest":
        return [paths.looks_like_copy(path), F.size(F.split(path, "/")), F.octet_length(path), path]
    if policy == "oldest":  # one unknown time makes the group go by path
        known = F.count("mtime").over(Window.partitionBy("size", "hash")) == F.count("*").over(Window.partitionBy("size", "hash"))
        return [F.when(known, F.col("mtime")), path]
    raise ValueError(f"unknown policy {policy}")


def with_keeper(members: DataFrame, policy: str) -> DataFrame:
    """Members with the keeper of their group."""
    keys = keeper_order(policy)
    named = members.withColumns({f"__k{i}": k for i, k in enumerate(keys)})
    by = Window.partitionBy("size", "hash").orderBy(*[f"__k{i}" for i in range(len(keys))])
    frame = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return named.withColumns({"keeper": F.first("path").over(frame), "keeper_dev": F.first("dev").over(frame), "keeper_ino": F.first("ino").over(frame) if "ino" in members.columns else F.lit(None).cast("long")}).drop(*[f"__k{i}" for i in range(len(keys))])


def decisions(members: DataFrame, policy: str, quarantine: str, protected: Column | None = None) -> DataFrame:
    """keeper, victim, action, bytes, dest, reason of every member but the keepers.

    A victim on the keeper's volume is linked, another quarantined; the first
    victim of a physical file is credited with its size. Victims that are the
    keeper's own file, already lie in quarantine or are protected are skipped.
    """
    m = with_keeper(members, policy).where("path <> keeper")
    q = F.lit(quarantine)
    ino = F.col("ino") if "ino" in members.columns else F.lit(None).cast("long")
    reason = F.when(ino.isNotNull() & (ino == F.col("keeper_ino")) & (F.col("dev") == F.col("keeper_dev")), "same file as the keeper").when(paths.in_directory(q, F.col("path")), "already in quarantine")
    if protected is not None:
        reason = reason.when(protected, "protected")
    m = m.withColumn("reason", reason)
    rank = F.row_number().over(Window.partitionBy("size", "hash", "reason", "dev", F.coalesce(ino.cast("string"), F.col("path"))).orderBy("path"))
    link = F.col("dev") == F.col("keeper_dev")
    return m.select(
        "keeper",
        F.col("path").alias("victim"),
        F.when(link, "link").otherwise("quarantine").alias("action"),
        F.when(rank == 1, F.col("size")).otherwise(F.lit(0)).cast("long").alias("bytes"),
        F.when(~link, paths.quarantine_dest(q, F.col("path"))).alias("dest"),
        "reason",
    )


def plan(decided: DataFrame) -> DataFrame:
    return decided.where("reason is null").drop("reason")


def skipped(decided: DataFrame) -> DataFrame:
    return decided.where("reason is not null").select(F.col("victim").alias("path"), "reason")


def totals(plan_: DataFrame) -> DataFrame:
    return plan_.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_if(F.col("action") == "link").alias("links"), F.count_if(F.col("action") == "quarantine").alias("quarantines"))


def conflicts(plan_: DataFrame) -> DataFrame:
    """Files that are kept by one action and consumed by another, and victims of two actions."""
    both = plan_.select(F.col("victim").alias("path")).join(plan_.select(F.col("keeper").alias("path")).distinct(), "path", "left_semi")
    twice = plan_.groupBy(F.col("victim").alias("path")).count().where("count > 1").select("path")
    return both.union(twice).distinct()


def unique_dests(plan_: DataFrame) -> DataFrame:
    """Quarantine destinations told apart by a number when they collide."""
    n = F.row_number().over(Window.partitionBy("dest").orderBy("victim"))
    return plan_.where("dest is not null").withColumn("n", n).withColumn("dest", paths.numbered(F.col("dest"), F.col("n"))).drop("n")
