"""Relational views of content: files, entries and chunks over the source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(entry_idx, path, content, size, dev): each document as a file.

    The path is source/lang/doc_id, the volume is the source. ``content`` is
    only read when a plan uses it.
    """
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("entry_idx"),
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".txt")).alias("path"),
        F.encode("text", "UTF-8").alias("content"),
        F.octet_length("text").cast("long").alias("size"),
        F.col("source").alias("dev"),
    )
