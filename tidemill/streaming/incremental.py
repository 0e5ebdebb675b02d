"""Structured Streaming: incremental dedup, contiguous frontiers, growing byte sources."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemill.operators.similar import shared_folder


def parquet_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    reader: DataStreamReader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rpartition("/")
    # a stream reads a folder; of one with other tables only the file asked for
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_file = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()
    return reader.option("pathGlobFilter", name).parquet(folder) if is_file else reader.parquet(path)


def _run(stream: DataFrame, mode: str) -> DataFrame:
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/tidemill-stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def distinct_content(spark: SparkSession, path: str) -> DataFrame:
    """hash of every distinct text, each emitted once whatever batch it comes in."""
    s = parquet_stream(spark, path).where("text is not null").select(F.md5("text").alias("hash")).dropDuplicates(["hash"])
    return _run(s, "append")


def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keep the frontier of a file and the finished parts beyond it; emit when it advances."""
    at, beyond = state.get if state.exists else (0, [])
    ahead = set(beyond)
    for p in parts:
        ahead.update(int(i) for i in p.loc[p["done"], "idx"] if i >= at)
    start = at
    while at in ahead:
        ahead.remove(at)
        at += 1
    first = not state.exists
    state.update((at, sorted(ahead)))
    if at > start or first:
        yield pd.DataFrame({"file": [key[0]], "frontier": [at]})


def frontier_updates(parts: DataFrame) -> DataFrame:
    """(file, frontier) updates of a stream of (file, idx, done)."""
    return parts.groupBy("file").applyInPandasWithState(advance, "file long, frontier long", "frontier long, beyond array<long>", "append", GroupStateTimeout.NoTimeout)


def frontiers(spark: SparkSession, path: str) -> DataFrame:
    s = parquet_stream(spark, path).select((F.col("event_id") % 20).alias("file"), F.floor(F.col("event_id") / 20).alias("idx"), (F.col("event_id") % 97 != 5).alias("done"))
    return _run(frontier_updates(s), "append").groupBy("file").agg(F.max("frontier").alias("frontier"))
