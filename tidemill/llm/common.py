"""Scratch tables, sizing and table access for the training-data operators."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWNED: dict[str, list[tuple[SparkSession, str]]] = {}
_LOCAL: list[tempfile.TemporaryDirectory] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the cluster.

    Only where neither that setting nor a checkpoint folder is present (local
    tests) a temporary folder of this machine is used.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="tidemill-"))
    return f"file://{_LOCAL[0].name}"


def cut(df: DataFrame, owner: str = "query") -> DataFrame:
    """Write df once to the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of executors, and computes
    df a single time however often the result is used.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemill-{uuid.uuid4().hex}"
    _OWNED.setdefault(owner, []).append((spark, path))
    df.write.parquet(path)
    # the shuffles behind the table are not needed any more: let Spark find them unreferenced and delete their files
    del df
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()
    return spark.read.parquet(path)


def release(owner: str | None = None) -> None:
    """Delete the tables that cut() wrote for this owner (all, without one)."""
    for key in [owner] if owner else list(_OWNED):
        for spark, path in _OWNED.pop(key, []):
            jvm = spark.sparkContext._jvm
            if jvm is None:
                continue
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _at_exit() -> None:
    try:
        release()
    except Exception:  # the JVM is already gone
        pass


atexit.register(_at_exit)

def fresh(df: DataFrame, name: str) -> str:
    """A name like this one that df has no column of."""
    while name in df.columns:
        name += "_"
    return name


class Numbers:
    """Long numbers for the ids of df, in the order of the ids, whatever their type.

    Integral ids are their own numbers. Others are numbered once by a range sort
    and written to the shared folder; monotonic numbers of sorted partitions
    keep the order.
    """

    def __init__(self, df: DataFrame, id_col: str, owner: str = "query"):
        self.kind = df.schema[id_col].dataType.simpleString()
        self.table = None
        if self.kind not in ("tinyint", "smallint", "int", "bigint"):
            ids = df.select(F.col(f"`{id_col}`").alias("__tm_id")).where("__tm_id is not null").distinct().orderBy("__tm_id")
            self.table = cut(ids.withColumn("__tm_no", F.monotonically_increasing_id()), owner)
        self.plain = self.kind if self.table is not None else "bigint"

    def number(self, df: DataFrame, id_col: str, name: str) -> DataFrame:
        """df with the number of its id as a further column; null for a null id."""
        if self.table is None:
            return df.withColumn(name, F.col(f"`{id_col}`").cast("long"))
        table = self.table.toDF("__tm_id", name)
        return df.join(table, df[id_col] == table["__tm_id"], "left").select(*[df[f"`{c}`"] for c in df.columns], table[name])

    def name(self, df: DataFrame, number: str, id_col: str, plain: bool = False) -> DataFrame:
        """df with ids in place of the column of numbers; integral ones in their own type, or, plain, as long."""
        if self.table is None:
            return df.withColumn(number, F.col(number).cast("long" if plain else self.kind)).withColumnRenamed(number, id_col)
        return df.join(self.table.select(F.col("__tm_no").alias("__tm_m"), F.col("__tm_id").alias(f"__tm_{id_col}")), F.col(number) == F.col("__tm_m"), "left").drop("__tm_m", number).withColumnRenamed(f"__tm_{id_col}", id_col)


#: A token is a run of characters other than blanks and line ends.
TOKEN_RE = "[^ \\n\\t\\r]+"


def n_tokens(text: str | Column = "text") -> Column:
    """Tokens of a text; 0 for a null or empty one."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(TOKEN_RE)), F.lit(0)).cast("long")


N_TOKENS_SQL = "coalesce(len(regexp_extract_all(text, '[^ \\n\\t\\r]+')), 0)"
