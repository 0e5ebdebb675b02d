"""From raw documents to packed training sequences.

STAGES are applied in order; the result of each is written as Parquet and
reread as the documents of the next. All but the last return the columns of
documents.

1. toxicity: documents that the class-conditional models reject go.
2. near_dedup: of each group of near-duplicates the one of least id stays. Rows
   of one id with different texts are judged each; of equal ones one stays.
3. substring_dedup: passages that an earlier document has too are cut out; a
   document of which no word is left goes. n_chars follows the text.
4. mixing: each source's documents are scheduled by its weight over time, so
   a source above its target weight gives up its last documents and one below
   it is repeated; rows come in order of training position.
5. packing: one row per piece of a document with its bin and place there.

Null texts, null ids and empty tables pass through every stage; what each
operator does with them is said in its module. A stage deletes the scratch
tables of the stages before it, so write each result before the next call.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm import minhash, mixing, packing, passages, toxicity
from tidemill.llm.common import Numbers, cut, fresh, read, release

WORK = "pipeline"
ID = "doc_id"


def _columns(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in like.columns])


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(WORK)
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(WORK)
    numbers = Numbers(docs, ID, WORK)
    u, rn = fresh(docs, "__tm_u"), fresh(docs, "__tm_rn")
    again = cut(docs.groupBy(F.col(ID).alias("__tm_id")).count().where("count > 1 and __tm_id is not null").select("__tm_id"), WORK)
    rows = numbers.number(docs, ID, u)
    if not again.isEmpty():
        # of a repeated id the least text keeps it as its key, each other one gets a key above all ids
        once = rows.join(again, rows[ID] == again["__tm_id"], "left_anti")
        few = rows.join(again, rows[ID] == again["__tm_id"], "left_semi").withColumn(rn, F.row_number().over(Window.partitionBy(ID, "text").orderBy(ID))).where(F.col(rn) == 1)
        least = F.col("text") == F.min("text").over(Window.partitionBy(ID))
        few = few.withColumn(u, F.when(least, F.col(u)).otherwise(F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(ID, "text"), 3)))
        rows = once.unionByName(few.drop(rn))
    gone = minhash.near_duplicates(rows, id_col=u, owner=WORK).where("id <> root").select(F.col("id").alias("__tm_g"))
    return _columns(rows.join(gone, rows[u] == gone["__tm_g"], "left_anti"), docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(WORK)
    return passages.without_repeats(docs, owner=WORK)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(WORK)
    return mixing.mix(docs, owner=WORK, only_docs=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(WORK)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixed),
    ("packing", packed),
]

#: Stages 1 to 3 and 5 can't be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        owner = f"pipeline-{name}"
        release(owner)
        docs = cut(stage(spark, docs, sf_dir), owner)
        if before:
            release(before)  # the stage after has been written
        before = owner
    return STAGES[-1][1](spark, docs, sf_dir)
