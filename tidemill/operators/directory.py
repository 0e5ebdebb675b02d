"""Directory model of flat entries: ancestors, first-wins lookup, children, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ancestors(entries: DataFrame) -> DataFrame:
    """(path, index) of every directory above an entry; index: the first entry that implies it."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return entries.where(F.size(parts) > 1).select("index", F.explode(up).alias("path")).groupBy("path").agg(F.min("index").alias("index"))


def build(entries: DataFrame) -> DataFrame:
    """fold, path, is_dir, size, index: one row per case-folded path, the first spelling wins.

    entries: (index, path, size). A path that has children is a directory of
    size 0, whatever entry has that name.
    """
    dirs = ancestors(entries).select(F.lower("path").alias("fold"), "path", "index").withColumn("is_dir", F.lit(True))
    files = entries.select(F.lower("path").alias("fold"), "path", "index", "size").withColumn("is_dir", F.lit(False))
    both = dirs.withColumn("size", F.lit(0).cast("long")).unionByName(files)
    w = Window.partitionBy("fold")
    picked = both.withColumn("dir", F.max("is_dir").over(w)).withColumn("rn", F.row_number().over(w.orderBy("index", F.length("path"), "path"))).where("rn = 1")
    return picked.select("fold", "path", F.col("dir").alias("is_dir"), F.when(F.col("dir"), F.lit(0)).otherwise(F.col("size")).cast("long").alias("size"), "index")


def children(model: DataFrame) -> DataFrame:
    """parent (folded), name, is_dir, size."""
    return model.select(F.regexp_extract("fold", "^(.*)/[^/]*$", 1).alias("parent"), F.element_at(F.split("path", "/"), -1).alias("name"), "is_dir", "size")


def subtree_sizes(entries: DataFrame) -> DataFrame:
    """path, n_files, bytes of everything below each directory."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return entries.where(F.size(parts) > 1).select(F.explode(up).alias("path"), "size").groupBy("path").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


def totals(model: DataFrame) -> DataFrame:
    return model.agg(F.count_if("is_dir").alias("dirs"), F.count_if(~F.col("is_dir")).alias("files"), F.sum("size").alias("bytes"))


def parse_registry(texts: DataFrame) -> DataFrame:
    """archive, root, writable from blank-line separated key=value records; bad lines cost only themselves."""
    rec = texts.select(F.explode(F.split(F.regexp_replace("text", "\r", ""), "\n[ \t]*\n")).alias("rec"))
    lines = F.filter(F.split("rec", "\n"), lambda x: ~F.startswith(F.ltrim(x), F.lit("#")) & x.rlike("^[ \t]*[A-Za-z_]+[ \t]*="))

    def field(k: str):
        mine = F.filter(lines, lambda x: x.rlike(f"^[ \t]*{k}[ \t]*="))
        return F.when(F.size(mine) > 0, F.trim(F.regexp_replace(F.element_at(mine, -1), "^[^=]*=", "")))

    got = rec.select(*[field(k).alias(k) for k in ("archive", "root", "writable")])
    return got.where("archive is not null and root is not null").withColumn("writable", F.coalesce(F.lower("writable").isin("true", "1", "yes"), F.lit(False)))


def upsert(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Registry with the new rows in place of those of the same root."""
    return registry.join(new.select("root"), "root", "left_anti").select(registry.columns).unionByName(new)
