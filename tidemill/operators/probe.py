"""Is content worth compressing? Extension verdicts, entropy, summaries, codec plans."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.paths import extension

STORE = "jpg jpeg png gif webp heic avif mp3 aac ogg opus flac m4a mp4 mkv mov avi webm m2ts zip gz tgz bz2 xz zst lz4 br 7z rar jar apk docx xlsx pptx epub woff woff2".split()
COMPRESS = "txt md csv tsv json xml html htm css js tsx jsx rs c h cpp hpp py java go rb sh toml yaml yml ini log sql tex svg bmp wav tiff tar iso pdb".split()
IMAGES = "jpg jpeg png gif bmp webp tif tiff heic avif ico pnm".split()
MIN_SAMPLE, STORE_ENTROPY, STORE_RATIO = 512, 7.8, 0.95


def ext_verdict(path: Column) -> Column:
    e = extension(path)
    return F.when(e.isin(STORE), "store").when(e.isin(COMPRESS), "compress")


def is_jpeg(path: Column) -> Column:
    return extension(path).isin("jpg", "jpeg", "jpe", "jfif")


def is_image(path: Column) -> Column:
    return extension(path).isin(IMAGES)


def byte_entropy(data: bytes | None) -> float:
    """Shannon entropy in bits per byte; 0 for nothing."""
    if not data:
        return 0.0
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    n = n[n > 0]
    return float(np.log2(n.sum()) - (n * np.log2(n)).sum() / n.sum())


def entropy(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, size, bits) of each content: one histogram per row in Arrow batches, no explode and no shuffle."""

    @F.pandas_udf("double")
    def bits(content: pd.Series) -> pd.Series:
        return content.map(byte_entropy).astype(float)

    return files.select(key, "size", bits("content").alias("bits"))


def verdicts(measured: DataFrame) -> DataFrame:
    """Verdict by extension, size and entropy for (path, size, bits)."""
    by_ext = ext_verdict(F.col("path"))
    v = F.when(F.col("size") == 0, "compress").when(by_ext.isNotNull(), by_ext).when(F.col("size") < MIN_SAMPLE, "compress").when(F.col("bits") >= STORE_ENTROPY, "store").otherwise("compress")
    return measured.withColumn("verdict", v)


def summary(judged: DataFrame) -> DataFrame:
    """files, bytes, stored share; incompressible when 90 % of the bytes would be stored."""
    stored = F.col("verdict") == "store"
    s = judged.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.count_if(stored).alias("store_files"), F.coalesce(F.sum(F.when(stored, F.col("size"))), F.lit(0)).alias("store_bytes"))
    return s.withColumn("mostly_incompressible", (F.col("total_bytes") > 0) & (F.col("store_bytes") * 10 >= F.col("total_bytes") * 9))


def store_hint(compressed: Column, size: Column) -> Column:
    """Repacking keeps an entry stored that its source could hardly shrink."""
    return compressed.cast("decimal(20,0)") * 100 >= size.cast("decimal(20,0)") * 95
