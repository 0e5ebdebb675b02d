"""Formats: recognition by magic bytes and names, targets, presets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: suffix, container, codec, writable
TARGETS = (
    (".zip", "zip", "none", True),
    (".7z", "7z", "none", True),
    (".rar", "rar", "none", False),
    (".iso", "iso", "none", False),
    (".pack", "pack", "none", True),
    (".tar", "tar", "none", True),
    *((s, "tar", c, True) for s, c in ((".tar.gz", "gzip"), (".tgz", "gzip"), (".tar.xz", "xz"), (".txz", "xz"), (".tar.zst", "zstd"), (".tzst", "zstd"), (".tar.bz2", "bzip2"), (".tbz2", "bzip2"), (".tar.lz4", "lz4"))),
    (".tar.br", "tar", "brotli", False),
    *((s, "raw", c, False) for s, c in ((".gz", "gzip"), (".xz", "xz"), (".zst", "zstd"), (".bz2", "bzip2"), (".lz4", "lz4"), (".br", "brotli"))),
)


def _bytes(hexed: str) -> Column:
    return F.unhex(F.lit(hexed))


def sniff_magic(head: Column) -> Column:
    """container/codec by the first 263 bytes, else null."""
    begins = lambda h: F.substring(head, 1, len(h) // 2) == _bytes(h)
    return (
        F.when(begins("504B0304") | begins("504B0506") | begins("504B0708"), "zip/none")
        .when(begins("526172211A0700") | begins("526172211A0701"), "rar/none")
        .when(begins("377ABCAF271C"), "7z/none")
        .when(begins("4352414D1B01"), "pack/none")
        .when(begins("1F8B08"), "raw/gzip")
        .when(begins("FD377A585A00"), "raw/xz")
        .when(begins("28B52FFD"), "raw/zstd")
        .when(begins("425A68"), "raw/bzip2")
        .when(begins("04224D18"), "raw/lz4")
        .when(F.substring(head, 258, 5) == _bytes("7573746172"), "tar/none")
    )


def sniff_iso(content: Column) -> Column:
    return F.when(F.substring(content, 32770, 5) == _bytes("4344303031"), "iso/none")


def sniff_name(name: Column) -> Column:
    """By suffix, the longest that fits."""
    out = F.lit(None).cast("string")
    for s, c, k, _ in sorted(TARGETS, key=lambda t: len(t[0])):
        out = F.when(F.endswith(F.lower(name), F.lit(s)), f"{c}/{k}").otherwise(out)
    return out


def sniff(name: Column, content: Column) -> Column:
    """Magic wins; a tar name upgrades a bare codec it agrees with; then ISO, then the name."""
    magic, named = sniff_magic(F.substring(content, 1, 263)), sniff_name(name)
    tarred = F.startswith(named, F.lit("tar/")) & (F.split(named, "/")[1] == F.split(magic, "/")[1]) & F.startswith(magic, F.lit("raw/"))
    return F.coalesce(F.when(tarred, named), magic, sniff_iso(content), named)


def targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TARGETS), "suffix string, container string, codec string, writable boolean")


def label(fmt: Column) -> Column:
    c, k = F.split(fmt, "/")[0], F.split(fmt, "/")[1]
    return F.when(c == "raw", k).when((c == "tar") & (k != "none"), F.concat(F.lit("tar."), k)).otherwise(c)


def random_access(fmt: Column) -> Column:
    return F.split(fmt, "/")[0].isin("zip", "pack", "iso") | (fmt == "tar/none")


def writable(fmt: Column) -> Column:
    return fmt.isin(sorted({f"{c}/{k}" for _, c, k, w in TARGETS if w}))


def streamable(fmt: Column) -> Column:
    return F.split(fmt, "/")[0].isin("tar", "zip")


def pack_target(level: Column) -> Column:
    """Bytes at which a pack closes, by level."""
    mib = 1 << 20
    return F.when(level == "fast", 8 * mib).when(level == "auto", 16 * mib).when(level == "small", 32 * mib).when(level == "tiny", 64 * mib - mib // 4).otherwise(16 * mib).cast("long")


def preset(level: Column, codec: Column) -> Column:
    by = {"deflate": (1, 6, 9, 9), "zstd": (1, 3, 19, 22), "xz": (0, 6, 9, 9), "bzip2": (1, 9, 9, 9), "brotli": (2, 6, 11, 11), "lz4": (1, 1, 9, 12)}
    out = F.lit(None).cast("int")
    for k, vals in by.items():
        for lv, v in zip(("fast", "auto", "small", "tiny"), vals, strict=True):
            out = F.when((codec == k) & (level == lv), v).otherwise(out)
    return out


def block_count(fmt: Column, entries: Column) -> Column:
    """Independently decodable units of an archive."""
    return F.when(F.split(fmt, "/")[0].isin("zip", "iso"), entries).otherwise(F.least(entries, F.lit(1)))
