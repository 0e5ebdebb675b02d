"""Discovery documents: mirror lists in headers and XML, checksum manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, source, ord): targets of rel=duplicate in a Link header, in order; http and https only."""
    items = F.regexp_extract_all(F.col(col), F.lit("<[^>]*>[^<]*"), 0)
    dup = F.filter(items, lambda x: x.rlike("(?i);\\s*rel\\s*=\\s*\"?duplicate\"?") & x.rlike("(?i)^<https?://"))
    return df.select(key, F.posexplode(F.transform(dup, lambda x: F.regexp_extract(x, "^<([^>]*)>", 1))).alias("ord", "source")).select(key, "source", "ord")


def metalinks(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, source, size, sha256) of Metalink XML, versions 3 and 4; other schemes than http(s) are dropped."""
    x = F.col(col)
    urls = F.filter(F.xpath(x, F.lit("//*[local-name()='url']/text()")), lambda u: u.rlike("(?i)^https?://"))
    size = F.xpath_string(x, F.lit("//*[local-name()='size']"))
    sha = F.lower(F.trim(F.xpath_string(x, F.lit("//*[local-name()='hash'][@type='sha-256' or @type='sha256']"))))
    return df.select(key, F.explode(urls).alias("source"), F.when(size.rlike("^[0-9]{1,18}$"), size).cast("long").alias("size"), F.when(sha.rlike("^[0-9a-f]{64}$"), sha).alias("sha256"))


def manifest(df: DataFrame, col: str) -> DataFrame:
    """(name, sha256) from the lines of a checksum manifest; lines of another shape are passed over."""
    line = df.select(F.explode(F.split(F.col(col), "\r?\n")).alias("l"))
    pat = "^([0-9a-fA-F]{64}) [ *](.+)$"
    return line.where(F.col("l").rlike(pat)).select(F.regexp_extract("l", pat, 2).alias("name"), F.lower(F.regexp_extract("l", pat, 1)).alias("sha256"))


def sha256_ok(content: Column, expected: Column) -> Column:
    return F.lower(F.trim(expected)) == F.sha2(content, 256)
