"""Paths, formats and compressibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import formats, paths, probe
from tidemill.plans.catalog import files, table
from tidemill.plans.duplicates import FILES
from tidemill.plans.registry import query

_BARE = "regexp_replace(url, '^[a-z]+://', '')"
_PARTS = "list_filter(string_split(replace({0}, '\\', '/'), '/'), lambda c: c NOT IN ('', '.'))"


def _safe(col: str) -> str:
    p = _PARTS.format(col)
    return f"CASE WHEN len({p}) BETWEEN 1 AND 4096 AND NOT list_bool_or([false] || list_transform({p}, lambda c: c = '..' OR contains(c, ':') OR contains(c, chr(0)))) THEN array_to_string({p}, '/') END"


@query(f"SELECT page_id, {_safe(_BARE)} AS safe, {_safe('url')} AS with_scheme, {_safe(_BARE + chr(32) + chr(124) + chr(124) + chr(32) + chr(39) + '/../x' + chr(39))} AS climbing FROM pages")
def path_sanitize(spark, sf_dir):
    bare = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select("page_id", paths.sanitize(bare).alias("safe"), paths.sanitize(F.col("url")).alias("with_scheme"), paths.sanitize(F.concat(bare, F.lit("/../x"))).alias("climbing"))


@query(FILES + " SELECT path, '/quarantine/' || array_to_string(list_filter(string_split(path, '/'), lambda c: c NOT IN ('', '.', '..')), '/') AS dest FROM files")
def quarantine_dest(spark, sf_dir):
    return files(spark, sf_dir).select("path", paths.quarantine_dest(F.lit("/quarantine"), F.col("path")).alias("dest"))


_EXTS = "jpg txt mp4 rs gz tar ts unknownext m2ts tsx JPG".split()


def _renamed(spark, sf_dir):
    e = F.element_at(F.array(*[F.lit(x) for x in _EXTS]), (F.col("entry_idx") % len(_EXTS) + 1).cast("int"))
    return files(spark, sf_dir).withColumn("path", F.regexp_replace("path", "txt$", "")).withColumn("path", F.concat("path", e))


_RENAMED = FILES + f", named AS (SELECT entry_idx, text, size, regexp_replace(path, 'txt$', '') || ([{', '.join(repr(x) for x in _EXTS)}])[entry_idx % {len(_EXTS)} + 1] AS path FROM files)"
_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_VERDICT = f"CASE WHEN lower(regexp_extract(path, '\\.([^./]*)$', 1)) IN {_LIST(probe.STORE)} THEN 'store' WHEN lower(regexp_extract(path, '\\.([^./]*)$', 1)) IN {_LIST(probe.COMPRESS)} THEN 'compress' END"


@query(_RENAMED + f" SELECT path, {_VERDICT} AS verdict FROM named")
def ext_verdict(spark, sf_dir):
    return _renamed(spark, sf_dir).select("path", probe.ext_verdict(F.col("path")).alias("verdict"))


_BITS = """, b AS (SELECT path, size, unnest(regexp_extract_all(hex(encode(text)), '..')) AS v FROM {0}), c AS (SELECT path, any_value(size) AS size, v, CAST(count(*) AS DOUBLE) AS n FROM b GROUP BY path, v),
e AS (SELECT path, log2(CAST(any_value(size) AS DOUBLE)) - sum(n * log2(n)) / any_value(size) AS bits FROM c GROUP BY path)"""


@query(FILES + _BITS.format("files") + " SELECT f.path, CAST(round(coalesce(bits, 0) * 1000000) AS BIGINT) AS microbits FROM files f LEFT JOIN e ON e.path = f.path")
def entropy(spark, sf_dir):
    return probe.entropy(files(spark, sf_dir)).select("path", F.round(F.col("bits") * 1_000_000).cast("long").alias("microbits"))


@query(_RENAMED + _BITS.format("named") + f""", v AS (SELECT n.size, CASE WHEN n.size = 0 THEN 'compress' WHEN {_VERDICT.replace('path', 'n.path')} IS NOT NULL THEN {_VERDICT.replace('path', 'n.path')} WHEN n.size < 512 THEN 'compress' WHEN bits >= 7.8 THEN 'store' ELSE 'compress' END AS verdict FROM named n LEFT JOIN e ON e.path = n.path)
SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS total_bytes, count(*) FILTER (WHERE verdict = 'store') AS store_files, CAST(coalesce(sum(size) FILTER (WHERE verdict = 'store'), 0) AS BIGINT) AS store_bytes,
  coalesce(sum(size) FILTER (WHERE verdict = 'store'), 0) * 10 >= sum(size) * 9 AS mostly_incompressible FROM v""")
def probe_summary(spark, sf_dir):
    return probe.summary(probe.verdicts(probe.entropy(_renamed(spark, sf_dir))))


_HEADS = "504B0304 526172211A0700 377ABCAF271C 1F8B08 28B52FFD 425A68 FD377A585A00 04224D18 00112233".split()
_NAMES = "a.tar.gz b.zip c.tgz d.tar e.bin f.gz g.tar.xz h.tar.zst".split()


@query(f"""WITH h AS (SELECT doc_id, ([{', '.join(repr(x) for x in _HEADS)}])[doc_id % {len(_HEADS)} + 1] AS head, ([{', '.join(repr(x) for x in _NAMES)}])[doc_id % {len(_NAMES)} + 1] AS name FROM documents),
m AS (SELECT *, CASE head WHEN '504B0304' THEN 'zip/none' WHEN '526172211A0700' THEN 'rar/none' WHEN '377ABCAF271C' THEN '7z/none' WHEN '1F8B08' THEN 'raw/gzip' WHEN '28B52FFD' THEN 'raw/zstd' WHEN '425A68' THEN 'raw/bzip2' WHEN 'FD377A585A00' THEN 'raw/xz' WHEN '04224D18' THEN 'raw/lz4' END AS magic,
  CASE name WHEN 'a.tar.gz' THEN 'tar/gzip' WHEN 'b.zip' THEN 'zip/none' WHEN 'c.tgz' THEN 'tar/gzip' WHEN 'd.tar' THEN 'tar/none' WHEN 'f.gz' THEN 'raw/gzip' WHEN 'g.tar.xz' THEN 'tar/xz' WHEN 'h.tar.zst' THEN 'tar/zstd' END AS named FROM h)
SELECT doc_id, name, CASE WHEN starts_with(named, 'tar/') AND starts_with(magic, 'raw/') AND split_part(named, '/', 2) = split_part(magic, '/', 2) THEN named ELSE coalesce(magic, named) END AS format FROM m""")
def sniff_format(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    at = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("doc_id") % len(xs) + 1).cast("int"))
    h = d.select("doc_id", at(_NAMES).alias("name"), F.concat(F.unhex(at(_HEADS)), F.encode(F.substring("text", 1, 300), "UTF-8")).alias("content"))
    return h.select("doc_id", "name", formats.sniff(F.col("name"), F.col("content")).alias("format"))


@query(FILES + ", n AS (SELECT entry_idx, CASE entry_idx % 4 WHEN 0 THEN '/x/Copy of a.txt' WHEN 1 THEN '/x/a (2).txt' WHEN 2 THEN '/x/duplicate' ELSE '/copy/plain.txt' END AS path FROM files) SELECT entry_idx, path, (entry_idx % 4) < 3 AS is_copy FROM n")
def copy_names(spark, sf_dir):
    p = F.element_at(F.array(*[F.lit(x) for x in ("/x/Copy of a.txt", "/x/a (2).txt", "/x/duplicate", "/copy/plain.txt")]), (F.col("entry_idx") % 4 + 1).cast("int"))
    return files(spark, sf_dir).select("entry_idx", p.alias("path")).withColumn("is_copy", paths.looks_like_copy(F.col("path")))


@query("SELECT page_id, split_part(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', ''), '/', -1) AS name FROM pages")
def url_filename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.url_filename(F.col("url")).alias("name"))


@query(FILES + """ SELECT path, CASE WHEN size >= 1048576 THEN printf('%.2f MiB', size / 1048576.0) WHEN size >= 1024 THEN printf('%.2f KiB', size / 1024.0) ELSE size || ' B' END AS human FROM files WHERE size % 1024 NOT BETWEEN 1 AND 1023 OR size < 1024""")
def bytes_human(spark, sf_dir):
    return files(spark, sf_dir).where("size % 1024 = 0 or size < 1024").select("path", paths.bytes_human(F.col("size")).alias("human"))


@query("SELECT doc_id, 'bytes ' || doc_id * 10 || '-' || (doc_id * 10 + 9) || '/*' AS value, doc_id * 10 AS first_byte FROM documents")
def content_range(spark, sf_dir):
    v = F.concat(F.lit("bytes "), (F.col("doc_id") * 10).cast("string"), F.lit("-"), (F.col("doc_id") * 10 + 9).cast("string"), F.lit("/*"))
    return table(spark, sf_dir, "documents").select("doc_id", v.alias("value")).withColumn("first_byte", paths.content_range_start(F.col("value")))


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 > 0 THEN make_timestamp(CAST(1980 + o_orderkey % 100 AS BIGINT), CAST(1 + o_orderkey % 12 AS BIGINT), CAST(1 + o_orderkey % 28 AS BIGINT), CAST(o_orderkey % 24 AS BIGINT), CAST(o_orderkey % 60 AS BIGINT), CAST((o_orderkey % 30) * 2 AS DOUBLE)) END AS VARCHAR) AS mtime FROM orders")
def zip_mtime(spark, sf_dir):
    k = F.col("o_orderkey")
    date = F.shiftleft((k % 100).cast("int"), 9).bitwiseOR(F.shiftleft((1 + k % 12).cast("int"), 5)).bitwiseOR((1 + k % 28).cast("int"))
    time = F.shiftleft((k % 24).cast("int"), 11).bitwiseOR(F.shiftleft((k % 60).cast("int"), 5)).bitwiseOR((k % 30).cast("int"))
    t = paths.zip_mtime(F.when(k % 5 > 0, date).otherwise(0), time)
    return table(spark, sf_dir, "orders").select("o_orderkey", t.cast("string").alias("mtime"))


@query("SELECT page_id, regexp_replace(url, '^([a-z]+)://.*$', '\\1') || '/v' || page_id % 3 || '.' || page_id % 7 || '.' || page_id AS tag, CAST(page_id % 3 AS INTEGER) AS major, CAST(page_id % 7 AS INTEGER) AS minor, page_id % 3 > 1 OR (page_id % 3 = 1 AND page_id % 7 > 2) OR (page_id % 3 = 1 AND page_id % 7 = 2 AND page_id > 50) AS newer FROM pages")
def version_compare(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    v = F.concat(F.lit("v"), (F.col("page_id") % 3).cast("string"), F.lit("."), (F.col("page_id") % 7).cast("string"), F.lit("."), F.col("page_id").cast("string"))
    k = paths.version_key(v)
    base = paths.version_key(F.lit("1.2.50"))
    return p.select("page_id", F.concat(F.regexp_replace("url", "^([a-z]+)://.*$", "$1"), F.lit("/"), v).alias("tag"), k["col1"].alias("major"), k["col2"].alias("minor"), (k > base).alias("newer"))
