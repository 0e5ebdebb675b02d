"""Chunks, packs, ranges and the directory model."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.operators import chunks, directory, similar
from tidemill.plans.catalog import files, table
from tidemill.plans.duplicates import FILES
from tidemill.plans.registry import query
from tidemill.sources import archives, writers

TARGET = 65536

LINES = FILES + """, raw AS (SELECT entry_idx, string_split(text, chr(10)) AS l FROM files), ex AS (SELECT entry_idx, unnest(range(len(l))) AS pos, l, unnest(l) AS line FROM raw),
lines AS (SELECT entry_idx, CAST(pos AS INTEGER) AS pos, CASE WHEN pos < len(l) - 1 THEN line || chr(10) ELSE line END AS chunk FROM ex),
chunks AS (SELECT entry_idx, pos, CAST(strlen(chunk) AS INTEGER) AS length, sha256(chunk) AS hash, chunk FROM lines WHERE chunk <> '')"""
FIRST = LINES + """, fs AS (SELECT hash, CAST(max(length) AS BIGINT) AS length, min((entry_idx, pos)) AS place FROM chunks GROUP BY hash),
ids AS (SELECT hash, length, place[1] AS entry_idx, row_number() OVER (ORDER BY place) - 1 AS chunk_id, CAST(sum(length) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS start FROM fs)"""


def _lines(spark, sf_dir):
    return chunks.line_chunks(files(spark, sf_dir))


def _ids(spark, sf_dir):
    return chunks.numbered(chunks.first_seen(_lines(spark, sf_dir)))


@query(LINES + " SELECT entry_idx, pos, length, hash FROM chunks")
def line_chunks(spark, sf_dir):
    return _lines(spark, sf_dir).drop("chunk")


@query(FILES + """, b AS (SELECT entry_idx, text, unnest(range(CAST(ceil(length(text) / 256.0) AS BIGINT))) AS pos FROM files WHERE text <> ''), c AS (SELECT entry_idx, CAST(pos AS INTEGER) AS pos, substring(text, pos * 256 + 1, 256) AS chunk FROM b)
SELECT entry_idx, pos, CAST(strlen(chunk) AS INTEGER) AS length, sha256(chunk) AS hash FROM c""")
def fixed_chunks(spark, sf_dir):
    return chunks.fixed_chunks(files(spark, sf_dir)).drop("chunk")


@query(LINES + """, f AS (SELECT entry_idx, pos, chunk, CAST(('0x' || substr(md5(chunk), 1, 2)) AS INTEGER) % 8 = 0 AS last FROM chunks),
n AS (SELECT *, coalesce(sum(CAST(last AS INTEGER)) OVER (PARTITION BY entry_idx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM f),
g AS (SELECT entry_idx, CAST(no AS INTEGER) AS pos, string_agg(chunk, '' ORDER BY pos) AS chunk FROM n GROUP BY entry_idx, no)
SELECT entry_idx, pos, CAST(strlen(chunk) AS INTEGER) AS length, sha256(chunk) AS hash FROM g""")
def line_cdc_chunks(spark, sf_dir):
    return chunks.line_cdc_chunks(files(spark, sf_dir))


@query("SELECT source || '/' || doc_id || '.txt' AS path, true AS same FROM documents WHERE doc_id % 20 = 0 AND text IS NOT NULL")
def archive_roundtrip(spark, sf_dir):
    """Documents written as an archive with compression and read back by the archive source.

    A row without a source is an entry that is named by its id alone. Entries of
    one name are held against those read back in order of content.
    """
    archives.register(spark)
    d = table(spark, sf_dir, "documents").where("doc_id % 20 = 0 and text is not null")
    file = F.concat(F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    path = F.concat("source", file)
    e = d.select(path.alias("path"), F.ltrim(F.coalesce(path, file), F.lit("/")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    folder = similar.shared_folder(spark).removeprefix("file://")
    made = f"{folder}/tidemill-{uuid.uuid4().hex}.tar.zst"
    os.makedirs(folder, exist_ok=True)
    writers.create(e.select(F.col("name").alias("path"), "content"), made, "tar/zstd")
    nth = lambda by: F.row_number().over(Window.partitionBy("name").orderBy(by))
    back = spark.read.format("archive").option("content", "true").load(made).select(F.col("raw_path").alias("name"), F.col("content").alias("again"))
    j = e.withColumn("n", nth("content")).join(back.withColumn("n", nth("again")), ["name", "n"], "left")
    return j.select("path", F.coalesce(F.col("again") == F.col("content"), F.lit(False)).alias("same"))


@query("WITH RECURSIVE" + FILES[4:] + """, e AS (SELECT entry_idx // 256 AS archive, entry_idx AS index, size, entry_idx % 50 > 40 AS stored, row_number() OVER (PARTITION BY entry_idx // 256 ORDER BY entry_idx) AS rn FROM files),
f AS (SELECT archive, index, size, stored, rn, CAST(0 AS INTEGER) AS block, CAST(size AS HUGEINT) AS bytes, 1 AS n FROM e WHERE rn = 1
  UNION ALL SELECT e.archive, e.index, e.size, e.stored, e.rn, CASE WHEN c.new THEN f.block + 1 ELSE f.block END, CASE WHEN c.new THEN CAST(e.size AS HUGEINT) ELSE f.bytes + e.size END, CASE WHEN c.new THEN 1 ELSE f.n + 1 END
  FROM f JOIN e ON e.archive = f.archive AND e.rn = f.rn + 1, LATERAL (SELECT e.stored <> f.stored OR f.bytes >= 65536 OR f.n >= 40 AS new) c)
SELECT archive, index, size, stored, block FROM f""")
def solid_blocks(spark, sf_dir):
    """Blocks of archives of 256 entries: at most 40 entries and what reaches 64 KiB, one method each."""
    f = files(spark, sf_dir)
    return chunks.solid_blocks(f.select(F.col("entry_idx").alias("index"), "size", (F.col("entry_idx") % 50 > 40).alias("stored")), 65536, 40, F.floor(F.col("index") / 256))


_EST = """ SELECT (SELECT count(DISTINCT entry_idx) FROM chunks) AS files, count(*) AS chunks, count(DISTINCT hash) AS distinct_chunks, CAST(sum(length) AS BIGINT) AS total_bytes,
  CAST((SELECT sum(m) FROM (SELECT max(length) AS m FROM chunks GROUP BY hash)) AS BIGINT) AS unique_bytes, CAST(sum(length) - (SELECT sum(m) FROM (SELECT max(length) AS m FROM chunks GROUP BY hash)) AS BIGINT) AS saved FROM chunks"""


@query(LINES + _EST)
def dedup_estimate(spark, sf_dir):
    return chunks.estimate(_lines(spark, sf_dir))


@query()
def cdc_chunks(spark, sf_dir):
    return chunks.cdc_chunks(files(spark, sf_dir))


@query()
def cdc_estimate(spark, sf_dir):
    return chunks.estimate(chunks.cdc_chunks(files(spark, sf_dir)))


@query(LINES + ", n AS (SELECT count(DISTINCT hash) AS n FROM chunks) SELECT true AS close FROM n")
def approx_distinct(spark, sf_dir):
    c = _lines(spark, sf_dir)
    both = chunks.approx_unique(c).crossJoin(c.agg(F.count_distinct("hash").alias("n")))
    return both.select((F.abs(F.col("approx_distinct") - F.col("n")) <= 0.1 * F.col("n")).alias("close"))


@query(FIRST + " SELECT hash, length, chunk_id, start FROM ids")
def chunk_first_seen(spark, sf_dir):
    return _ids(spark, sf_dir).select("hash", "length", "chunk_id", "start")


SHARD = 64  # entries that one writer packs
_FOLD = f"""WITH RECURSIVE {FIRST[5:]}, sh AS (SELECT *, entry_idx // {SHARD} AS shard FROM ids),
nxt AS (SELECT i.shard, i.chunk_id, min(j.chunk_id) AS last FROM sh i LEFT JOIN sh j ON j.shard = i.shard AND j.start + j.length >= i.start + {TARGET} GROUP BY i.shard, i.chunk_id),
heads AS (SELECT n.shard, 0 AS pack_id, n.chunk_id AS head, n.last FROM nxt n WHERE n.chunk_id = (SELECT min(chunk_id) FROM sh WHERE sh.shard = n.shard)
  UNION ALL SELECT h.shard, h.pack_id + 1, n.chunk_id, n.last FROM heads h JOIN nxt n ON n.shard = h.shard AND n.chunk_id = h.last + 1),
packed AS (SELECT CAST(i.shard AS BIGINT) AS shard, i.chunk_id, i.length, CAST(h.pack_id AS INTEGER) AS pack_id FROM sh i JOIN heads h ON i.shard = h.shard AND i.chunk_id >= h.head AND i.chunk_id <= coalesce(h.last, 9223372036854775807))"""


def _packed(spark, sf_dir):
    """Each range of entries is packed by a task of its own."""
    return chunks.assign_packs(_ids(spark, sf_dir), TARGET, F.floor(F.col("entry_idx") / SHARD))


@query(_FOLD + " SELECT * FROM packed")
def pack_assign(spark, sf_dir):
    return _packed(spark, sf_dir)


@query(_FOLD + " SELECT shard, pack_id, count(*) AS n_chunks, CAST(sum(length) AS BIGINT) AS raw_len FROM packed GROUP BY shard, pack_id")
def pack_stats(spark, sf_dir):
    return chunks.pack_stats(_packed(spark, sf_dir))


@query(FIRST + " SELECT c.entry_idx, c.pos, i.chunk_id, c.length FROM chunks c JOIN ids i ON i.hash = c.hash")
def entry_chunk_map(spark, sf_dir):
    return chunks.entry_map(_lines(spark, sf_dir), _ids(spark, sf_dir))


@query(FILES + " SELECT entry_idx, hex(encode(text)[101:300]) AS data FROM files WHERE size > 100")
def read_range(spark, sf_dir):
    return chunks.read_range(_lines(spark, sf_dir), 100, 200)


@query("SELECT CAST(0 AS BIGINT) AS mismatches, count(*) FILTER (WHERE text <> '') AS entries FROM documents")
def reconstruct_check(spark, sf_dir):
    built = chunks.reconstruct(_lines(spark, sf_dir)).withColumnRenamed("text", "built")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_idx"), "text").where("text <> ''")
    j = d.join(built, "entry_idx", "left")
    return j.agg(F.count_if(~F.coalesce(F.col("text") == F.col("built"), F.lit(False))).alias("mismatches"), F.count("*").alias("entries"))


@query("WITH RECURSIVE" + FIRST[4:] + """, m AS (SELECT c.entry_idx, c.pos, c.length, i.chunk_id // 8 AS pack_id FROM chunks c JOIN ids i ON i.hash = c.hash),
o AS (SELECT *, sum(length) OVER (PARTITION BY entry_idx) AS total, sum(length) OVER (PARTITION BY entry_idx ORDER BY pos ROWS UNBOUNDED PRECEDING) - length AS start, lag(pack_id) OVER (PARTITION BY entry_idx ORDER BY pos) AS prev, row_number() OVER (PARTITION BY entry_idx ORDER BY pos) AS rn FROM m),
f AS (SELECT entry_idx, pos, length, total, rn, start, CAST(0 AS INTEGER) AS split, CAST(0 AS HUGEINT) AS base FROM o WHERE rn = 1
  UNION ALL SELECT o.entry_idx, o.pos, o.length, o.total, o.rn, o.start, CASE WHEN o.total >= 1024 AND o.pack_id <> o.prev AND o.start - f.base >= 512 THEN f.split + 1 ELSE f.split END,
    CASE WHEN o.total >= 1024 AND o.pack_id <> o.prev AND o.start - f.base >= 512 THEN CAST(o.start AS HUGEINT) ELSE f.base END FROM f JOIN o ON o.entry_idx = f.entry_idx AND o.rn = f.rn + 1)
SELECT entry_idx, split, min(pos) AS first_pos, CAST(sum(length) AS BIGINT) AS bytes FROM f GROUP BY entry_idx, split""")
def entry_splits(spark, sf_dir):
    m = chunks.entry_map(_lines(spark, sf_dir), _ids(spark, sf_dir)).withColumn("pack_id", F.floor(F.col("chunk_id") / 8))
    return chunks.entry_splits(m, 512, 1024)


_ENTRIES = "SELECT doc_id AS index, (CASE WHEN doc_id % 5 = 0 THEN upper(source) ELSE source END) || '/' || lang || '/' || (doc_id % 40) || CASE WHEN doc_id % 9 = 0 THEN '' ELSE '/f' || doc_id || '.txt' END AS path, CAST(strlen(text) AS BIGINT) AS size FROM documents"
_MODEL = f"""WITH e AS ({_ENTRIES}), p AS (SELECT index, size, path, string_split(path, '/') AS s FROM e),
up AS (SELECT index, s, unnest(range(1, len(s))) AS i FROM p), anc AS (SELECT array_to_string(s[1:i], '/') AS path, min(index) AS index FROM up GROUP BY 1),
b AS (SELECT lower(path) AS fold, path, index, true AS is_dir, CAST(0 AS BIGINT) AS size FROM anc UNION ALL SELECT lower(path), path, index, false, size FROM e),
r AS (SELECT *, bool_or(is_dir) OVER (PARTITION BY fold) AS dir, row_number() OVER (PARTITION BY fold ORDER BY index, length(path), path) AS rn FROM b),
model AS (SELECT fold, path, dir AS is_dir, CASE WHEN dir THEN 0 ELSE size END AS size, index FROM r WHERE rn = 1)"""


def _entries(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    src = F.when(F.col("doc_id") % 5 == 0, F.upper("source")).otherwise(F.col("source"))
    tail = F.when(F.col("doc_id") % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("/f"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return d.select(F.col("doc_id").alias("index"), F.concat(src, F.lit("/"), "lang", F.lit("/"), (F.col("doc_id") % 40).cast("string"), tail).alias("path"), F.octet_length("text").cast("long").alias("size"))


@query(_MODEL + " SELECT * FROM model")
def dir_lookup(spark, sf_dir):
    return directory.build(_entries(spark, sf_dir))


@query(_MODEL + " SELECT regexp_extract(fold, '^(.*)/[^/]*$', 1) AS parent, split_part(path, '/', -1) AS name, is_dir, size FROM model")
def dir_tree(spark, sf_dir):
    return directory.children(directory.build(_entries(spark, sf_dir)))


@query(_MODEL + " SELECT count(*) FILTER (WHERE is_dir) AS dirs, count(*) FILTER (WHERE NOT is_dir) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM model")
def dir_totals(spark, sf_dir):
    return directory.totals(directory.build(_entries(spark, sf_dir)))


@query(f"WITH e AS ({_ENTRIES}), p AS (SELECT size, string_split(path, '/') AS s FROM e), up AS (SELECT size, s, unnest(range(1, len(s))) AS i FROM p) SELECT array_to_string(s[1:i], '/') AS path, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM up GROUP BY 1")
def dir_sizes(spark, sf_dir):
    return directory.subtree_sizes(_entries(spark, sf_dir))
