"""Verification, skips, collisions, work order, recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import recovery, verify
from tidemill.plans.catalog import files, table
from tidemill.plans.duplicates import FILES
from tidemill.plans.registry import query


def _entries(spark, sf_dir):
    """Declared sizes and md5 sums, with a fault in every 13th size and every 17th sum; every 5th has no sum."""
    f = files(spark, sf_dir)
    sum_ = F.md5("content")
    return f.select(
        F.col("entry_idx").alias("index"),
        "path",
        (F.col("size") + F.when(F.col("entry_idx") % 13 == 0, 1).otherwise(0)).alias("size"),
        F.when(F.col("entry_idx") % 5 != 0, F.when(F.col("entry_idx") % 17 == 0, F.reverse(sum_)).otherwise(sum_)).alias("sum"),
        F.col("size").alias("got_size"),
        sum_.alias("got_sum"),
    )


_ENTRIES = FILES + """, e AS (SELECT entry_idx AS index, path, size + CASE WHEN entry_idx % 13 = 0 THEN 1 ELSE 0 END AS size, CASE WHEN entry_idx % 5 <> 0 THEN CASE WHEN entry_idx % 17 = 0 THEN reverse(md5(text)) ELSE md5(text) END END AS sum, size AS got_size, md5(text) AS got_sum FROM files),
j AS (SELECT *, CASE WHEN got_size <> size THEN 'size mismatch' WHEN sum IS NOT NULL AND got_sum <> sum THEN 'checksum mismatch' ELSE 'ok' END AS status FROM e)"""


@query(_ENTRIES + """ SELECT count(*) FILTER (WHERE status = 'ok') AS checked, count(*) FILTER (WHERE status = 'ok' AND sum IS NOT NULL) AS sum_verified, CAST(sum(size) FILTER (WHERE status = 'ok') AS BIGINT) AS bytes,
  count(*) FILTER (WHERE status <> 'ok') AS failed, count(*) FILTER (WHERE status = 'ok') > 0 AND count(*) FILTER (WHERE status = 'ok' AND sum IS NOT NULL) = 0 AS content_unverified FROM j""")
def verify_report(spark, sf_dir):
    return verify.report(verify.verdicts(_entries(spark, sf_dir)))


@query(_ENTRIES + " SELECT index, status FROM j WHERE status <> 'ok'")
def verify_failures(spark, sf_dir):
    return verify.failures(verify.verdicts(_entries(spark, sf_dir)))


@query()
def crc_table(spark, sf_dir):
    """CRC-32 (IEEE) of every content."""
    return files(spark, sf_dir).select("path", F.crc32("content").alias("crc"))


@query(_ENTRIES + """, h AS (SELECT path, got_size, got_sum FROM e WHERE index % 3 <> 0)
SELECT e.index, e.path, coalesce(h.got_size = e.size AND h.got_sum = e.sum, false) AS skip FROM e LEFT JOIN h ON h.path = e.path""")
def skip_existing(spark, sf_dir):
    e = _entries(spark, sf_dir)
    have = e.where("index % 3 <> 0").select("path", F.col("got_size").alias("size"), F.col("got_sum").alias("sum"))
    return verify.already_correct(e, have)


@query("SELECT lower(CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END || '/' || doc_id % 300) AS dest, count(*) AS n, max(doc_id) AS winner FROM documents GROUP BY 1 HAVING count(*) > 1")
def dest_collisions(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    p = F.concat(F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.col("source")), F.lit("/"), (F.col("doc_id") % 300).cast("string"))
    return verify.collisions(d.select(F.col("doc_id").alias("index"), p.alias("path")))


@query("""WITH e AS (SELECT doc_id AS index, CAST(strlen(text) AS BIGINT) AS size, CASE WHEN doc_id % 4 > 0 THEN CAST(doc_id % 50 AS VARCHAR) ELSE '#' || doc_id END AS k FROM documents),
w AS (SELECT *, sum(size) OVER (PARTITION BY k) AS weight, min(index) OVER (PARTITION BY k) AS first FROM e)
SELECT index, size, k, CAST(weight AS BIGINT) AS weight, first FROM w ORDER BY weight DESC, first, size DESC, index""")
def work_order(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    e = d.select(F.col("doc_id").alias("index"), F.octet_length("text").cast("long").alias("size"), F.when(F.col("doc_id") % 4 > 0, F.col("doc_id") % 50).alias("key"))
    return verify.ordered(verify.work_order(e))


@query(FILES + " SELECT CAST(sum(size) FILTER (WHERE entry_idx % 6 <> 0) AS VARCHAR) AS bytes, count(*) FILTER (WHERE entry_idx % 6 <> 0) AS files FROM files")
def entry_totals(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("kind", F.when(F.col("entry_idx") % 6 == 0, "dir").otherwise("file"))
    return verify.totals(f).select(F.col("bytes").cast("string").alias("bytes"), "files")


@query("""WITH c AS (SELECT l_orderkey AS entry_idx, l_linenumber AS chunk, l_orderkey * 8 + l_linenumber AS chunk_id, l_orderkey % 50 AS pack_id, CAST(l_quantity AS BIGINT) - 1 AS length FROM lineitem),
r AS (SELECT 'chunk_without_pack' AS rule, count(*) FILTER (WHERE pack_id >= 45) AS n FROM c UNION ALL SELECT 'empty_chunk', count(*) FILTER (WHERE length <= 0) FROM c
  UNION ALL SELECT 'size_not_sum', count(*) FROM (SELECT entry_idx FROM c GROUP BY entry_idx HAVING sum(length) <> 100))
SELECT rule, n FROM r WHERE n > 0""")
def index_rules(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    c = li.select(F.col("l_orderkey").alias("entry_idx"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("chunk_id"), (F.col("l_orderkey") % 50).alias("pack_id"), F.lit(0).alias("offset"), (F.col("l_quantity").cast("long") - 1).alias("length"))
    packs = spark.range(45).select(F.col("id").alias("pack_id"), F.lit(1 << 40).alias("raw_len"))
    entries = c.select("entry_idx").distinct().withColumn("size", F.lit(100))
    # the tables repeat line numbers, so chunks are keyed by row here
    return verify.rules(packs, c.select("chunk_id", "pack_id", "offset", "length"), c.select("entry_idx", "chunk_id").limit(0), entries.limit(0)).unionByName(
        c.groupBy("entry_idx").agg(F.sum("length").alias("got")).where("got <> 100").agg(F.count("*").alias("n")).select(F.lit("size_not_sum").alias("rule"), "n").where("n > 0")
    )


_SHARD = 1024
_GEO = f"greatest(1, least(200, CAST(ceil(size / {_SHARD}.0) AS INTEGER)))"


@query(FILES + f", g AS (SELECT path, size, {_GEO} AS n FROM files) SELECT path, n, CAST(greatest(1, ceil(size / CAST(n AS DOUBLE))) AS BIGINT) AS shard_size, CAST(greatest(1, least(255 - n, round(n * CAST(0.1 AS DOUBLE)))) AS INTEGER) AS m FROM g")
def shard_geometry(spark, sf_dir):
    g = recovery.geometry(F.col("size"), 0.1, _SHARD)
    return files(spark, sf_dir).select("path", *[c.alias(k) for k, c in g.items()])


@query(FILES + f""", g AS (SELECT entry_idx, text, size, {_GEO} AS n FROM files), s AS (SELECT entry_idx, text, CAST(greatest(1, ceil(size / CAST(n AS DOUBLE))) AS BIGINT) AS w, unnest(range(n)) AS idx FROM g)
SELECT entry_idx, CAST(idx AS INTEGER) AS idx, sha256(encode(text)[idx * w + 1:(idx + 1) * w] || unhex(repeat('00', CAST(w - strlen_part AS INTEGER)))) AS hash FROM (SELECT *, greatest(0, least(w, strlen(text) - idx * w)) AS strlen_part FROM s)""")
def shard_hashes(spark, sf_dir):
    return recovery.hashes(recovery.shards(files(spark, sf_dir), 0.1, _SHARD))


def _damaged(spark, sf_dir):
    s = recovery.shards(files(spark, sf_dir), 0.1, _SHARD)
    hit = ((F.col("entry_idx") % 3 == 0) & (F.col("idx") == 0)) | ((F.col("entry_idx") % 7 == 0) & (F.col("idx") < 3))
    return s, hit


@query(FILES + f""", g AS (SELECT entry_idx, {_GEO} AS n FROM files), s AS (SELECT entry_idx, n, unnest(range(n)) AS idx FROM g),
d AS (SELECT entry_idx, any_value(n) AS n, count(*) FILTER (WHERE (entry_idx % 3 = 0 AND idx = 0) OR (entry_idx % 7 = 0 AND idx < 3)) AS damaged FROM s GROUP BY entry_idx)
SELECT entry_idx, damaged, CASE WHEN damaged = 0 THEN 'intact' WHEN damaged <= greatest(1, least(255 - n, round(n * CAST(0.1 AS DOUBLE)))) THEN 'repairable' ELSE 'lost' END AS state FROM d""")
def damage_report(spark, sf_dir):
    s, hit = _damaged(spark, sf_dir)
    stored = s.select("entry_idx", "idx", "m", F.sha2("payload", 256).alias("hash"))
    broken = s.withColumn("payload", F.when(hit, F.concat(F.lit(b"\x01"), F.col("payload"))).otherwise(F.col("payload")))
    return recovery.damage(stored, recovery.hashes(broken))


@query("SELECT doc_id AS entry_idx, true AS restored FROM documents WHERE strlen(text) > 0 AND doc_id % 10 = 0")
def rs_repair(spark, sf_dir):
    """Parity, loss of as many shards as there is parity, repair, comparison with the original."""
    f = files(spark, sf_dir).where("entry_idx % 10 = 0 and size > 0")
    s = recovery.with_parity(recovery.shards(f, 0.2, _SHARD))
    back = recovery.repaired(s.where(F.col("idx") >= F.col("m"))).select("entry_idx", F.col("content").alias("again"))
    j = f.join(back, "entry_idx", "left")
    return j.select("entry_idx", F.coalesce(F.substring("again", F.lit(1), F.col("size").cast("int")) == F.col("content"), F.lit(False)).alias("restored"))


@query("SELECT doc_id AS entry_idx, true AS opened, strlen(text) + 28 AS sealed_bytes FROM documents")
def seal_roundtrip(spark, sf_dir):
    """AES-256-GCM with bound metadata; a nonce per entry from its number."""
    key, nonce = bytes(range(32)), F.unhex(F.lpad(F.hex("entry_idx"), 24, "0"))
    f = files(spark, sf_dir).select("entry_idx", "content", recovery.seal(F.col("content"), key, nonce, F.encode("path", "UTF-8")).alias("sealed"), "path")
    opened = recovery.unseal(F.col("sealed"), key, F.encode("path", "UTF-8"))
    return f.select("entry_idx", (opened == F.col("content")).alias("opened"), F.octet_length("sealed").cast("long").alias("sealed_bytes"))
