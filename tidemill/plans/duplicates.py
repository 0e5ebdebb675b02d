"""Duplicate groups, keep policies and reclaim plans over documents as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import dedup, reclaim
from tidemill.plans.catalog import files
from tidemill.plans.registry import query

QUARANTINE = "/quarantine"

FILES = """WITH files AS (SELECT doc_id AS entry_idx, '/' || source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.txt' AS path,
  text, CAST(strlen(text) AS BIGINT) AS size, source AS dev FROM documents)"""
MEMBERS = FILES + """, members AS (SELECT entry_idx, path, size, dev, sha256(text) AS hash, count(*) OVER (PARTITION BY size, sha256(text)) AS n_files,
  CASE WHEN entry_idx % 11 <> 0 THEN (entry_idx * 7919) % 1000 END AS mtime FROM files WHERE size >= 1)"""
GROUPS = MEMBERS + """, g AS (SELECT size, hash, count(*) AS n_files, (count(*) - 1) * size AS reclaimable, min(path) AS first_path FROM members WHERE n_files > 1 GROUP BY size, hash)"""
_STEM = "CASE WHEN regexp_extract(lower(split_part(path, '/', -1)), '^(.+)\\.[^.]*$', 1) = '' THEN lower(split_part(path, '/', -1)) ELSE regexp_extract(lower(split_part(path, '/', -1)), '^(.+)\\.[^.]*$', 1) END"
_COPY = f"(regexp_matches(lower(split_part(path, '/', -1)), 'copy|duplicate') OR regexp_matches(rtrim({_STEM}), '\\([0-9]+\\)$'))"
_ORDER = {
    "first": "path",
    "shortest": f"{_COPY}, len(string_split(path, '/')), strlen(path), path",
    "oldest": "CASE WHEN nulls = 0 THEN mtime END, path",
}


def _ranked(policy: str) -> str:
    return MEMBERS + f""", r AS (SELECT *, row_number() OVER (PARTITION BY size, hash ORDER BY {_ORDER[policy]}) AS rk
  FROM (SELECT *, count(*) FILTER (WHERE mtime IS NULL) OVER (PARTITION BY size, hash) AS nulls FROM members WHERE n_files > 1))"""


def _members(spark, sf_dir):
    m = dedup.members(files(spark, sf_dir))
    return m.withColumn("mtime", F.when(F.col("entry_idx") % 11 != 0, F.col("entry_idx") * 7919 % 1000))


@query(FILES + " SELECT count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes, min(size) AS min_size, max(size) AS max_size FROM files")
def scan_metrics(spark, sf_dir):
    return dedup.scan_metrics(files(spark, sf_dir))


@query(FILES + " SELECT * FROM (SELECT path, size, count(*) OVER (PARTITION BY size) AS n_same_size FROM files WHERE size >= 1) WHERE n_same_size > 1")
def size_gate(spark, sf_dir):
    return dedup.size_gate(files(spark, sf_dir))


@query(FILES + """, k AS (SELECT path, size, CASE WHEN size >= 256 THEN sha256(encode(text)[1:64] || encode(text)[-64:]) END AS pk, count(*) OVER (PARTITION BY size) AS n FROM files WHERE size >= 1)
SELECT path, size FROM (SELECT *, count(*) OVER (PARTITION BY size, pk) AS np FROM k WHERE n > 1) WHERE pk IS NULL OR np > 1""")
def partial_gate(spark, sf_dir):
    return dedup.partial_gate(files(spark, sf_dir), 64)


@query(GROUPS + " SELECT * FROM g")
def dup_groups(spark, sf_dir):
    return dedup.ranked(dedup.groups(files(spark, sf_dir)))


@query(MEMBERS + " SELECT size, hash, path, n_files, row_number() OVER (PARTITION BY size, hash ORDER BY path) AS rn FROM members WHERE n_files > 1")
def dup_members(spark, sf_dir):
    return dedup.members(files(spark, sf_dir)).select("size", "hash", "path", "n_files", "rn")


@query(GROUPS + " SELECT count(*) AS n_groups, CAST(coalesce(sum(n_files), 0) AS BIGINT) AS n_members, CAST(coalesce(sum(n_files - 1), 0) AS BIGINT) AS redundant_files, CAST(coalesce(sum(reclaimable), 0) AS BIGINT) AS reclaimable FROM g")
def dup_summary(spark, sf_dir):
    return dedup.summary(files(spark, sf_dir))


@query(FILES + """, k AS (SELECT path, size, CASE WHEN size >= 256 THEN sha256(encode(text)[1:64] || encode(text)[-64:]) END AS pk, count(*) OVER (PARTITION BY size) AS n FROM files WHERE size >= 1),
p AS (SELECT *, count(*) OVER (PARTITION BY size, pk) AS np FROM k WHERE n > 1)
SELECT CAST((SELECT coalesce(sum(128), 0) FROM p WHERE size >= 256) AS BIGINT) AS partial_bytes, CAST((SELECT coalesce(sum(size), 0) FROM p WHERE pk IS NULL OR np > 1) AS BIGINT) AS full_bytes,
  CAST((SELECT sum(size) FROM files) AS BIGINT) AS scanned_bytes""")
def bytes_hashed(spark, sf_dir):
    return dedup.bytes_hashed(files(spark, sf_dir), 64)


@query(GROUPS + " SELECT * FROM g ORDER BY reclaimable DESC, first_path LIMIT 50")
def top_groups(spark, sf_dir):
    return dedup.ranked(dedup.groups(files(spark, sf_dir))).limit(dedup.TOP_GROUPS)


@query(FILES + """, f AS (SELECT *, CASE WHEN entry_idx % 3 <> 0 THEN entry_idx % 2 END AS ino FROM files WHERE size >= 1)
SELECT size, sha256(text) AS hash, count(*) AS n_files, count(DISTINCT CASE WHEN ino IS NOT NULL THEN dev || '/' || ino END) + count(*) FILTER (WHERE ino IS NULL) AS copies, min(path) AS first_path,
  greatest(0, count(DISTINCT CASE WHEN ino IS NOT NULL THEN dev || '/' || ino END) + count(*) FILTER (WHERE ino IS NULL) - 1) * size AS reclaimable
FROM f GROUP BY size, sha256(text) HAVING count(*) > 1""")
def hardlink_groups(spark, sf_dir):
    f = files(spark, sf_dir)
    return dedup.physical_groups(f.withColumn("ino", F.when(F.col("entry_idx") % 3 != 0, F.col("entry_idx") % 2)))


def _keeper(policy):
    def run(spark, sf_dir):
        m = reclaim.with_keeper(_members(spark, sf_dir), policy)
        return m.where("path = keeper").select("size", "hash", "keeper")

    run.__name__ = f"keeper_{policy}"
    return query(_ranked(policy) + " SELECT size, hash, path AS keeper FROM r WHERE rk = 1")(run)


for _p in _ORDER:
    _keeper(_p)

_DECIDED = _ranked("shortest") + f""", d AS (SELECT k.path AS keeper, v.path AS victim, CASE WHEN v.dev = k.dev THEN 'link' ELSE 'quarantine' END AS action, v.size AS bytes,
  CASE WHEN v.dev <> k.dev THEN '{QUARANTINE}/' || array_to_string(list_filter(string_split(v.path, '/'), lambda c: c NOT IN ('', '.', '..')), '/') END AS dest,
  CASE WHEN v.entry_idx % 7 = 0 THEN 'protected' END AS reason FROM r v JOIN r k ON k.size = v.size AND k.hash = v.hash AND k.rk = 1 WHERE v.rk > 1)"""


def _decided(spark, sf_dir):
    return reclaim.decisions(_members(spark, sf_dir), "shortest", QUARANTINE, F.col("entry_idx") % 7 == 0)


@query(_DECIDED + " SELECT keeper, victim, action, bytes, dest FROM d WHERE reason IS NULL")
def reclaim_plan(spark, sf_dir):
    return reclaim.plan(_decided(spark, sf_dir)).orderBy("victim")


@query(_DECIDED + " SELECT victim AS path, reason FROM d WHERE reason IS NOT NULL")
def reclaim_skipped(spark, sf_dir):
    return reclaim.skipped(_decided(spark, sf_dir))


@query(_DECIDED + " SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, count(*) FILTER (WHERE action = 'link') AS links, count(*) FILTER (WHERE action = 'quarantine') AS quarantines FROM d WHERE reason IS NULL")
def plan_totals(spark, sf_dir):
    return reclaim.totals(reclaim.plan(_decided(spark, sf_dir)))


@query(_DECIDED + ", p AS (SELECT * FROM d WHERE reason IS NULL) SELECT count(*) AS conflicts FROM p WHERE victim IN (SELECT keeper FROM p)")
def plan_validate(spark, sf_dir):
    return reclaim.conflicts(reclaim.plan(_decided(spark, sf_dir))).agg(F.count("*").alias("conflicts"))


@query(FILES + ", r AS (SELECT DISTINCT '/' || dev AS root FROM files UNION SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) FROM files) SELECT root FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE starts_with(a.root, b.root || '/'))")
def root_collapse(spark, sf_dir):
    f = files(spark, sf_dir)
    roots = f.select(F.concat(F.lit("/"), "dev").alias("root")).union(f.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("root")))
    return dedup.collapse_roots(roots)


@query(_DECIDED + """, c AS (SELECT victim, '/q/' || split_part(victim, '/', 3) || '.txt' AS dest FROM d), n AS (SELECT victim, dest, row_number() OVER (PARTITION BY dest ORDER BY victim) AS n FROM c)
SELECT victim, CASE WHEN n = 1 THEN dest ELSE regexp_replace(dest, '\\.txt$', '') || ' (' || n || ').txt' END AS dest FROM n""")
def unique_dests(spark, sf_dir):
    d = _decided(spark, sf_dir).select("victim", F.concat(F.lit("/q/"), F.split("victim", "/")[2], F.lit(".txt")).alias("dest"))
    return reclaim.unique_dests(d).select("victim", "dest")


@query(_DECIDED + " SELECT to_json({'keeper': keeper, 'victim': victim, 'bytes': bytes}) AS line FROM d WHERE reason IS NULL")
def plan_json(spark, sf_dir):
    return reclaim.plan(_decided(spark, sf_dir)).select(F.to_json(F.struct("keeper", "victim", "bytes")).alias("line"))
