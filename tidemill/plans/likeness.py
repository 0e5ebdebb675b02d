"""Similarity over embeddings as images: signatures, banded pairs, verification, groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import similar
from tidemill.plans.catalog import table
from tidemill.plans.registry import query

_SIG = """WITH s AS (SELECT vec_id AS id, embedding AS v, list_transform(range(64), lambda i: embedding[i + 1] > embedding[(i + 1) % 64 + 1]) AS b FROM embeddings),
d AS (SELECT x.id AS a, y.id AS b, list_sum(list_transform(range(1, 65), lambda i: CAST(x.b[i] <> y.b[i] AS INTEGER))) AS distance, x.v AS va, y.v AS vb FROM s x JOIN s y ON x.id < y.id),
p AS (SELECT a, b, CAST(distance AS INTEGER) AS distance, va, vb FROM d WHERE distance <= 15)"""


def _sigs(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), similar.gradient_signature(F.col("embedding")).alias("sig"))


@query(_SIG + " SELECT a, b, distance FROM p")
def hamming_pairs(spark, sf_dir):
    return similar.banded_pairs(_sigs(spark, sf_dir), 15).select("a", "b", F.col("distance").cast("int").alias("distance"))


@query(_SIG.replace("WITH s", "WITH RECURSIVE s", 1) + """, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
m AS (SELECT id, min(root) AS root FROM r GROUP BY id) SELECT root, count(*) AS n, array_to_string(list_sort(list(id)), ',') AS members FROM m GROUP BY root""")
def similar_groups(spark, sf_dir):
    g = similar.groups(similar.banded_pairs(_sigs(spark, sf_dir), 15))
    return g.select("root", "n", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query(_SIG + " SELECT a, b, distance FROM p WHERE list_sum(list_transform(range(1, 65), lambda i: abs(CAST(va[i] AS DOUBLE) - CAST(vb[i] AS DOUBLE)))) / 64 <= CAST(0.1 AS DOUBLE) OR a % 4 = 0 OR b % 4 = 0")
def verify_pairs(spark, sf_dir):
    """Pairs that verification leaves; every fourth print is missing, so its pairs stay."""
    prints = table(spark, sf_dir, "embeddings").where("vec_id % 4 <> 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    pairs = similar.banded_pairs(_sigs(spark, sf_dir), 15).select("a", "b", F.col("distance").cast("int").alias("distance"))
    return similar.verified(pairs, prints, 0.1)
