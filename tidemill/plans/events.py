"""Ordered folds, stream equivalents and discovery documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import discovery
from tidemill.operators import ordered
from tidemill.plans.catalog import table
from tidemill.plans.registry import query
from tidemill.streaming import incremental


@query("""WITH p AS (SELECT event_id % 20 AS file, event_id // 20 AS idx, bool_or(event_id % 97 <> 5) AS done FROM events GROUP BY 1, 2), m AS (SELECT file, max(idx) + 1 AS n FROM p GROUP BY file)
SELECT m.file, coalesce((SELECT min(idx) FROM p WHERE p.file = m.file AND NOT done), n) AS frontier FROM m""")
def watermark(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return ordered.watermark(e.select((F.col("event_id") % 20).alias("file"), F.floor(F.col("event_id") / 20).alias("idx"), (F.col("event_id") % 97 != 5).alias("done")))


@query("""WITH RECURSIVE s AS (SELECT user_id AS key, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE user_id IS NOT NULL),
r AS (SELECT key, rn, value AS rate FROM s WHERE rn = 1 UNION ALL SELECT s.key, s.rn, CAST(0.3 AS DOUBLE) * s.value + CAST(0.7 AS DOUBLE) * r.rate FROM r JOIN s ON s.key = r.key AND s.rn = r.rn + 1)
SELECT key, max(rn) AS n, CAST(round(arg_max(rate, rn) * 10000) AS BIGINT) AS rate FROM r GROUP BY key""")
def ewma_rate(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("user_id is not null")
    r = ordered.ewma(e.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), "value"))
    return r.select("key", F.col("n").cast("long").alias("n"), F.round(F.col("rate") * 10000).cast("long").alias("rate"))


_BENCH = """a AS (SELECT user_id AS key, event_id AS seq, event_type NOT IN ('error', 'click', 'view') AS ok FROM events), l AS (SELECT key, max(seq) FILTER (WHERE ok) AS last_ok FROM a GROUP BY key),
f AS (SELECT a.key, count(*) FILTER (WHERE NOT ok AND (last_ok IS NULL OR seq > last_ok)) AS failures FROM a JOIN l ON l.key = a.key GROUP BY a.key),
bench AS (SELECT key, failures, CASE WHEN failures >= 3 THEN 2 * least(failures, 6) ELSE 0 END AS cooldown FROM f)"""


def _benched(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return ordered.benched(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (~F.col("event_type").isin("error", "click", "view")).alias("ok")))


@query("WITH " + _BENCH + " SELECT * FROM bench")
def bench_state(spark, sf_dir):
    return _benched(spark, sf_dir)


@query("WITH " + _BENCH + """, c AS (SELECT key % 7 AS file, key AS source, (key % 3 + 1) / CAST(key % 11 + 1 AS DOUBLE) AS score FROM bench WHERE cooldown = 0)
SELECT file, arg_min(source, (score, source)) AS source FROM c GROUP BY file""")
def source_pick(spark, sf_dir):
    b = _benched(spark, sf_dir)
    return ordered.pick(b.select((F.col("key") % 7).alias("file"), F.col("key").alias("source"), (F.col("key") % 3).alias("inflight"), (F.col("key") % 11 + 1).cast("double").alias("rate"), "cooldown"))


@query("""WITH m AS (SELECT l_partkey AS file, l_suppkey AS source, CAST(l_quantity AS BIGINT) % 3 AS size, l_linenumber % 2 AS sample, l_returnflag <> 'A' AS ranges, l_orderkey, l_linenumber FROM lineitem),
u AS (SELECT file, source, min(size) AS size, min(sample) AS sample, bool_and(ranges) AS ranges FROM m GROUP BY file, source), a AS (SELECT *, first_value(size) OVER w AS s0, first_value(sample) OVER w AS p0 FROM u WINDOW w AS (PARTITION BY file ORDER BY source))
SELECT file, source FROM a WHERE ranges AND size = s0 AND sample = p0""")
def mirror_check(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("source"))
    u = li.agg(F.min(F.col("l_quantity").cast("long") % 3).alias("size"), F.min(F.col("l_linenumber") % 2).alias("sample"), F.bool_and(F.col("l_returnflag") != "A").alias("ranges"))
    return ordered.mirror_ok(u)


@query("SELECT page_id, 'https://m' || i || '.example.org/' || page_id AS source, CAST(i - 1 AS INTEGER) AS ord FROM pages, (SELECT unnest([1, 2]) AS i)")
def link_header(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    h = F.format_string('<https://m1.example.org/%d>; rel=duplicate, <https://x.example.org/sig>; rel="describedby", <https://m2.example.org/%d>; rel="duplicate"; pri=1', "page_id", "page_id")
    return discovery.duplicates(p.select("page_id", h.alias("link")), "page_id", "link")


@query("SELECT page_id, 'http://a.example.org/' || page_id AS source, page_id * 3 AS size, lpad(CAST(page_id AS VARCHAR), 64, 'a') AS sha256 FROM pages")
def metalink(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    x = F.format_string(
        '<metalink xmlns="urn:ietf:params:xml:ns:metalink"><file name="f"><size>%d</size><hash type="md5">00</hash><hash type="sha-256">%s</hash><url>http://a.example.org/%d</url><url>ftp://b.example.org/f</url></file></metalink>',
        F.col("page_id") * 3, F.upper(F.lpad(F.col("page_id").cast("string"), 64, "a")), "page_id",
    )
    return discovery.metalinks(p.select("page_id", x.alias("xml")), "page_id", "xml")


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, CAST(round(sum(value) * 100) AS BIGINT) AS cents FROM events GROUP BY 1, 2")
def window_events(spark, sf_dir):
    """Tumbling windows, an extension."""
    e = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour")).agg(F.count("*").alias("n"), F.round(F.sum("value") * 100).cast("long").alias("cents"))
    return e.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "cents")


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL")
def grouping_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT md5(text) AS hash FROM documents WHERE text IS NOT NULL")
def stream_incremental_dedup(spark, sf_dir):
    """Distinct content of a stream of files, run until what is there has been read."""
    return incremental.distinct_content(spark, f"{sf_dir}/documents.parquet")


@query("""WITH p AS (SELECT event_id % 20 AS file, event_id // 20 AS idx, event_id % 97 <> 5 AS done FROM events), m AS (SELECT file, max(idx) + 1 AS n FROM p GROUP BY file)
SELECT m.file, coalesce((SELECT min(idx) FROM p WHERE p.file = m.file AND NOT done), n) AS frontier FROM m""")
def stream_watermark(spark, sf_dir):
    """The contiguous frontier kept by a stateful streaming operator."""
    return incremental.frontiers(spark, f"{sf_dir}/events.parquet")
