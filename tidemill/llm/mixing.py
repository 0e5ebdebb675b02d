"""Mixing sources to target weights over time: a curriculum.

Each source has a weight schedule w(t), linear between knots, over training
time t in [0, 1]. Its integral, scaled to the token budget, is the source's
cumulative token demand D(t). The documents of a source, in the order of the
md5 of their ids, supply tokens; a document whose first token is the c-th of
its source stands at t = D^-1(c). A source that runs out is repeated until its
demand is met (or ``max_epochs`` times where that is given); supply beyond the demand D(1) is not scheduled. The result is
range-sorted by position.

Base weights are a source's tokens to the power 3/4, times the shape of its
schedule. All arithmetic runs in the JVM; running sums are
taken inside (source, 16-bit hash bucket), on top of the buckets' offsets, so
that a hot source is spread over 65536 groups. Rows travel as one struct.

Cases: a null source is a source of its own; null or empty texts have no
tokens and stand where the next document of their source does; rows with a
null id come first in their source; of rows with one id the shorter comes
first, and equal ones are scheduled each; ties of position are ordered by
source, id and epoch; a document stands where its first token does, however
long it is; a source or table without tokens schedules nothing. Columns of any
name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import N_TOKENS_SQL, cut, n_tokens, read

#: Knots (t, weight) of the three shapes: early, flat and late sources.
SHAPES: tuple[tuple[tuple[float, float], ...], ...] = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.25)),
    ((0.0, 1.0), (0.5, 1.0), (1.0, 1.0)),
    ((0.0, 0.25), (0.5, 0.5), (1.0, 2.0)),
)
SCALE = 1_000_000_000


def shape_of(source: Column) -> Column:
    """Which shape a source follows: by the last character of its name."""
    return F.pmod(F.coalesce(F.ascii(F.right(source, F.lit(1))), F.lit(0)), F.lit(3))


def _area(knots) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))


def _segments(knots):
    """(share of the area before, share after, t0, t1, w0, w1) of each stretch."""
    total, before = _area(knots), 0.0
    for a, b in zip(knots, knots[1:], strict=False):
        here = (b[0] - a[0]) * (a[1] + b[1]) / 2
        yield before / total, (before + here) / total, a[0], b[0], a[1], b[1]
        before += here


def invert(x: Column, shape: Column) -> Column:
    """t at which the share x of the schedule's area is reached."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(SHAPES):
        total = _area(knots)
        t = F.lit(1.0)
        for f0, f1, t0, t1, w0, w1 in reversed(list(_segments(knots))):
            a = (x - F.lit(f0)) * F.lit(total)
            d = F.lit(2.0) * a / (F.lit(w0) + F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2.0) * a * F.lit((w1 - w0) / (t1 - t0)))))
            t = F.when(x < F.lit(f1), F.lit(t0) + d).otherwise(t)
        out = F.when(shape == k, t).otherwise(out)
    return out


def mix(docs: DataFrame, max_epochs: int | None = None, budget_tokens: int | None = None, id_col: str = "doc_id", source_col: str = "source", tokens: Column | None = None, owner: str = "query", only_docs: bool = False) -> DataFrame:
    """Rows of docs, each with n_tokens, epoch and position (billionths of training time), in order of position.

    Columns of docs with these three names are replaced; with only_docs the
    rows have just the columns of docs, but stand in that order.
    """
    if not only_docs:
        docs = docs.drop("n_tokens", "epoch", "position")
    key = F.coalesce(F.md5(F.col(f"`{id_col}`").cast("string")), F.lit(""))
    source = F.col(f"`{source_col}`")
    base = docs.select(
        F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("r"),
        (n_tokens() if tokens is None else tokens).alias("n"), key.alias("k"), F.substring(key, 1, 4).alias("b"), F.col(f"`{id_col}`").alias("id"), source.alias("source"), F.coalesce(F.concat(F.lit("s"), source), F.lit("")).alias("s"),
    )
    # cut once (no text): tokens per (source, bucket) with running offsets per source
    sums = cut(base.groupBy("s", "b").agg(F.sum("n").alias("sum"), F.first(shape_of(F.col("source"))).alias("shape")), owner)
    areas = F.lit(0.0)
    for k, knots in enumerate(SHAPES):
        areas = F.when(F.col("shape") == k, F.lit(_area(knots))).otherwise(areas)
    per = sums.groupBy("s").agg(F.sum("sum").alias("supply"), F.first("shape").alias("shape")).withColumn("w", F.sqrt(F.col("supply").cast("double")) * F.sqrt(F.sqrt(F.col("supply").cast("double"))) * areas)
    total = per.agg(F.sum("w").alias("wsum"), F.sum("supply").alias("all"))
    demand = (F.lit(float(budget_tokens)) if budget_tokens is not None else F.col("all").cast("double")) * F.col("w") / F.col("wsum")
    per = per.crossJoin(total).select("s", "supply", "shape", demand.alias("demand")).where("supply > 0")
    before = F.sum("sum").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("s", "b", F.coalesce(before, F.lit(0)).alias("before")).join(per, "s")
    inside = F.sum("n").over(Window.partitionBy("s", "b").orderBy("k", "id", "n").rowsBetween(Window.unboundedPreceding, -1))
    placed = base.withColumn("in", F.coalesce(inside, F.lit(0))).join(offsets, ["s", "b"])
    epochs = F.ceil(F.col("demand") / F.col("supply")).cast("int")
    epochs = epochs if max_epochs is None else F.least(F.lit(max_epochs), epochs)
    each = placed.withColumn("e", F.explode(F.sequence(F.lit(0), F.greatest(epochs - 1, F.lit(0)))))
    c = (F.col("e").cast("long") * F.col("supply") + F.col("before") + F.col("in")).cast("double")
    each = each.withColumn("x", c / F.col("demand")).where("x < 1")
    ordered = each.withColumn("p", F.floor(invert(F.col("x"), F.col("shape")) * SCALE).cast("long")).orderBy("p", "source", "id", "e")
    own = [F.col("r").getField(x).alias(x) for x in docs.columns]
    if only_docs:
        return ordered.select(*own)
    return ordered.select(*own, F.col("n").alias("n_tokens"), F.col("e").alias("epoch"), F.col("p").alias("position"))


def _invert_sql() -> str:
    out = "CASE shape"
    for k, knots in enumerate(SHAPES):
        total = _area(knots)
        out += f" WHEN {k} THEN CASE"
        for f0, f1, t0, t1, w0, w1 in _segments(knots):
            a = f"((x - CAST({f0!r} AS DOUBLE)) * CAST({total!r} AS DOUBLE))"
            out += f" WHEN x < CAST({f1!r} AS DOUBLE) THEN CAST({t0!r} AS DOUBLE) + 2 * {a} / (CAST({w0!r} AS DOUBLE) + sqrt(greatest(0, CAST({w0 * w0!r} AS DOUBLE) + 2 * {a} * CAST({(w1 - w0) / (t1 - t0)!r} AS DOUBLE))))"
        out += " ELSE 1 END"
    return out + " END"


def oracle(table: str = "documents") -> str:
    areas = "CASE shape" + "".join(f" WHEN {k} THEN CAST({_area(kn)!r} AS DOUBLE)" for k, kn in enumerate(SHAPES)) + " END"
    return f"""WITH base AS (SELECT doc_id, source, {N_TOKENS_SQL} AS n_tokens, coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS k,
  coalesce(ascii(right(source, 1)), 0) % 3 AS shape FROM {table}),
per AS (SELECT source, shape, sum(n_tokens) AS supply, sqrt(CAST(sum(n_tokens) AS DOUBLE)) * sqrt(sqrt(CAST(sum(n_tokens) AS DOUBLE))) * {areas} AS w FROM base GROUP BY source, shape),
dem AS (SELECT source, supply, (SELECT CAST(sum(supply) AS DOUBLE) FROM per) * w / (SELECT sum(w) FROM per) AS demand FROM per WHERE supply > 0),
placed AS (SELECT b.*, d.supply, d.demand, sum(n_tokens) OVER (PARTITION BY b.source ORDER BY k, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS c FROM base b JOIN dem d ON b.source IS NOT DISTINCT FROM d.source),
reps AS (SELECT *, unnest(range(CAST(ceil(demand / supply) AS BIGINT))) AS e FROM placed),
occ AS (SELECT *, CAST(e * supply + c AS DOUBLE) / demand AS x, CAST(e AS INTEGER) AS epoch FROM reps)
SELECT doc_id, source, n_tokens, epoch, CAST(floor({_invert_sql()} * {SCALE}) AS BIGINT) AS position FROM occ WHERE x < 1"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", n_tokens().alias("__tm_len"))
    return mix(cut(docs), tokens=F.col("__tm_len")).drop("__tm_len")
