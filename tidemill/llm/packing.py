"""Best-fit packing of documents into training sequences, large items first.

Documents longer than the capacity are cut into full pieces and a rest, so the
whole text is packed. Pieces above a third of the capacity are paired greedily,
the longest with the longest partner that fits, so a bin holds two of them at
most; the other pieces go, longest first, into the smallest gap that takes
them.

Pieces of one length are interchangeable, so the packing is planned on the
histogram of lengths: a table bounded by the capacity, however many documents
there are. The plan says which ranks of a length go to which bins; ranks come
from row numbers inside (length, hash bucket) and the buckets' offsets, so no
task sees more than a small share of even the most common length.

Cases: a null or empty text has no tokens and one row with null bin; null and
repeated ids are ordinary documents; ties of length are broken by bucket, id
and piece; an empty table gives an empty result. Only id and text are read, so
other columns cannot clash.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import cut, n_tokens, read
from tidemill.llm.kernels import tidy

CAPACITY = 2048
BUCKETS = 256


def plan(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (length, rank_from, rank_to, bin_from, per_bin, offset) for counts[length].

    Rank r of a length goes to bin bin_from + (r - rank_from) // per_bin, at
    offset + ((r - rank_from) % per_bin) * length.
    """
    left = {s: int(counts[s]) for s in range(1, capacity + 1) if counts[s]}
    taken = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, deque[tuple[int, int]]] = {}  # gap -> (first bin, bins)
    open_gaps: list[int] = []
    bins = 0

    def put(s: int, m: int, per: int, first: int, offset: int) -> None:
        out.append((s, taken[s], taken[s] + m * per, first, per, offset))
        taken[s] += m * per
        left[s] -= m * per

    def leave(gap: int, first: int, m: int) -> None:
        if gap > 0:
            if gap not in gaps:
                gaps[gap] = deque()
                insort(open_gaps, gap)
            gaps[gap].append((first, m))

    large = sorted(s for s in left if 3 * s > capacity)
    for s in reversed(large):
        while left[s]:
            p = next((x for x in reversed(large[: bisect_left(large, min(s, capacity - s) + 1)]) if left[x] > (x == s)), None)
            m = left[s] if p is None else left[s] // 2 if p == s else min(left[s], left[p])
            if p == s:  # pairs of one length
                put(s, m, 2, bins, 0)
            else:
                put(s, m, 1, bins, 0)
                if p is not None:
                    put(p, m, 1, bins, s)
            leave(capacity - s - (p or 0), bins, m)
            bins += m
    for s in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while c := left[s]:
            i = bisect_left(open_gaps, s)
            if i < len(open_gaps):
                gap = open_gaps[i]
                first, n = gaps[gap].popleft()
                if not gaps[gap]:
                    del gaps[gap], open_gaps[i]
            else:
                gap, first, n = capacity, bins, -(-c // (capacity // s))
                bins += n
            per = min(gap // s, c)
            m = min(n, c // per)
            put(s, m, per, first, capacity - gap)
            leave(gap - per * s, first, m)
            if n > m:
                if gap == capacity:  # the last new bin takes what is left over
                    rest = left[s]
                    put(s, 1, rest, first + m, 0)
                    leave(gap - rest * s, first + m, 1)
                else:
                    if gap not in gaps:
                        gaps[gap] = deque()
                        insort(open_gaps, gap)
                    gaps[gap].appendleft((first + m, n - m))
    return np.array(sorted(out), np.int64).reshape(-1, 6)


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", tokens: Column | None = None, owner: str = "query") -> DataFrame:
    """id, piece, n_tokens, bin_id, bin_offset: one row per piece of a document."""
    kind = docs.schema[id_col].dataType.simpleString()
    sized = docs.select(F.col(id_col).alias("id"), (n_tokens() if tokens is None else tokens).alias("n"))
    full = F.floor(F.col("n") / capacity).cast("int")
    last = F.when((F.col("n") % capacity == 0) & (F.col("n") > 0), full - 1).otherwise(full)
    pieces = cut(
        sized.select("id", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
            "id", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece").cast("long") * capacity).cast("long").alias("n"), F.pmod(F.xxhash64("id", "piece"), F.lit(BUCKETS)).cast("int").alias("bucket")
        ),
        owner,
    )
    grid = np.zeros((capacity + 1, BUCKETS), np.int64)  # bounded by the parameters
    counted = pieces.where("n > 0").groupBy("n", "bucket").count().toArrow()
    grid[counted.column("n").to_numpy(), counted.column("bucket").to_numpy()] = counted.column("count").to_numpy()
    rows = plan(grid.sum(1), capacity)
    before = np.cumsum(grid, 1) - grid
    span = int(grid.sum()) + 1
    start = rows[:, 0] * span + rows[:, 1]

    @tidy
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, bucket, rn = (b.column(i).to_numpy() for i in (2, 3, 4))
            some = n > 0
            rank = before[n, bucket] + rn - 1
            if len(rows):
                r = rows[np.clip(np.searchsorted(start, n * span + rank, side="right") - 1, 0, None)]
                at = rank - r[:, 1]
                where = r[:, 3] + at // r[:, 4]
                off = r[:, 5] + at % r[:, 4] * n
            else:
                where = off = np.zeros(len(n), np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(where, pa.int64(), mask=~some), pa.array(off, pa.int64(), mask=~some)],
                names=[id_col, "piece", "n_tokens", "bin_id", "bin_offset"],
            )

    ranked = pieces.withColumn("rn", F.row_number().over(Window.partitionBy("n", "bucket").orderBy("id", "piece")).cast("long"))
    return ranked.mapInArrow(assign, f"`{id_col}` {kind}, piece int, n_tokens long, bin_id long, bin_offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
