"""Chunks, first occurrences, packs, and reading ranges back."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_chunks(files: DataFrame) -> DataFrame:
    """entry_idx, pos, length, hash: content cut after each line end. Lengths in bytes."""
    t = files.select("entry_idx", F.split(F.decode("content", "UTF-8"), "\n").alias("lines"))
    # their number is taken before they are rows: inside, each line would have the content split once more
    e = t.select("entry_idx", F.size("lines").alias("n"), "lines").select("entry_idx", "n", F.posexplode("lines").alias("pos", "line"))
    c = e.select("entry_idx", "pos", F.when(F.col("pos") < F.col("n") - 1, F.concat("line", F.lit("\n"))).otherwise(F.col("line")).alias("chunk")).where("chunk <> ''")
    return c.select("entry_idx", "pos", F.octet_length("chunk").alias("length"), F.sha2("chunk", 256).alias("hash"), "chunk")


def fixed_chunks(files: DataFrame, width: int = 256) -> DataFrame:
    """Blocks of `width` characters; the last may be shorter."""
    t = files.select("entry_idx", F.decode("content", "UTF-8").alias("t")).where("t <> ''")
    e = t.select("entry_idx", "t", F.explode(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / width).cast("int"))).alias("pos"))
    c = e.select("entry_idx", "pos", F.substring("t", F.col("pos") * width + 1, F.lit(width)).alias("chunk"))
    return c.select("entry_idx", "pos", F.octet_length("chunk").alias("length"), F.sha2("chunk", 256).alias("hash"), "chunk")


def estimate(chunks: DataFrame) -> DataFrame:
    """files, chunks, distinct chunks, total and unique bytes, saved (0 at least)."""
    per = chunks.groupBy("hash").agg(F.count("*").alias("n"), F.sum("length").alias("b"), F.max("length").alias("one"))
    files = chunks.agg(F.count_distinct("entry_idx").alias("files"))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.count("*").alias("distinct_chunks"), F.coalesce(F.sum("b"), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum("one"), F.lit(0)).cast("long").alias("unique_bytes"))
    return files.crossJoin(out).withColumn("saved", F.greatest(F.lit(0), F.col("total_bytes") - F.col("unique_bytes")))


def approx_unique(chunks: DataFrame) -> DataFrame:
    """One-pass estimate of distinct chunks (HyperLogLog++), an extension."""
    return chunks.agg(F.approx_count_distinct("hash", 0.02).alias("approx_distinct"))


def first_seen(chunks: DataFrame) -> DataFrame:
    """hash, length, entry_idx, pos of the first occurrence in entry order."""
    at = F.struct("entry_idx", "pos")
    return chunks.groupBy("hash").agg(F.min(at).alias("at"), F.max("length").alias("length")).select("hash", F.col("length").cast("long").alias("length"), F.col("at.entry_idx").alias("entry_idx"), F.col("at.pos").alias("pos"))


def numbered(distinct: DataFrame, span: int = 1 << 16) -> DataFrame:
    """chunk_id in order of (entry_idx, pos), and bytes before it, without one global sort task.

    Counts and bytes per range of `span` entries give offsets; inside a range
    row numbers are local.
    """
    part = F.floor(F.col("entry_idx") / span)
    d = distinct.withColumn("part", part)
    sums = d.groupBy("part").agg(F.count("*").alias("n"), F.sum("length").alias("b"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offs = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
    w = Window.partitionBy("part").orderBy("entry_idx", "pos")
    local = d.withColumn("rn", F.row_number().over(w)).withColumn("lb", F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(offs, "part").select("hash", "length", "entry_idx", "pos", (F.col("n0") + F.col("rn") - 1).cast("long").alias("chunk_id"), (F.col("b0") + F.col("lb")).cast("long").alias("start"))


def assign_packs(chunks: DataFrame, target: int, shard: Column | None = None) -> DataFrame:
    """shard, chunk_id, length, pack_id: a pack closes after the chunk that reaches the target.

    A fold with reset: where a pack starts depends on where the last one ended,
    so it is sequential within a shard (such as the range of entries one writer
    owns) and shards run side by side. Inside, one binary search per pack finds
    its end in the running sum. Without a shard the table is folded as a whole.
    """

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk_id")
        end = np.cumsum(t.column("length").to_numpy())
        pack = np.zeros(len(end), np.int32)
        at = base = k = 0
        while at < len(end):
            to = min(int(np.searchsorted(end, base + target)) + 1, len(end))
            pack[at:to] = k
            at, base, k = to, int(end[to - 1]), k + 1
        return pa.table({"shard": t.column("shard"), "chunk_id": t.column("chunk_id"), "length": t.column("length"), "pack_id": pa.array(pack)})

    slim = chunks.select((F.lit(0) if shard is None else shard).cast("long").alias("shard"), F.col("chunk_id").cast("long").alias("chunk_id"), F.col("length").cast("long").alias("length"))
    return slim.groupBy("shard").applyInArrow(fold, "shard long, chunk_id long, length long, pack_id int")


def pack_stats(packed: DataFrame) -> DataFrame:
    return packed.groupBy("shard", "pack_id").agg(F.count("*").alias("n_chunks"), F.sum("length").alias("raw_len"))


def entry_map(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """entry_idx, pos, chunk_id, length: which chunks an entry is made of."""
    return chunks.join(ids.select("hash", "chunk_id"), "hash").select("entry_idx", "pos", "chunk_id", "length")


def with_offsets(chunks: DataFrame) -> DataFrame:
    """Chunks with the byte of the entry at which they start."""
    before = Window.partitionBy("entry_idx").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)))


def read_range(chunks: DataFrame, offset: int, length: int) -> DataFrame:
    """entry_idx, data: bytes [offset, offset + length) of each entry, from the chunks that overlap it."""
    c = with_offsets(chunks).where((F.col("start") < offset + length) & (F.col("start") + F.col("length") > offset))
    lo = F.greatest(F.lit(0), F.lit(offset) - F.col("start"))
    hi = F.least(F.col("length"), F.lit(offset + length) - F.col("start"))
    part = F.hex(F.substring(F.encode("chunk", "UTF-8"), (lo + 1).cast("int"), (hi - lo).cast("int")))
    got = c.select("entry_idx", "pos", part.alias("part")).groupBy("entry_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "").alias("data"))
    return got


def reconstruct(chunks: DataFrame) -> DataFrame:
    """entry_idx, text: the chunks of each entry in order."""
    return chunks.groupBy("entry_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk"))), lambda x: x["chunk"]), "").alias("text"))


def entry_splits(mapped: DataFrame, min_split: int, min_total: int) -> DataFrame:
    """entry_idx, split, first_pos, bytes: an entry cut where its pack changes, once a piece is big enough.

    The rows come sorted and many entries are cut at once, all their first
    splits, then all second ones; an entry is held until its last row is there.
    """

    def heads(entry: pa.ChunkedArray) -> np.ndarray:
        """Whether a row is its entry's first; rows without an entry are one."""
        e, none = entry.fill_null(0).to_numpy(), entry.is_null().to_numpy()
        return np.r_[True, (e[1:] != e[:-1]) | (none[1:] != none[:-1])]

    def cut(t: pa.Table) -> pa.Table:
        ln, pack, pos = (t.column(c).to_numpy() for c in ("length", "pack_id", "pos"))
        first = heads(t.column("entry_idx"))
        head, no = np.flatnonzero(first), np.cumsum(first) - 1
        start = np.cumsum(ln) - ln
        big = np.add.reduceat(ln, head) >= min_total
        at = np.flatnonzero(~first & np.r_[False, pack[1:] != pack[:-1]] & big[no])  # where a split may begin
        now = head
        while len(now):
            k = np.maximum(np.searchsorted(start[at], start[now] + min_split), np.searchsorted(at, now, side="right"))
            now, k = now[k < len(at)], k[k < len(at)]
            now = at[k][no[at[k]] == no[now]]
            first[now] = True
        begin, splits = np.flatnonzero(first), np.cumsum(first)
        split = splits[begin] - splits[head][no[begin]]
        return pa.table({"entry_idx": t.column("entry_idx").take(pa.array(begin)), "split": pa.array(split.astype(np.int32)), "first_pos": pa.array(pos[begin].astype(np.int32)), "bytes": pa.array(np.add.reduceat(ln, begin))})

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            if held:  # with the last row before it
                edge = pa.chunked_array([held[-1].column("entry_idx").slice(held[-1].num_rows - 1), b.column("entry_idx")])
                begin = np.flatnonzero(heads(edge)[1:])
            else:
                begin = np.flatnonzero(heads(pa.chunked_array([b.column("entry_idx")])))
            if len(begin) and (held or begin[-1]):
                yield from cut(pa.Table.from_batches([*held, b.slice(0, begin[-1])])).to_batches()
                held = []
            held.append(b.slice(begin[-1]) if len(begin) else b)
        if held:
            yield from cut(pa.Table.from_batches(held)).to_batches()

    slim = mapped.select(F.col("entry_idx").cast("long").alias("entry_idx"), "pos", F.col("length").cast("long").alias("length"), "pack_id")
    return slim.repartition("entry_idx").sortWithinPartitions("entry_idx", "pos").mapInArrow(run, "entry_idx long, split int, first_pos int, bytes long")


#: Gear table of the content-defined chunker: fixed pseudo-random words.
GEAR = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64)


def cdc_cuts(data: np.ndarray, low: int, average: int, high: int) -> np.ndarray:
    """Ends of content-defined chunks (gear hash, normalised): low <= length <= high but for the last."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    # the gear hash shifts left by one per byte, so 48 bytes decide its masked high bits
    h = GEAR[data].copy()
    span = 1
    with np.errstate(over="ignore"):
        while span < 48:  # h over 2 * span bytes = h(now) + h(span ago) << span
            h[span:] += h[:-span] << np.uint64(span)
            span *= 2
    bits = max(1, average.bit_length() - 1)
    hard = (h >> np.uint64(64 - min(bits + 1, 16))) == 0
    soft = (h >> np.uint64(64 - max(bits - 1, 1))) == 0
    hards, softs = np.flatnonzero(hard), np.flatnonzero(soft)
    cuts, at = [], 0
    while at < n:
        lo, mid, hi = at + low, at + average, min(at + high, n)
        end = hi
        i = np.searchsorted(hards, lo - 1)
        if i < len(hards) and hards[i] + 1 <= min(mid, n):
            end = int(hards[i]) + 1
        else:
            j = np.searchsorted(softs, mid - 1)
            if j < len(softs) and softs[j] + 1 <= hi:
                end = int(softs[j]) + 1
        cuts.append(min(end, n))
        at = cuts[-1]
    return np.array(cuts, np.int64)


def cdc_chunks(files: DataFrame, low: int = 256, average: int = 1024, high: int = 4096) -> DataFrame:
    """entry_idx, pos, start, length, hash of content-defined chunks."""

    def run(batches):
        for b in batches:
            idx, pos, start, size, digest = [], [], [], [], []
            for e, data in zip(b.column("entry_idx").to_pylist(), b.column("content").to_pylist(), strict=True):
                if not data:
                    continue
                ends = cdc_cuts(np.frombuffer(data, np.uint8), low, average, high)
                begin = np.r_[0, ends[:-1]]
                idx += [e] * len(ends)
                pos += range(len(ends))
                start += begin.tolist()
                size += (ends - begin).tolist()
                digest += [hashlib.sha256(data[s:t]).hexdigest() for s, t in zip(begin.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(idx, pa.int64()), pa.array(pos, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int32()), pa.array(digest, pa.string())], names=["entry_idx", "pos", "start", "length", "hash"])

    return files.select("entry_idx", "content").mapInArrow(run, "entry_idx long, pos int, start long, length int, hash string")


def line_cdc_chunks(files: DataFrame, k: int = 8) -> DataFrame:
    """entry_idx, pos, length, hash: runs of lines that end after a line whose md5 begins with a byte divisible by k."""
    lines = line_chunks(files)
    ends = (F.conv(F.substring(F.md5("chunk"), 1, 2), 16, 10).cast("int") % k == 0).cast("int")
    before = Window.partitionBy("entry_idx").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    no = lines.withColumn("no", F.coalesce(F.sum(ends).over(before), F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk"))), lambda x: x["chunk"]), "")
    g = no.groupBy("entry_idx", F.col("no").cast("int").alias("pos")).agg(text.alias("chunk"))
    return g.select("entry_idx", "pos", F.octet_length("chunk").alias("length"), F.sha2("chunk", 256).alias("hash"))


def solid_blocks(entries: DataFrame, max_bytes: int = 128 << 20, max_entries: int = 8192, archive: Column | None = None) -> DataFrame:
    """archive, index, size, stored, block: a block closes when the method changes, or at its bytes or entries.

    A fold with reset over the order of one archive's entries; archives side by
    side. Without a column of archives all rows are one.
    """

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by("index")
        size, stored = t.column("size").to_numpy(), t.column("stored").to_numpy(zero_copy_only=False)
        end = np.cumsum(size)
        change = np.append(np.flatnonzero(stored[1:] != stored[:-1]) + 1, len(size))
        block = np.zeros(len(size), np.int32)
        at = base = k = 0
        while at < len(size):
            full = int(np.searchsorted(end, base + max_bytes)) + 1
            to = min(full, at + max_entries, int(change[np.searchsorted(change, at, side="right")]))
            block[at:to] = k
            at, base, k = to, int(end[to - 1]), k + 1
        return t.select(["archive", "index", "size", "stored"]).append_column("block", pa.array(block))

    slim = entries.select(F.col("index").cast("long").alias("index"), F.col("size").cast("long").alias("size"), "stored", (F.lit(0) if archive is None else archive).cast("long").alias("archive"))
    return slim.groupBy("archive").applyInArrow(fold, "archive long, index long, size long, stored boolean, block int")


def sized(content: Column, size: Column) -> Column:
    """Content of exactly the declared size: cut when it has grown, filled with zeros when it has shrunk."""
    return F.rpad(F.substring(content, F.lit(1), size.cast("int")), size.cast("int"), F.lit(b"\0"))
