"""MPEG transport streams as columns: demultiplexing, and a multiplexer to make some.

A stream column holds 188-byte packets. For each elementary stream that the
program tables (PAT, and the PMT pids that it names; CRC checked; sections may
cross packets) list, the demultiplexer checks the
continuity counters, drops legal duplicates, reassembles the PES packets and
stores payload, timestamps and random-access points. A whole Arrow batch of
streams is parsed at once: packets are rows of a matrix, streams are segments
of a stable sort, and PES headers are read from the reassembled bytes, so they
may cross packets.

Cases: null and empty streams give one row of status ``empty`` with a null pid;
streams without usable program tables one of status ``no_program``. Bytes out
of sync are skipped to the next 0x47 that repeats after 188 bytes or whose packet
ends the stream; a packet cut short at the end is dropped; so are packets with the
transport error flag or scrambling, and payload before the first PES header.
Time stamps go on over the wrap of their 33 bits. A pid that several programs
list is given once. A gap in the counters counts as an error and what is left is kept. Null ids and
repeated rows are demultiplexed one by one; very long streams are parsed whole,
one at a time. Only id and stream are read, so
other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import read
from tidemill.llm.kernels import flat, slices

PACKET, SYNC = 188, 0x47
VIDEO, AUDIO, PMT = 0x100, 0x101, 0x1000
UNIT = 1024  # bytes of text per access unit
KEY_EVERY = 8  # every so many units a random-access point
TICKS = 3003

_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = ((_c << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if _c & 0x80000000 else (_c << 1) & 0xFFFFFFFF
    _CRC[_i] = _c


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for x in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ int(_CRC[(c >> 24) ^ x])
    return c


# ---------------------------------------------------------------- multiplexer


def _section(pid: int, table: int, ext: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + ext.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    sec = b"\x00" + head + crc32_mpeg(head).to_bytes(4, "big")
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10" + sec).ljust(PACKET, b"\xff")


_TABLES = np.frombuffer(
    _section(0, 0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT).to_bytes(2, "big"))
    + _section(PMT, 2, 1, (0xE000 | VIDEO).to_bytes(2, "big") + b"\xf0\x00" + b"".join(bytes([t]) + (0xE000 | p).to_bytes(2, "big") + b"\xf0\x00" for t, p in ((0x1B, VIDEO), (0x0F, AUDIO)))),
    np.uint8,
).reshape(2, PACKET)


def _stamp(mark: int, t: np.ndarray) -> np.ndarray:
    return np.stack([(mark << 4) | ((t >> 29) & 14) | 1, (t >> 22) & 255, ((t >> 14) & 254) | 1, (t >> 7) & 255, ((t << 1) & 254) | 1], 1).astype(np.uint8)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then those of start[1], ..."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


def mux(video: pa.Array, audio: pa.Array) -> list[np.ndarray]:
    """One transport stream per row: PAT, PMT, then video and audio as PES packets."""
    n = len(video)
    src, row, pid, sid, start, size, pts, key = [], [], [], [], [], [], [], []
    base = 0
    for col, p, s, unit in ((video, VIDEO, 0xE0, UNIT), (audio, AUDIO, 0xC0, 4096)):
        buf, off = flat(col)
        many = -(-np.diff(off) // unit)
        r = np.repeat(np.arange(n), many)
        k = _ranges(np.zeros(n, np.int64), many)
        at = off[r] + k * unit
        src.append(buf)
        row.append(r)
        pid.append(np.full(len(r), p))
        sid.append(np.full(len(r), s))
        start.append(at + base)
        size.append(np.minimum(unit, off[r + 1] - at))
        pts.append(90000 + k * TICKS)
        key.append((k % KEY_EVERY == 0) | (s == 0xC0))
        base += len(buf)
    data = np.concatenate(src)
    row, pid, sid, start, size, pts, key = (np.concatenate(x) for x in (row, pid, sid, start, size, pts, key))
    order = np.argsort(row, kind="stable")
    row, pid, sid, start, size, pts, key = (x[order] for x in (row, pid, sid, start, size, pts, key))
    # PES bytes: header of 14 (PTS) or 19 (PTS and DTS) bytes, then the unit
    head = np.where(key, 19, 14)
    total = head + size
    first = np.cumsum(total) - total
    pes = np.zeros(int(total.sum()), np.uint8)
    for i, x in enumerate((0, 0, 1, sid, ((total - 6) >> 8), (total - 6) & 255, 0x80, np.where(key, 0xC0, 0x80), head - 9)):
        pes[first + i] = x
    pes[first[:, None] + np.arange(9, 14)] = np.where(key[:, None], _stamp(3, pts), _stamp(2, pts))
    pes[first[key][:, None] + np.arange(14, 19)] = _stamp(1, pts[key] - TICKS)
    pes[_ranges(first + head, size)] = data[_ranges(start, size)]
    # packets: the first of a key unit has an adaptation field with the flag, the last one stuffing
    af0 = np.where(key, 2, 0)
    many = -(-(total + af0) // 184)
    unit = np.repeat(np.arange(len(total)), many)
    k = _ranges(np.zeros(len(total), np.int64), many)
    lead = k == 0
    room = np.where(lead, 184 - af0[unit], 184)
    sent = np.where(lead, 0, 184 * k - af0[unit])
    load = np.minimum(room, total[unit] - sent)
    m = np.full((len(unit), PACKET), 0xFF, np.uint8)
    af = 184 - load
    m[:, 0] = SYNC
    m[:, 1] = (pid[unit] >> 8) | np.where(lead, 0x40, 0)
    m[:, 2] = pid[unit] & 255
    by = np.lexsort((np.arange(len(unit)), pid[unit], row[unit]))
    seg = np.r_[True, (pid[unit][by][1:] != pid[unit][by][:-1]) | (row[unit][by][1:] != row[unit][by][:-1])] if len(by) else np.zeros(0, bool)
    cc = np.empty(len(by), np.int64)
    cc[by] = (np.arange(len(by)) - np.maximum.accumulate(np.where(seg, np.arange(len(by)), 0))) & 15
    m[:, 3] = np.where(af > 0, 0x30, 0x10) | cc
    m[af > 0, 4] = (af[af > 0] - 1).astype(np.uint8)
    m[af > 1, 5] = np.where(key[unit] & lead, 0x40, 0)[af > 1]
    m.reshape(-1)[_ranges(np.arange(len(unit)) * PACKET + 4 + af, load)] = pes[_ranges(first[unit] + sent, load)]
    bounds = np.searchsorted(row[unit], np.arange(n + 1))
    return [np.concatenate([_TABLES, m[bounds[i] : bounds[i + 1]]]) for i in range(n)]


def multiplexed(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, stream: text as video and source as audio, with losses and repeats as transmission has.

    Ids of 5 modulo 13 lose the fifth packet, ids of 3 modulo 17 repeat the third
    (hashes of ids that are no integers).
    A null text has a null stream.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    no = F.col(id_col).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 31))
    src = docs.select(F.col(id_col).alias("id"), "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(no, F.lit(0)).alias("no"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out: list[bytes | None] = []
            for no, m, there in zip(b.column("no").to_numpy(), mux(b.column("text"), b.column("source")), b.column("text").is_valid().to_pylist(), strict=True):
                if no % 17 == 3:
                    m = np.insert(m, 3, m[2], axis=0) if len(m) > 2 else m
                if no % 13 == 5:
                    m = np.delete(m, 4, axis=0) if len(m) > 4 else m
                out.append(m.tobytes() if there else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], names=[id_col, "stream"])

    return src.mapInArrow(run, f"`{id_col}` {kind}, stream binary")


# -------------------------------------------------------------- demultiplexer


def packet_starts(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, row) of each packet; rows that are in sync throughout are found at once."""
    size = np.diff(off)
    many = size // PACKET
    row = np.repeat(np.arange(len(size)), many)
    at = off[row] + PACKET * _ranges(np.zeros(len(size), np.int64), many)
    bad = np.unique(row[buf[at] != SYNC]) if len(at) else row
    if not len(bad):
        return at, row
    keep = ~np.isin(row, bad)
    places, rows = [at[keep]], [row[keep]]
    for r in bad:
        p, end, got, due = int(off[r]), int(off[r + 1]), [], -1
        sync = np.flatnonzero(buf[p:end] == SYNC) + p
        while True:
            i = np.searchsorted(sync, p)
            if i == len(sync):
                break
            p = int(sync[i])
            if p + PACKET > end:
                break
            if p == due or p + PACKET == end or buf[p + PACKET] == SYNC:
                got.append(p)
                p += PACKET
                due = p
            else:
                p += 1
        places.append(np.array(got, np.int64))
        rows.append(np.full(len(got), r))
    at, row = np.concatenate(places), np.concatenate(rows)
    order = np.lexsort((at, row))
    return at[order], row[order]


def _sections(packets: list[bytes]) -> list[bytes]:
    """Whole current sections with a right CRC from the packets of one PSI pid."""
    data, out = b"", []

    def take(more: bytes) -> bytes:
        more = data + more
        while len(more) >= 3 and more[0] != 0xFF:
            n = 3 + ((more[1] & 15) << 8 | more[2])
            if len(more) < n:
                break
            if n > 8 and more[5] & 1 and crc32_mpeg(more[:n]) == 0:
                out.append(more[:n])
            more = more[n:]
        return more

    started = False
    for p in packets:
        body = p[5 + p[4] :] if p[3] & 0x20 else p[4:]
        if p[1] & 0x40 and body:
            if started:
                take(body[1 : 1 + body[0]])  # the pointer field counts the rest of the section before
            started, data = True, b""
            data = take(body[1 + body[0] :])
        elif started:
            data = take(body)
    return out


def programs(packets: list[bytes]) -> list[tuple[int, int]]:
    """(program, pid of its map) of the program association table."""
    return [(s[i] << 8 | s[i + 1], (s[i + 2] & 31) << 8 | s[i + 3]) for s in _sections(packets) if s[0] == 0 for i in range(8, len(s) - 7, 4) if s[i] << 8 | s[i + 1]]


def program_map(packets: list[bytes]) -> list[tuple[int, int, int]]:
    """(program, pid, stream type) of program map sections."""
    out = []
    for t in _sections(packets):
        if t[0] != 2 or len(t) < 16:
            continue
        j = 12 + ((t[10] & 15) << 8 | t[11])
        while j + 5 <= len(t) - 4:
            out.append((t[3] << 8 | t[4], (t[j + 1] & 31) << 8 | t[j + 2], t[j]))
            j += 5 + ((t[j + 3] & 15) << 8 | t[j + 4])
    return out


def _kinds(m: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """(group, kind of each, packets of each kind): packets `at`, sorted by group; groups of equal packets are one kind."""
    names, first, many = np.unique(group, return_index=True, return_counts=True)
    kind = np.zeros(len(names), np.int64)
    packets: list[list[bytes]] = []
    for size in np.unique(many):
        mine = np.flatnonzero(many == size)
        rows = np.ascontiguousarray(m[at[first[mine][:, None] + np.arange(size)]].reshape(len(mine), -1))
        seen, one, inv = np.unique(rows.view(f"V{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
        kind[mine] = len(packets) + inv
        packets += [[rows[i, k : k + PACKET].tobytes() for k in range(0, rows.shape[1], PACKET)] for i in one]
    return names, kind, packets


def elementary(m: np.ndarray, row: np.ndarray, pid: np.ndarray, fine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row << 13 | pid, stream type), sorted, of the streams that the tables of each row list.

    The association table says on which pids the maps are; tables that are equal
    in many rows are parsed once.
    """
    none = np.zeros(0, np.int64)
    pat = np.flatnonzero(fine & (pid == 0))
    rows, kind, packets = _kinds(m, pat, row[pat]) if len(pat) else (none, none, [])
    want, program = [none], [none]
    for k, p in enumerate(packets):
        found = np.array(sorted(set(programs(p))), np.int64).reshape(-1, 2)
        mine = rows[kind == k]
        want.append((mine[:, None] << 13 | found[:, 1]).ravel())
        program.append(np.tile(found[:, 0], len(mine)))
    want, program = np.concatenate(want), np.concatenate(program)
    listed = np.unique(want << 16 | program)
    code = row << 13 | pid
    pmt = np.flatnonzero(fine & np.isin(code, want))
    pmt = pmt[np.argsort(code[pmt], kind="stable")]
    groups, kind, packets = _kinds(m, pmt, code[pmt]) if len(pmt) else (none, none, [])
    keys, types = [none], [none]
    for k, p in enumerate(packets):
        mine = groups[kind == k]
        for number, stream, kind_of in program_map(p):
            ok = mine[np.isin(mine << 16 | number, listed)]
            keys.append(ok >> 13 << 13 | stream)
            types.append(np.full(len(ok), kind_of))
    keys, types = np.concatenate(keys), np.concatenate(types)
    keys, first = np.unique(keys, return_index=True)
    return keys, types[first]


UNITS = pa.struct([("pts", pa.int64()), ("dts", pa.int64()), ("random_access", pa.bool_()), ("packet", pa.int32()), ("bytes", pa.int32())])


def _time(f: np.ndarray, at: np.ndarray) -> np.ndarray:
    x = f[at[:, None] + np.arange(5)].astype(np.int64)
    return ((x[:, 0] >> 1) & 7) << 30 | x[:, 1] << 22 | (x[:, 2] >> 1) << 15 | x[:, 3] << 7 | x[:, 4] >> 1


def unwrapped(t: np.ndarray, stream: np.ndarray) -> np.ndarray:
    """Time stamps of 33 bits, stream after stream, carried on over their wrap: each is taken within 2^32 of the one before."""
    if not len(t):
        return t
    new = np.r_[True, stream[1:] != stream[:-1]]
    step = np.where(new, 0, (np.diff(t, prepend=t[:1]) + (1 << 32)) % (1 << 33) - (1 << 32))
    first = np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
    run = np.cumsum(step)
    return t[first] + run - run[first]


def demux(col: pa.Array) -> dict[str, pa.Array]:
    """Columns of the result for a column of streams; ``row`` is the stream's place in it."""
    buf, off = flat(col)
    at, row = packet_starts(buf, off)
    m = buf[at[:, None] + np.arange(PACKET)] if len(at) else np.zeros((0, PACKET), np.uint8)
    nth = np.arange(len(at)) - np.searchsorted(row, row)
    pid = (m[:, 1].astype(np.int64) & 31) << 8 | m[:, 2]
    afc, cc = m[:, 3] >> 4 & 3, (m[:, 3] & 15).astype(np.int64)
    af = np.where(afc & 2, m[:, 4].astype(np.int64) + 1, 0)
    flags = np.where(af > 1, m[:, 5], 0)
    fine = ((m[:, 1] & 0x80) == 0) & ((m[:, 3] & 0xC0) == 0) & (afc & 1 == 1) & (af < 184)
    keys, types = elementary(m, row, pid, fine)  # (row, pid) of each elementary stream
    n = len(keys)
    stream = np.searchsorted(keys, row << 13 | pid)
    mine = np.flatnonzero(fine & (keys[np.minimum(stream, n - 1)] == (row << 13 | pid))) if n else np.zeros(0, np.int64)
    mine = mine[np.argsort(stream[mine], kind="stable")]
    s = stream[mine]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    step = np.r_[0, (cc[mine][1:] - cc[mine][:-1]) & 15] if len(s) else np.zeros(0, np.int64)
    same = np.zeros(len(s), bool)
    maybe = np.flatnonzero(~new & (step == 0))
    same[maybe] = (m[mine[maybe]] == m[mine[maybe - 1]]).all(1)
    gap = ~new & ~same & (step != 1) & ((flags[mine] & 0x80) == 0)
    packets, errors, repeated = (np.bincount(s, w, minlength=n).astype(np.int64) for w in (None, gap, same))
    mine, s = mine[~same], s[~same]
    # all payload bytes, stream after stream; PES units start at marked packets
    load = 184 - af[mine]
    f = m.reshape(-1)[_ranges(mine * PACKET + 4 + af[mine], load)] if len(mine) else np.zeros(0, np.uint8)
    place = np.cumsum(load) - load
    lead = np.flatnonzero((m[mine, 1] & 0x40) != 0)
    begin = place[lead]
    seg_end = np.full(n, len(f))
    if len(mine):
        last = np.flatnonzero(np.r_[s[1:] != s[:-1], True])
        seg_end[s[last]] = place[last] + load[last]
    end = np.minimum(np.append(begin[1:], len(f)), seg_end[s[lead]]) if len(lead) else begin
    long = end - begin >= 9
    b0 = np.where(long, begin, 0)
    sound = long.copy()
    if len(f) >= 9:
        sound &= (f[b0] == 0) & (f[b0 + 1] == 0) & (f[b0 + 2] == 1)
    lead, begin, end = lead[sound], begin[sound], end[sound]
    size = f[begin + 4].astype(np.int64) << 8 | f[begin + 5]
    end = np.where(size > 0, np.minimum(end, begin + 6 + size), end)
    body = np.minimum(begin + 9 + f[begin + 8], end)
    padded = np.r_[f, np.zeros(20, np.uint8)]
    has_pts, has_dts = (f[begin + 7] & 0x80) != 0, (f[begin + 7] & 0xC0) == 0xC0
    pts, dts = _time(padded, begin + 9), _time(padded, begin + 14)
    us = s[lead]
    ahead = (pts - dts) % (1 << 33)
    pts[has_pts] = unwrapped(pts[has_pts], us[has_pts])
    dts = pts - ahead
    payload = f[_ranges(body, end - body)]
    per = np.bincount(us, minlength=n)
    unit_off = np.r_[0, np.cumsum(per)]
    byte_off = np.r_[0, np.cumsum(end - body)][unit_off]
    # rows without a stream: empty ones and those without tables
    bare = np.setdiff1d(np.arange(len(col)), keys >> 13)
    total, nb = n + len(bare), len(bare)
    none = np.r_[np.zeros(n, bool), np.ones(nb, bool)]
    pad = lambda x: np.r_[x, np.zeros(nb, np.int64)]
    units = pa.StructArray.from_arrays(
        [pa.array(pts, mask=~has_pts), pa.array(np.where(has_dts, dts, pts), mask=~has_pts), pa.array((flags[mine[lead]] & 0x40) != 0), pa.array(nth[mine[lead]].astype(np.int32)), pa.array((end - body).astype(np.int32))],
        fields=list(UNITS),
    )
    ends = lambda x: np.r_[x, np.full(nb, x[-1])].astype(np.int32)
    return {
        "row": pa.array(np.r_[keys >> 13, bare]),
        "pid": pa.array(pad(keys & 8191).astype(np.int32), mask=none),
        "stream_type": pa.array(pad(types).astype(np.int32), mask=none),
        "status": pa.array(["ok"] * n + ["empty" if off[r + 1] == off[r] else "no_program" for r in bare], pa.string()),
        "packets": pa.array(pad(packets)),
        "continuity_errors": pa.array(pad(errors)),
        "duplicates": pa.array(pad(repeated)),
        "units": pa.ListArray.from_arrays(pa.array(ends(unit_off), pa.int32()), units),
        "payload": pa.Array.from_buffers(pa.binary(), total, [None, pa.py_buffer(ends(byte_off)), pa.py_buffer(payload)]),
    }


SCHEMA = "pid int, stream_type int, status string, packets long, continuity_errors long, duplicates long, units array<struct<pts: long, dts: long, random_access: boolean, packet: int, bytes: int>>, payload binary"


def demultiplexed(streams: DataFrame, id_col: str = "doc_id", stream_col: str = "stream") -> DataFrame:
    """id, pid, stream_type, status, packets, continuity_errors, duplicates, units, payload per elementary stream."""
    kind = streams.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "stream", 2 << 20):
            cols = demux(b.column("stream"))
            row = cols.pop("row")
            yield pa.RecordBatch.from_arrays([b.column("id").take(row), *cols.values()], names=[id_col, *cols])

    return streams.select(F.col(id_col).alias("id"), F.col(stream_col).alias("stream")).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demultiplexed(multiplexed(read(spark, sf_dir, "documents")))
