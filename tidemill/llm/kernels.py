"""Vectorised byte kernels shared by the training-data operators.

Everything here works on one Arrow batch at a time and never loops over rows in
Python: texts are viewed as one flat UTF-8 buffer with offsets, and words,
shingles and hashes are derived with whole-array numpy operations.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_CACHE: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, cached per worker."""
    have = _CACHE.get(base)
    if have is None or len(have) < n:
        have = _CACHE[base] = _powers(base, max(n, 1 << 16))
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit words."""
    x = x.astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls read as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of about max_bytes of text (one row at least).

    Bounds the numpy temporaries of a worker; a longer text still comes whole.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = flat(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + max_bytes, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 1 << 18) -> Iterator[pa.Table]:
    """Runs of whole groups of about `rows` rows from batches sorted by key.

    A task so holds its largest group and one run, not its whole partition.
    """
    have: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        have.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(have).combine_chunks()
        k = t.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1]))
        if cut:
            yield t.slice(0, cut)
            have, n = t.slice(cut).to_batches(), n - cut
        else:
            have = t.to_batches()
            rows = max(rows, 2 * n)  # a group larger than a run: look for its end less often
    if have:
        yield pa.Table.from_batches(have).combine_chunks()


Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Return the memory that this process has free to the system."""
    _CACHE.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # GNU's C library has it
        trim(0)


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function for mapInArrow, after whose last batch the worker gives back the memory that it has free.

    Spark keeps workers and gives tasks to each in turn, so what idle ones hold
    counts beside what the busy ones need.
    """

    @functools.wraps(run)
    def to_the_end(batches: Batches) -> Batches:
        yield from run(batches)
        give_back()

    return to_the_end


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word of the rows, in order.

    A word is a run of ASCII letters, digits and two-byte UTF-8 letters; each
    three- or four-byte character (CJK, emoji) is a word of its own. A word
    never crosses rows.
    """
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    narrow = _NARROW[buf]
    cont = (buf & 0xC0) == 0x80
    lead = buf >= 0xE0
    if lead.any():
        wide = lead.copy()
        for k in (1, 2, 3):
            wide[k:] |= lead[:-k] & cont[k:]
        # a continuation byte after a two-byte lead is not wide
        two = (buf >= 0xC0) & ~lead
        after_two = np.zeros(n, bool)
        after_two[1:] = two[:-1]
        wide &= ~(after_two & cont)
        narrow &= ~wide
        start_w = lead
    else:
        wide = start_w = None
    begin = narrow.copy()
    begin[1:] &= ~narrow[:-1]
    edge = off[1:-1]
    edge = edge[edge < n]
    begin[edge] |= narrow[edge]
    stop = np.zeros(n + 1, bool)
    stop[1:] = narrow
    stop[1:-1] &= ~narrow[1:]
    stop[edge] |= np.where(edge > 0, narrow[edge - 1], False)
    if start_w is not None:
        begin |= start_w
        ends_w = np.zeros(n + 1, bool)
        ends_w[1:] = wide
        ends_w[1:-1] &= ~wide[1:] | lead[1:]
        ends_w[edge] |= np.where(edge > 0, wide[edge - 1], False)
        stop |= ends_w
    s = np.flatnonzero(begin)
    e = np.flatnonzero(stop)
    row = np.searchsorted(off, s, side="right") - 1
    return s, e, row


_NARROW = np.zeros(256, bool)
_NARROW[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_NARROW[0x80:0xE0] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def fold_case(buf: np.ndarray) -> np.ndarray:
    """ASCII capitals to small letters."""
    return _FOLD[buf]


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each buf[start:end]; equal bytes hash equally anywhere."""
    n = len(buf)
    with np.errstate(over="ignore"):
        acc = np.zeros(n + 1, U64)
        np.cumsum((buf.astype(U64) + U64(1)) * powers(_R, n), out=acc[1:])
        h = (acc[end] - acc[start]) * powers(_R_INV, n + 1)[start]
    return mix(h)


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, row) of each case-folded word."""
    s, e, row = words(buf, off)
    return span_hash(fold_case(buf), s, e), s, e, row


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word) of each run of `width` words within a row.

    A row of 1 to width-1 words yields one shingle of all its words.
    """
    count = np.bincount(row, minlength=n_rows) if len(row) else np.zeros(n_rows, np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    n = len(h)
    z = np.zeros(0, np.int64)
    if n == 0:
        return np.zeros(0, U64), z, z
    with np.errstate(over="ignore"):
        acc = np.zeros(n + 1, U64)
        np.cumsum(h * powers(_R, n), out=acc[1:])
        pos = np.arange(n, dtype=np.int64)
        last = first[row + 1]
        ok = (pos + width <= last) | ((pos == first[row]) & (count[row] < width))
        s = pos[ok]
        e = np.minimum(s + width, last[ok])
        g = (acc[e] - acc[s]) * powers(_R_INV, n + 1)[s] + (e - s).astype(U64)
    return mix(g), row[s], s
