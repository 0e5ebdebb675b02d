"""Sidecar files: recovery data and signatures beside content.

Recovery: magic (8), version, data and parity shards (u16), shard size, length
(u64), hash of the whole, hashes of all shards, parity payloads. Signature:
magic (8), public key (32), content hash (32), signature (64). Hashes are
SHA-256.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import recovery

MAGIC, SIGNED = b"PARITY01", b"SIGNED01"
_HEAD = "<8sBHHQQ32s"


class Invalid(ValueError):
    pass


def geometry(n_bytes: int, redundancy: float, shard: int = recovery.SHARD) -> tuple[int, int, int]:
    """(data shards, shard size, parity shards)."""
    r = min(max(redundancy, 0.01), 1.0)
    n = min(max(-(-n_bytes // shard), 1), recovery.MAX_SHARDS)
    return n, max(1, -(-n_bytes // n)), max(1, min(255 - n, int(n * r + 0.5)))


def _split(data: bytes, n: int, size: int) -> np.ndarray:
    return np.frombuffer(data[: n * size].ljust(n * size, b"\0"), np.uint8).reshape(n, size)


def create(data: bytes, redundancy: float = 0.1, shard: int = recovery.SHARD) -> bytes:
    n, size, m = geometry(len(data), redundancy, shard)
    rows = _split(data, n, size)
    extra = recovery.parity(rows, m)
    hashes = b"".join(hashlib.sha256(x.tobytes()).digest() for x in (*rows, *extra))
    return struct.pack(_HEAD, MAGIC, 1, n, m, size, len(data), hashlib.sha256(data).digest()) + hashes + extra.tobytes()


def parse(side: bytes) -> tuple[int, int, int, int, bytes, list[bytes], np.ndarray]:
    """The fields; sizes that do not fit together are refused before anything is allocated."""
    k = struct.calcsize(_HEAD)
    if len(side) < k:
        raise Invalid("too short")
    magic, version, n, m, size, length, whole = struct.unpack_from(_HEAD, side)
    if magic != MAGIC or version != 1 or not n or not m or n + m > 255 or not size:
        raise Invalid("not a recovery file of a known version")
    if length > n * size or len(side) != k + 32 * (n + m) + m * size:
        raise Invalid("the sizes do not fit together")
    hashes = [side[k + 32 * i : k + 32 * i + 32] for i in range(n + m)]
    return n, m, size, length, whole, hashes, np.frombuffer(side, np.uint8, m * size, k + 32 * (n + m)).reshape(m, size)


def check(data: bytes, side: bytes) -> str:
    """intact, repairable or lost."""
    n, m, size, length, whole, hashes, extra = parse(side)
    if len(data) == length and hashlib.sha256(data).digest() == whole:
        return "intact"
    rows = [*_split(data, n, size), *extra]
    bad = sum(hashlib.sha256(x.tobytes()).digest() != h for x, h in zip(rows, hashes, strict=True))
    return "repairable" if bad <= m else "lost"


def repair(data: bytes, side: bytes) -> bytes:
    n, m, size, length, whole, hashes, extra = parse(side)
    rows = np.concatenate([_split(data, n, size), extra])
    good = np.array([i for i in range(n + m) if hashlib.sha256(rows[i].tobytes()).digest() == hashes[i]])
    if len(good) < n:
        raise Invalid(f"{len(good)} of {n} shards are intact")
    out = recovery.repair(n, m, good, rows[good]).tobytes()[:length]
    if hashlib.sha256(out).digest() != whole:
        raise Invalid("the repaired content is not the original")
    return out


def sign(signer: recovery.Signer, data: bytes) -> bytes:
    key = signer.public_key()
    digest = hashlib.sha256(data).digest()
    return SIGNED + key + digest + signer.sign(digest)


def verify(signer: recovery.Signer, data: bytes, side: bytes, pinned: bytes | None = None) -> None:
    """Shape, pinned key, hash, signature, in this order; raises what is wrong first."""
    if len(side) != 136 or side[:8] != SIGNED:
        raise Invalid("not a signature file")
    if pinned is not None and side[8:40] != pinned:
        raise Invalid("signed with another key")
    digest = hashlib.sha256(data).digest()
    if side[40:72] != digest:
        raise Invalid("the content has changed")
    if not signer.verify(digest, side[72:]):
        raise Invalid("the signature is wrong")


def with_sidecars(files: DataFrame, redundancy: float = 0.1, shard: int = recovery.SHARD) -> DataFrame:
    """(path, sidecar) of each file, made side by side."""
    make = F.udf(lambda x: create(bytes(x), redundancy, shard) if x is not None else None, "binary")
    return files.select("path", make("content").alias("sidecar"))


def states(files: DataFrame, sides: DataFrame) -> DataFrame:
    """(path, state): intact, repairable, lost, or invalid for an unreadable sidecar."""

    def one(data, side):
        try:
            return check(bytes(data), bytes(side))
        except Invalid:
            return "invalid"

    return files.join(sides, "path").select("path", F.udf(one, "string")("content", "sidecar").alias("state"))
