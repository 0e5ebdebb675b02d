"""Recovery: shard geometry, hashes, damage, Reed-Solomon parity and repair; seals and signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD, MAX_SHARDS = 256 * 1024, 200


def geometry(size: Column, redundancy: float, shard: int = SHARD) -> dict[str, Column]:
    """n data shards, their size and m parity shards for a length."""
    r = min(max(redundancy, 0.01), 1.0)
    n = F.greatest(F.lit(1), F.least(F.lit(MAX_SHARDS), F.ceil(size / shard))).cast("int")
    shard_size = F.greatest(F.lit(1), F.ceil(size / n)).cast("long")
    m = F.greatest(F.lit(1), F.least(F.lit(255) - n, F.round(n * F.lit(r)).cast("int"))).cast("int")
    return {"n": n, "shard_size": shard_size, "m": m}


def shards(files: DataFrame, redundancy: float = 0.1, shard: int = SHARD) -> DataFrame:
    """entry_idx, idx, payload (zero padded) of the data shards."""
    g = files.select("entry_idx", "content", "size").withColumns(geometry(F.col("size"), redundancy, shard))
    e = g.select("entry_idx", "content", "shard_size", "m", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("idx"))
    part = F.substring("content", (F.col("idx") * F.col("shard_size") + 1).cast("int"), F.col("shard_size").cast("int"))
    return e.select("entry_idx", "idx", "n", "m", F.rpad(part, F.col("shard_size").cast("int"), F.lit(b"\0")).alias("payload"))


def hashes(sh: DataFrame) -> DataFrame:
    return sh.select("entry_idx", "idx", F.sha2("payload", 256).alias("hash"))


def damage(stored: DataFrame, now: DataFrame, parity: Column | str = "m") -> DataFrame:
    """entry_idx, damaged, state: intact, repairable (at most m shards), lost."""
    n = now.select("entry_idx", "idx", F.col("hash").alias("now"))
    j = stored.join(n, ["entry_idx", "idx"], "left").groupBy("entry_idx").agg(F.count_if(~F.coalesce(F.col("now") == F.col("hash"), F.lit(False))).alias("damaged"), F.max(parity).alias("m"))
    return j.select("entry_idx", "damaged", F.when(F.col("damaged") == 0, "intact").when(F.col("damaged") <= F.col("m"), "repairable").otherwise("lost").alias("state"))


# GF(2^8) with the polynomial 0x11d
_EXP = np.zeros(512, np.uint8)
_LOG = np.zeros(256, np.int64)
_x = 1
for _i in range(255):
    _EXP[_i], _LOG[_x] = _x, _i
    _x = (_x << 1) ^ (0x11D if _x & 0x80 else 0)
_EXP[255:510] = _EXP[:255]


def gf_mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = np.asarray(a, np.uint8), np.asarray(b, np.uint8)
    return np.where((a == 0) | (b == 0), 0, _EXP[_LOG[a] + _LOG[b]]).astype(np.uint8)


def gf_dot(m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Matrix product over the field; d: shards x bytes."""
    out = np.zeros((len(m), d.shape[1]), np.uint8)
    for i in range(m.shape[1]):
        out ^= gf_mul(m[:, i : i + 1], d[i : i + 1])
    return out


def gf_inverse(m: np.ndarray) -> np.ndarray:
    n = len(m)
    a = np.concatenate([m.astype(np.uint8), np.eye(n, dtype=np.uint8)], axis=1)
    for c in range(n):
        p = c + int(np.argmax(a[c:, c] != 0))
        if a[p, c] == 0:
            raise ValueError("singular")
        a[[c, p]] = a[[p, c]]
        a[c] = gf_mul(a[c], _EXP[255 - _LOG[a[c, c]]])
        rest = np.arange(n) != c
        a[rest] ^= gf_mul(a[rest, c : c + 1], a[c : c + 1])
    return a[:, n:]


def systematic(n: int, m: int) -> np.ndarray:
    """Vandermonde matrix of n + m rows made systematic: the first n rows are the identity."""
    rows = np.arange(n + m)[:, None]
    v = np.where((rows == 0) & (np.arange(n)[None, :] > 0), 0, _EXP[(_LOG[np.maximum(rows, 1)] * np.arange(n)[None, :]) % 255])
    v[:, 0] = 1
    return gf_dot(v.astype(np.uint8), gf_inverse(v[:n].astype(np.uint8)))


def parity(data: np.ndarray, m: int) -> np.ndarray:
    return gf_dot(systematic(len(data), m)[len(data) :], data)


def repair(n: int, m: int, idx: np.ndarray, payload: np.ndarray) -> np.ndarray:
    """The n data shards from any n intact shards (idx: their numbers, data before parity)."""
    if len(idx) < n:
        raise ValueError(f"{len(idx)} of {n} shards are intact")
    idx, payload = idx[:n], payload[:n]
    return gf_dot(gf_inverse(systematic(n, m)[idx]), payload)


def with_parity(sh: DataFrame) -> DataFrame:
    """entry_idx, idx, n, m, payload of data and parity shards."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        n, m = t.column("n")[0].as_py(), t.column("m")[0].as_py()
        data = np.stack([np.frombuffer(x, np.uint8) for x in t.column("payload").to_pylist()])
        extra = parity(data, m)
        k = n + m
        return pa.table({"entry_idx": pa.array([t.column("entry_idx")[0].as_py()] * k, pa.int64()), "idx": pa.array(range(k), pa.int32()), "n": pa.array([n] * k, pa.int32()), "m": pa.array([m] * k, pa.int32()), "payload": pa.array([x.tobytes() for x in np.concatenate([data, extra])], pa.binary())})

    return sh.groupBy("entry_idx").applyInArrow(run, "entry_idx long, idx int, n int, m int, payload binary")


def repaired(intact: DataFrame) -> DataFrame:
    """entry_idx, content (padded), ok from the intact shards of each file."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        n, m = t.column("n")[0].as_py(), t.column("m")[0].as_py()
        try:
            data = repair(n, m, t.column("idx").to_numpy(), np.stack([np.frombuffer(x, np.uint8) for x in t.column("payload").to_pylist()])).tobytes()
        except ValueError:
            data = None
        return pa.table({"entry_idx": t.column("entry_idx").slice(0, 1), "content": pa.array([data], pa.binary()), "ok": pa.array([data is not None])})

    return intact.groupBy("entry_idx").applyInArrow(run, "entry_idx long, content binary, ok boolean")


def seal(content: Column, key: bytes, nonce: Column, aad: Column) -> Column:
    """AES-256-GCM: nonce, ciphertext and tag; aad is bound but not stored."""
    return F.aes_encrypt(content, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), nonce, aad)


def unseal(sealed: Column, key: bytes, aad: Column) -> Column:
    return F.aes_decrypt(sealed, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), aad)


DOMAIN = b"content-signature-v1"


class Signer:
    """Ed25519 signatures over DOMAIN and a content hash, by the JVM of the driver."""

    def __init__(self, spark, pair=None):
        self.jvm = spark.sparkContext._jvm
        self.pair = pair or self.jvm.java.security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair()

    def public_key(self) -> bytes:
        """The 32 bytes of the key."""
        spec = self.jvm.java.lang.Class.forName("java.security.spec.X509EncodedKeySpec")
        return bytes(self.jvm.java.security.KeyFactory.getInstance("Ed25519").getKeySpec(self.pair.getPublic(), spec).getEncoded())[-32:]

    def sign(self, digest: bytes) -> bytes:
        s = self.jvm.java.security.Signature.getInstance("Ed25519")
        s.initSign(self.pair.getPrivate())
        s.update(bytearray(DOMAIN + digest))
        return bytes(s.sign())

    def verify(self, digest: bytes, signature: bytes) -> bool:
        s = self.jvm.java.security.Signature.getInstance("Ed25519")
        s.initVerify(self.pair.getPublic())
        s.update(bytearray(DOMAIN + digest))
        return bool(s.verify(bytearray(signature)))
