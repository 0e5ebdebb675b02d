"""Archives from rows: zip, tar with a codec, and solid pack archives.

Contents are compressed side by side in tasks; one ordered pass on the driver
joins the pieces (an archive is one file), holding one entry or pack at a time.
"""

import io
import os
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import codecs
from tidemill.operators import chunks as C
from tidemill.sources import pack, sevenzip


def _ordered(entries: DataFrame):
    """Rows in order of path, fetched partition by partition."""
    return entries.select("path", "content").orderBy("path").toLocalIterator()


def write_zip(entries: DataFrame, path: str, store: bool = False) -> int:
    n = 0
    partial = f"{path}.partial"
    with zipfile.ZipFile(partial, "w", zipfile.ZIP_STORED if store else zipfile.ZIP_DEFLATED) as z:
        for r in _ordered(entries):
            z.writestr(zipfile.ZipInfo(r["path"].lstrip("/"), (1980, 1, 1, 0, 0, 0)), bytes(r["content"]), compress_type=z.compression)
            n += 1
    os.replace(partial, path)
    return n


def write_tar(entries: DataFrame, path: str, codec: str = "none") -> int:
    """Members are compressed in tasks as streams of their own, which read back as one."""
    if codec not in ("none", "gzip", "bzip2", "xz", "zstd", "lz4"):
        raise ValueError(f"no concatenated streams with {codec}")

    @F.pandas_udf("binary")
    def member(name: pd.Series, content: pd.Series) -> pd.Series:
        def one(n, data):
            info = tarfile.TarInfo(n.lstrip("/"))
            info.size, info.mode = len(data), 0o644
            buf = io.BytesIO()
            buf.write(info.tobuf(tarfile.PAX_FORMAT))
            buf.write(data)
            buf.write(b"\0" * (-len(data) % 512))
            return codecs.encode(codec, buf.getvalue())

        return name.combine(content, one)

    n = 0
    partial = f"{path}.partial"
    with open(partial, "wb") as f:
        for r in entries.select("path", member("path", "content").alias("m")).orderBy("path").select("m").toLocalIterator():
            f.write(r["m"])
            n += 1
        f.write(codecs.encode(codec, b"\0" * 1024))
    os.replace(partial, path)
    return n


def write_pack(entries: DataFrame, path: str, target: int = 16 << 20, low: int = 16384, average: int = 65536, high: int = 262144) -> dict:
    """Content-defined chunks, each stored once, in packs that close at the target."""
    e = entries.select("path", "content").withColumn("size", F.octet_length("content").cast("long"))
    names = [(r["path"].lstrip("/"), r["size"]) for r in e.select("path", "size").orderBy("path").collect()]
    order = entries.sparkSession.createDataFrame([(p, i) for i, (p, _) in enumerate(names)], "name string, entry_idx long")
    numbered = e.join(order, F.ltrim(e["path"], F.lit("/")) == order["name"]).select("entry_idx", "content", "size")
    cut = C.cdc_chunks(numbered, low, average, high).persist()
    try:
        ids = C.numbered(C.first_seen(cut)).persist()
        placed = {r["chunk_id"]: (r["pack_id"], r["length"]) for r in C.assign_packs(ids, target).collect()}
        table, fill = [], {}
        for k in range(len(placed)):
            p, n = placed[k]
            table.append((p, fill.get(p, 0), n))
            fill[p] = fill.get(p, 0) + n
        of: dict[int, list[int]] = {}
        for r in C.entry_map(cut, ids).orderBy("entry_idx", "pos").collect():
            of.setdefault(r["entry_idx"], []).append(r["chunk_id"])
        at = cut.select("hash", "entry_idx", "pos", F.col("start").alias("begin"))
        data = ids.join(at, ["hash", "entry_idx", "pos"]).join(numbered.select("entry_idx", "content"), "entry_idx")
        blobs = data.select("chunk_id", F.substring("content", (F.col("begin") + 1).cast("int"), F.col("length").cast("int")).alias("blob")).orderBy("chunk_id").toLocalIterator()

        def packs():
            buf, now = [], 0
            for r in blobs:
                p = table[r["chunk_id"]][0]
                if p != now:
                    yield b"".join(buf)
                    buf, now = [], p
                buf.append(bytes(r["blob"]))
            if buf:
                yield b"".join(buf)

        rows = [{"name": n, "is_dir": False, "size": s or 0, "mode": 0o644, "chunk_ids": of.get(i, [])} for i, (n, s) in enumerate(names)]
        pack.write(path, rows, table, packs())
    finally:
        cut.unpersist()
    total = sum(s or 0 for _, s in names)
    return {"entries": len(names), "in_bytes": total, "out_bytes": os.path.getsize(path), "dedup_saved": total - sum(n for *_, n in table)}


def write_7z(entries: DataFrame, path: str, block_bytes: int = 128 << 20, block_entries: int = 8192) -> int:
    """Solid blocks in order of path."""
    files = [(r["path"].lstrip("/"), bytes(r["content"])) for r in _ordered(entries)]
    partial = f"{path}.partial"
    sevenzip.write(partial, files, block_bytes, block_entries)
    os.replace(partial, path)
    return len(files)


WRITERS = {
    "zip/none": write_zip,
    "7z/none": write_7z,
    "pack/none": write_pack,
    **{f"tar/{c}": (lambda e, p, c=c: write_tar(e, p, c)) for c in ("none", "gzip", "bzip2", "xz", "zstd", "lz4")},
}


def create(entries: DataFrame, path: str, fmt: str, overwrite: bool = False):
    """Write (path, content) rows as an archive of the format, container/codec."""
    if fmt not in WRITERS:
        raise ValueError(f"can't write {fmt}")
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    return WRITERS[fmt](entries, path)


def convert(spark, source: str, dest: str, fmt: str, overwrite: bool = False):
    """Entries of an archive written in another format; any that can't be read stops it."""
    got = spark.read.format("archive").option("content", "true").load(source)
    bad = got.where("status <> 'ok' or (kind = 'file' and safe_path is null)").select("raw_path", "status").first()
    if bad:
        raise ValueError(f"{bad['raw_path']}: {bad['status']}")
    return create(got.where("kind = 'file'").select(F.col("safe_path").alias("path"), "content"), dest, fmt, overwrite)


def extract(spark, source: str, folder: str) -> dict:
    """Files of archives below a folder; what is there with equal size and CRC-32 is skipped."""
    import zlib

    got = spark.read.format("archive").option("content", "true").load(source).where("kind = 'file'")

    def there(rel: str, size: int, crc: int) -> bool:
        p = os.path.join(folder, rel)
        if not os.path.isfile(p) or os.path.getsize(p) != size:
            return False
        with open(p, "rb") as f:
            return zlib.crc32(f.read()) == crc

    same = F.udf(there, "boolean")
    good = got.where("status = 'ok' and safe_path is not null and content is not null")
    todo = good.withColumn("skip", same("safe_path", F.octet_length("content").cast("long"), F.crc32("content")))
    counts = todo.groupBy("skip").agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("b")).collect()
    todo.where("not skip").repartition("safe_path").sortWithinPartitions("safe_path", "index").select("safe_path", "content", "modified").write.format("extract").mode("append").save(folder)
    total = {r["skip"]: (r["n"], r["b"]) for r in counts}
    return {"extracted": total.get(False, (0, 0))[0], "bytes": total.get(False, (0, 0))[1] or 0, "skipped": total.get(True, (0, 0))[0], "refused": got.count() - good.count()}
