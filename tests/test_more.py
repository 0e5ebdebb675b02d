import io
import os
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_operators import blob, files
from tests.test_sources import rows
from tidemill.operators import apply, chunks, dedup, images, reclaim, recovery, sidecars
from tidemill.sources import archives, sevenzip, writers
from tidemill.streaming import growing


def test_7z_round_trip(spark, tmp_path):
    archives.register(spark)
    body = {"a/b.txt": b"hello " * 5000, "é.bin": blob(70000), "empty": b"", "c": b"x"}
    writers.create(rows(spark, body), f"{tmp_path}/o.7z", "7z/none")
    got = spark.read.format("archive").option("content", "true").load(f"{tmp_path}/o.7z").collect()
    assert {r.safe_path: bytes(r.content) for r in got} == body and all(r.status == "ok" for r in got)
    with pytest.raises(FileExistsError):
        writers.create(rows(spark, body), f"{tmp_path}/o.7z", "7z/none")
    writers.convert(spark, f"{tmp_path}/o.7z", f"{tmp_path}/o.zip", "zip/none")
    rep = writers.extract(spark, f"{tmp_path}/o.zip", f"{tmp_path}/out")
    assert rep["extracted"] == 4 and writers.extract(spark, f"{tmp_path}/o.zip", f"{tmp_path}/out")["skipped"] == 4
    assert {n: open(f"{tmp_path}/out/{n}", "rb").read() for n in body} == body
    bad = bytearray((tmp_path / "o.7z").read_bytes())
    bad[40] ^= 1
    (tmp_path / "bad.7z").write_bytes(bad)
    with pytest.raises(Exception):
        r = sevenzip.Reader(f"{tmp_path}/bad.7z")
        [r.read(i) for i in range(len(r.entries))]


def test_solid_blocks_and_lines(spark):
    e = spark.createDataFrame([(0, 5, False), (1, 6, False), (2, 1, True), (3, 1, True), (4, 1, True), (5, 20, False)], "index long, size long, stored boolean")
    assert [r.block for r in chunks.solid_blocks(e, 10, 2).orderBy("index").collect()] == [0, 0, 1, 1, 2, 3]
    f = files(spark, [("x", b"\n".join(b"line %d" % i for i in range(200)), "v")])
    c = chunks.line_cdc_chunks(f).collect()
    assert sum(r.length for r in c) == f.first()["size"] and 1 < len(c) < 200
    g = spark.createDataFrame([(bytearray(b"abcdef"), 3), (bytearray(b"ab"), 4)], "c binary, n long").select(chunks.sized(F.col("c"), F.col("n")).alias("x")).collect()
    assert [bytes(r.x) for r in g] == [b"abc", b"ab\0\0"]


def test_sidecars(spark):
    data = blob(100_000, 9)
    side = sidecars.create(data, 0.1, 4096)
    n, m, size, *_ = sidecars.parse(side)
    assert (n, size, m) == (25, 4000, 3) and sidecars.check(data, side) == "intact"
    hurt = bytearray(data)
    for k in (0, 5, 24):
        hurt[k * size + 1] ^= 1
    assert sidecars.check(bytes(hurt), side) == "repairable" and sidecars.repair(bytes(hurt), side) == data
    assert sidecars.repair(data[:-5000], side) == data
    hurt[10 * size] ^= 1
    assert sidecars.check(bytes(hurt), side) == "lost"
    with pytest.raises(sidecars.Invalid):
        sidecars.repair(bytes(hurt), side)
    for bad in (b"", side[:-1], b"X" + side[1:]):
        with pytest.raises(sidecars.Invalid):
            sidecars.parse(bad)
    f = files(spark, [("x", data, "v"), ("y", b"", "v")])
    sides = sidecars.with_sidecars(f, 0.1, 4096)
    assert {r.path: r.state for r in sidecars.states(f, sides).collect()} == {"x": "intact", "y": "intact"}
    s = recovery.Signer(spark)
    sig = sidecars.sign(s, data)
    sidecars.verify(s, data, sig, sig[8:40])
    for args in ((data + b"x", sig, None), (data, sig[:-1], None), (data, sig, b"k" * 32), (data, sig[:-1] + bytes([sig[-1] ^ 1]), None)):
        with pytest.raises(sidecars.Invalid):
            sidecars.verify(s, *args)


def test_apply_plan(spark, tmp_path):
    for n in ("a", "b", "c", "d"):
        (tmp_path / n).write_bytes(b"same" if n != "d" else b"diff")
    p = str(tmp_path)
    plan = spark.createDataFrame([(f"{p}/a", f"{p}/b", "link", 4, None), (f"{p}/a", f"{p}/c", "quarantine", 4, f"{p}/q/c"), (f"{p}/a", f"{p}/d", "link", 4, None), (f"{p}/a", f"{p}/gone", "link", 4, None)], "keeper string, victim string, action string, bytes long, dest string")
    assert [r.status for r in apply.apply(plan).collect()][:2] == ["would be done"] * 2 and not os.path.samefile(f"{p}/a", f"{p}/b")
    got = {os.path.basename(r.victim): (r.status, r.bytes) for r in apply.apply(plan, dry_run=False).collect()}
    assert got["b"] == ("done", 4) and got["c"] == ("done", 4) and got["d"] == ("content differs now", 0) and got["gone"][0].startswith("failed")
    assert os.path.samefile(f"{p}/a", f"{p}/b") and (tmp_path / "q" / "c").read_bytes() == b"same" and not (tmp_path / "c").exists()
    m = dedup.members(files(spark, [("/x", b"1", "v"), ("/y", b"1", "w")]))
    assert reclaim.plan(reclaim.decisions(m, "first", "/q")).first().dest == "/q/y"


def test_images(spark):
    r = np.random.default_rng(1)
    x = np.kron(r.integers(0, 255, (8, 9)), np.ones((16, 16)))[:, :, None].repeat(3, 2).astype(np.uint8)
    big = np.kron(x, np.ones((2, 2, 1))).astype(np.uint8)
    assert bin((images.dhash(x) ^ images.dhash(big)) & (1 << 64) - 1).count("1") <= 2
    assert images.dhash(np.tile(np.arange(90, 0, -1)[None, :, None], (80, 1, 3)).astype(np.uint8)) == -1
    df = spark.createDataFrame([(("f", 128, 144, 3, 16, bytearray(x.tobytes())),), (("bad", -1, -1, -1, -1, bytearray()),)], "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>")
    p = images.prints(df)
    assert images.unreadable(p).first().unreadable == 1 and len(p.where("sig is not null").first().v) == 64 * 64 * 3


def test_growing_tar(spark, tmp_path):
    spark.dataSource.register(growing.GrowingFile)
    body = {f"dir/f{i}.txt": blob(3000 + i, i + 1) for i in range(5)}
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w") as t:
        for n, c in body.items():
            i = tarfile.TarInfo(n)
            i.size = len(c)
            t.addfile(i, io.BytesIO(c))
    whole = buf.getvalue()
    path = tmp_path / "g.tar"

    def run(upto):
        path.write_bytes(whole[:upto])
        s = spark.readStream.format("growing").option("path", str(path)).option("slice", "1000").load()
        q = growing.members(s).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return {r.name: bytes(r.content) for r in spark.read.schema("path string, name string, content binary").parquet(f"{tmp_path}/out").collect()}

    first = run(8000)
    assert 0 < len(first) < 5 and all(body[n] == c for n, c in first.items())
    assert run(len(whole)) == body
    members, used = growing.split_tar(whole[:5000])
    assert len(members) == 1 and used == 512 + 3072
