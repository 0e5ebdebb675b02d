import io
import os
import random
import tarfile
import tracemalloc
import zipfile

import pytest

from tidemill.functions import codecs
from tidemill.plans import registry
from tidemill.sources import archives, iso, pack, writers


@pytest.fixture(scope="module")
def reg(spark):
    archives.register(spark)
    return spark


@pytest.fixture
def tree(tmp_path):
    r = random.Random(3)
    body = {"README.md": b"hello\n" * 50, "src/a.txt": b"same" * 30000, "assets/copy.txt": b"same" * 30000, "empty.txt": b"", "bin/ramp.bin": bytes(range(256)) * 20, "noise.bin": bytes(r.randrange(256) for _ in range(90000))}
    for n, c in body.items():
        p = tmp_path / "tree" / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(c)
    return tmp_path, body


def rows(spark, body):
    return spark.createDataFrame([(n, bytearray(c)) for n, c in body.items()], "path string, content binary")


def load(spark, path):
    got = spark.read.format("archive").option("content", "true").load(str(path)).collect()
    assert all(r.status == "ok" for r in got), [r.status for r in got]
    return {r.safe_path: bytes(r.content) for r in got if r.kind == "file"}


@pytest.mark.parametrize("codec", ["gzip", "xz", "zstd", "bzip2", "lz4", "brotli", "none"])
def test_codecs(codec):
    data = os.urandom(3000) + b"text " * 9000
    assert codecs.decode(codec, codecs.encode(codec, data)) == data
    if codec not in ("brotli", "none"):
        assert codecs.decode(codec, codecs.encode(codec, data) + codecs.encode(codec, b"more")) == data + b"more"
        with pytest.raises(Exception):
            codecs.decode(codec, codecs.encode(codec, data)[:-9])


def test_skippable_frames_and_seams():
    skip = b"\x50\x2a\x4d\x18\x04\x00\x00\x00abcd"
    assert codecs.decode("zstd", skip + codecs.encode("zstd", b"x") + skip + codecs.encode("zstd", b"y")) == b"xy"
    parts = [os.urandom(4000) for _ in range(5)]
    for codec in ("bzip2", "xz"):
        whole = b"".join(codecs.encode(codec, p) for p in parts)
        assert len(codecs.seams(codec, whole, 1)) >= 5 and b"".join(codecs.decode_seams(codec, whole, 1)) == b"".join(parts)


@pytest.mark.parametrize("codec, module, new", [("zstd", codecs.zstandard, "ZstdDecompressor"), ("gzip", codecs.zlib, "decompressobj"), ("bzip2", codecs.bz2, "BZ2Decompressor"), ("xz", codecs.lzma, "LZMADecompressor")])
def test_members_are_read_once(monkeypatch, codec, module, new):
    """What is handed to decompressors is in proportion to the stream, however many members it has."""
    parts = [os.urandom(9000) for _ in range(200)]
    whole = b"".join(codecs.encode(codec, p) for p in parts)
    handed = 0

    class Counted:
        def __init__(self, d):
            self.d = d

        def __getattr__(self, name):
            return getattr(self.d, name)

        def decompressobj(self):
            return Counted(self.d.decompressobj())

        def decompress(self, data):
            nonlocal handed
            handed += len(data)
            return self.d.decompress(data)

    real = getattr(module, new)
    monkeypatch.setattr(module, new, lambda *a: Counted(real(*a)))
    assert codecs.decode(codec, whole) == b"".join(parts)
    assert len(whole) <= handed < 4 * len(whole)


@pytest.mark.parametrize("codec", ["zstd", "gzip", "lz4"])
def test_compressed_tar_is_not_held_whole(tmp_path, codec):
    made = tmp_path / "t.tar"
    bodies = [os.urandom(1 << 19).hex().encode() for _ in range(40)]
    with tarfile.open(made, "w") as t:
        for k, body in enumerate(bodies):
            i = tarfile.TarInfo(f"{k}")
            i.size = len(body)
            t.addfile(i, io.BytesIO(body))
    packed = tmp_path / f"t.tar.{codec}"
    packed.write_bytes(codecs.encode(codec, made.read_bytes()))
    tracemalloc.start()
    try:
        for k, row in enumerate(archives.entries(str(packed), True)):
            assert row[3] == f"{k}" and row[-1] == bodies[k]
        assert k == 39 and tracemalloc.get_traced_memory()[1] < (50 if codec == "lz4" else 10) << 20
    finally:
        tracemalloc.stop()


def test_damaged_compressed_tar_gives_no_good_row(reg, tree):
    """The last frame is damaged: none of the entries before it counts as read."""
    tmp, body = tree
    writers.write_tar(rows(reg, body), f"{tmp}/o.tar.zst", "zstd")
    whole = (tmp / "o.tar.zst").read_bytes()
    for name, bad in (("cut", whole[:-3]), ("junk", whole + b"junkjunk")):
        (tmp / f"{name}.tar.zst").write_bytes(bad)
        got = reg.read.format("archive").option("content", "true").load(f"{tmp}/{name}.tar.zst").collect()
        assert len(got) == 1 and got[0].status.startswith("damaged")


def test_zip_tar_pack_round_trip(reg, tree):
    tmp, body = tree
    df = rows(reg, body)
    writers.write_zip(df, f"{tmp}/o.zip")
    writers.write_tar(df, f"{tmp}/o.tar")
    for ext, codec in (("gz", "gzip"), ("xz", "xz"), ("zst", "zstd"), ("bz2", "bzip2"), ("lz4", "lz4")):
        writers.write_tar(df, f"{tmp}/o.tar.{ext}", codec)
    rep = writers.write_pack(df, f"{tmp}/o.pack", target=100_000, low=2048, average=8192, high=32768)
    assert rep["dedup_saved"] >= 110_000 and rep["in_bytes"] == sum(map(len, body.values()))
    for n in ("o.zip", "o.tar", "o.tar.gz", "o.tar.xz", "o.tar.zst", "o.tar.bz2", "o.tar.lz4", "o.pack"):
        assert load(reg, tmp / n) == body, n
    with tarfile.open(f"{tmp}/o.tar.gz") as t:
        assert {m.name for m in t} == set(body)
    r = pack.Reader(f"{tmp}/o.pack")
    k = next(i for i, e in enumerate(r.index.entries) if e["name"] == "noise.bin")
    assert r.read(k, 1000, 50000) == body["noise.bin"][1000:51000]


def test_damaged_archives_are_rows_not_crashes(reg, tree):
    tmp, body = tree
    writers.write_pack(rows(reg, body), f"{tmp}/p.pack", target=50_000, low=2048, average=8192, high=32768)
    good = (tmp / "p.pack").read_bytes()
    r = random.Random(5)
    os.makedirs(tmp / "bad")
    for k in range(30):
        x = bytearray(good)
        if k % 3 == 0:
            x = x[: r.randrange(len(x))]
        else:
            for _ in range(4):
                x[r.randrange(len(x) - 400, len(x))] ^= 1 << r.randrange(8)
        (tmp / "bad" / f"{k}.pack").write_bytes(x)
    (tmp / "bad" / "x.zip").write_bytes(b"PK\x03\x04" + b"\0" * 50)
    (tmp / "bad" / "y.rar").write_bytes(b"Rar!\x1a\x07\x00" + b"\0" * 50)
    got = reg.read.format("archive").option("content", "true").load(f"{tmp}/bad").collect()
    assert {os.path.basename(g.archive) for g in got} == set(os.listdir(tmp / "bad"))
    assert any(g.status == "unsupported" for g in got)


def test_unsafe_names_and_raw_streams(reg, tmp_path):
    with zipfile.ZipFile(tmp_path / "u.zip", "w") as z:
        z.writestr("../evil", "x")
        z.writestr("/abs/ok", "y")
    got = {r.raw_path: r.safe_path for r in reg.read.format("archive").load(f"{tmp_path}/u.zip").collect()}
    assert got == {"../evil": None, "/abs/ok": "abs/ok"}
    (tmp_path / "a.txt.gz").write_bytes(codecs.encode("gzip", b"one") + codecs.encode("gzip", b"two"))
    assert load(reg, tmp_path / "a.txt.gz") == {"a.txt": b"onetwo"}


def image(names):
    """A small ISO 9660 image with files in its root."""
    sec = 2048
    rec = lambda name, lba, n, flags: (lambda raw: bytes([33 + len(raw) + (len(raw) + 1) % 2, 0]) + lba.to_bytes(4, "little") + lba.to_bytes(4, "big") + n.to_bytes(4, "little") + n.to_bytes(4, "big") + b"\0" * 7 + bytes([flags, 0, 0]) + b"\1\0\0\1" + bytes([len(raw)]) + raw + b"\0" * ((len(raw) + 1) % 2))(name)
    files, lba = [], 20
    for n, c in names.items():
        files.append((n, lba, c))
        lba += -(-len(c) // sec) or 1
    root = rec(b"\0", 18, sec, 2) + rec(b"\1", 18, sec, 2) + b"".join(rec(n.encode() + b";1", at, len(c), 0) for n, at, c in files)
    pvd = bytearray(sec)
    pvd[0:6] = b"\x01CD001"
    pvd[156:190] = rec(b"\0", 18, sec, 2)[:34]
    out = bytearray(sec * lba)
    out[16 * sec : 17 * sec] = pvd
    out[17 * sec : 17 * sec + 6] = b"\xffCD001"
    out[18 * sec : 18 * sec + len(root)] = root
    for _, at, c in files:
        out[at * sec : at * sec + len(c)] = c
    return bytes(out)


def test_iso(reg, tmp_path):
    (tmp_path / "d.iso").write_bytes(image({"A.TXT": b"abc", "BIG.BIN": b"z" * 5000, "NOEXT.": b"q"}))
    assert load(reg, tmp_path / "d.iso") == {"A.TXT": b"abc", "BIG.BIN": b"z" * 5000, "NOEXT": b"q"}
    assert iso.decode_name("né;1".encode("utf-16-be"), True) == "né"


def test_iso_directories_that_are_not_listed(reg, tmp_path, monkeypatch):
    (tmp_path / "d.iso").write_bytes(image({"A.TXT": b"abc"}))
    monkeypatch.setattr(iso, "MAX_DIR", 100)
    (e,) = iso.scan(f"{tmp_path}/d.iso")
    assert e.is_dir and e.truncated == "above 100 bytes"
    (row,) = archives.entries(f"{tmp_path}/d.iso", False)
    assert row[-2] == "truncated: above 100 bytes"


def test_walk_and_extract(reg, tree):
    tmp, body = tree
    os.symlink("README.md", tmp / "tree" / "link")
    os.link(tmp / "tree" / "README.md", tmp / "tree" / "hard")
    got = {os.path.relpath(r.path, tmp / "tree"): r for r in reg.read.format("files").load(f"{tmp}/tree").collect()}
    assert {k for k, r in got.items() if r.kind == "file"} == {*body, "hard"} and got["link"].link_target == "README.md"
    assert got["hard"].ino == got["README.md"].ino and got["src/a.txt"].size == 120000
    writers.write_zip(rows(reg, body), f"{tmp}/e.zip")
    e = reg.read.format("archive").option("content", "true").load(f"{tmp}/e.zip").select("safe_path", "content", "modified")
    e.write.format("extract").mode("append").save(f"{tmp}/out")
    assert {n: (tmp / "out" / n).read_bytes() for n in body} == body


def test_tar_keeps_only_files_and_directories(reg, tmp_path):
    with tarfile.open(tmp_path / "t.tar", "w") as t:
        for kind, n in ((tarfile.REGTYPE, "f"), (tarfile.SYMTYPE, "l"), (tarfile.DIRTYPE, "d")):
            i = tarfile.TarInfo(n)
            i.type, i.size, i.mtime = kind, 2 if n == "f" else 0, 0
            t.addfile(i, io.BytesIO(b"ab"))
    got = reg.read.format("archive").option("content", "true").load(f"{tmp_path}/t.tar").collect()
    assert [(r.raw_path, r.kind, r.modified) for r in got] == [("f", "file", None), ("d", "dir", None)]


def test_archive_roundtrip_of_odd_rows(spark, tmp_path):
    """Rows without a source, with an empty one, and of one id come back one by one."""
    d = [(0, "a", None), (0, "b", None), (20, "x", "s"), (20, "x", "s"), (20, "y", "s"), (40, "z", ""), (60, "", "s"), (80, None, "s"), (81, "no", "s"), (None, "no", "s")]
    spark.createDataFrame(d, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in registry.QUERIES["archive_roundtrip"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(None, True)] * 2 + [("s/20.txt", True)] * 3 + [("/40.txt", True), ("s/60.txt", True)], key=str)
