import datetime
import itertools
import random
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.functions import codecs, discovery
from tidemill.operators import chunks, dedup, directory, formats, ordered, paths, probe, reclaim, recovery, similar, verify


def blob(n, seed=1):
    """xorshift32 bytes: incompressible and the same everywhere."""
    x, out = (0x12345678 ^ (seed * 0x9E3779B9)) & 0xFFFFFFFF, bytearray()
    for _ in range(n):
        x ^= (x << 13) & 0xFFFFFFFF
        x ^= x >> 17
        x ^= (x << 5) & 0xFFFFFFFF
        out.append(x >> 24)
    return bytes(out)


def files(spark, rows):
    return spark.createDataFrame([(i, p, bytearray(c), len(c), d) for i, (p, c, d) in enumerate(rows)], "entry_idx long, path string, content binary, size long, dev string")


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


def test_photos(spark):
    a, b = b"A" * 5000, b"B" * 5000
    f = files(spark, [("a/IMG_0001.jpg", a, "v"), ("b/8f3a91cc.jpg", a, "v"), ("c/nested/copy of photo.jpg", a, "v"), ("b/different.jpg", b, "v"), ("unique.txt", b"x", "v"), ("empty1", b"", "v"), ("empty2", b"", "v")])
    g = dedup.groups(f).collect()
    assert len(g) == 1 and g[0].n_files == 3 and g[0].reclaimable == 10000 and g[0].paths == sorted(g[0].paths)
    assert dedup.size_gate(f).count() == 4 and dedup.partial_gate(f, 64).count() == 3


def test_unique_sizes_hash_nothing(spark):
    f = files(spark, [(f"f{i}.bin", b"z" * (1000 + i), "v") for i in range(6)])
    m = dedup.bytes_hashed(f).first()
    assert m.partial_bytes == m.full_bytes == 0 and dedup.groups(f).count() == 0


def test_hard_links(spark):
    f = files(spark, [("a", b"x" * 9, "v"), ("b", b"x" * 9, "v")]).withColumn("ino", F.lit(7))
    r = dedup.physical_groups(f).first()
    assert r.n_files == 2 and r.reclaimable == 0
    m = dedup.members(f).withColumn("ino", F.lit(7))
    d = reclaim.decisions(m, "first", "/q")
    assert reclaim.plan(d).count() == 0 and reclaim.skipped(d).first().reason == "same file as the keeper"


def test_keepers(spark):
    same = b"y" * 50
    f = files(spark, [("/root/misc/unsorted/Copy of Copy of x.jpg", same, "v"), ("/root/photos/x.jpg", same, "w"), ("/q/z.jpg", same, "v")])
    m = dedup.members(f).withColumn("mtime", F.col("entry_idx"))
    keep = lambda p: reclaim.with_keeper(m, p).first().keeper
    assert keep("shortest") == "/q/z.jpg" and keep("first") == "/q/z.jpg" and keep("oldest").startswith("/root/misc")
    d = reclaim.decisions(m, "oldest", "/q")
    acts = {r.victim: r for r in d.collect()}
    assert acts["/q/z.jpg"].reason == "already in quarantine" and acts["/root/photos/x.jpg"].action == "quarantine" and acts["/root/photos/x.jpg"].dest == "/q/root/photos/x.jpg"
    plan = spark.createDataFrame([("/a", "/b"), ("/c", "/a")], "keeper string, victim string")
    assert [r.path for r in reclaim.conflicts(plan).collect()] == ["/a"]
    with pytest.raises(ValueError):
        reclaim.keeper_order("newest")


@pytest.mark.parametrize(
    ("raw", "want"),
    [("../etc/passwd", None), ("a/../../b", None), ("C:/Windows/system32", None), ("foo\0bar", None), ("", None), ("/", None), ("dir\\sub/file.txt", "dir/sub/file.txt"), ("/etc/hosts", "etc/hosts"), ("./a//b/.", "a/b"), ("a/" * 4095 + "a", "a/" * 4095 + "a"), ("a/" * 4096 + "a", None)],
)
def test_sanitize(spark, raw, want):
    assert one(spark, paths.sanitize, raw) == want


def test_names(spark):
    for n, w in {"NUL": "_NUL", "CON.txt": "_CON.txt", "com1": "_com1", "NULL.txt": "NULL.txt", "COM10": "COM10", "console.log": "console.log"}.items():
        assert one(spark, paths.mangle_device, n) == w
    assert one(spark, lambda x: paths.join_under(F.lit("/out"), x, True), "a/NUL/b.txt") == "/out/a/_NUL/b.txt"
    assert [one(spark, paths.extension, p) for p in ("x/a.TXT", "a.tar.gz", ".bashrc", "noext", "d.ir/f")] == ["txt", "gz", "", "", ""]
    assert one(spark, paths.printable, "a\x07b\n") == "a\\u{0007}b\\u{000a}"
    assert [one(spark, paths.version_key, v) for v in ("v1.2.3", "1.10.0", "x")] == [(1, 2, 3), (1, 10, 0), None]
    assert one(spark, paths.safe_tag, "v1.0") and not one(spark, paths.safe_tag, "../x") and one(spark, paths.safe_repo, "a/b") and not one(spark, paths.safe_repo, "a/b/c")
    assert one(spark, paths.default_dest, "x/a.tar.gz") == "x/a" and one(spark, paths.default_dest, "b.zip") == "b"
    assert one(spark, lambda x: paths.numbered(x, F.lit(2)), "/q/a.txt") == "/q/a (2).txt"
    assert one(spark, paths.content_range_start, "bytes 65536-131071/200000") == 65536 and one(spark, paths.content_range_start, "items 1-2") is None
    assert one(spark, paths.bytes_human, 1536, "long") == "1.50 KiB" and one(spark, paths.thousands, 1234567, "long") == "1,234,567"
    assert one(spark, paths.unix_mtime, 0, "long") is None and one(spark, paths.filetime, 116444736000000000 + 10_000_000, "long") == datetime.datetime(1970, 1, 1, 0, 0, 1)
    assert one(spark, dedup.is_scratch, ".photo.jpg.tidemill-link-12") and not one(spark, dedup.is_scratch, ".photo.jpg.abc-link-12") and not one(spark, dedup.is_scratch, "photo-link-12")
    assert [one(spark, paths.charset, n) for n in ("abc", "déjà", "日本", "да")] == ["ascii", "latin", "cjk", "cyrillic"]
    assert one(spark, paths.scrub, "can't open /home/me/x.txt now") == "can't open <path> now"


def test_formats(spark):
    for head, want in {b"PK\x03\x04": "zip/none", b"7z\xbc\xaf\x27\x1c": "7z/none", b"\x1f\x8b\x08": "raw/gzip", b"BZh9": "raw/bzip2", b"text": None}.items():
        assert one(spark, formats.sniff_magic, bytearray(head), "binary") == want
    assert one(spark, formats.sniff_magic, bytearray(b"\0" * 257 + b"ustar"), "binary") == "tar/none"
    assert one(spark, lambda x: formats.sniff(F.lit("a.tar.gz"), x), bytearray(b"\x1f\x8b\x08"), "binary") == "tar/gzip"
    assert one(spark, lambda x: formats.sniff(F.lit("a.tar.xz"), x), bytearray(b"\x1f\x8b\x08"), "binary") == "raw/gzip"
    assert one(spark, lambda x: formats.sniff(F.lit("a"), x), bytearray(b"\0" * 32769 + b"CD001"), "binary") == "iso/none"
    assert one(spark, formats.label, "tar/gzip") == "tar.gzip" and one(spark, formats.writable, "rar/none") is False
    assert one(spark, formats.pack_target, "tiny") == (64 << 20) - (256 << 10)
    assert formats.targets(spark).count() == len(formats.TARGETS)


def test_probe(spark):
    f = files(spark, [("a.bin", blob(70000), "v"), ("b.bin", b"the quick brown fox " * 500, "v"), ("c.jpg", b"x" * 9000, "v"), ("d.bin", b"", "v"), ("e.bin", blob(100), "v")])
    v = {r.path: r.verdict for r in probe.verdicts(probe.entropy(f)).collect()}
    assert v == {"a.bin": "store", "b.bin": "compress", "c.jpg": "store", "d.bin": "compress", "e.bin": "compress"}
    s = spark.createDataFrame([("store", 900), ("compress", 100)], "verdict string, size long")
    assert probe.summary(s).first().mostly_incompressible
    ratio = {r.path: r.r for r in f.select("path", codecs.sample_ratio("content").alias("r"), codecs.spread_incompressible("content").alias("s")).collect()}
    assert ratio["a.bin"] > 0.95 and ratio["b.bin"] < 0.1 and ratio["e.bin"] == 1.0
    assert codecs.deflate_ratio(b"") == 1.0


def test_chunkers(spark):
    a, b = blob(200_000, 3), blob(60_000, 4)
    data = np.frombuffer(a, np.uint8)
    cuts = chunks.cdc_cuts(data, 2048, 8192, 32768)
    size = np.diff(np.r_[0, cuts])
    assert cuts[-1] == len(a) and (size[:-1] >= 2048).all() and (size <= 32768).all()
    moved = chunks.cdc_cuts(np.frombuffer(b"inserted" + a, np.uint8), 2048, 8192, 32768) - 8
    assert len(set(cuts) & set(moved)) > 0.8 * len(cuts)
    f = files(spark, [("x", a, "v"), ("y", a, "v"), ("z", b + a, "v"), ("e", b"", "v")])
    est = chunks.estimate(chunks.cdc_chunks(f, 2048, 8192, 32768)).first()
    assert est.files == 3 and est.total_bytes == 660_000 and est.saved > 300_000
    assert chunks.cdc_cuts(np.zeros(0, np.uint8), 1, 2, 3).size == 0


def test_packs_close_after_the_chunk_that_reaches_the_target(spark):
    r = random.Random(1)
    ln = [r.randrange(1, 40) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(ln)), "chunk_id long, length long")
    got = {x.chunk_id: x.pack_id for x in chunks.assign_packs(df, 100).collect()}
    p = total = 0
    for i, n in enumerate(ln):
        assert got[i] == p
        total += n
        if total >= 100:
            p, total = p + 1, 0


def test_recovery(spark):
    for n, m in ((1, 1), (5, 2), (20, 7)):
        data = np.frombuffer(blob(n * 50, n), np.uint8).reshape(n, 50)
        every = np.concatenate([data, recovery.parity(data, m)])
        for seed in range(5):
            keep = np.array(sorted(random.Random(seed).sample(range(n + m), n)))
            assert (recovery.repair(n, m, keep, every[keep]) == data).all()
        with pytest.raises(ValueError):
            recovery.repair(n, m, np.arange(n - 1), every[: n - 1])
    f = files(spark, [("x", blob(5000), "v"), ("y", b"s", "v")])
    s = recovery.with_parity(recovery.shards(f, 0.4, 1000))
    back = {r.entry_idx: r for r in recovery.repaired(s.where("not (entry_idx = 0 and idx in (0, 3))")).collect()}
    assert bytes(back[0].content)[:5000] == blob(5000) and bytes(back[1].content) == b"s"
    assert not {r.entry_idx: r for r in recovery.repaired(s.where("not (entry_idx = 0 and idx < 3)")).collect()}[0].ok


def test_signatures(spark):
    s = recovery.Signer(spark)
    sig = s.sign(b"d" * 32)
    assert len(sig) == 64 and s.verify(b"d" * 32, sig) and not s.verify(b"e" * 32, sig)


def test_similar(spark):
    v = [0.0] * 64
    v[3] = 1.0
    assert one(spark, similar.gradient_signature, v, "array<float>") == 8
    rows = [(i, x) for i, x in enumerate((0, 1, 3, 1 << 62, (1 << 62) | 1, -1))]
    pairs = {(r.a, r.b): r.distance for r in similar.banded_pairs(spark.createDataFrame(rows, "id long, sig long"), 2).collect()}
    want = {(i, j): bin((a ^ b) & (1 << 64) - 1).count("1") for i, a in rows for j, b in rows if i < j}
    assert pairs == {k: d for k, d in want.items() if d <= 2}
    g = similar.groups(spark.createDataFrame([(1, 2), (2, 3), (8, 9)], "a long, b long")).collect()
    assert sorted(tuple(r.members) for r in g) == [(1, 2, 3), (8, 9)]
    assert one(spark, lambda x: similar.aspect_close(x, F.lit(100.0), F.lit(105.0), F.lit(100.0)), 100.0, "double")


def test_directory(spark):
    def model(rows):
        df = spark.createDataFrame([(i, p, s) for i, (p, s) in enumerate(rows)], "index long, path string, size long")
        return {r.fold: (r.path, r.is_dir, r.size) for r in directory.build(df).collect()}

    m = model([("src/a.txt", 1), ("SRC/b.txt", 2)])
    assert m["src"] == ("src", True, 0) and set(m) == {"src", "src/a.txt", "src/b.txt"}
    assert model([("File.txt", 10), ("file.txt", 20)]) == {"file.txt": ("File.txt", False, 10)}
    for rows in ([("foo", 5), ("foo/bar", 7)], [("foo/bar", 7), ("foo", 5)]):
        assert model(rows)["foo"][1:] == (True, 0)
    reg = directory.parse_registry(spark.createDataFrame([("# c\narchive=/a.zip\nroot=/m\nwritable=true\n\nbroken\nroot=/n\n\narchive=/b.zip\njunk line\nroot=/o",)], "text string")).collect()
    assert sorted((r.archive, r.root, r.writable) for r in reg) == [("/a.zip", "/m", True), ("/b.zip", "/o", False)]


def test_order_and_integrity(spark):
    def order(rows):
        df = spark.createDataFrame([(i, s, k) for i, (s, k) in enumerate(rows)], "index long, size long, key long")
        return [r["index"] for r in verify.ordered(verify.work_order(df)).collect()]

    assert order([(30, 7), (25, 3), (20, 7), (15, 3)]) == [0, 2, 1, 3]
    assert order([(10, None), (40, None), (20, None), (30, None)]) == [1, 3, 2, 0]
    assert zlib.crc32(b"123456789") == one(spark, F.crc32, bytearray(b"123456789"), "binary") == 3421780262
    packs = spark.createDataFrame([(0, 10)], "pack_id long, raw_len long")
    ch = spark.createDataFrame([(0, 0, 0, 6), (1, 0, 6, 6), (2, 5, 0, 1)], "chunk_id long, pack_id long, offset long, length long")
    ec = spark.createDataFrame([(0, 0), (1, 9)], "entry_idx long, chunk_id long")
    en = spark.createDataFrame([(0, 6), (1, 4)], "entry_idx long, size long")
    assert {r.rule: r.n for r in verify.rules(packs, ch, ec, en).collect()} == {"chunk_without_pack": 1, "chunk_outside_pack": 1, "unknown_chunk": 1, "size_not_sum": 1}
    assert verify.within_budget(packs, 10).first().ok
    t = spark.createDataFrame([((1 << 63) - 1, "file")] * 3 + [(5, "dir")], "size long, kind string")
    assert int(verify.totals(t).first().bytes) == 18446744073709551615


def test_folds(spark):
    w = spark.createDataFrame([(1, 0, True), (1, 1, True), (1, 3, True), (2, 1, True), (3, 0, False), (4, 0, True)], "file long, idx long, done boolean")
    assert {r.file: r.frontier for r in ordered.watermark(w).collect()} == {1: 2, 2: 0, 3: 0, 4: 1}
    e = spark.createDataFrame([("a", 1, 0, 10.0), ("a", 2, 0, 20.0), ("a", 3, 0, 0.0)], "key string, ts long, seq long, value double")
    assert abs(ordered.ewma(e).first().rate - 0.7 * 13.0) < 1e-9
    b = spark.createDataFrame([("a", 1, False), ("a", 2, False), ("a", 3, False), ("b", 1, False), ("b", 2, True), ("c", 1, False)], "key string, seq long, ok boolean")
    assert {r.key: (r.failures, r.cooldown) for r in ordered.benched(b).collect()} == {"a": (3, 6), "b": (0, 0), "c": (1, 0)}


def test_manifests(spark):
    d = spark.createDataFrame([("A" * 64 + "  x.zip\nbad line\n" + "b" * 64 + " *dir/y.zip",)], "m string")
    assert [(r.name, r.sha256) for r in discovery.manifest(d, "m").collect()] == [("x.zip", "a" * 64), ("dir/y.zip", "b" * 64)]


def test_pairs_of_crowded_bands_are_all_found(spark):
    """Any number of equal or near signatures: every pair within the distance, each once."""
    import itertools

    r = random.Random(5)
    sigs = [r.getrandbits(64) for _ in range(60)] + [7] * 12 + [7 ^ (1 << k) for k in range(12)]
    signed = [x - (1 << 64) if x >> 63 else x for x in sigs]
    df = spark.createDataFrame([(f"s{i:03d}", x) for i, x in enumerate(signed)] + [(None, 7), ("z", None)], "id string, sig long")
    for d in (15, 2):
        want = {(f"s{i:03d}", f"s{j:03d}", (sigs[i] ^ sigs[j]).bit_count()) for i, j in itertools.combinations(range(len(sigs)), 2) if (sigs[i] ^ sigs[j]).bit_count() <= d}
        got = [tuple(x) for x in similar.banded_pairs(df, d).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_pairs_of_many_signatures(spark):
    n = 20000
    x = np.random.default_rng(3).integers(0, 1 << 63, n).astype(np.int64)
    x[-50:] = x[:50] ^ 5
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "sig": x}))
    got = {(r.a, r.b): r.distance for r in similar.banded_pairs(df, 15).collect()}
    u = x.view(np.uint64)
    want = {}
    for at in range(0, n, 500):
        d = np.bitwise_count(u[at : at + 500, None] ^ u[None, :])
        i, j = np.nonzero(d <= 15)
        want |= {(int(p + at), int(q)): int(d[p, q]) for p, q in zip(i, j) if p + at < q}
    assert got == want and len(want) >= 50


def test_gates_spare_the_hashing(spark):
    rows = [(i, f"/f{i:03d}", bytearray(b"x" * (10 + i)), 10 + i, "d") for i in range(20)]
    rows += [(100 + k, f"/g{k}", bytearray(b"a" * 400 + bytes([k // 2])), 401, "d") for k in range(4)] + [(200 + k, f"/h{k}", bytearray(bytes([k]) * 50 + b"m" * 400), 450, "d") for k in range(3)]
    df = spark.createDataFrame(rows, "entry_idx long, path string, content binary, size long, dev string")
    assert {r.path for r in dedup.gated(df.where("entry_idx < 100"), 16).collect()} == set()
    assert {r.path for r in dedup.gated(df, 16).collect()} == {"/g0", "/g1", "/g2", "/g3"}
    assert dedup.gated(df, 16, limit=0).count() == len(rows)
    one, all_ = (sorted(map(tuple, d.collect())) for d in (dedup.groups(df, 16), dedup.groups(df, 1 << 20)))
    assert one == all_ and sorted((r[2], r[4]) for r in one) == [(2, "/g0"), (2, "/g2")]


def test_lines_cost_what_they_are_long(spark):
    """One text of many lines against as many lines in several texts."""
    one = spark.createDataFrame([(0, bytearray(b"a line\n" * 16000))], "entry_idx long, content binary").coalesce(1)
    many = spark.createDataFrame([(k, bytearray(b"a line\n" * 1000)) for k in range(16)], "entry_idx long, content binary").coalesce(1)
    took = []
    for f in (many, one, many, one):
        at = time.time()
        assert chunks.line_chunks(f).agg(F.count("*"), F.sum("length"), F.max("pos")).first()[:2] == (16000, 112000)
        took.append(time.time() - at)
    assert took[3] < 4 * took[2] + 0.5


def test_line_chunks_of_odd_contents(spark):
    f = spark.createDataFrame([(0, bytearray(b"")), (1, None), (2, bytearray(b"\n")), (3, bytearray(b"\n\na")), (4, bytearray("é\r\nb\n".encode()))], "entry_idx long, content binary")
    got = [(r.entry_idx, r.pos, r.length, r.chunk) for r in chunks.line_chunks(f).orderBy("entry_idx", "pos").collect()]
    assert got == [(2, 0, 1, "\n"), (3, 0, 1, "\n"), (3, 1, 1, "\n"), (3, 2, 1, "a"), (4, 0, 4, "é\r\n"), (4, 1, 2, "b\n")]


@pytest.mark.parametrize("batch", ["1", "7", "10000"])
def test_entry_splits_across_batches(spark, batch):
    """As the fold row by row gives them, wherever batches end; no call of Python for each entry."""
    r = random.Random(8)
    rows = [(e, p, r.randrange(1, 60), r.randrange(4)) for e in [None, *range(-3, 90)] for p in range(r.choice([1, 2, 5, 40, 300]))]
    want = []
    for e, its in itertools.groupby(rows, lambda x: x[0]):
        its = list(its)
        total, start, base = sum(x[2] for x in its), 0, 0
        for k, (_, pos, ln, pack) in enumerate(its):
            if k == 0 or total >= 600 and pack != its[k - 1][3] and start - base >= 200:
                want.append([e, want[-1][1] + 1 if k else 0, pos, 0])
                base = start
            want[-1][3] += ln
            start += ln
    r.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = chunks.entry_splits(spark.createDataFrame(rows, "entry_idx long, pos int, length int, pack_id long"), 200, 600)
        assert sorted([list(x) for x in got.collect()], key=str) == sorted(want, key=str)
        assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
