import numpy as np
import pyarrow as pa

from tidemill.llm import transport as T


def brute(ts: bytes):
    """Plain demultiplexer, one packet after another."""
    streams, cc, out = {}, {}, {}
    for k in range(len(ts) // 188):
        p = ts[k * 188 : k * 188 + 188]
        pid = (p[1] & 31) << 8 | p[2]
        at = 4
        rai = False
        if p[3] & 0x20:
            rai = p[4] > 0 and bool(p[5] & 0x40)
            at = 5 + p[4]
        if pid not in (0, T.PMT):
            s = out.setdefault(pid, {"packets": 0, "errors": 0, "dup": 0, "pes": [], "last": None})
            s["packets"] += 1
            c = p[3] & 15
            if s["last"] is not None:
                lc, lp = s["last"]
                if c == lc and p == lp:
                    s["dup"] += 1
                    continue
                if c != (lc + 1) % 16:
                    s["errors"] += 1
            s["last"] = (c, p)
            if p[1] & 0x40:
                s["pes"].append([k, rai, b""])
            if s["pes"]:
                s["pes"][-1][2] += p[at:]
    res = {}
    for pid, s in out.items():
        units, payload = [], b""
        for k, rai, b in s["pes"]:
            size = b[4] << 8 | b[5]
            body = b[: 6 + size][9 + b[8] :]
            t = lambda x: (x[0] >> 1 & 7) << 30 | x[1] << 22 | x[2] >> 1 << 15 | x[3] << 7 | x[4] >> 1
            pts = t(b[9:14])
            units.append({"pts": pts, "dts": t(b[14:19]) if b[7] & 0x40 else pts, "random_access": rai, "packet": k, "bytes": len(body)})
            payload += body
        res[pid] = (s["packets"], s["errors"], s["dup"], units, payload)
    return res


def rows(streams):
    cols = T.demux(pa.array(streams, pa.binary()))
    return pa.table(cols).to_pylist()


def test_same_as_brute_force_with_losses():
    rng = np.random.default_rng(1)
    texts = ["", "a", "b" * 1024, *("".join(chr(c) for c in rng.integers(32, 900, n)) for n in rng.integers(1, 9000, 30))]
    made = T.mux(pa.array(texts), pa.array([f"s{i}" for i in range(len(texts))]))
    made = [np.insert(m, 3, m[2], axis=0) if i % 3 == 1 and len(m) > 4 else np.delete(m, 4, axis=0) if i % 3 == 2 and len(m) > 6 else m for i, m in enumerate(made)]
    streams = [m.tobytes() for m in made]
    got = {(r["row"], r["pid"]): r for r in rows(streams)}
    for i, s in enumerate(streams):
        for pid, (n, e, d, units, payload) in brute(s).items():
            r = got[i, pid]
            assert (r["packets"], r["continuity_errors"], r["duplicates"]) == (n, e, d)
            assert r["units"] == units and r["payload"] == payload


def test_round_trip_is_exact():
    texts = ["héllo " * 1000, "x", "y" * 184, "z" * 70000]
    got = {(r["row"], r["pid"]): r for r in rows([m.tobytes() for m in T.mux(pa.array(texts), pa.array(["q"] * 4))])}
    for i, t in enumerate(texts):
        assert got[i, T.VIDEO]["payload"] == t.encode() and got[i, T.AUDIO]["payload"] == b"q"
        assert got[i, T.VIDEO]["stream_type"] == 0x1B and got[i, T.VIDEO]["continuity_errors"] == 0
        n = -(-len(t.encode()) // T.UNIT)
        assert [u["random_access"] for u in got[i, T.VIDEO]["units"]] == [k % T.KEY_EVERY == 0 for k in range(n)]
        assert [u["pts"] for u in got[i, T.VIDEO]["units"]] == [90000 + T.TICKS * k for k in range(n)]


def test_bytes_out_of_sync():
    m = T.mux(pa.array(["w" * 5000]), pa.array(["q"]))[0].tobytes()
    for broken in (b"junk" + m, m + b"tail", m[: 188 * 4] + b"noise" + m[188 * 4 :]):
        r = {x["pid"]: x for x in rows([broken, m])if x["row"] == 0}
        assert r[T.VIDEO]["payload"] == b"w" * 5000
    assert rows([b"no stream at all", b"", None]) and [x["status"] for x in rows([b"no stream at all", b"", None])] == ["no_program", "empty", "empty"]
    damaged = bytearray(m)
    damaged[20] ^= 255  # PAT checksum fails
    assert rows([bytes(damaged)])[0]["status"] == "no_program"


def test_odd_rows(odd):
    got = T.demultiplexed(T.multiplexed(odd)).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 3, 4, 5, 6, None}
    assert next(r for r in got if r.doc_id == 0).status == "empty"
    assert T.demultiplexed(T.multiplexed(odd.limit(0))).count() == 0


def foreign(pmt_pid, pointer, stamps, long_map=False):
    """A stream by other means than mux: its own pids, pointer fields and maps that cross packets."""

    def crc(data):
        c = 0xFFFFFFFF
        for x in data:
            for k in range(7, -1, -1):
                c = (c << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if (c >> 31) ^ (x >> k & 1) else 0)
        return c.to_bytes(4, "big")

    def section(table, number, body):
        head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc3\x00\x00" + body
        return head + crc(head)

    def packets(pid, data, counter):
        data = bytes([pointer]) + b"\xff" * pointer + data
        out = b""
        for k in range(0, len(data), 184):
            out += bytes([0x47, (0x40 if k == 0 else 0) | pid >> 8, pid & 255, 0x10 | (counter + k // 184) % 16]) + data[k : k + 184].ljust(184, b"\xff")
        return out

    filler = b"\x05\x3c" + b"x" * 60
    loop = b"".join(bytes([t]) + (0xE000 | p).to_bytes(2, "big") + (0xF000 | len(d)).to_bytes(2, "big") + d for t, p, d in ((0x1B, 0x345, filler * (4 if long_map else 0)), (0x0F, 0x346, b"")))
    pat = section(0, 1, (0).to_bytes(2, "big") + b"\xe0\x10" + (7).to_bytes(2, "big") + (0xE000 | pmt_pid).to_bytes(2, "big"))
    other = section(2, 9, b"\xe1\x00\xf0\x00" + b"\x02\xe3\x99\xf0\x00")  # a program that the PAT does not name
    out = packets(0, pat, 0) + packets(pmt_pid, other + section(2, 7, b"\xe3\x45\xf0\x00" + loop), 0)
    for k, t in enumerate(stamps):
        stamp = bytes([0x21 | (t >> 30 & 7) << 1, t >> 22 & 255, 1 | (t >> 15 & 127) << 1, t >> 7 & 255, 1 | (t & 127) << 1])
        pes = b"\x00\x00\x01\xe0\x00\x00\x80\x80\x05" + stamp + b"unit%d" % k
        out += bytes([0x47, 0x43, 0x45, 0x30 | k % 16, 183 - len(pes), 0]) + b"\xff" * (182 - len(pes)) + pes
    return out


def test_streams_of_other_makers():
    near = (1 << 33) - 3000
    for pid, pointer, long_map in ((0x20, 1, False), (0x1FF, 0, True), (0x20, 40, True)):
        s = foreign(pid, pointer, [near, near + 1500, 0, 1500], long_map)
        got = {r["pid"]: r for r in rows([s])}
        assert set(got) == {0x345, 0x346} and got[0x345]["stream_type"] == 0x1B
        assert got[0x345]["payload"] == b"unit0unit1unit2unit3" and got[0x345]["continuity_errors"] == 0
        assert [u["pts"] for u in got[0x345]["units"]] == [near, near + 1500, near + 3000, near + 4500]
        assert [u["dts"] for u in got[0x345]["units"]] == [near, near + 1500, near + 3000, near + 4500]
    # a table that is named by no PAT is none
    assert [r["status"] for r in rows([foreign(0x20, 0, [1])[188:]])] == ["no_program"]


def test_rows_keep_their_own_values(spark, docs):
    df = docs(["a" * 3000, "b" * 10, "b" * 10], ids=[5, 6, 6]).selectExpr("*", "'x' as pid", "3 as units", "7 as id", "'y' as payload", "1 as row")
    got = [(r.doc_id, r.pid, bytes(r.payload)) for r in T.demultiplexed(T.multiplexed(df)).collect()]
    assert sorted(g for g in got if g[0] == 6) == sorted([(6, T.VIDEO, b"b" * 10), (6, T.AUDIO, b"s0")] * 2)
    named = spark.createDataFrame([("k1", "abc", "s")], "doc_id string, text string, source string")
    assert {(r.doc_id, bytes(r.payload)) for r in T.demultiplexed(T.multiplexed(named)).collect()} == {("k1", b"abc"), ("k1", b"s")}
