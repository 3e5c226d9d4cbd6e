"""Capture files, sensor lines and text contracts."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from netlens.sources import capture as C, events as EV, pcap as P, tables as TB
from netlens.streaming import live as L


def capture(frames, order="<", nano=False, cut=0):
    magic = {("<", False): b"\xd4\xc3\xb2\xa1", (">", False): b"\xa1\xb2\xc3\xd4", ("<", True): b"\x4d\x3c\xb2\xa1", (">", True): b"\xa1\xb2\x3c\x4d"}[order, nano]
    out = magic + struct.pack(f"{order}HHIIII", 2, 4, 0, 0, 65535, 1)
    for ts, f in frames:
        out += struct.pack(f"{order}IIII", ts // 10**6, ts % 10**6 * (1000 if nano else 1), len(f), len(f)) + f
    return out[:len(out) - cut]


def tcp(src, dst, sport, dport, flags, seq, tags=(), ttl=64, ihl=5, payload=0):
    eth = b"\x02" * 6 + b"\x04" * 6 + b"".join(struct.pack("!HH", 0x8100, t) for t in tags) + b"\x08\x00"
    ip = struct.pack("!BBHHHBBH4s4s", 0x40 | ihl, 0, ihl * 4 + 20 + payload, 99, 0, ttl, 6, 0, bytes(map(int, src.split("."))), bytes(map(int, dst.split("."))))
    return eth + ip + b"\x00" * (ihl * 4 - 20) + struct.pack("!HHIIBBHHH", sport, dport, seq, 0, 0x50, flags, 0, 0, 0)


def files(spark, **contents):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "path string, content binary")


def test_four_formats_and_decode(spark):
    f = [(1_700_000_000_123_456, tcp("10.0.0.1", "10.0.0.2", 40000, 80, 2, 4_000_000_000, (30, 99), payload=7)), (1_700_000_001_000_001, tcp("10.0.0.2", "10.0.0.1", 80, 40000, 18, 5, ihl=6))]
    df = files(spark, a=capture(f), b=capture(f, ">"), c=capture(f, "<", True), d=capture(f, ">", True))
    got = P.decode_packets(P.frames_of(df)).orderBy("file", "rec_no").collect()
    assert len(got) == 8
    r, q = got[0], got[1]
    assert (r["ts_us"], r["src_ip"], r["tcp_seq"], r["vlan"], r["ip_id"], r["tcp_payload_length"], r["tcp_flags"]) == (1_700_000_000_123_456, "10.0.0.1", 4_000_000_000, 30, 99, 7, 2)
    assert (q["vlan"], q["src_port"], q["tcp_payload_length"]) == (0, 80, 0)
    assert {(x["file"], x["ts_us"]) for x in got} == {(n, t) for n in "abcd" for t, _ in f}


def test_damaged_files_are_counted_or_fatal(spark):
    f = [(1_700_000_000_000_000, tcp("10.0.0.1", "10.0.0.2", 1, 2, 2, 3))] * 2
    df = files(spark, good=capture(f), cut=capture(f, cut=5), bad=b"nonsense" * 5)
    fr = P.frames_of(df, "count")
    assert {r["error"]: r["files"] for r in P.unreadable(fr).collect()} == {"truncated frame": 1, "unsupported magic": 1}
    inv = {r["file"]: r["records"] for r in P.file_inventory(fr).collect()}
    assert inv == {"good": 2, "cut": 1, "bad": 0}
    with pytest.raises(Exception, match="truncated frame"):
        P.frames_of(df.where("path = 'cut'")).collect()


def test_arp_and_short_frames(spark):
    arp = b"\xff" * 6 + b"\x02\x00\x00\x00\x00\x07" + b"\x81\x00\x00\x14" + b"\x08\x06" + struct.pack("!HHBBH", 1, 0x800, 6, 4, 1) + b"\x02\x00\x00\x00\x00\x07" + bytes([10, 0, 0, 9]) + b"\x00" * 10
    odd = arp.replace(struct.pack("!HHBBH", 1, 0x800, 6, 4, 1), struct.pack("!HHBBH", 1, 0x800, 8, 4, 1))
    df = files(spark, a=capture([(1, arp), (2, odd), (3, arp[:20]), (4, b"\x00" * 5)]))
    got = P.decode_l2(P.frames_of(df)).collect()
    assert [(r["sender_ip"], r["vlan"], r["src_mac"], r["arp_request"], r["protocol"]) for r in got] == [("10.0.0.9", 20, "02:00:00:00:00:07", True, -1)]
    assert P.decode_packets(P.frames_of(df)).count() == 0


def test_event_lines(spark):
    lines = [
        '{"timestamp":"2026-01-01T00:00:00.000001+0000","event_type":"dns","src_ip":"10.10.0.1","dest_ip":"10.10.0.2","dns":{"type":"answer","rcode":"NXDOMAIN","rrname":"X"}}',
        '{"timestamp":"2026-01-01T00:00:01Z","event_type":"dns","src_ip":"10.10.0.1","dns":{"type":"query","queries":[{"rrname":"WWW.A.example"}]}}',
        '{"timestamp":"2026-01-01T00:00:02+00:00","event_type":"tls","src_ip":"8.8.8.8","dest_ip":"10.10.0.3","tls":{}}',
        '{"event_type":"http","src_ip":"10.10.0.1","http":{"status":200}}',
        '{"timestamp":"2026-01-01T00:00:03Z","event_type":"dns","src_ip":"10.10.0.1","dns":{"type":"request"}}',
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {r["kind"]: r for r in EV.app_observations(EV.parse_events(df), "10.10.0.0/16").collect()}
    assert set(got) == {"dns_nxdomain", "dns_query", "tls"}
    assert got["dns_query"]["dns_name"] == "www.a.example" and got["dns_nxdomain"]["entity_ip"] == "10.10.0.1"
    assert (got["tls"]["entity_ip"], got["tls"]["event_key"]) == ("10.10.0.3", "2026-01-01T00:00:02+00:00")
    with pytest.raises(Exception, match="invalid event line"):
        EV.parse_events(df.unionByName(spark.createDataFrame([("{broken",)], "value string"))).collect()


def test_header_contract(spark, tmp_path):
    df = spark.createDataFrame([("c", 1.0, 0.123456789)], "campaign_id string, a double, b double")
    TB.write_features(df, str(tmp_path / "x"), ["campaign_id"], ["a", "b"], "csv")
    assert TB.read_features_csv(spark, str(tmp_path / "x"), ["campaign_id"], ["a", "b"]).first()["b"] == 0.12345679
    with pytest.raises(ValueError, match="header differs"):
        TB.read_features_csv(spark, str(tmp_path / "x"), ["campaign_id"], ["b", "a"])


def written(spark, tmp_path, **contents):
    folder = tmp_path / "caps"
    folder.mkdir()
    for k, v in contents.items():
        (folder / k).write_bytes(v)
    return str(folder)


def nested(n, rng):
    """Frames of many lengths, some of which hold a whole capture as payload."""
    out = []
    for i in range(n):
        f = tcp("10.0.0.1", "10.0.0.2", 40000 + i % 7, 80, 2, i) + rng.bytes(int(rng.choice([0, 0, 3, 200, 1400, 9000])))
        if i % 9 == 0:
            f += capture([(1_700_000_000_000_000 + k, f[:54]) for k in range(int(rng.integers(1, 40)))])[24 * int(i % 2) :]
        out.append((1_700_000_000_000_000 + i // 3, f))
    return out


@pytest.mark.parametrize("order, nano", [("<", False), (">", True)])
def test_ranges_of_bytes_give_the_same_frames(spark, tmp_path, order, nano):
    rng = np.random.default_rng(2)
    a, b = nested(260, rng), nested(70, rng)
    path = written(spark, tmp_path, a=capture(a, order, nano), b=capture(b, order, nano), c=capture([], order, nano))
    for split, longest in ((1 << 20, C.LONGEST), (5_000, 14_000), (40_000, 14_000)):
        df = C.read_capture(spark, path, split, longest=longest)
        if split == 5_000:
            assert df.rdd.getNumPartitions() > 50
        rows = C.numbered(df, split).orderBy("arrival").collect()
        assert [(r.file[-1], r.rec_no, r.ts_us, bytes(r.frame)) for r in rows] == [(n, i, t, f) for n, x in (("a", a), ("b", b)) for i, (t, f) in enumerate(x)]
        assert C.torn_ranges(df, split).count() == 0 and len({r.arrival for r in rows}) == len(rows)


def test_files_in_cells_reach_python_in_pieces(spark):
    rng = np.random.default_rng(8)
    whole = capture(nested(40, rng))
    assert len(whole) > 4 * P.PIECE
    files = [("a", whole), ("b", whole[:-3]), ("c", b""), ("d", capture([])), ("e", whole[: P.PIECE]), ("f", b"\0" * 3 * P.PIECE), ("g", whole[:20])]
    df = P.frames_of(spark.createDataFrame(files, "path string, content binary").repartition(2), "count")
    got = {k: [] for k, _ in files}
    for r in df.collect():
        got[r.file].append((r.rec_no, r.frame and bytes(r.frame), r.error))
    frames = [(i, f, None) for i, (_, f) in enumerate(nested(40, np.random.default_rng(8)))]
    cut = (None, None, "truncated frame")
    assert got["a"] == frames and got["b"] == [*frames[:-1], cut] and got["d"] == []
    assert [got[k][0][2] for k in "cfg"] == ["unsupported magic", "unsupported magic", "truncated header"]
    n = len(got["e"]) - 1
    assert got["e"][:n] == frames[:n] and got["e"][n][2].startswith("truncated")
    sizes = spark.createDataFrame(files, "path string, content binary")
    sent = P.frames_of(sizes, "count")._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(content" in sent


def test_a_task_reads_many_small_ranges(spark, tmp_path):
    frames = [[(1_700_000_000_000_000 + 100 * i + k, tcp("10.0.0.1", "10.0.0.2", 40000 + i, 80, 2, k)) for k in range(40)] for i in range(30)]
    path = written(spark, tmp_path, **{f"f{i:02}": capture(x) for i, x in enumerate(frames)})
    df = C.read_capture(spark, path, 1_000, longest=2_000, task=10 * (64 << 10))
    assert df.rdd.getNumPartitions() < 15 < C.read_capture(spark, path, 1_000, longest=2_000).rdd.getNumPartitions()
    assert C.read_capture(spark, path).rdd.getNumPartitions() == 1  # files much smaller than a split
    rows = C.numbered(df, 1_000).orderBy("arrival").collect()
    assert [(int(r.file[-2:]), r.rec_no, r.ts_us, bytes(r.frame)) for r in rows] == [(i, n, t, f) for i, x in enumerate(frames) for n, (t, f) in enumerate(x)]
    assert C.torn_ranges(df, 1_000).count() == 0


def test_damaged_files_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(3)
    f = nested(120, rng)
    path = written(spark, tmp_path, cut=capture(f, cut=5), good=capture(f), head=capture(f) + b"\x01" * 7, bad=b"nonsense" * 500, empty=b"")
    for split, longest in ((1 << 20, C.LONGEST), (3_000, 14_000)):
        df = C.read_capture(spark, path, split, "count", longest)
        assert {r["file"].rsplit("/")[-1]: r["error"] for r in df.where("error is not null").collect()} == {"cut": "truncated frame", "head": "truncated record header", "bad": "unsupported magic", "empty": "unsupported magic"}
        assert {r["file"].rsplit("/")[-1]: r["count"] for r in df.where("frame is not null").groupBy("file").count().collect()} == {"cut": 119, "good": 120, "head": 120}
    with pytest.raises(Exception, match="truncated frame"):
        C.read_capture(spark, path + "/cut", 3_000).collect()


def test_stream_reads_closed_files_once(spark, tmp_path):
    rng = np.random.default_rng(4)
    parts = [nested(40, rng) for _ in range(4)]
    path = written(spark, tmp_path, f0=capture(parts[0]), f1=capture(parts[1]))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        L.run_to_table(C.stream_captures(spark, path, 2_000), out, check)
        return [bytes(r.frame) for r in spark.read.parquet(out).orderBy("arrival").collect()]

    assert run() == [f for _, f in parts[0]]  # the newest file may still be written
    for i in (2, 3):
        (tmp_path / "caps" / f"f{i}").write_bytes(capture(parts[i]))
    assert run() == [f for p in parts[:3] for _, f in p]
    assert run() == [f for p in parts[:3] for _, f in p]


def test_records_of_a_file_are_written_in_order_as_they_come(spark, tmp_path):
    rng = np.random.default_rng(6)
    whole = {f"f{i}": capture(nested(n, rng), "<" if i else ">") for i, n in enumerate((150, 0, 1, 90))}
    rows = []
    for name, data in whole.items():
        at, order = 24, "<" if name != "f0" else ">"
        while at < len(data):
            n = 16 + struct.unpack_from(f"{order}I", data, at + 8)[0]
            rows.append((name, at, data[:24], data[at : at + n]))
            at += n
    rows.append(("f1", 5, whole["f1"][:24], None))  # a record that could not be made; the file is there
    rng.shuffle(rows)
    df = spark.createDataFrame([(p, int(n), h, r) for p, n, h, r in rows], "path string, place long, head binary, record binary").repartition(6)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")  # a file goes on from batch to batch
    try:
        C.write_records(df, "place", str(tmp_path / "made"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert {f.name: f.read_bytes() for f in (tmp_path / "made").iterdir()} == whole


def test_no_cell_holds_a_file_of_the_way_from_captures_to_rules(spark, tmp_path, monkeypatch):
    from netlens.plans import q_sources as Q

    monkeypatch.setattr(C, "write_files", lambda files, folder: pytest.fail("whole files in cells"))
    made = []
    monkeypatch.setattr(C, "write_records", lambda rows, order, folder, write=C.write_records: (made.append((rows, folder)), write(rows, order, folder)))
    rows = [(i, f"2024-01-01 0{i % 9}:00:00", i % 5, ("view", "click", "error")[i % 3], 1.0, '{"k": %d}' % (i % 100)) for i in range(600)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.to_timestamp_ntz("ts")).write.parquet(str(tmp_path / "events.parquet"))
    assert Q.capture_to_rules(spark, str(tmp_path)).count() > 0
    (rows, folder), = made
    assert "collect_list" not in rows._jdf.queryExecution().toString() and len(C.listed(folder)) == Q.FILES
    assert C.read_capture(spark, folder).count() == 600


def test_ranges_of_a_task_go_on_and_find_their_way_after_damage(tmp_path, monkeypatch):
    whole = nested(300, np.random.default_rng(7))
    data = bytearray(capture(whole))
    places, at = [], 24
    for _, f in whole:
        places.append(at)
        at += 16 + len(f)
    (tmp_path / "a").write_bytes(data)
    searched = []
    monkeypatch.setattr(C, "first_record", lambda *a, find=C.first_record: (searched.append(a[2]), find(*a))[1])

    def read():
        parts = C.ranges(str(tmp_path), C.listed(str(tmp_path)), 3_000)
        apart = [r for p in parts for b in C.read_range(p, False, 14_000) for r in b.to_pylist()]
        many, searched[:] = len(searched), []
        assert [r for b in C.read_together(parts, False, 14_000) for r in b.to_pylist()] == apart
        return apart, many, len(searched)

    rows, many, few = read()
    assert [r["frame"] for r in rows] == [f for _, f in whole] and many > 50 and few == 0
    for bad in (1_000, 14_000, 4_000_000_000):  # a length that leads into another frame, or out of the file
        broken = bytearray(data)
        struct.pack_into("<I", broken, places[150] + 8, bad)
        (tmp_path / "a").write_bytes(broken)
        read()
