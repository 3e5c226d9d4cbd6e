"""Live windows from keyed state: the same rows as the batch form, in any batches, with state that stays bounded."""

import os
import random

import pandas as pd
import pytest

from netlens.operators import features as FT
from netlens.streaming import live as L, windows as W
from test_features import APP, BASE, SCHEMA, SEC, ring

NAMES = ["packet_count_10s", "flow_attempt_count_30s", "unique_dst_port_ratio_30s", "flow_duration_mean_30s", "tcp_retransmission_ratio_10s", "http_request_count_60s", "syn_count_10s"]


def traffic(minutes, seed=4):
    """The ring again and again, so that flows return after their horizon has passed."""
    rnd = random.Random(seed)
    out = []
    for m in range(minutes):
        for p in ring(12, seed + m):
            out.append(dict(p, ts_us=BASE + (60 * m + rnd.randrange(60)) * SEC + rnd.randrange(SEC), arrival=len(out)))
    return sorted(out, key=lambda p: (p["ts_us"], p["arrival"]))


def replayed(spark, folder, packets, files):
    for i in range(files):
        part = packets[i * len(packets) // files : (i + 1) * len(packets) // files]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return L.closed_file_stream(spark, str(folder), spark.createDataFrame([], SCHEMA).schema, 1)


@pytest.mark.parametrize("trigger", [{"availableNow": True}, {"processingTime": "0 seconds"}])
def test_streamed_rows_equal_batch_rows_and_state_stays_bounded(spark, tmp_path, trigger):
    packets = traffic(8)
    app = spark.createDataFrame([(BASE + t * SEC, t, "10.10.0.1", "http", 200, "GET", "", "", "") for t in range(5, 460, 7)], APP)
    stream = replayed(spark, tmp_path / "in", packets, 5)
    events = lambda lo, hi: app.where((app.ts_us > lo) & (app.ts_us <= hi))
    out = str(tmp_path / "out")
    q = W.stream_features(stream, events, out, str(tmp_path / "check"), "10.10.0.0/16", 10 * SEC, 7, NAMES, shards=2, trigger=trigger)
    if "availableNow" in trigger:
        q.awaitTermination()
    else:
        q.processAllAvailable()
        q.stop()
    last = (packets[-1]["ts_us"] - 5_000) // (10 * SEC)
    batch = FT.features_at_horizon(spark.createDataFrame(packets, SCHEMA), app, "10.10.0.0/16", 10 * SEC, 7, NAMES)
    first = -(-packets[0]["ts_us"] // (10 * SEC))
    want = {tuple(r) for r in batch.where(f"anchor between {first} and {last}").collect()}
    got = [tuple(r) for r in spark.read.parquet(f"{out}/rows").drop("epoch").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # neither state nor files grow with the time the stream has been up
    cells = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.numInputRows]
    assert max(cells[3:]) <= 1.5 * max(cells[:3])
    assert sorted(os.listdir(out)) == ["progress", "rows"] and len([x for x in os.listdir(f"{out}/progress") if x.startswith("epoch=")]) <= 2


def test_reduced_rows_of_any_cut_give_the_same_parts():
    """Owners, attempts and retransmissions from cells, however the packets were cut into cells."""
    rnd = random.Random(11)
    rows = []
    for i in range(400):
        f, b = rnd.randrange(6), rnd.randrange(1, 12)
        t = b * 100 - rnd.randrange(100)
        seq = rnd.choice([None, 1.0, 2.0, 3.0])
        rows.append(dict(flow=f"f{f}", bucket=b, src_ip=f"s{i % 2}", src_port=i % 2, protocol=6, last_us=t, t0=t, a0=i, entity_ip=f"e{i % 2}", peer_ip="p", target_port=80, seq=None, m=None, **{c: 1 for c in W._COUNTS}))
        if seq:
            rows.append(dict(rows[-1], seq=seq, m=1))
    frame = pd.DataFrame(rows)
    for anchor in range(1, 15):
        part = W.parts_of_anchor(frame, anchor, 7)
        sums = frame[frame["seq"].isna() & (frame["bucket"] > anchor - 7) & (frame["bucket"] <= anchor)]
        used = frame[frame["seq"].notna() & (frame["bucket"] > anchor - 7) & (frame["bucket"] <= anchor)].sort_values(["t0", "a0"])
        again = used[used.duplicated(["flow", "src_ip", "src_port", "seq"]) & (used["bucket"] == anchor)]
        x, begun = part[~part["begun"].astype(bool)], part[part["begun"].astype(bool)]
        assert x["retr"].sum() == len(again) and x["n"].sum() == (sums["bucket"] > anchor - 6).sum()
        first = sums.sort_values(["t0", "a0"]).drop_duplicates("flow")
        assert len(begun) == (first["bucket"] > anchor - 3).sum()
        for r in x.itertuples():
            assert r.t0 == first["t0"][first["entity_ip"] == r.entity_ip].loc[lambda s: s == r.t0].iloc[0]


def test_all_windows_that_end_together_come_from_one_pass():
    """The same parts as window after window, and lean ones that leave out what no feature reads."""
    rnd = random.Random(12)
    rows = []
    for i in range(900):
        b = rnd.choice([rnd.randrange(1, 9), rnd.randrange(20, 30)])
        t = b * 100 - rnd.randrange(100)
        seq = rnd.choice([None, 1.0, 2.0, 3.0])
        rows.append(dict(flow=rnd.choice([None, "f0", "f1", "f2", "f3"]), bucket=b, src_ip=rnd.choice([None, "s0", "s1"]), src_port=i % 2, protocol=rnd.choice([6, 6, None]), last_us=t, t0=t, a0=i, entity_ip=f"e{i % 3}", peer_ip="p", target_port=80, seq=None, m=None, **{c: rnd.randrange(5) for c in W._COUNTS}))
        if seq:
            rows.append(dict(rows[-1], seq=seq, m=rnd.randrange(1, 4)))
    frame = pd.DataFrame(rows)
    plain = lambda parts: sorted(map(str, parts.astype(object).where(parts.notna(), None).itertuples(index=False, name=None)))
    for first, last in ((1, 40), (3, 6), (9, 22)):
        apart = pd.concat([W.parts_of_anchor(frame, anchor, 7) for anchor in range(first, last + 1)])
        assert plain(W.parts_of_anchors(frame, first, last, 7)) == plain(apart)
        lean = W.parts_of_anchors(frame, first, last, 7, lean=True)
        near = lambda x: x[x["begun"].astype(bool) | (x["off"] < 3)]
        assert plain(near(lean)) == plain(near(apart))
        far = [x.loc[~x["begun"].astype(bool) & (x["off"] >= 3), ["anchor", "entity_ip"]] for x in (lean, apart)]
        assert not far[0].duplicated().any() and plain(far[0]) == plain(far[1].drop_duplicates())


def test_scan_stream_keeps_only_what_later_batches_need(spark, tmp_path):
    rows = [dict(ring(1)[0], ts_us=BASE + i * SEC, arrival=i, src_ip="10.10.0.1", dst_ip="10.20.0.1", protocol=6, src_port=1000 + i, dst_port=20 + i % 15, tcp_flags=2, tcp_payload_length=0) for i in range(400)]
    out = str(tmp_path / "out")
    L.scan_stream(replayed(spark, tmp_path / "in", rows, 5), out, str(tmp_path / "check"), "10.10.0.0/16", 5, 30 * SEC, 3 * SEC, 60 * SEC, 90 * SEC, SEC, 60 * SEC).awaitTermination()
    held = [x for x in os.listdir(f"{out}/held") if x.startswith("epoch=")]
    assert len(held) <= 2
    counts = {x: spark.read.parquet(f"{out}/held/{x}/packets").count() for x in held}
    assert all(80 <= n <= 100 for n in counts.values())
    at = sorted(r.fail_us for r in spark.read.parquet(f"{out}/triggers").collect())
    assert len(at) >= 5 and all(b - a >= 60 * SEC for a, b in zip(at, at[1:]))

