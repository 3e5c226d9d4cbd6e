"""Pending windows and measures in force: shards of keys in few rows of state give what one key after another gives."""

import random

import pandas as pd

from netlens.operators import actions as A
from netlens.streaming import live as L

BASE = 1_700_000_000_000_000


def run(spark, tmp_path, batches, ddl, made):
    """Rows by batch of a stream over the batches, and the most rows its state had; an empty batch keeps their numbers."""
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = {}
    stream = made(L.closed_file_stream(spark, str(tmp_path / "in"), ddl, 1))
    q = stream.writeStream.foreachBatch(lambda b, epoch: out.update({epoch: [tuple(r) for r in b.collect()]})).option(
        "checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    return out, max(p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators)


def test_pending_windows_run_out_to_the_millisecond_and_share_rows_of_state(spark, tmp_path):
    ms, expiry, delay = 1_000, 2_000_000, 500
    rnd = random.Random(5)
    hosts = [None, *(f"10.10.0.{i}" for i in range(40))]
    batches, at, want, state, wm = [], BASE, {}, {}, 0
    for b in range(7):
        rows = [(h, BASE + w * 500 * ms, rnd.choice(["pending"] * 4 + ["decided", None]), at + rnd.randrange(200) * ms + rnd.randrange(ms))
                for h in hosts for w in range(max(0, 2 * b - 5), 2 * b + 2) if rnd.random() < 0.3]
        # the next watermark is one millisecond past the end of one window, and at that of no other
        rows.append(("edge", BASE + 500 * b * ms, "pending", BASE + expiry + (delay + 1 + 500 * b) * ms + 7))
        batches.append(rows)
        told, touched = [], {}
        for h, w, kind, _ in rows:
            touched.setdefault((h, w), set()).add(kind)
        for key, kinds in touched.items():
            if "decided" in kinds:
                state.pop(key, None)
                told.append((*key, "decided"))
            else:
                state[key] = max((key[1] + expiry) // 1000, wm + 1)
        over = [key for key, due in state.items() if due < wm]
        told += [(*key, "pcap_incompleto") for key in over]
        for key in over:
            del state[key]
        want[b] = told
        at = max(r[3] for r in rows)
        wm = at // 1000 - delay
    want[7] = [(*key, "pcap_incompleto") for key, due in state.items() if due < wm]  # a last batch without rows
    got, rows = run(spark, tmp_path, batches, "entity_ip string, window_us long, kind string, ts_us long", lambda x: L.pending_windows(x, expiry, f"{delay} milliseconds"))
    order = lambda rows: sorted(rows, key=str)
    assert {b: order(r) for b, r in got.items() if r} == {b: order(r) for b, r in want.items() if r}
    assert {r[2] for b in want.values() for r in b} == {"decided", "pcap_incompleto"}


def test_a_window_without_a_host_is_decided_in_a_later_batch(spark, tmp_path):
    batches = [[(h, BASE, "pending", BASE) for h in (None, "10.10.0.1", "10.10.0.2")], [(h, BASE, "decided", BASE + 1) for h in (None, "10.10.0.1")], [("late", BASE + 10**9, "pending", BASE + 10**9)]]
    got, _ = run(spark, tmp_path, batches, "entity_ip string, window_us long, kind string, ts_us long", lambda x: L.pending_windows(x, 10**6, "1 second", shards=1))
    assert {r for b in got.values() for r in b} == {(None, BASE, "decided"), ("10.10.0.1", BASE, "decided"), ("10.10.0.2", BASE, "pcap_incompleto")}


def test_one_window_of_many_hosts_is_a_row_of_state_a_shard(spark, tmp_path):
    batches = [[(f"10.10.{i % 9}.{i}", BASE, "pending", BASE) for i in range(3_000)], [("late", BASE, "pending", BASE + 1)]]
    got, rows = run(spark, tmp_path, batches, "entity_ip string, window_us long, kind string, ts_us long", lambda x: L.pending_windows(x, 10**9, "1 second"))
    assert not any(got.values()) and rows <= 3 * 64  # with its timers; before, a row a host
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage") == "true"  # else each partition has buffers of its own


def test_measures_go_on_from_batch_to_batch_and_share_rows_of_state(spark, tmp_path):
    rnd = random.Random(9)
    second, day = 1_000_000, 86_400_000_000
    rows = []
    for i in range(6_000):
        ip = rnd.choice([None, "10.10.0.1", "10.10.0.2", *(f"10.10.1.{j}" for j in range(400))])
        t = BASE + rnd.choice([0, 0, 0, 2, 5]) * day + rnd.randrange(7_000) * second
        rows.append((ip, rnd.choice(["dc1", "srv-dmz"]), rnd.choice(["dns", "todo", "todo", None]), rnd.choice(["BLOCK", "LIMIT", "LIMIT", None]), f"e{i}", t, t - rnd.randrange(400) * second, t - rnd.randrange(90) * second))
    rows.sort(key=lambda r: (r[5], r[4]))
    batches = [rows[i : i + 1_000] for i in range(0, 6_000, 1_000)]
    want, pasts = set(), {}
    for b in batches:
        for key, part in pd.DataFrame(b, columns=["ip", "target", "scope", "action", "event_id", "t_us", "from_us", "to_us"]).groupby(["ip", "target"], dropna=False):
            part = part.sort_values(["t_us", "event_id"], ignore_index=True)
            key = tuple(None if pd.isna(k) else k for k in key)
            found, pasts[key] = A.changes(part, pasts.get(key, A.NO_PAST), second)
            want |= {(part["event_id"][r.row], r.state, r.in_force, r.until_us, r.level) for r in found.itertuples() if r.state != "renovada"}
    got, held = run(spark, tmp_path, batches, "entity_ip string, target string, scope string, action string, event_id string, t_us long, from_us long, to_us long",
                    lambda x: L.stream_actions(x, second, "1 hour", shards=4, cells=4))
    told = [r for b in got.values() for r in b]
    assert len(told) == len(set(told)) and set(told) == want and {r[1] for r in told} == {"nueva", "escalada"}
    assert held <= 60 and len(pasts) > 700  # before, a row an address and target
