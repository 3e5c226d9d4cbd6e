"""Feature rows against a direct restatement of their definitions, on a random ring."""

import math
import random

import pytest

from netlens.operators import features as FT, prep

SEC = 1_000_000
BASE = 1_700_000_000 * SEC


def ring(n=300, seed=3):
    rnd = random.Random(seed)
    hosts = ["10.10.0.1", "10.10.0.2", "10.10.0.3", "10.20.0.1", "192.168.9.9"]
    out = []
    for i in range(n):
        a, b = rnd.sample(hosts, 2)
        proto = rnd.choice([6, 6, 6, 17, 1])
        sp, dp = (rnd.choice([1000, 1001, 80]), rnd.choice([80, 443, 53])) if proto != 1 else (0, 0)
        out.append(dict(ts_us=BASE + rnd.randrange(150 * SEC), arrival=i, src_ip=a, dst_ip=b, protocol=proto, src_port=sp, dst_port=dp,
                        ip_length=rnd.choice([40, 140, 540]), ttl=rnd.choice([63, 64]), fragmented=rnd.random() < 0.1,
                        tcp_flags=rnd.choice([2, 18, 16, 4, 24]) if proto == 6 else 0, tcp_seq=rnd.choice([1, 2, 3]) if proto == 6 else 0,
                        tcp_payload_length=rnd.choice([0, 100, 500]) if proto == 6 else 0, icmp_type=rnd.choice([0, 8]) if proto == 1 else -1,
                        icmp_id=rnd.choice([1, 2]) if proto == 1 else 0))
    return out


SCHEMA = ("ts_us long, arrival long, src_ip string, dst_ip string, protocol int, src_port int, dst_port int, ip_length int, ttl int, fragmented boolean, "
          "tcp_flags int, tcp_seq long, tcp_payload_length int, icmp_type int, icmp_id int")
APP = "ts_us long, arrival long, entity_ip string, kind string, status int, method string, dns_name string, event_key string, tls_version string"


def attributed(packets):
    owner, seen, out = {}, {}, []
    for p in sorted(packets, key=lambda p: (p["ts_us"], p["arrival"])):
        ends = sorted([(p["src_ip"], p["src_port"]), (p["dst_ip"], p["dst_port"])])
        key = (p["protocol"], *ends) if p["protocol"] in (6, 17) else (1, *sorted([p["src_ip"], p["dst_ip"]]), p["icmp_id"])
        new = key not in owner
        if new:
            swap = p["protocol"] == 6 and p["tcp_flags"] & 18 == 18
            echo = p["protocol"] == 1 and p["icmp_type"] == 0
            e, q = (p["dst_ip"], p["src_ip"]) if swap or echo else (p["src_ip"], p["dst_ip"])
            owner[key] = (e, q, p["src_port"] if swap else p["dst_port"], p["ts_us"])
        e, q, port, t0 = owner[key]
        if not e.startswith("10.10."):
            continue
        rt = False
        if p["protocol"] == 6 and p["tcp_payload_length"]:
            d = (p["src_ip"], p["src_port"], p["dst_ip"], p["dst_port"])
            rt = p["tcp_seq"] in seen.setdefault(d, set())
            seen[d].add(p["tcp_seq"])
        out.append(dict(p, entity=e, peer=q, port=port, new=new, dur=p["ts_us"] - t0, rt=rt, out=p["src_ip"] == e))
    return out


def rows_of(obs, step=10):
    by = {}
    for o in obs:
        by.setdefault(o["entity"], []).append(o)
    out = {}
    for e, items in by.items():
        ts = [o["ts_us"] for o in items]
        first, last = min(ts) // (step * SEC) + 1, -(-max(ts) // (step * SEC))
        for a in range(first, last + 1):
            w = lambda s: [o for o in items if (a * step - s) * SEC < o["ts_us"] <= a * step * SEC]
            w10, w30 = w(10), w(30)
            att = [o for o in w30 if o["new"]]
            r = lambda x, y: x / y if y else 0.0
            flows = {}
            for o in w30:
                k = (o["peer"], o["port"], o["protocol"])
                flows[k] = max(flows.get(k, 0), o["dur"])
            tx = sum(o["ip_length"] for o in w30 if o["out"])
            data = [o for o in w10 if o["tcp_payload_length"] and o["protocol"] == 6]
            out[e, a] = dict(
                packet_rate_10s=len(w10) / 10, unique_dst_ip_ratio_30s=r(len({o["peer"] for o in att}), len(att)),
                unique_dst_port_ratio_30s=r(len({o["port"] for o in att if o["port"]}), len([1 for o in att if o["port"]])),
                protocol_diversity_30s=r(len({o["protocol"] for o in w30}), len(w30)), tx_rx_byte_ratio_30s=r(tx, sum(o["ip_length"] for o in w30)),
                flow_duration_mean_30s=r(sum(flows.values()), len(flows)) / SEC, tcp_retransmission_ratio_10s=r(sum(o["rt"] for o in data), len(data)))
    return out


@pytest.fixture(scope="module")
def no_app(spark):
    return spark.createDataFrame([], APP)


def test_dense_rows_match_the_definitions(spark, no_app):
    packets = ring()
    obs = prep.attribute(spark.createDataFrame(packets, SCHEMA), "10.10.0.0/16")
    want = rows_of(attributed(packets))
    names = list(next(iter(want.values())))
    got = {(r["entity_ip"], r["anchor"]): r for r in FT.features(obs, no_app, columns=names).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        for n in names:
            assert math.isclose(got[k][n], w[n], abs_tol=1e-9), (k, n)


def test_horizon_rows_equal_rows_computed_on_the_horizon_alone(spark, no_app):
    packets = ring(200, 9)
    names = ["packet_count_10s", "flow_attempt_count_30s", "unique_dst_port_ratio_30s", "unique_dst_ip_ratio_30s", "protocol_diversity_30s", "syn_count_10s", "tx_rx_byte_ratio_30s",
             "tcp_retransmission_ratio_10s", "flow_duration_mean_30s", "rst_ratio_10s", "ttl_mean_10s"]
    df = spark.createDataFrame(packets, SCHEMA)
    live = {(r["entity_ip"], r["anchor"]): r for r in FT.features_at_horizon(df, no_app, "10.10.0.0/16", 10 * SEC, 7, names).collect()}
    last = max(a for _, a in live)
    seen = set()
    for a in range(min(a for _, a in live), last + 1):
        part = [p for p in packets if (a * 10 - 70) * SEC < p["ts_us"] <= a * 10 * SEC]
        obs = attributed(part)
        for e in {o["entity"] for o in obs if o["ts_us"] > (a * 10 - 60) * SEC}:
            seen.add((e, a))
            mine = [o for o in obs if o["entity"] == e]
            w = lambda s: [o for o in mine if o["ts_us"] > (a * 10 - s) * SEC]  # noqa: B023, E731
            r = lambda x, y: x / y if y else 0.0
            w10, w30 = w(10), w(30)
            att, data, flows = [o for o in w30 if o["new"]], [o for o in w10 if o["protocol"] == 6 and o["tcp_payload_length"]], {}
            for o in w30:
                k = (o["peer"], o["port"], o["protocol"])
                flows[k] = max(flows.get(k, 0), o["dur"])
            want = dict(
                packet_count_10s=len(w10), flow_attempt_count_30s=len(att), unique_dst_port_ratio_30s=r(len({o["port"] for o in att if o["port"]}), len([1 for o in att if o["port"]])),
                unique_dst_ip_ratio_30s=r(len({o["peer"] for o in att}), len(att)), protocol_diversity_30s=r(len({o["protocol"] for o in w30}), len(w30)),
                syn_count_10s=sum(o["out"] and o["protocol"] == 6 and o["tcp_flags"] & 18 == 2 for o in w10), tx_rx_byte_ratio_30s=r(sum(o["ip_length"] for o in w30 if o["out"]), sum(o["ip_length"] for o in w30)),
                tcp_retransmission_ratio_10s=r(sum(o["rt"] for o in data), len(data)), flow_duration_mean_30s=r(sum(flows.values()), len(flows)) / SEC,
                rst_ratio_10s=r(sum(o["protocol"] == 6 and o["tcp_flags"] & 4 > 0 for o in w10), sum(o["protocol"] == 6 for o in w10)), ttl_mean_10s=r(sum(o["ttl"] for o in w10), len(w10)),
            )
            for n, v in want.items():
                assert math.isclose(live[e, a][n], v, abs_tol=1e-9), (e, a, n)
    assert seen == set(live) - {k for k in live if k[1] > last}


def test_owner_changes_when_the_first_packet_leaves_the_horizon(spark, no_app):
    """A flow's reply owns it once the horizon has lost the SYN; each packet goes to six anchors at most."""
    base = dict(ring(1)[0], protocol=6, src_ip="10.10.0.1", dst_ip="10.10.0.2", src_port=1000, dst_port=80, tcp_payload_length=0)
    syn = dict(base, ts_us=BASE + 5 * SEC, arrival=0, tcp_flags=2)
    late = [dict(base, ts_us=BASE + t * SEC, arrival=i + 1, src_ip="10.10.0.2", dst_ip="10.10.0.1", src_port=80, dst_port=1000, tcp_flags=16) for i, t in enumerate((35, 75, 115))]
    rows = FT.features_at_horizon(spark.createDataFrame([syn, *late], SCHEMA), no_app, "10.10.0.0/16", 10 * SEC, 7, ["packet_count_10s", "flow_attempt_count_30s"]).collect()
    first = BASE // (10 * SEC) + 1
    got = {(r["entity_ip"], r["anchor"] - first): (r["packet_count_10s"], r["flow_attempt_count_30s"]) for r in rows}
    assert got["10.10.0.1", 3] == (1, 0) and ("10.10.0.2", 3) not in got  # the SYN is in the horizon
    assert got["10.10.0.2", 7] == (1, 0) and ("10.10.0.1", 7) not in got  # now the packet of 35 s is the first
    assert got["10.10.0.2", 11] == (1, 0) and len(rows) == 17
    assert got["10.10.0.2", 7 + 3] == (0, 0)


def test_window_is_open_left_closed_right_and_grid_guard(spark, no_app):
    """An instant on the grid has no row of its own; alone it has no row at all."""
    one = dict(ring(1)[0], src_ip="10.10.0.1", dst_ip="10.20.0.1", protocol=17, ts_us=BASE)
    obs = lambda ps: prep.attribute(spark.createDataFrame(ps, SCHEMA), "10.10.0.0/16")
    assert FT.features(obs([one]), no_app, columns=["packet_count_10s"]).count() == 0
    later = dict(one, ts_us=BASE + 25 * SEC, arrival=1)
    got = {r["anchor"] - BASE // (10 * SEC): r for r in FT.features(obs([one, later]), no_app, columns=["packet_count_10s", "protocol_diversity_30s"]).collect()}
    assert sorted(got) == [1, 2, 3]
    assert [got[i]["packet_count_10s"] for i in (1, 2, 3)] == [0, 0, 1]
    assert got[1]["protocol_diversity_30s"] == 1.0 and got[3]["protocol_diversity_30s"] == 1.0


def test_application_ratios(spark):
    """NXDOMAIN and name ratios are clamped, an empty method is a label, missing data is 0."""
    t = BASE + 5 * SEC
    app = [(t, 0, "10.10.0.1", "dns_query", 0, "", "", "", ""), (t, 1, "10.10.0.1", "dns_query", 0, "", "a", "", ""), (t, 2, "10.10.0.1", "http", 200, "GET", "", "", ""), (t, 3, "10.10.0.1", "http", 500, "", "", "", "")]
    app += [(t, 4 + i, "10.10.0.1", "dns_nxdomain", 0, "", "", "", "") for i in range(3)]
    obs = prep.attribute(spark.createDataFrame([], SCHEMA), "10.10.0.0/16")
    names = ["dns_nxdomain_ratio_60s", "unique_dns_name_ratio_60s", "http_method_entropy_60s", "http_error_ratio_60s", "mean_ip_len_10s", "tls_version_ratio_60s"]
    r = FT.features(obs, spark.createDataFrame(app, APP), columns=names).first()
    assert [r[n] for n in names] == [1.0, 0.5, 1.0, 0.5, 0.0, 0.0]


def test_late_capture_start_is_an_error(spark, no_app):
    obs = prep.attribute(spark.createDataFrame(ring(5), SCHEMA), "10.10.0.0/16")
    with pytest.raises(Exception, match="capture start"):
        FT.capture_start(obs, no_app, BASE + 10_000 * SEC).collect()
