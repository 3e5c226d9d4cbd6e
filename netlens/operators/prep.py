"""Packet preparation: scope, copies of the mirror port, flow attribution, layer 2."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from netlens.functions.columns import (
    ACK, ICMP, RST, SYN, TCP, flow_key, has_flag, in_scope,
)
from netlens.operators.core import SECOND, drop_repeats, near_previous, retained_fold

ORDER = ("ts_us", "arrival")
# What makes two frames copies of one another.
MIRROR_KEY = ("protocol", "src_ip", "dst_ip", "src_port", "dst_port", "ip_id", "ip_length", "tcp_seq", "icmp_type", "icmp_id")
TCP_KEY = ("src_ip", "dst_ip", "src_port", "dst_port", "tcp_flags", "tcp_seq", "ip_length")
DNS_KEY = ("dns_event", "src_ip", "src_port", "dest_ip", "dns_id", "name", "rrtype", "rcode")
MIRROR_GAP_US = 5_000
CONTROL_PROTOCOLS = (112, 240)


# --- filters that keep count -----------------------------------------------------------

def split_excluded(df: DataFrame, ip: str, cidrs: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows outside the excluded networks, and how many rows each excluded address had."""
    flagged = df.withColumn("_out", in_scope(F.col(ip), cidrs))
    kept = flagged.where(~F.col("_out")).drop("_out")
    counted = flagged.where("_out").groupBy(ip).agg(F.count(F.lit(1)).alias("rows_excluded"))
    return kept, counted


def drop_protocols(packets: DataFrame, protocols: Sequence[int] = CONTROL_PROTOCOLS) -> DataFrame:
    return packets.where(~F.col("protocol").isin(*protocols))


def l2_scope(l2: DataFrame, scope: str, protocols: Sequence[int] = CONTROL_PROTOCOLS) -> DataFrame:
    """Layer-2 rows of entities in scope, without the control-plane protocols."""
    return l2.where(in_scope(F.col("sender_ip"), scope) & ~F.col("protocol").isin(*protocols))


# --- copies ------------------------------------------------------------------------------

def dedup_mirror(packets: DataFrame, gap_us: int = MIRROR_GAP_US) -> DataFrame:
    """One row per frame: copies differ by at most one hop and the higher TTL is kept."""
    return drop_repeats(packets, MIRROR_KEY, ORDER, "ts_us", gap_us, inclusive=True, value="ttl")


def mirror_dropped(packets: DataFrame, gap_us: int = MIRROR_GAP_US) -> DataFrame:
    gone = retained_fold(packets, MIRROR_KEY, ORDER, "ts_us", gap_us, inclusive=True, value="ttl")
    return gone.agg(F.count(F.lit(1)).alias("dropped"))


def dedup_tcp(packets: DataFrame, gap_us: int = MIRROR_GAP_US, refresh: bool = True,
              keys: Sequence[str] = TCP_KEY, slice_us: int = 60 * SECOND) -> DataFrame:
    """Drop copies less than ``gap_us`` after the previous one; ``refresh`` measures from
    the last copy seen, otherwise from the last one kept."""
    if not refresh:
        return drop_repeats(packets, keys, ORDER, "ts_us", gap_us)
    x = near_previous(packets, keys, ORDER, {"ts_us": "_p"}, "ts_us", gap_us - 1, slice_us)
    return x.where("_p is null").drop("_p")


def dedup_dns(events: DataFrame, gap_us: int = MIRROR_GAP_US) -> DataFrame:
    return drop_repeats(events, DNS_KEY, ORDER, "ts_us", gap_us)


def dedup_http(events: DataFrame) -> DataFrame:
    """First record of each (flow, transaction, url).

    Grouping with ``min_by`` combines map-side, so a heavily copied transaction is one
    row per task before the shuffle.
    """
    cols = [c for c in events.columns if c not in ("flow_id", "tx_id", "url")]
    first = F.min_by(F.struct(*cols), F.struct(*ORDER)).alias("r")
    return events.groupBy("flow_id", "tx_id", "url").agg(first).select("flow_id", "tx_id", "url", "r.*").select(*events.columns)


def dedup_dns_second(events: DataFrame) -> DataFrame:
    """One query per (source, port, id, name) and second."""
    second = F.floor(F.col("ts_us") / SECOND).alias("second")
    return events.select("src_ip", "src_port", "dns_id", "name", second).distinct()


# --- flows --------------------------------------------------------------------------------

def flow_owner():
    """Owner, peer and target port that a flow's first packet fixes."""
    synack = (F.col("protocol") == TCP) & has_flag(F.col("tcp_flags"), SYN) & has_flag(F.col("tcp_flags"), ACK)
    echo = (F.col("protocol") == ICMP) & (F.col("icmp_type") == 0)
    swap = synack | echo
    return F.struct(
        F.col("ts_us").alias("t0"),
        F.col("arrival").alias("a0"),
        F.when(swap, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("entity_ip"),
        F.when(swap, F.col("src_ip")).otherwise(F.col("dst_ip")).alias("peer_ip"),
        F.when(synack, F.col("src_port")).otherwise(F.col("dst_port")).alias("target_port"),
    )


def packet_flags(df: DataFrame) -> DataFrame:
    """Direction and TCP marks of an attributed packet."""
    tcp = F.col("protocol") == TCP
    flags = F.col("tcp_flags")
    syn, ack = has_flag(flags, SYN), has_flag(flags, ACK)
    out = df.withColumn("outbound", F.col("src_ip") == F.col("entity_ip"))
    return out.withColumns({
        "syn": tcp & F.col("outbound") & syn & ~ack,
        "syn_ack": tcp & ~F.col("outbound") & syn & ack,
        "rst": tcp & has_flag(flags, RST),
    })


def attribute(packets: DataFrame, scope: str) -> DataFrame:
    """Attribute packets to the flow's initiator; flows out of scope are dropped whole.

    The flow's first packet is found by a map-side combined ``min_by`` and joined back, so
    a flow holding a third of the traffic is not gathered in one window partition (the
    adaptive skew join splits its side). Retransmission = a data segment whose sequence
    number the same direction already used; its first use is found the same way.
    """
    p = packets.withColumn("flow", flow_key())
    first = p.groupBy("flow").agg(F.min_by(flow_owner(), F.struct(*ORDER)).alias("o"))
    owned = p.join(first.where(in_scope(F.col("o.entity_ip"), scope)), "flow")
    x = owned.select(
        *p.columns, "o.entity_ip", "o.peer_ip", "o.target_port",
        ((F.col("ts_us") == F.col("o.t0")) & (F.col("arrival") == F.col("o.a0"))).alias("flow_attempt"),
        (F.col("ts_us") - F.col("o.t0")).alias("flow_duration_us"),
    )
    direction = ["src_ip", "src_port", "dst_ip", "dst_port", "tcp_seq"]
    data = (F.col("protocol") == TCP) & (F.col("tcp_payload_length") > 0)
    seen = x.where(data).groupBy(*direction).agg(F.min(F.struct(*ORDER)).alias("seen"))
    x = x.withColumn("data_segment", data).join(
        seen.withColumn("data_segment", F.lit(True)), [*direction, "data_segment"], "left"
    )
    again = F.col("data_segment") & (F.struct(*[F.col(c) for c in ORDER]) > F.col("seen"))
    x = x.withColumn("retransmission", F.coalesce(again, F.lit(False))).drop("seen")
    return packet_flags(x)


def attribute_basic(packets: DataFrame, scope: str) -> DataFrame:
    """Attribution without durations and retransmissions."""
    p = packets.withColumn("flow", flow_key())
    first = p.groupBy("flow").agg(F.min_by(flow_owner(), F.struct(*ORDER)).alias("o"))
    x = p.join(first.where(in_scope(F.col("o.entity_ip"), scope)), "flow").select(
        *p.columns, "o.entity_ip", "o.peer_ip", "o.target_port",
        ((F.col("ts_us") == F.col("o.t0")) & (F.col("arrival") == F.col("o.a0"))).alias("flow_attempt"),
    )
    return packet_flags(x)


# --- layer 2 --------------------------------------------------------------------------------

def forwarding_macs(l2: DataFrame) -> DataFrame:
    """Source addresses seen in more than one VLAN."""
    return (
        l2.groupBy("src_mac").agg(F.count_distinct("vlan").alias("vlans")).where("vlans > 1")
    )


def native_vlan(l2: DataFrame) -> DataFrame:
    """An entity's own VLAN: the most frequent one among frames nobody forwarded.

    Ties take the lowest tag; an entity seen only through forwarders uses all frames.
    The frames are first counted per (entity, MAC, VLAN), so only counts are joined.
    """
    counts = l2.groupBy("sender_ip", "src_mac", "vlan").agg(F.count(F.lit(1)).alias("n"))
    forwarders = (
        counts.groupBy("src_mac").agg(F.count_distinct("vlan").alias("v")).where("v > 1").select("src_mac", F.lit(0).alias("own"))
    )
    marked = counts.join(forwarders, "src_mac", "left").withColumn("own", F.coalesce("own", F.lit(1)))
    votes = marked.groupBy("sender_ip", "vlan").agg(
        F.sum("n").alias("n_all"), F.sum(F.col("n") * F.col("own")).alias("n_own")
    )
    rank = F.struct(
        F.when(F.col("n_own") > 0, 1).otherwise(0), F.when(F.col("n_own") > 0, F.col("n_own")).otherwise(F.col("n_all")), -F.col("vlan")
    )
    return votes.groupBy("sender_ip").agg(F.max_by("vlan", rank).alias("native_vlan"))


def in_native_vlan(l2: DataFrame) -> DataFrame:
    """Frames of each entity in its own VLAN."""
    own = native_vlan(l2)
    return l2.join(own, "sender_ip").where("vlan = native_vlan")


def mac_transitions(l2: DataFrame, slice_us: int = 60 * SECOND, tol_us: int = 60 * SECOND) -> DataFrame:
    """Frames whose MAC differs from the entity's previous frame, with that frame's instant.

    Only predecessors inside the longest window matter (a transition counts in a window
    that holds both frames), so the look-back is bounded by ``tol_us``.
    """
    x = near_previous(
        l2, ["sender_ip"], ORDER, {"src_mac": "prev_mac", "ts_us": "prev_ts"}, "ts_us", tol_us, slice_us
    )
    return x.where("prev_mac is not null and prev_mac <> src_mac")
