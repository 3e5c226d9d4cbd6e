"""Live feature rows from keyed state: packets reduced per bucket, windows closed by event-time timers.

The state is keyed by shards of flows, so that one timer closes a window for many flows at once. A shard
holds the reduced rows of the buckets in the horizon and nothing older; each batch adds cells of its own and
rewrites none. What a batch reads does not depend on how long the stream has been up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from netlens.functions.columns import ACK, ICMP, RST, SYN, TCP, ceil_bucket, flow_key, has_flag, in_scope
from netlens.operators.core import remove, scratch_path
from netlens.operators.features import LIVE_SUMS, rows_of_anchors
from netlens.operators.prep import flow_owner
from netlens.streaming.cells import packed, store_on_disk, unpacked
from netlens.streaming.marks import mark, marked

#: Rows of a shard that are cut into cells at once.
PACK_ROWS = 200_000
_COUNTS = [c for c in LIVE_SUMS if c != "retr"]
_SIDE = ["flow", "bucket", "src_ip", "src_port", "protocol"]
_OWNER = ["t0", "a0", "entity_ip", "peer_ip", "target_port"]
_REDUCED = (
    "flow string, bucket long, src_ip string, src_port int, protocol int, " + ", ".join(f"{c} long" for c in _COUNTS)
    + ", last_us long, t0 long, a0 long, entity_ip string, peer_ip string, target_port int, seq long, m long"
)
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
_REDUCED_TYPE = pa.schema([(n, _KINDS[t]) for n, t in (c.split() for c in _REDUCED.split(", "))])
_PART = (
    "anchor long, off int, begun boolean, src_ip string, protocol int, " + ", ".join(f"{c} long" for c in LIVE_SUMS)
    + ", last_us long, t0 long, entity_ip string, peer_ip string, target_port int, clock_us long"
)


def _measured(packets: DataFrame, step_us: int) -> DataFrame:
    """One row a packet with the measures that are summed, its claim to own the flow, and its sequence if it carries data."""
    flags, tcp = F.col("tcp_flags"), F.col("protocol") == TCP
    syn, ack = has_flag(flags, SYN), has_flag(flags, ACK)
    data = tcp & (F.col("tcp_payload_length") > 0)
    bit = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    marks = {
        "n": F.lit(1).cast("long"), "bytes": F.col("ip_length").cast("long"), "large": bit(F.col("ip_length").between(500, 1500)), "icmp": bit(F.col("protocol") == ICMP),
        "tcp": bit(tcp), "ttl": F.col("ttl").cast("long"), "frag": bit(F.col("fragmented")), "rst": bit(tcp & has_flag(flags, RST)), "data": bit(data),
        "syns": bit(tcp & syn & ~ack), "synacks": bit(tcp & syn & ack),
    }
    p = packets.withColumn("flow", flow_key()).withColumn("bucket", ceil_bucket(F.col("ts_us"), step_us)).withColumn("o", flow_owner())
    return p.select(*_SIDE, *[marks[c].alias(c) for c in _COUNTS], F.col("ts_us").alias("last_us"), *[F.col(f"o.{c}").alias(c) for c in _OWNER], F.when(data, F.col("tcp_seq")).alias("seq"))


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums and first packet per (flow, bucket, sender), and uses per sequence, of each Arrow batch."""
    names = _REDUCED_TYPE.names

    def shaped(t: pa.Table) -> pa.Table:
        return pa.table([t.column(n).cast(k).combine_chunks() if n in t.column_names else pa.nulls(t.num_rows, k) for n, k in zip(names, _REDUCED_TYPE.types)], schema=_REDUCED_TYPE)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]).sort_by([("t0", "ascending"), ("a0", "ascending")])
        sums = t.group_by(_SIDE, use_threads=False).aggregate([*[(c, "sum") for c in _COUNTS], ("last_us", "max"), *[(c, "first") for c in _OWNER]])
        sums = sums.rename_columns([n.rsplit("_", 1)[0] if n not in _SIDE else n for n in sums.column_names])
        used = t.filter(pc.is_valid(t.column("seq"))).group_by([*_SIDE, "seq"], use_threads=False).aggregate([("n", "sum"), ("last_us", "max")])
        used = used.rename_columns(["m" if n == "n_sum" else "last_us" if n == "last_us_max" else n for n in used.column_names])
        yield from pa.concat_tables([shaped(sums), shaped(used)]).combine_chunks().to_batches()


def parts_of_anchor(rows: pd.DataFrame, anchor: int, horizon_steps: int) -> pd.DataFrame:
    """What the flows of reduced rows add to one anchor: sums by bucket and sender with their owner, and attempts."""
    return parts_of_anchors(rows, anchor, anchor, horizon_steps)


def parts_of_anchors(rows: pd.DataFrame, first: int, last: int, horizon_steps: int, lean: bool = False) -> pd.DataFrame:
    """What the flows of reduced rows add to each anchor from ``first`` to ``last``, all of them at once.

    A flow's first row of a bucket owns it from that bucket on, once the bucket before has left the horizon, until it leaves
    itself; so owners are found by search, and the rows of a horizon are not read again for each anchor. ``lean`` leaves one
    row of an owner's address in the last three offsets, where it tells no more than that the address was seen.
    """
    rows = rows[(rows["bucket"] > first - horizon_steps) & (rows["bucket"] <= last)]
    flow, src = (pd.factorize(rows[c], use_na_sentinel=False) for c in ("flow", "src_ip"))
    rows = rows.assign(flow=flow[0], src_ip=src[0])
    sums, used = rows[rows["seq"].isna()], rows[rows["seq"].notna()]
    side = ["flow", "bucket", "src_ip", "protocol"]
    group = dict(as_index=False, dropna=False, sort=False)
    x = sums[sums["bucket"] > first - 6].groupby(side, **group).agg({**{c: "sum" for c in _COUNTS}, "last_us": "max"})
    # attempts and owners: the first row of each flow and bucket, in their order
    firsts = sums.sort_values(["t0", "a0"]).drop_duplicates(["flow", "bucket"]).sort_values(["flow", "bucket"], ignore_index=True)
    span, low = last - first + horizon_steps + 1, first - horizon_steps + 1
    place = (firsts["flow"] * span + (firsts["bucket"] - low)).to_numpy(np.int64)
    before = firsts.groupby("flow")["bucket"].shift()
    # segments whose sequence the horizon of their own anchor holds already
    key = ["flow", "src_ip", "src_port", "seq"]
    seen = used[[*key, "bucket"]].drop_duplicates().sort_values("bucket")
    seen["old"] = seen.groupby(key, dropna=False)["bucket"].shift() > seen["bucket"] - horizon_steps
    now = used[used["bucket"] >= first].groupby([*key, "bucket", "protocol"], **group)["m"].sum().merge(seen, on=[*key, "bucket"])
    now["retr"] = now["m"].astype("int64") - ~now["old"]
    x = x.merge(now.groupby(side, **group)["retr"].sum(), on=side, how="left")

    def spread(bucket: np.ndarray, offsets: int) -> tuple[np.ndarray, np.ndarray]:
        at = [np.flatnonzero((bucket + off >= first) & (bucket + off <= last)) for off in range(offsets)]
        return np.concatenate(at), np.repeat(np.arange(offsets), [len(i) for i in at])

    bucket = x["bucket"].to_numpy(np.int64)
    at, off = spread(bucket, 6)
    owner = np.searchsorted(place, x["flow"].to_numpy(np.int64)[at] * span + (bucket[at] + off - horizon_steps + 1 - low))
    if lean:
        far = off >= 3
        entity = pd.factorize(firsts["entity_ip"], use_na_sentinel=False)[0][owner]
        keep = ~far | ~pd.DataFrame({"entity": entity, "anchor": bucket[at] + off, "far": far}).duplicated().to_numpy()
        at, off, owner = at[keep], off[keep], owner[keep]
    out = x.iloc[at].reset_index(drop=True)
    out["off"], out["begun"] = off, False
    out["retr"] = out["retr"].where(out["off"] == 0)
    out["src_ip"] = pd.Series(np.asarray(src[1], object), dtype=object).take(out["src_ip"]).to_numpy()
    fixed = firsts[_OWNER]
    out[_OWNER] = fixed.iloc[owner].reset_index(drop=True)
    bucket = firsts["bucket"].to_numpy(np.int64)
    at, off = spread(bucket, 3)
    fresh = ~(before.to_numpy(float)[at] > bucket[at] + off - horizon_steps)
    at, off = at[fresh], off[fresh]
    begun = fixed.iloc[at].reset_index(drop=True).assign(bucket=bucket[at], off=off, begun=True)
    out = pd.concat([out.drop(columns="flow"), begun], ignore_index=True)
    out["anchor"], out["clock_us"] = out["bucket"] + out["off"], None
    numbers = [*LIVE_SUMS, "last_us"]
    out[numbers] = out[numbers].fillna(0).astype("int64")
    return out[[c.split()[0] for c in _PART.split(", ")]]


def _packs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The frames of a shard put together to about ``PACK_ROWS`` rows, which bounds both the cells and the memory."""
    held, rows = [], 0
    for frame in frames:
        held.append(frame)
        rows += len(frame)
        if rows >= PACK_ROWS:
            yield pd.concat(held, ignore_index=True)
            held, rows = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


class _Windows(StatefulProcessor):
    """A shard's reduced rows by bucket; a timer at each window's end hands on what the shard adds to it."""

    def __init__(self, step_us: int, horizon_steps: int):
        self.step_us, self.horizon = step_us, horizon_steps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", "bucket long, cell long", "rows binary")
        self.counts = handle.getMapState("counts", "bucket long", "cells long")
        self.done = handle.getValueState("done", "anchor long")

    def _end_ms(self, anchor: int) -> int:
        return -(-anchor * self.step_us // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        ends = set()
        for frame in _packs(rows):
            for bucket, part in frame[_REDUCED_TYPE.names].groupby("bucket"):
                bucket = int(bucket)
                cell = self._cells_of(bucket)
                table = pa.Table.from_pandas(part, schema=_REDUCED_TYPE, preserve_index=False)
                self.cells.updateValue((bucket, cell), (packed(table),))
                self.counts.updateValue((bucket,), (cell + 1,))
                # the six windows that hold the bucket, and the instant at which no horizon does
                ends.update(self._end_ms(anchor) for anchor in (*range(bucket, bucket + 6), bucket + self.horizon))
        for end in ends:
            if end > now:
                self.handle.registerTimer(end)
        yield self._clock(now)

    def _cells_of(self, bucket: int) -> int:
        return self.counts.getValue((bucket,))[0] if self.counts.containsKey((bucket,)) else 0

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        last, done = now * 1000 // self.step_us, self.done.get()[0] if self.done.exists() else None
        if done is not None and done >= last:  # the first timer of a batch closes all windows that have ended
            return
        buckets = sorted(bucket for (bucket,) in self.counts.keys())
        anchors = sorted({a for bucket in buckets for a in range(bucket, bucket + 6) if a <= last and (done is None or a > done)})
        for run, tables in self._runs(anchors, buckets):
            yield parts_of_anchors(pa.concat_tables(tables).to_pandas(), run[0], run[-1], self.horizon, lean=True)
        for bucket in buckets:
            if bucket <= last - self.horizon:
                for cell in range(self._cells_of(bucket)):
                    self.cells.removeKey((bucket, cell))
                self.counts.removeKey((bucket,))
        self.done.update((last,))
        yield self._clock(now)

    def _runs(self, anchors: list[int], buckets: list[int]) -> Iterator[tuple[list[int], list[pa.Table]]]:
        """Anchors in runs with the rows of their horizons, about ``PACK_ROWS`` rows or one anchor each; a bucket is read once."""
        held, run = {}, []
        for anchor in anchors:
            for bucket in buckets:
                if anchor - self.horizon < bucket <= anchor and bucket not in held:
                    held[bucket] = pa.concat_tables([unpacked(self.cells.getValue((bucket, cell))[0]) for cell in range(self._cells_of(bucket))])
            run.append(anchor)
            if anchor == anchors[-1] or sum(t.num_rows for t in held.values()) >= PACK_ROWS:
                yield run, list(held.values())
                held, run = {b: t for b, t in held.items() if b > anchor + 1 - self.horizon}, []

    def _clock(self, now_ms: int) -> pd.DataFrame:
        names = [c.split()[0] for c in _PART.split(", ")]
        return pd.DataFrame([[None] * (len(names) - 1) + [now_ms * 1000]], columns=names)

    def close(self) -> None:
        pass


def window_parts(packets: DataFrame, step_us: int, horizon_steps: int, guard_us: int, shards: int) -> DataFrame:
    """What each shard of flows adds to each window, once the packets have passed its end by ``guard_us``."""
    reduced = _measured(packets, step_us).mapInArrow(_reduced, _REDUCED)
    x = reduced.withColumn("shard", F.pmod(F.xxhash64("flow"), F.lit(shards))).withColumn("at", F.timestamp_micros("last_us"))
    x = x.withWatermark("at", f"{guard_us} microseconds")
    return x.groupBy("shard").transformWithStateInPandas(_Windows(step_us, horizon_steps), _PART, "Append", "EventTime")


def stream_features(
    packets: DataFrame, events: Callable[[int, int], DataFrame], out: str, checkpoint: str, scope: str,
    step_us: int, horizon_steps: int, columns: list[str], guard_us: int = 5_000, shards: int = 64, trigger: dict | None = None,
) -> StreamingQuery:
    """Feature rows of each window once the packets have passed its end, by ``trigger`` (default: the backlog, then stop).

    Packets drive time: a window is decided when the newest packet is ``guard_us`` past it, however quiet the events are. A
    decided window is never computed again, and packets older than the decided windows are dropped. ``events`` gives the
    events of a stretch of time; only those of the windows decided in a batch are read. A repeated batch overwrites its folder.
    """
    if horizon_steps < 6:
        raise ValueError("a horizon is at least as long as the longest window")
    store_on_disk(packets.sparkSession)

    def step(batch: DataFrame, epoch: int) -> None:
        spark = packets.sparkSession  # that of the batch plans without adaptive execution
        path = scratch_path(spark)
        batch.write.parquet(path)  # the state must not be advanced twice
        parts = spark.read.schema(batch.schema).parquet(path)
        clock, oldest = parts.agg(F.max("clock_us"), F.min("anchor")).first()
        done = marked(spark, out, epoch)
        first = done + 1 if done is not None else oldest
        # a batch without rows, or with late ones only, has no clock
        if first is not None and clock is not None and clock // step_us >= first:
            last = clock // step_us
            app = events((first - 6) * step_us, last * step_us)
            owned = parts.where("anchor is not null").where(in_scope(F.col("entity_ip"), scope))
            app = app.withColumn("bucket", ceil_bucket(F.col("ts_us"), step_us))
            rows = rows_of_anchors(owned.where("not begun"), owned.where("begun"), app, step_us, columns)
            rows.where(F.col("anchor").between(first, last)).write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")
            done = last
        if done is not None:
            mark(spark, out, epoch, done)
        remove(spark, parts)

    parts = window_parts(packets, step_us, horizon_steps, guard_us, shards)
    return parts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
