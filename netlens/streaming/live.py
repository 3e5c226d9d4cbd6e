"""Live forms of the operators. Batch and stream share the operator code."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from netlens.operators.actions import DECAY_S, MAX_EXPIRY_S, NO_PAST, change
from netlens.operators.core import SECOND, drop_repeats, materialize, remove
from netlens.operators.scan import failed_ports, failure_events, syn_attempts
from netlens.streaming.cells import packed, store_on_disk, unpacked
from netlens.streaming.marks import delete, mark, marked, numbers


def closed_file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1, max_age: str | None = None) -> DataFrame:
    """Stream of files their producer has closed and renamed into ``path``."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (r.option("maxFileAge", max_age) if max_age else r).parquet(path)


def scan_stream(
    packets: DataFrame, out: str, checkpoint: str, scope: str, k: int, window_us: int, grace_us: int,
    refractory_us: int, retention_us: int, gap_us: int, slice_us: int, trigger: dict | None = None,
) -> StreamingQuery:
    """Scan triggers as the packets arrive, the same as the batch rule gives on causal failures, by ``trigger``.

    An attempt is judged when its grace time has passed, so instants up to the newest packet
    minus the grace are final. Triggers already published take part in the refractory rule. Each batch
    keeps the packets and triggers that later ones can need as one table of its own and removes those
    before the last, so what a batch reads grows with the retention, not with the time the stream is up.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = [n for n in numbers(spark, f"{out}/held") if n < epoch]
        fresh = batch
        if before:
            fresh = fresh.unionByName(spark.read.parquet(f"{out}/held/epoch={before[-1]}/packets"))
        done = marked(spark, out, epoch)
        done = -1 if done is None else done
        recent = materialize(fresh.where(F.col("ts_us") > done - retention_us))
        newest = recent.agg(F.max("ts_us")).first()[0]
        upto = done if newest is None else max(newest - grace_us, done)
        f = failure_events(syn_attempts(recent, scope, gap_us, slice_us), grace_us, causal=True).withColumn("window_us", F.lit(window_us).cast("long"))
        f = f.where(F.col("fail_us") <= upto)
        hot = failed_ports(f, ["src_ip", "dst_ip"], max(slice_us, 2 * window_us)).where((F.col("failed_ports") >= k) & (F.col("fail_us") > done) & (F.col("fail_us") <= upto))
        cols = ["src_ip", "dst_ip", "fail_us", "syn_us", "port", "attempt_id", "failed_ports"]
        hot = hot.select(*cols, F.lit(True).alias("new"))
        if before:
            old = spark.read.parquet(f"{out}/held/epoch={before[-1]}/triggers")
            hot = hot.unionByName(old.where(F.col("fail_us") > done - refractory_us).select(*cols, F.lit(False).alias("new")))
        kept = drop_repeats(materialize(hot), ["src_ip", "dst_ip"], ["fail_us", "syn_us", "port", "attempt_id"], "fail_us", refractory_us, slice_us=64 * refractory_us)
        kept = materialize(kept)
        kept.where("new").select(*cols).write.mode("overwrite").parquet(f"{out}/triggers/epoch={epoch}")
        recent.where(F.col("ts_us") > upto - retention_us).write.mode("overwrite").parquet(f"{out}/held/epoch={epoch}/packets")
        kept.where(F.col("fail_us") > upto - refractory_us).select(*cols).write.mode("overwrite").parquet(f"{out}/held/epoch={epoch}/triggers")
        mark(spark, out, epoch, upto)
        for past in numbers(spark, f"{out}/held")[:-2]:  # a batch before the last is never repeated
            delete(spark, f"{out}/held/epoch={past}")
        remove(spark, recent)
        remove(spark, kept)

    return packets.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def bucket_counts(packets: DataFrame, step_us: int, delay: str) -> DataFrame:
    """Packets per (entity, bucket), emitted when the packet watermark closes the bucket.

    Buckets are open on the left, so the event time of a packet is moved back by 1 µs.
    """
    x = packets.withColumn("at", F.timestamp_micros(F.col("ts_us") - 1)).withWatermark("at", delay)
    g = x.groupBy(F.window("at", f"{step_us // SECOND} seconds"), "entity_ip").agg(F.count(F.lit(1)).alias("packets"), F.sum(F.col("ip_length").cast("long")).alias("bytes"))
    return g.select("entity_ip", (F.unix_micros("window.end") / step_us).cast("long").alias("bucket"), "packets", "bytes")


def decided_once(decisions: DataFrame, delay: str) -> DataFrame:
    """First decision of each window; repeats inside the watermark are dropped."""
    x = decisions.withColumn("at", F.timestamp_micros("logged_us")).withWatermark("at", delay)
    return x.dropDuplicatesWithinWatermark(["entity_ip", "window_us"])


class _Pending(StatefulProcessor):
    """The windows of a shard that wait: a cell of state a window, with its entities and when each of them runs out."""

    def __init__(self, expiry_us: int):
        self.expiry_us = expiry_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "window_us long", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, side = timerValues.getCurrentWatermarkInMs(), ["entity_ip", "window_us"]
        once = lambda x: x.groupby(side, as_index=False, dropna=False)["decided"].max()
        found = once(pd.concat([once(f[side].assign(decided=f["kind"] == "decided")) for f in rows]))
        yield self._told(found.loc[found["decided"], side], "decided")
        if (found["window_us"].isna() & ~found["decided"]).any():
            raise ValueError("a pending window has no end")
        for window, part in found.groupby("window_us"):
            window = int(window)
            held = self.held.getValue((window,)) if self.held.containsKey((window,)) else None
            waits = part.loc[~part["decided"], ["entity_ip"]].assign(due_ms=max((window + self.expiry_us) // 1000, now + 1))
            if held is not None:
                before = unpacked(held[0]).to_pandas()
                hosts, named = before["entity_ip"], part["entity_ip"]
                again = hosts.isin(named.dropna()) | (hosts.isna() & named.isna().any())
                waits = pd.concat([before[~again], waits])
            elif not len(waits):
                continue
            self._put(window, waits)
            for due in waits["due_ms"].unique():
                self.handle.registerTimer(int(due) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        # the first timer of a batch finds all that has run out
        for window in [w for (w,) in self.held.keys() if (w + self.expiry_us) // 1000 < now]:
            waits = unpacked(self.held.getValue((window,))[0]).to_pandas()
            over = waits["due_ms"] < now
            if over.any():
                self._put(window, waits[~over])
                yield self._told(waits.loc[over, ["entity_ip"]].assign(window_us=window), "pcap_incompleto")

    def _put(self, window: int, waits: pd.DataFrame) -> None:
        if len(waits):
            self.held.updateValue((window,), (packed(pa.Table.from_pandas(waits, schema=_WAITS, preserve_index=False)),))
        else:
            self.held.removeKey((window,))

    def _told(self, windows: pd.DataFrame, outcome: str) -> pd.DataFrame:
        return windows.assign(outcome=outcome)

    def close(self) -> None:
        pass


_WAITS = pa.schema([("entity_ip", pa.string()), ("due_ms", pa.int64())])


def pending_windows(marks: DataFrame, expiry_us: int, delay: str, shards: int = 64) -> DataFrame:
    """Outcome of every pending window: decided in time, or ``pcap_incompleto`` when its timer runs out.

    marks: entity_ip, window_us, kind (pending | decided), ts_us. The state is keyed by shards of windows, so that a call
    handles the marks of many windows and one timer ends all those that run out together.
    """
    store_on_disk(marks.sparkSession)
    x = marks.withColumn("at", F.timestamp_micros("ts_us")).withWatermark("at", delay)
    x = x.select("entity_ip", "window_us", "kind", "at", F.pmod(F.xxhash64("entity_ip", "window_us"), F.lit(shards)).alias("shard"))
    return x.groupBy("shard").transformWithStateInPandas(_Pending(expiry_us), "entity_ip string, window_us long, outcome string", "Append", "EventTime")


_ACTIONS = pa.schema([("cell", pa.int64()), *[(c, pa.string()) for c in ("entity_ip", "target", "scope", "action", "event_id")], *[(c, pa.int64()) for c in ("t_us", "from_us", "to_us")]])
_PASTS = pa.schema([("entity_ip", pa.string()), ("target", pa.string()), ("due_ms", pa.int64()), ("past", pa.string())])
_TOLD = ["event_id", "state", "in_force", "until_us", "level"]


class _Measures(StatefulProcessor):
    """The measures in force and the ladders of a shard of (address, target), packed in cells of which a batch rewrites those it meets."""

    def __init__(self, second_us: int):
        self.second_us, self.keep_us = second_us, (DECAY_S + MAX_EXPIRY_S) * second_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "cell long", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        table = pa.concat_tables([pa.Table.from_pandas(f[_ACTIONS.names], schema=_ACTIONS, preserve_index=False) for f in rows])
        table = table.sort_by([(c, "ascending") for c in ("cell", "entity_ip", "target", "t_us", "event_id")])
        cells = table["cell"].to_numpy()
        starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])).tolist()
        out, last = [], now
        for a, b in zip(starts, [*starts[1:], len(cells)]):
            cell = int(cells[a])
            pasts = self._read(cell, now)
            out += self._fold(table.slice(a, b - a), pasts, now)
            last = max(last, *(due for due, _ in pasts.values()))
            self._write(cell, pasts)
        # batches of about the same time share a timer
        grid = self.keep_us // 8_000 + 1
        self.handle.registerTimer((last // grid + 1) * grid)
        yield pd.DataFrame(out, columns=_TOLD)

    def _fold(self, rows: pa.Table, pasts: dict, now_ms: int) -> list[tuple]:
        """The rows of a cell in the order of (address, target), time and event: those that bring a new or a more severe measure."""
        out, at, newest = [], None, None

        def leave() -> None:
            if at is not None:
                due = max((newest + self.keep_us) // 1000, now_ms + 1)
                pasts[at] = (due, {"force": force, "ladder": ladder})

        instants = [pc.fill_null(rows.column(c), np.iinfo(np.int64).min).to_pylist() for c in ("t_us", "from_us", "to_us")]
        for ip, target, scope, action, event, t, begin, end in zip(*(rows.column(c).to_pylist() for c in ("entity_ip", "target", "scope", "action", "event_id")), *instants):
            if (ip, target) != at:
                leave()
                at, newest = (ip, target), t
                past = pasts[at][1] if at in pasts else NO_PAST
                force, ladder = dict(past["force"]), past["ladder"]
            newest = max(newest, t)
            if scope is None:
                continue
            is_block = action == "BLOCK"
            was, until, proved = force.get(scope, (None, t, begin))
            if t >= until or is_block > was or (is_block == was and begin >= proved):
                (state, in_force, lasts, level, _), ladder = change(force, ladder, scope, t, is_block, end, self.second_us)
                if state != "renovada":
                    out.append((event, state, in_force, lasts, level))
        leave()
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for (cell,) in list(self.held.keys()):
            self._write(cell, self._read(cell, now))
        yield pd.DataFrame([], columns=_TOLD)

    def _read(self, cell: int, now_ms: int) -> dict:
        """(address, target) -> (due, past) of those that have not decayed: nothing of the others is in force, and their ladder begins anew."""
        if not self.held.containsKey((cell,)):
            return {}
        columns = unpacked(self.held.getValue((cell,))[0]).to_pydict()
        return {(ip, target): (due, json.loads(past)) for ip, target, due, past in zip(*columns.values()) if due >= now_ms}

    def _write(self, cell: int, pasts: dict) -> None:
        if pasts:
            rows = [(*key, due, json.dumps(past)) for key, (due, past) in pasts.items()]
            self.held.updateValue((cell,), (packed(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _PASTS)], schema=_PASTS)),))
        elif self.held.containsKey((cell,)):
            self.held.removeKey((cell,))

    def close(self) -> None:
        pass


def stream_actions(actions: DataFrame, second_us: int, delay: str, shards: int = 64, cells: int = 64) -> DataFrame:
    """New and escalated measures as decisions arrive (the rest only moves the state).

    The same fold as the batch form, from the measures in force and the ladder kept as state; state that has decayed is dropped
    by an event-time timer. The state is keyed by shards of (address, target), and a shard's histories are packed in cells.
    """
    store_on_disk(actions.sparkSession)
    x = actions.withColumn("at", F.timestamp_micros("t_us")).withWatermark("at", delay)
    place = F.pmod(F.xxhash64("entity_ip", "target"), F.lit(shards * cells))
    x = x.select("at", *[c for c in _ACTIONS.names if c != "cell"], (place % shards).alias("shard"), F.floor(place / shards).alias("cell"))
    return x.groupBy("shard").transformWithStateInPandas(_Measures(second_us), "event_id string, state string, in_force string, until_us long, level int", "Append", "EventTime")


def sessions(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """Sessions of each source, emitted once the watermark has passed their end."""
    x = events.withColumn("at", F.timestamp_micros("ts_us")).withWatermark("at", delay)
    g = x.groupBy(F.session_window("at", gap), "src_ip").agg(F.count(F.lit(1)).alias("events"))
    return g.select("src_ip", F.unix_micros("session_window.start").alias("from_us"), F.unix_micros("session_window.end").alias("end_us"), "events")


def tail_view(records: DataFrame, cursor: tuple[int, int], rows: int, ts: str = "ts_us", tie: str = "arrival") -> DataFrame:
    """The next records after a cursor, oldest first, at most ``rows`` (the page size)."""
    after = (F.col(ts) > cursor[0]) | ((F.col(ts) == cursor[0]) & (F.col(tie) > cursor[1]))
    return records.where(after).orderBy(ts, tie).limit(rows)


def to_table(df: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """An append stream into Parquet, by ``trigger`` (default: everything available, then stop)."""
    w = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return w.trigger(**(trigger or {"availableNow": True})).start()


def run_to_table(df: DataFrame, out: str, checkpoint: str) -> None:
    """Run an append stream over everything available into Parquet."""
    to_table(df, out, checkpoint).awaitTermination()
