"""Queries N04 and W01-W12: recorded tables replayed through Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netlens.operators.core import materialize, remove, scratch_path
from netlens.plans import q_actions as QA, q_features as QF, q_scan as QS
from netlens.plans.adapt import DAY_US as D, SCOPE, SQL_VIEWS, STEP_US as S, sql, table, view
from netlens.plans.q_prep import H
from netlens.plans.registry import ORACLES, add, r6
from netlens.streaming import live as L, windows as W

CHUNKS = 3


def replay(s, df: DataFrame, ts: str, file_rows: int = 100_000) -> DataFrame:
    """The table as a stream of batches in time order.

    Files of one stretch of time hold instants in no order, so a stretch is one batch: each is written as the same number
    of files, those without rows included, and a batch reads as many. The table is computed once for all stretches.
    """
    path, df = scratch_path(s), materialize(df)
    lo, hi, rows = df.agg(F.min(ts), F.max(ts), F.count(ts)).first()
    width = (hi - lo) // CHUNKS + 1
    files = -(-rows // (CHUNKS * file_rows))
    for i in range(CHUNKS):
        part = df.where((F.col(ts) >= lo + i * width) & (F.col(ts) < lo + (i + 1) * width))
        part.repartition(files).write.mode("append").parquet(path)
        for _ in range((i + 1) * files - len(s.read.schema(df.schema).parquet(path).inputFiles())):
            s.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(path)
    remove(s, df)
    return L.closed_file_stream(s, path, df.schema, files)


def collected(s, stream: DataFrame) -> DataFrame:
    out, check = scratch_path(s), scratch_path(s)
    L.run_to_table(stream, out, check)
    return s.read.schema(stream.schema).parquet(out)


def n04(s, d):
    out, check = scratch_path(s), scratch_path(s)
    L.scan_stream(replay(s, table(s, d, "tcp"), "ts_us"), out, check, SCOPE, QS.K, QS.W, QS.G, QS.REF, 40 * D, QS.GAP, 4 * D).awaitTermination()
    return s.read.parquet(f"{out}/triggers").select("src_ip", "dst_ip", F.col("fail_us").alias("trigger_us"), "failed_ports", "attempt_id")


_f, _c = SQL_VIEWS["fails"][1], SQL_VIEWS["fcnt"][1]
view("failsc", "att", _f.replace("reply_us WHEN reply IS NULL", f"least(reply_us, syn_us+{QS.G}) WHEN reply IS NULL"))
view("fcntc", "failsc", _c.replace("fails a", "failsc a").replace("fails b", "failsc b"))
add("N04_scan_stream", n04, sql("fcntc", f"WITH RECURSIVE {QS.TRIG.replace('FROM fcnt', 'FROM fcntc')} SELECT src_ip, dst_ip, trigger_us, CAST(failed_ports AS INT) AS failed_ports, attempt_id FROM trig WHERE trigger_us <= (SELECT max(ts_us) FROM tcp)-{QS.G}"))


def streamed(s, d):
    app = table(s, d, "app")
    out, check = scratch_path(s), scratch_path(s)
    events = lambda lo, hi: app.where((F.col("ts_us") > lo) & (F.col("ts_us") <= hi))
    W.stream_features(replay(s, table(s, d, "packets"), "ts_us"), events, out, check, SCOPE, S, QF.H, QF.LIVE).awaitTermination()
    return s.read.parquet(f"{out}/rows").drop("epoch")


LAST = f"((SELECT max(ts_us) FROM packets)-5000)//{S}"
F37 = ORACLES["F37_live_horizon_rows"]
add("W01_stream_features", lambda s, d: r6(streamed(s, d).withColumn("flow_duration_mean_30s", QF.micros("flow_duration_mean_30s"))),
    F37[:F37.rindex("SELECT entity_ip, CAST(a AS BIGINT)")] + F37[F37.rindex("SELECT entity_ip, CAST(a AS BIGINT)"):] + f" WHERE a <= {LAST}")


def w02(s, d):
    p = table(s, d, "packets").select("ts_us", F.col("src_ip").alias("entity_ip"), "ip_length")
    return collected(s, L.bucket_counts(replay(s, p, "ts_us"), S, "1 day"))


add("W02_packet_watermark", w02, sql("packets", f"""SELECT src_ip AS entity_ip, CAST((ts_us+{S}-1)//{S} AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS packets, CAST(sum(ip_length) AS BIGINT) AS bytes FROM packets
 WHERE ((ts_us+{S}-1)//{S})*{S} <= ((SELECT max(ts_us) FROM packets)-1)//1000*1000-{D} GROUP BY 1, 2"""))
add("W03_decided_once", lambda s, d: collected(s, L.decided_once(replay(s, table(s, d, "dec").select("entity_ip", "window_us", "logged_us"), "logged_us"), "2 days").select("entity_ip", "window_us")),
    sql("dec", "SELECT DISTINCT entity_ip, window_us FROM dec"))


def w04(s, d):
    x = table(s, d, "dec").groupBy("entity_ip", "window_us").agg(F.min("logged_us").alias("first"), F.max("k").alias("k"))
    x = materialize(x)
    p = x.select("entity_ip", "window_us", F.lit("pending").alias("kind"), F.col("first").alias("ts_us"))
    q = x.where("k % 3 > 0").select("entity_ip", "window_us", F.lit("decided").alias("kind"), (F.col("window_us") + H).alias("ts_us"))
    y = collected(s, L.pending_windows(replay(s, p.unionByName(q), "ts_us"), 2 * D, "1 hour"))
    return y.groupBy("outcome").agg(F.count(F.lit(1)).alias("windows"))


add("W04_pending_expiry", w04, sql("dec", f"""WITH x AS (SELECT entity_ip, window_us, max(k) AS k, min(logged_us) AS f FROM dec GROUP BY 1, 2), m AS (SELECT greatest((SELECT max(f) FROM x), (SELECT max(window_us+{H}) FROM x WHERE k%3>0)) AS m)
SELECT 'decided' AS outcome, CAST(count(*) AS BIGINT) AS windows FROM x WHERE k%3>0 UNION ALL SELECT 'pcap_incompleto', CAST(count(*) AS BIGINT) FROM x, m WHERE k%3=0 AND (window_us+{2 * D})//1000 < m//1000-3600000 HAVING count(*)>0"""))


def w08(s, d):
    """Windows whose streamed row differs from the batch row of the same horizon."""
    batch = QF.FT.features_at_horizon(table(s, d, "packets"), table(s, d, "app"), SCOPE, S, QF.H, QF.LIVE)
    last = (table(s, d, "packets").agg(F.max("ts_us")).first()[0] - 5000) // S
    batch = batch.where(F.col("anchor") <= last)
    live = streamed(s, d).select(*batch.columns)
    # rows of one side count up, those of the other down, so that each side is computed once
    both = batch.withColumn("_n", F.lit(1)).unionByName(live.withColumn("_n", F.lit(-1)))
    left = both.groupBy(*batch.columns).agg(F.sum("_n").alias("_n"))
    total = lambda n: F.coalesce(F.sum(F.when(n > 0, n)), F.lit(0).cast("long"))
    return left.agg(total(F.col("_n")).alias("only_batch"), total(-F.col("_n")).alias("only_stream"))


add("W08_stream_equals_batch", w08, "SELECT CAST(0 AS BIGINT) AS only_batch, CAST(0 AS BIGINT) AS only_stream")
add("W09_sessions", lambda s, d: collected(s, L.sessions(replay(s, table(s, d, "http").select("src_ip", "ts_us"), "ts_us"), "12 hours", "1 day")), sql("http", f"""
WITH l AS (SELECT *, CASE WHEN ts_us-lag(ts_us) OVER w < {12 * H} THEN 0 ELSE 1 END AS n FROM http WINDOW w AS (PARTITION BY src_ip ORDER BY ts_us)), g AS (SELECT *, sum(n) OVER (PARTITION BY src_ip ORDER BY ts_us) AS i FROM l)
SELECT src_ip, min(ts_us) AS from_us, max(ts_us)+{12 * H} AS end_us, CAST(count(*) AS BIGINT) AS events FROM g GROUP BY src_ip, i HAVING max(ts_us)+{12 * H} <= (SELECT max(ts_us) FROM http)//1000*1000-{D}"""))


def w11(s, d):
    x = table(s, d, "packets")
    t = x.agg(F.min("ts_us")).first()[0] + 12 * D
    return L.tail_view(x, (t, 0), 300).select("arrival", "src_ip", "dst_ip")


add("W11_tail_view", w11, sql("packets", f"SELECT arrival, src_ip, dst_ip FROM packets WHERE ts_us >= (SELECT min(ts_us) FROM packets)+{12 * D} ORDER BY ts_us, arrival LIMIT 300"))
A08 = ORACLES["A08_apply_actions"]
add("W12_stream_actions",
    lambda s, d: collected(s, L.stream_actions(replay(s, QA.proposed(s, d).where("target is not null").select("entity_ip", "target", "scope", "action", "event_id", "t_us", "from_us", "to_us"), "t_us"), QA.UNIT, "1 hour")),
    A08[:A08.rindex("SELECT event_id, state")] + "SELECT event_id, state, act AS in_force, until_us, CAST(level AS INT) AS level FROM a WHERE state IN ('nueva','escalada')")
