"""Replayed tables: a batch is a whole stretch of time however many files hold it, and batches without rows end no stream."""

from netlens.operators import features as FT
from netlens.plans import q_streaming as Q
from netlens.streaming import live as L, windows as W
from test_features import APP, BASE, SCHEMA, SEC
from test_live_windows import NAMES, traffic


def test_a_batch_holds_a_whole_stretch_of_several_files(spark, tmp_path):
    rows = [(t * 37 % 900, t) for t in range(900)] + [(2_700, 900)]  # the middle stretch is empty, the last has one row
    seen = {}
    stream = Q.replay(spark, spark.createDataFrame(rows, "ts_us long, k long").repartition(5), "ts_us", file_rows=100)
    stream.writeStream.foreachBatch(lambda b, epoch: seen.update({epoch: sorted(r.ts_us for r in b.collect())})).trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "check")).start().awaitTermination()
    assert [seen[i] for i in sorted(seen)] == [list(range(900)), [], [2_700]]


def test_batches_without_rows_decide_nothing_and_lose_nothing(spark, tmp_path):
    packets, folder, out = traffic(4), str(tmp_path / "in"), str(tmp_path / "out")
    half = len(packets) // 2
    for part in (packets[:half], [], [], packets[half:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    app = spark.createDataFrame([(BASE + t * SEC, t, "10.10.0.1", "http", 200, "GET", "", "", "") for t in range(5, 230, 7)], APP)
    stream = L.closed_file_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema, 1)
    events = lambda lo, hi: app.where((app.ts_us > lo) & (app.ts_us <= hi))
    W.stream_features(stream, events, out, str(tmp_path / "check"), "10.10.0.0/16", 10 * SEC, 7, NAMES, shards=2, trigger={"availableNow": True}).awaitTermination()
    first, last = -(-packets[0]["ts_us"] // (10 * SEC)), (packets[-1]["ts_us"] - 5_000) // (10 * SEC)
    batch = FT.features_at_horizon(spark.createDataFrame(packets, SCHEMA), app, "10.10.0.0/16", 10 * SEC, 7, NAMES)
    got = [tuple(r) for r in spark.read.parquet(f"{out}/rows").drop("epoch").collect()]
    assert len(got) == len(set(got)) and set(got) == {tuple(r) for r in batch.where(f"anchor between {first} and {last}").collect()}
