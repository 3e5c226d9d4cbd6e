"""Many rows as one value of keyed state."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession

#: State needs a store that keeps it on disk; large states must not live in the executors' heap.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def store_on_disk(spark: SparkSession) -> None:
    """Streams of the session keep state in ``STORE``, whose buffers all partitions of an executor share."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "200")


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(cell: bytes) -> pa.Table:
    return pa.ipc.open_stream(cell).read_all()
