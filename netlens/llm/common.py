"""What the corpus operators share: word and line splitting, mergeable sketches, ranks, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: A word: a run without blanks (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession) -> str:
    """A new folder under the shared one that the session names in ``spark.checkpoint.dir``.

    Only a session on one machine that names none (tests) gets a temporary folder; a cluster
    without a shared folder is an error, as its executors could not read each other's files.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corpus-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/corpus-{uuid.uuid4().hex}"


def stash(df: DataFrame) -> DataFrame:
    """Write an intermediate to the shared folder and read it back: it cuts lineage and is computed once."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Remove a stashed table that nothing reads any more."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """The words of a text, none for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1), F.array().cast("array<string>"))


class Places(dict):
    """word -> its place among the words met so far."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def in_groups(df: DataFrame, keys: Sequence[str], handle: Callable[[pa.Table], Sequence[Sequence]], schema: pa.Schema, ddl: str) -> DataFrame:
    """``handle`` on the rows of each key, a table of whole-number keys with groups of bounded size.

    It returns columns in the order of ``schema``. Groups come one after another in sorted partitions,
    so that many small ones cost little.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def results(groups: list[pa.Table]) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in schema]
            for g in groups:
                for col, new in zip(cols, handle(g)):
                    col.extend(new)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            k = np.stack([t.column(c).to_numpy() for c in keys])
            ends = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
            starts = np.append(0, ends)
            rest = t.slice(int(starts[-1]))
            yield results([t.slice(int(a), int(b - a)) for a, b in zip(starts, ends)])
        if rest is not None:
            yield results([rest])

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ddl)


# --- mergeable quantile sketch ------------------------------------------------------

def cell_of(x: Column) -> Column:
    """Cell of a whole number >= 0 in a log-linear sketch: 16 cells an octave, so a relative error of 1/16 at most.

    Counts per cell merge by addition, in any order and with the same result.
    """
    shift = (F.length(F.bin(x)) - 5).cast("int")
    return F.when(x < 16, x).otherwise(shift * 16 + F.call_function("shiftright", x, shift)).cast("int")


def cell_floor(cell: Column) -> Column:
    """The smallest number of a cell."""
    shift = (F.floor(cell / 16) - 1).cast("int")
    return F.when(cell < 16, cell.cast("long")).otherwise(F.call_function("shiftleft", (cell - shift * 16).cast("long"), shift))


# --- ranks --------------------------------------------------------------------------

def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rank from 0 over the whole table, without one task for all rows.

    Rows are dealt out by range; a range is ranked by itself and shifted by the rows before it.
    ``order`` must be total, else equal rows get their ranks in any order.
    """
    cut = stash(df.orderBy(*order).withColumn("_pid", F.spark_partition_id()))
    sizes = cut.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).drop("_n")
    inner = F.row_number().over(Window.partitionBy("_pid").orderBy(*order)) - 1
    return cut.withColumn("_in", inner).join(before, "_pid").withColumn(name, F.col("_before") + F.col("_in")).drop("_pid", "_in", "_before")


# --- components ---------------------------------------------------------------------

def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge to another.

    Alternates large and small stars: each round points neighbours at the smallest node known,
    and ends when a round changes nothing; rounds grow with the logarithm of the longest path.
    A node's neighbours are never gathered: each step is a minimum by key and an equi-join, and
    the adaptive skew join splits the rows of a hub. Each round is a table in the shared folder.
    """
    spark = edges.sparkSession
    now = stash(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )

    def digest(t: DataFrame):
        return tuple(t.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    seen = digest(now)
    while seen[0]:
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stash(small.union(low2.select("u", F.col("m").alias("v"))).distinct())
        stamp = digest(new)
        discard(spark, now)
        now = new
        if stamp == seen:
            break
        seen = stamp
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
