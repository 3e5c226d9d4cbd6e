"""Exclusion ranges ``IP@start/end`` ('*' = any address, both ends inclusive)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netlens.functions.columns import parse_ts_us
from netlens.operators.core import MINUTE, point_in_interval

_SHAPE = r"^([^@]+)@([^/]+)/(.+)$"


def parse_ranges(texts: DataFrame, column: str = "text") -> DataFrame:
    """Text ranges as (ip, lo_us, hi_us); a malformed or reversed range fails the job."""
    c = F.col(column)
    lo = parse_ts_us(F.regexp_extract(c, _SHAPE, 2))
    hi = parse_ts_us(F.regexp_extract(c, _SHAPE, 3))
    good = c.rlike(_SHAPE) & lo.isNotNull() & hi.isNotNull() & (lo <= hi)
    bad = F.raise_error(F.concat(F.lit("malformed exclusion range: "), c)).cast("long")
    return texts.select(
        F.regexp_extract(c, _SHAPE, 1).alias("ip"), F.when(good, lo).otherwise(bad).alias("lo_us"), hi.alias("hi_us")
    )


def _matches(rows: DataFrame, ranges: DataFrame, ip: str, ts: str, how: str, width_us: int) -> DataFrame:
    """Rows inside (or outside) the ranges: named addresses first, then the '*' ranges.

    The '*' ranges join on the time cell alone, so no row meets a range far from it.
    """
    named = ranges.where("ip <> '*'").withColumnRenamed("ip", ip).dropDuplicates()
    every = ranges.where("ip = '*'").drop("ip").dropDuplicates()
    if how == "left_anti":
        step = point_in_interval(rows, named, [ip], ts, "lo_us", "hi_us", how, width_us)
        return point_in_interval(step, every, [], ts, "lo_us", "hi_us", how, width_us)
    hit = point_in_interval(rows, named, [ip], ts, "lo_us", "hi_us", "left_semi", width_us)
    rest = point_in_interval(rows, named, [ip], ts, "lo_us", "hi_us", "left_anti", width_us)
    return hit.unionByName(point_in_interval(rest, every, [], ts, "lo_us", "hi_us", "left_semi", width_us))


def exclude_ranges(rows: DataFrame, ranges: DataFrame, ip: str, ts: str, width_us: int = 60 * MINUTE) -> DataFrame:
    return _matches(rows, ranges, ip, ts, "left_anti", width_us)


def mark_ineligible(rows: DataFrame, ranges: DataFrame, ip: str, ts: str, width_us: int = 60 * MINUTE):
    """Clear ``eligible`` on excluded rows; also how many flipped per partition."""
    inside = _matches(rows, ranges, ip, ts, "left_semi", width_us)
    flipped = inside.where("eligible").groupBy("partition").agg(F.count(F.lit(1)).alias("flipped"))
    outside = exclude_ranges(rows, ranges, ip, ts, width_us)
    return outside.unionByName(inside.withColumn("eligible", F.lit(False))), flipped
