"""Feature tables: contract-checked text files, idempotent accumulation, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from netlens.functions.columns import in_scope
from netlens.operators.learn import content_digest


def read_features_csv(spark: SparkSession, path: str, meta: list[str], names: list[str]) -> DataFrame:
    """A feature file whose header must match the contract name by name and in order."""
    header = spark.read.text(path).limit(1).first()  # one line
    want = [*meta, *names]
    got = header[0].split(",") if header else []
    if got != want:
        raise ValueError(f"header differs from the contract: {[p for p in zip(got, want) if p[0] != p[1]][:3] or (len(got), len(want))}")
    schema = ", ".join([f"{m} string" for m in meta] + [f"{n} double" for n in names])
    x = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    flags = [m for m in meta if m.startswith("eligible")]
    return x.withColumns({m: F.lower(m) == "true" for m in flags})


def write_features(df: DataFrame, path: str, meta: list[str], names: list[str], fmt: str = "parquet") -> None:
    """Contract columns in order. Text files carry eight decimals; Parquet is the main form."""
    cols = [F.col(m) for m in meta]
    if fmt == "csv":
        text = [F.when(F.col(m), "True").otherwise("False").alias(m) if dict(df.dtypes)[m] == "boolean" else F.col(m) for m in meta]
        df.select(*text, *[F.format_string("%.8f", F.col(n)).alias(n) for n in names]).write.option("header", True).csv(path)
    else:
        df.select(*cols, *names).write.parquet(path)


def accumulate(rows: DataFrame, existing: DataFrame, slice_bounds: tuple[int, int], head_us: int, tail_us: int, excluded: list[str]) -> DataFrame:
    """Rows of a slice that are new: margins cut, excluded networks out, known keys out."""
    lo, hi = slice_bounds
    x = rows.where((F.col("window_us") >= lo + head_us) & (F.col("window_us") <= hi - tail_us))
    x = x.where(~in_scope(F.col("entity_ip"), excluded)) if excluded else x
    return x.join(existing.select("entity_ip", "window_us"), ["entity_ip", "window_us"], "left_anti")


def write_lot(rows: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """Write a lot once and return its digest."""
    rows.select(*columns).write.parquet(path)
    return content_digest(rows, [], columns)
