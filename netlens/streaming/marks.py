"""How far a stream has decided, in one small file a batch; a repeated batch does not see its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def numbers(spark: SparkSession, path: str, prefix: str = "epoch=") -> list[int]:
    """The numbers of the folders ``prefix`` + number in a folder."""
    fs, p = _folder(spark, path)
    return sorted(int(s.getPath().getName().removeprefix(prefix)) for s in fs.listStatus(p) if s.getPath().getName().startswith(prefix)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _folder(spark, path)
    fs.delete(p, True)


def marked(spark: SparkSession, out: str, epoch: int) -> int | None:
    """The mark of the last batch before this one."""
    before = [n for n in numbers(spark, f"{out}/progress") if n < epoch]
    return spark.read.schema("mark long").json(f"{out}/progress/epoch={before[-1]}").first()[0] if before else None


def mark(spark: SparkSession, out: str, epoch: int, value: int) -> None:
    """Write a batch's mark; only the last two stay, as a batch before the last is never repeated."""
    spark.createDataFrame([(value,)], "mark long").coalesce(1).write.mode("overwrite").json(f"{out}/progress/epoch={epoch}")
    for old in numbers(spark, f"{out}/progress")[:-2]:
        delete(spark, f"{out}/progress/epoch={old}")
