"""Capture files as a splittable source: ranges of bytes are partitions, and no file is held whole.

A record header carries no mark, so a range finds its first record by following a chain of plausible headers from
further back than the longest record reaches; near the beginning of a file it starts at the first record.
``torn_ranges`` compares where ranges end and begin.
"""

from __future__ import annotations

import struct
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from netlens.operators.core import scan
from netlens.sources.pcap import ETHERNET, MAGICS

HEADER, RECORD = 24, 16
#: ``arrival`` orders records by file, then by place: the number of the file above this many bits of its byte offset.
PLACE_BITS = 40
SCHEMA = "file string, arrival long, ts_us long, frame binary, error string"
_TYPE = pa.schema([("file", pa.string()), ("arrival", pa.int64()), ("ts_us", pa.int64()), ("frame", pa.binary()), ("error", pa.string())])
_ROWS, _BYTES, _READ = 4096, 4 << 20, 1 << 20
#: The opening of a range counts as so many bytes of what a task reads.
_OPEN = 64 << 10
#: Frames are not longer than this (the tools' own limit).
LONGEST = 262_144
YEAR_S = 366 * 86_400


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a folder by name, or of one file; hidden files are left out."""
    store, place = filesystem(path)
    info = store.get_file_info(place)
    found = store.get_file_info(fs.FileSelector(place)) if info.type == fs.FileType.Directory else [info]
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


class Range(InputPartition):
    """Records whose headers begin in [start, stop) of a file."""

    def __init__(self, root: str, path: str, number: int, start: int, stop: int, size: int):
        self.root, self.path, self.number, self.start, self.stop, self.size = root, path, number, start, stop, size


class Ranges(InputPartition):
    """Ranges that one task reads one after another."""

    def __init__(self, parts: list[Range]):
        self.parts = parts


def together(parts: list[Range], task_bytes: int) -> list[Ranges]:
    """Ranges in their order, as many to a task as hold about ``task_bytes``, an opened file counted as some more."""
    out: list[list[Range]] = []
    held = 0
    for part in parts:
        cost = part.stop - part.start + _OPEN
        if not out or held + cost > task_bytes:
            out.append([])
            held = 0
        out[-1].append(part)
        held += cost
    return [Ranges(p) for p in out]


def ranges(root: str, files: list[tuple[str, int]], split: int, first: int = 0) -> list[Range]:
    return [
        Range(root, path, first + i, at, min(at + split, size), size)
        for i, (path, size) in enumerate(files) for at in range(0, max(size, 1), split)
    ]


def first_record(data: bytes, at: int, start: int, size: int, order: str, per_us: int, longest: int, clock: int) -> int | None:
    """Place of the first record from ``start`` on; ``data`` is the file from ``at`` = start - 2 * (longest + 16) on.

    The earliest chain of plausible headers that reaches ``start`` is followed. One that begins inside a frame has to meet
    that frame's end to go on, and no frame is longer than ``longest``, so at ``start`` the chain is that of the file. Instants
    within a year of ``clock``, the file's first, tell headers from other fields.
    """
    n = min(longest + RECORD, len(data))
    raw = np.append(np.frombuffer(data, np.uint8), np.zeros(RECORD, np.uint8)).astype(np.int64)
    scale = [1, 1 << 8, 1 << 16, 1 << 24][:: 1 if order == "<" else -1]
    seconds, fraction, held, sent = (sum(raw[w + k : w + k + n] * f for k, f in enumerate(scale)) for w in (0, 4, 8, 12))
    header = struct.Struct(f"{order}IIII")
    for begin in np.flatnonzero((abs(seconds - clock) <= YEAR_S) & (fraction < 1_000_000 * per_us) & (held <= longest) & (held <= sent)).tolist():
        place, records = begin, 0
        while at + place < start:
            if place + RECORD > len(data):
                break
            s, f, h, o = header.unpack_from(data, place)
            if not (abs(s - clock) <= YEAR_S and f < 1_000_000 * per_us and h <= longest and h <= o):
                break
            if at + place + RECORD + h > size:  # the last record of a file that was cut short
                if records > 3:
                    return None
                break
            place, records = place + RECORD + h, records + 1
        else:
            return at + place
    return None


def read_together(parts: list[Range], fail: bool, longest: int = LONGEST) -> Iterator[pa.RecordBatch]:
    """Frames of ranges one after another; a range that begins where the one before stops goes on from its last record."""
    before, at = None, None
    for part in parts:
        goes_on = before is not None and (part.path, part.start) == (before.path, before.stop)
        at = yield from read_range(part, fail, longest, at if goes_on else None)
        before = part


def read_range(part: Range, fail: bool, longest: int = LONGEST, begin: int | None = None) -> Generator[pa.RecordBatch, None, int | None]:
    """Frames of a range; damage at the file's end is a row with the reason, or an error.

    ``begin`` is the place of the first record, if known; it is looked for where no plausible header stands there. Returns
    the place of the first record after the range, None if the range did not come to its end.
    """
    store, _ = filesystem(part.root)
    rows: list[tuple] = []
    held = 0

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _TYPE)], schema=_TYPE)
        rows.clear()
        return out

    def damaged(reason: str) -> None:
        if fail:
            raise ValueError(f"{part.path}: {reason}")
        rows.append((part.path, None, None, None, reason))

    with store.open_input_file(part.path) as source:
        head = source.read_at(min(HEADER, part.size), 0)
        reason = "unsupported magic" if head[:4] not in MAGICS else "truncated header" if len(head) < HEADER else None
        if reason is None:
            order, per_us = MAGICS[head[:4]]
            reason = "not an Ethernet capture" if struct.unpack_from(f"{order}I", head, 20)[0] != ETHERNET else None
        if reason is not None:
            if part.start == 0:
                damaged(reason)
                yield batch()
            return None
        record = struct.Struct(f"{order}IIII")
        at, before = HEADER, part.start - 2 * (longest + RECORD)
        clock = struct.unpack(f"{order}I", source.read_at(4, HEADER))[0] if before > HEADER else 0
        if before > HEADER and begin is not None and begin + RECORD <= part.size:
            s, f, h, o = record.unpack(source.read_at(RECORD, begin))
            if not (abs(s - clock) <= YEAR_S and f < 1_000_000 * per_us and h <= longest and h <= o):
                begin = None
        if begin is not None:
            at = begin
        elif before > HEADER:
            probe = source.read_at(min(2 * (longest + RECORD) + RECORD, part.size - before), before)
            at = first_record(probe, before, part.start, part.size, order, per_us, longest, clock)
        elif part.start:  # near the beginning the records are followed from the first
            probe = source.read_at(min(part.start + RECORD, part.size), 0)
            while at < part.start and at + RECORD <= part.size:
                at += RECORD + record.unpack_from(probe, at)[2]
        if at is None:
            return None
        whole = True
        data, base = b"", at
        while at < part.stop:
            need = RECORD if len(data) - (at - base) < RECORD else RECORD + record.unpack_from(data, at - base)[2]
            if at - base + need > len(data):  # read on from the record at hand
                data, base = source.read_at(min(max(min(_READ, part.stop - at + RECORD), need), part.size - at), at), at
                if len(data) < RECORD:
                    damaged("truncated record header")
                    whole = False
                    break
                need = RECORD + record.unpack_from(data, 0)[2]
                if at + need > part.size:
                    damaged("truncated frame")
                    whole = False
                    break
                if need > len(data):
                    continue
            seconds, fraction, length, _ = record.unpack_from(data, at - base)
            frame = data[at - base + RECORD : at - base + RECORD + length]
            rows.append((part.path, part.number << PLACE_BITS | at, seconds * 1_000_000 + fraction // per_us, frame, None))
            at, held = at + RECORD + length, held + length
            if len(rows) == _ROWS or held > _BYTES:
                yield batch()
                held = 0
    if rows:
        yield batch()
    return at if whole else None


class _Files(DataSourceReader):
    def __init__(self, options):
        self.root, self.split, self.fail, self.longest = options["path"], int(options.get("split", 64 << 20)), options.get("on_error", "fail") == "fail", int(options.get("longest", LONGEST))
        self.task_bytes = int(options.get("task", self.split))

    def partitions(self):
        return together(ranges(self.root, listed(self.root), self.split), self.task_bytes)

    def read(self, partition):
        yield from read_together(partition.parts, self.fail, self.longest)


class _ClosedFiles(DataSourceStreamReader):
    """Files of a folder but the newest by name, which its producer may still be writing. An offset counts closed files."""

    def __init__(self, options):
        self.root, self.split, self.fail, self.longest = options["path"], int(options.get("split", 64 << 20)), options.get("on_error", "fail") == "fail", int(options.get("longest", LONGEST))
        self.task_bytes = int(options.get("task", self.split))

    def initialOffset(self):
        return {"files": 0}

    def latestOffset(self):
        return {"files": max(len(listed(self.root)) - 1, 0)}

    def partitions(self, start, end):
        return together(ranges(self.root, listed(self.root)[start["files"] : end["files"]], self.split, start["files"]), self.task_bytes)

    def read(self, partition):
        yield from read_together(partition.parts, self.fail, self.longest)


class CaptureSource(DataSource):
    """``spark.read.format("capture")``, options ``split``, ``task`` (one reads ranges together up to it, by default ``split``) and ``longest`` frame in bytes, ``on_error`` fail or count; as a stream, closed files in order."""

    @classmethod
    def name(cls):
        return "capture"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Files(self.options)

    def streamReader(self, schema):
        return _ClosedFiles(self.options)


def read_capture(spark: SparkSession, path: str, split: int = 64 << 20, on_error: str = "fail", longest: int = LONGEST, task: int | None = None) -> DataFrame:
    """Frames of the capture files of a folder (by name) or of one file: file, arrival, ts_us, frame, error.

    ``(ts_us, arrival)`` is the stable order of time, file and record; ``arrival`` is unique over all files.
    """
    spark.dataSource.register(CaptureSource)
    return spark.read.format("capture").option("split", split).option("on_error", on_error).option("longest", longest).option("task", task or split).load(path)


def stream_captures(spark: SparkSession, path: str, split: int = 64 << 20, on_error: str = "count") -> DataFrame:
    """The same frames as a stream of closed files; files are only added to the folder, in the order of their names."""
    spark.dataSource.register(CaptureSource)
    return spark.readStream.format("capture").option("split", split).option("on_error", on_error).load(path)


def numbered(frames: DataFrame, split: int = 64 << 20) -> DataFrame:
    """Frames with ``rec_no``, their number in the file from 0: counted per stretch of bytes and carried over."""
    x = scan(frames.where("frame is not null"), ["file"], ["arrival"], "arrival", split, {"rec_no": ("sum", F.lit(1).cast("long"), False)})
    return x.withColumn("rec_no", F.coalesce("rec_no", F.lit(0).cast("long")))


def torn_ranges(frames: DataFrame, split: int) -> DataFrame:
    """(file, arrival): first frames of a stretch that do not begin where the stretch before ends; none if all ranges are right."""
    place = F.col("arrival").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    x = frames.where("frame is not null").select("file", "arrival", place.alias("at"), (place + RECORD + F.length("frame")).alias("to"))
    edges = x.groupBy("file", F.floor(F.col("at") / split).alias("range")).agg(F.min("at").alias("at"), F.min("arrival").alias("arrival"), F.max("to").alias("to"))
    before = F.lag("to", 1, HEADER).over(Window.partitionBy("file").orderBy("range"))
    return edges.withColumn("before", before).where("at <> before").select("file", "arrival")


def write_files(files: DataFrame, folder: str) -> None:
    """Write (path, content) rows as files of a folder, from the executors."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = filesystem(folder)
        store.create_dir(place)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with store.open_output_stream(f"{place}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([b.column(0)], names=["path"])

    files.select("path", "content").mapInArrow(write, "path string").count()


def write_records(records: DataFrame, order: str, folder: str) -> None:
    """Write (path, ``order``, head, record) rows as files of a folder: a head, then the records that are not null, sorted.

    A task writes its files one after another as their rows come, so no file is held whole.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = filesystem(folder)
        store.create_dir(place)
        path, out = "", None
        try:
            for b in batches:
                paths = b.column(0).to_pylist()
                starts = [i for i, p in enumerate(paths) if i == 0 or p != paths[i - 1]]
                for i, j in zip(starts, [*starts[1:], len(paths)]):
                    if paths[i] != path:
                        if out is not None:
                            out.close()
                            yield pa.RecordBatch.from_arrays([pa.array([path], pa.string())], names=["path"])
                        path, out = paths[i], store.open_output_stream(f"{place}/{paths[i]}")
                        out.write(b.column(1)[i].as_py())
                    out.write(b"".join(b.column(2).slice(i, j - i).drop_null().to_pylist()))
        finally:
            if out is not None:
                out.close()
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.string())], names=["path"])

    x = records.repartition("path").sortWithinPartitions("path", order, "record")
    x.select("path", "head", "record").mapInArrow(write, "path string").count()
