"""Capture files as tables: one task per file, columns decoded in Arrow batches."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

FRAMES = "file string, rec_no long, ts_us long, frame binary, error string"
# Magic -> byte order and fraction units per microsecond.
MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
ETHERNET = 1
BATCH, BATCH_BYTES, PIECE = 4096, 4 << 20, 8192


class _Records:
    """Records of one file that arrives in pieces; a ValueError names what is wrong with it."""

    def __init__(self):
        self.left, self.head, self.per_us = b"", None, 1

    def feed(self, piece: bytes, last: bool) -> Iterator[tuple[int, bytes]]:
        """(instant in µs, frame) of the records that are whole by now; what is left waits for the next piece."""
        data, at = self.left + piece, 0
        if self.head is None:
            if data[:4] not in MAGICS and (last or len(data) >= 4):
                raise ValueError("unsupported magic")
            if len(data) < 24:
                if last:
                    raise ValueError("truncated header")
                self.left = data
                return
            order, self.per_us = MAGICS[data[:4]]
            if struct.unpack_from(f"{order}I", data, 20)[0] != ETHERNET:
                raise ValueError("not an Ethernet capture")
            self.head, at = struct.Struct(f"{order}IIII"), 24
        while at < len(data):
            if at + 16 > len(data):
                if last:
                    raise ValueError("truncated record header")
                break
            seconds, fraction, size, _ = self.head.unpack_from(data, at)
            if at + 16 + size > len(data):
                if last:
                    raise ValueError("truncated frame")
                break
            yield seconds * 1_000_000 + fraction // self.per_us, data[at + 16:at + 16 + size]
            at += 16 + size
        self.left = data[at:]


def frames_of(files: DataFrame, on_error: str = "fail") -> DataFrame:
    """Frames of (path, content) rows. ``count`` keeps the frames before the damage and adds
    an error row with the reason; ``fail`` fails the job.

    Contents go to Python in pieces of ``PIECE`` bytes, one after another, so a batch of rows stays small
    however large the files are.
    """
    schema = pa.schema([("file", pa.string()), ("rec_no", pa.int64()), ("ts_us", pa.int64()), ("frame", pa.binary()), ("error", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, n, rows, held = None, 0, [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for b in batches:
            places, lasts, pieces = b.column("place").to_pylist(), b.column("last").to_pylist(), b.column("piece")
            for path, place, last, piece in zip(b.column("path").to_pylist(), places, lasts, pieces):
                if place == 0:
                    records, n = _Records(), 0
                if records is None:  # the rest of a damaged file
                    continue
                try:
                    for ts, frame in records.feed(piece.as_py(), last):
                        rows.append((path, n, ts, frame, None))
                        n, held = n + 1, held + len(frame)
                        if len(rows) == BATCH or held > BATCH_BYTES:
                            yield batch()
                            rows, held = [], 0
                except ValueError as e:
                    if on_error == "fail":
                        raise ValueError(f"{path}: {e}") from e
                    rows.append((path, None, None, None, str(e)))
                    records = None
        if rows:
            yield batch()

    last = F.greatest(F.ceil(F.length("content") / PIECE) - 1, F.lit(0)).cast("int")
    cut = lambda i: F.struct(i.alias("place"), (i == last).alias("last"), F.substring("content", i * PIECE + 1, F.lit(PIECE)).alias("piece"))
    pieces = files.select("path", F.inline(F.transform(F.sequence(F.lit(0), F.coalesce(last, F.lit(0))), cut)))
    return pieces.mapInArrow(scan, FRAMES)


def read_frames(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    return frames_of(spark.read.format("binaryFile").load(path), on_error)


def unreadable(frames: DataFrame) -> DataFrame:
    """Files that could not be read to the end, counted by reason."""
    return frames.where("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("files"))


def file_inventory(frames: DataFrame) -> DataFrame:
    return frames.groupBy("file").agg(F.count("frame").alias("records"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.max("error").alias("error"))


# --- header decode ------------------------------------------------------------------------

class _Bytes:
    """Random access to the bytes of a binary column, for a whole batch at once."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, dtype=np.int64)[column.offset: column.offset + len(column) + 1]
        self.data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        self.start, self.size = ends[:-1], np.diff(ends)

    def u8(self, at) -> np.ndarray:
        pos = np.minimum(self.start + np.minimum(at, np.maximum(self.size - 1, 0)), len(self.data) - 1)
        return self.data[pos].astype(np.int64)

    def u16(self, at) -> np.ndarray:
        return self.u8(at) * 256 + self.u8(at + 1)

    def u32(self, at) -> np.ndarray:
        return self.u16(at) * 65536 + self.u16(at + 2)

    def ip(self, at) -> list[str]:
        return [".".join(map(str, o)) for o in np.stack([self.u8(at + i) for i in range(4)], axis=1)]

    def mac(self, at) -> list[str]:
        return [":".join(f"{v:02x}" for v in o) for o in np.stack([self.u8(at + i) for i in range(6)], axis=1)]


def _link(b: _Bytes):
    """Payload offset, ether type and outer VLAN after any number of tags; and what is usable."""
    at = np.full(len(b.size), 14, dtype=np.int64)
    ok = b.size >= 14
    kind, vlan = b.u16(np.full_like(at, 12)), np.zeros_like(at)
    while True:
        tagged = ok & np.isin(kind, (0x8100, 0x88A8))
        if not tagged.any():
            return at, kind, vlan, ok
        ok &= ~(tagged & (b.size < at + 4))
        tagged &= ok
        vlan = np.where(tagged & (vlan == 0), b.u16(at) & 0x0FFF, vlan)
        kind = np.where(tagged, b.u16(at + 2), kind)
        at = np.where(tagged, at + 4, at)


PACKETS = ("file string, rec_no long, ts_us long, src_ip string, dst_ip string, ip_length int, protocol int, ttl int, fragmented boolean, "
           "src_port int, dst_port int, tcp_flags int, tcp_seq long, tcp_payload_length int, icmp_type int, icmp_id int, vlan int, ip_id int")


def decode_packets(frames: DataFrame, place: str = "rec_no") -> DataFrame:
    """IPv4 headers of the frames: 14 packet columns, VLAN and IP id. Other frames are dropped.

    ``place`` is the column that orders frames of one instant: ``rec_no`` in a file, or ``arrival`` over all files.
    """
    columns = PACKETS.replace("rec_no", place)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            b = _Bytes(rb.column("frame"))
            at, kind, vlan, ok = _link(b)
            head = (b.u8(at) & 15) * 4
            ok = ok & (kind == 0x0800) & (b.size >= at + 20) & (b.u8(at) >> 4 == 4) & (head >= 20) & (b.size >= at + head)
            total, frag, proto = b.u16(at + 2), b.u16(at + 6), b.u8(at + 9)
            t = at + head
            tcp, udp, icmp = (proto == 6) & (b.size >= t + 20), (proto == 17) & (b.size >= t + 8), (proto == 1) & (b.size >= t + 8)
            z = lambda cond, v, other=0: np.where(cond, v, other)
            data = np.maximum(0, total - head - (b.u8(t + 12) >> 4) * 4)
            ints = [z(tcp | udp, b.u16(t)), z(tcp | udp, b.u16(t + 2)), z(tcp, b.u8(t + 13))]
            cols = [
                rb.column("file"), rb.column(place), rb.column("ts_us"), pa.array(b.ip(at + 12), pa.string()), pa.array(b.ip(at + 16), pa.string()),
                pa.array(total, pa.int32()), pa.array(proto, pa.int32()), pa.array(b.u8(at + 8), pa.int32()), pa.array((frag & 0x2000 > 0) | (frag & 0x1FFF > 0)),
                *[pa.array(v, pa.int32()) for v in ints], pa.array(z(tcp, b.u32(t + 4)), pa.int64()), pa.array(z(tcp, data), pa.int32()),
                pa.array(z(icmp, b.u8(t), -1), pa.int32()), pa.array(z(icmp, b.u16(t + 4)), pa.int32()), pa.array(vlan, pa.int32()), pa.array(b.u16(at + 4), pa.int32()),
            ]
            names = [f.split()[0] for f in columns.split(", ")]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(ok))

    return frames.where("frame is not null").select("file", place, "ts_us", "frame").mapInArrow(decode, columns)


def decode_packets_basic(frames: DataFrame) -> DataFrame:
    """The columns of the first contract: no TTL, sequence, payload or fragment."""
    return decode_packets(frames).select("file", "rec_no", "ts_us", "src_ip", "dst_ip", "ip_length", "protocol", "src_port", "dst_port", "tcp_flags")


L2 = "file string, rec_no long, ts_us long, vlan int, src_mac string, sender_ip string, arp_request boolean, protocol int"


def decode_l2(frames: DataFrame) -> DataFrame:
    """Sender of each IPv4 or ARP frame with its MAC and outer VLAN (protocol -1 = ARP)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            b = _Bytes(rb.column("frame"))
            at, kind, vlan, ok = _link(b)
            ip4 = ok & (kind == 0x0800) & (b.size >= at + 20) & (b.u8(at) >> 4 == 4)
            arp = ok & (kind == 0x0806) & (b.size >= at + 28) & (b.u16(at + 2) == 0x0800) & (b.u8(at + 4) == 6) & (b.u8(at + 5) == 4)
            cols = [
                rb.column("file"), rb.column("rec_no"), rb.column("ts_us"), pa.array(vlan, pa.int32()), pa.array(b.mac(np.full_like(at, 6)), pa.string()),
                pa.array(b.ip(np.where(arp, at + 14, at + 12)), pa.string()), pa.array(arp & (b.u16(at + 6) == 1)), pa.array(np.where(arp, -1, b.u8(at + 9)), pa.int32()),
            ]
            names = [f.split()[0] for f in L2.split(", ")]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(ip4 | arp))

    return frames.where("frame is not null").select("file", "rec_no", "ts_us", "frame").mapInArrow(decode, L2)


# --- slices ----------------------------------------------------------------------------------

def slice_frames(frames: DataFrame, t0_us: int, t1_us: int, margin_us: int = 0) -> DataFrame:
    """Frames in [t0 - margin, t1]; partitioned captures prune by their time column."""
    return frames.where((F.col("ts_us") >= t0_us - margin_us) & (F.col("ts_us") <= t1_us))


def slice_dns(packets: DataFrame, resolver: str, t0_us: int, t1_us: int, gap_us: int = 5_000) -> DataFrame:
    """Name-service packets to or from one resolver in a time slice, copies removed."""
    from netlens.operators.prep import dedup_tcp

    p = packets.where((F.col("ts_us") >= t0_us) & (F.col("ts_us") <= t1_us) & (F.col("protocol") == 17))
    p = p.where(((F.col("dst_ip") == resolver) & (F.col("dst_port") == 53)) | ((F.col("src_ip") == resolver) & (F.col("src_port") == 53)))
    return dedup_tcp(p, gap_us, keys=("src_ip", "dst_ip", "src_port", "dst_port", "ip_length", "ip_id"))


def closed_files(files: DataFrame, start: str = "start_us", max_age_us: int | None = None, now_us: int | None = None) -> DataFrame:
    """All files but the newest of each directory; optionally none older than the age limit."""
    newest = files.groupBy("directory").agg(F.max(start).alias("_newest"))
    x = files.join(newest, "directory").where(F.col(start) < F.col("_newest")).drop("_newest")
    return x if max_age_us is None else x.where(F.lit(now_us) - F.col(start) <= max_age_us)
