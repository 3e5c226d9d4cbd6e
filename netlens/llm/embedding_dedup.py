"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors at cosine c are sqrt(2 - 2c) apart. After a rotation into blocks of few dimensions, two of
them within that distance are, in at least one block, within their share of the squared distance. So the
pairs within the share in some block hold all links, and each of them is then verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netlens.llm.common import components, in_groups, stash

_RULED = "uid long, blk int, c0 long, c1 long, home boolean, data binary"
_CELL = pa.schema([("uid", pa.int64()), ("blk", pa.int32()), ("c0", pa.int64()), ("c1", pa.int64()), ("home", pa.bool_()), ("data", pa.binary())])
_OUT = pa.schema([("uid", pa.int64()), ("links", pa.int64()), ("low", pa.int64())])
#: Rotated coordinates are whole multiples of 2^-20, so that sums of their squares are exact in any order.
SCALE = 2.0**20


@cache
def _rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _rotated(unit: np.ndarray) -> np.ndarray:
    return np.rint(unit @ _rotation(unit.shape[1]) * SCALE)


def _blocks(dim: int, width: int) -> list[slice]:
    return [slice(a, min(a + width, dim)) for a in range(0, dim, width)]


def _budget(dim: int, cosine: float) -> float:
    """Squared distance a dimension, in units of the grid; the last term pays for rounding."""
    return (2 - 2 * cosine) * (1 + 1e-9) * SCALE**2 / dim + 8 * SCALE * np.sqrt((2 - 2 * cosine) / dim) + 4


def _cells(batches: Iterator[pa.RecordBatch], width: int, cosine: float) -> Iterator[pa.RecordBatch]:
    """For each block: the vector's own cell, and the cells that a vector within its budget can have.

    Cells are squares over the block's first two coordinates, twice as wide as the block's radius.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            uids, rows = part.column(0).to_pylist(), part.column(1).to_pylist()
            by_dim: dict[int, list[int]] = {}
            for i, r in enumerate(rows):
                by_dim.setdefault(len(r) // 8, []).append(i)
            out: list[tuple] = []
            for dim, members in by_dim.items():
                y = _rotated(_unit(np.stack([np.frombuffer(rows[i], np.float64) for i in members])))
                for b, s in enumerate(_blocks(dim, width)):
                    radius = np.sqrt(_budget(dim, cosine) * (s.stop - s.start))
                    z = y[:, s][:, :2]
                    z = np.pad(z, ((0, 0), (0, 2 - z.shape[1])))
                    own, lo, hi = (np.floor(v / (2 * radius)).astype(np.int64) for v in (z, z - radius, z + radius))
                    for k, i in enumerate(members):
                        out.append((uids[i], b, *own[k].tolist(), True, rows[i]))
                        near = product(*[range(lo[k, d], hi[k, d] + 1) for d in (0, 1)])
                        out += [(uids[i], b, *c, False, rows[i]) for c in near]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _CELL)], schema=_CELL)


def _compare(width: int, cosine: float):
    def handle(g: pa.Table) -> list[list]:
        """Links of each home vector: weighed number, and the smallest id its local component has.

        A pair counts in the first block that has it within its share, and only there.
        """
        home = g.column("home").to_numpy(zero_copy_only=False)
        uid, mult, node, block = (g.column(c).to_numpy() for c in ("uid", "mult", "node", "blk"))
        x = _unit(np.stack([np.frombuffer(r, np.float64) for r in g.column("data").to_pylist()]))
        y = _rotated(x)
        h, r = np.flatnonzero(home), np.flatnonzero(~home)
        if not len(h) or not len(r):
            return [[], [], []]
        dim, b = x.shape[1], int(block[0])
        parts = _blocks(dim, width)

        def within(k: int, i: np.ndarray) -> np.ndarray:
            s = parts[k]
            p, q = y[i, s], y[r, s]
            d = (p * p).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None] - 2 * (p @ q.T)
            return d <= _budget(dim, cosine) * (s.stop - s.start)

        links = np.zeros(len(h), np.int64)
        linked = np.zeros((len(h), len(r)), bool)
        for at in range(0, len(h), 256):
            i = h[at : at + 256]
            ok = within(b, i)
            if not ok.any():
                continue
            ok &= (x[i] @ x[r].T >= cosine) & (uid[i][:, None] != uid[r][None])
            if ok.any():
                linked[at : at + 256] = ok
                first = ok.copy()
                for k in range(b):
                    first &= ~within(k, i)
                links[at : at + 256] = first @ mult[r]
        low_h, low_r = node[h].copy(), node[r].copy()
        busy = linked.any()
        while busy:
            new_h = np.minimum(low_h, np.where(linked, low_r[None], np.iinfo(np.int64).max).min(axis=1))
            new_r = np.minimum(low_r, np.where(linked, new_h[:, None], np.iinfo(np.int64).max).min(axis=0))
            busy = (new_h != low_h).any() or (new_r != low_r).any()
            low_h, low_r = new_h, new_r
        out_h, out_r = (links > 0) | (low_h != node[h]), low_r != node[r]
        return [
            [*uid[h][out_h].tolist(), *uid[r][out_r].tolist()],
            [*links[out_h].tolist(), *[0] * int(out_r.sum())],
            [*low_h[out_h].tolist(), *low_r[out_r].tolist()],
        ]

    return handle


def near_duplicate_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.98, width: int = 8, chunk: int = 1024,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; rows of one label link at ``cosine`` or more.

    Equal vectors of a label are one class and are compared once, with their number as weight. Classes
    meet in the cells of each block; a cell's rows are dealt to chunks of bounded size, and all pairs of
    chunks are compared, each in a task that returns a count and the smallest linked id a vector, no pairs.

    Vectors that are null, empty, zero, or hold null or non-finite numbers, rows with a null label and rows with a
    null vec_id link with nothing: no links, their own id as component, kept. Vectors of different length do not
    link. Repeated ids count as different vectors and share a node. Other columns are not read.
    """
    x = F.transform(F.col(embedding), lambda v: v.cast("double"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    usable = F.col("x").isNotNull() & F.forall("x", finite) & F.exists("x", lambda v: v != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), x.alias("x")).withColumn("usable", F.coalesce(usable, F.lit(False)))
    # adding 0.0 makes -0.0 equal to 0.0
    rows = stash(rows.select("vec_id", "label", "usable", F.when(F.col("usable"), F.transform("x", lambda v: v + 0.0)).alias("x")))
    good = rows.where("usable")
    classes = stash(good.groupBy("label", "x").agg(F.count(F.lit(1)).alias("mult"), F.min("vec_id").alias("node")).withColumn("uid", F.monotonically_increasing_id()))
    packed = classes.select("uid", "x").mapInArrow(_pack, "uid long, data binary")
    cells = stash(packed.mapInArrow(lambda it: _cells(it, width, cosine), _RULED).join(classes.select("uid", "label", "mult", "node", F.size("x").alias("dim")), "uid"))
    cell = ["label", "dim", "blk", "c0", "c1"]
    sizes = cells.groupBy(*cell).agg(
        F.ceil(F.count_if("home") / chunk).cast("int").alias("hs"), F.ceil(F.count_if(~F.col("home")) / chunk).cast("int").alias("rs")).where("hs > 0 and rs > 0")
    sizes = stash(sizes.withColumn("cell", F.monotonically_increasing_id()))
    dealt = cells.join(sizes, cell)
    mine = lambda n: F.pmod(F.xxhash64("uid"), F.col(n).cast("long")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = dealt.withColumn("i", F.explode(F.when(F.col("home"), F.array(mine("hs"))).otherwise(every("hs"))))
    dealt = dealt.withColumn("j", F.explode(F.when(F.col("home"), every("rs")).otherwise(F.array(mine("rs")))))
    dealt = dealt.select("cell", "i", "j", "blk", "home", "uid", "mult", "node", "data")
    found = stash(in_groups(dealt, ["cell", "i", "j"], _compare(width, cosine), _OUT, "uid long, links long, low long"))
    counts = found.groupBy("uid").agg(F.sum("links").alias("links"))
    edges = found.join(classes.select("uid", "node"), "uid").select(F.col("node").alias("a"), F.col("low").alias("b"))
    # equal vectors link under whatever id
    same = good.join(classes.where("mult > 1"), ["label", "x"]).select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    comp = stash(components(edges.union(same)))
    linked = stash(
        classes.join(counts, "uid", "left").select(F.col("label").alias("_label"), F.col("x").alias("_x"), (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n"))
    )
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("node"))
    joined = good.join(linked, (F.col("label") == F.col("_label")) & (F.col("x") == F.col("_x")))
    out = joined.select("vec_id", F.col("n").alias("n_links"), F.col("vec_id").alias("node")).join(comp, "node", "left")
    component = F.coalesce("component", "vec_id")
    out = out.select("vec_id", "n_links", component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
    return out.union(alone.select("vec_id", "n_links", F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = [np.array(v, np.float64).tobytes() for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["uid", "data"])
