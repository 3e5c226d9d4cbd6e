"""Near-duplicate documents by SetSketch registers: band them, estimate by likelihood, verify on full sets.

A register is the minimum of one random value per shingle, turned into an exponential variable and
truncated to a power of a base close to 1. Registers of a union are the maxima of the parts' registers,
so sketches merge; equal registers are as frequent as the sets are similar, so they can be banded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from netlens.llm.common import components, discard, in_groups, stash

BASE = 1.001
RATE = 20.0
REGISTERS = 128
_RNG = np.random.default_rng(20240229)
_FLIP = _RNG.integers(0, 2**64, REGISTERS, dtype=np.uint64)
_SPREAD = _RNG.integers(0, 2**64, REGISTERS, dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def bands_for(threshold: float, miss: float = 1e-6) -> tuple[int, int]:
    """(bands, rows a band): the longest rows at which a pair of that similarity is lost less often than ``miss``."""
    return next((REGISTERS // r, r) for r in range(16, 0, -1) if (1 - threshold**r) ** (REGISTERS // r) < miss or r == 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """word -> 64 bit hash; emptied when it grows past its bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(tokens: list[bytes], size: int, hashes: WordHashes) -> np.ndarray:
    """The distinct shingles of a word sequence as sorted 64 bit hashes; a shorter sequence is one shingle."""
    w = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    if not len(w):
        return w
    k = min(size, len(w))
    s = np.full(len(w) - k + 1, np.uint64(k))
    for i in range(k):
        s += w[i : len(w) - k + 1 + i] * _PLACE[i]
    return np.unique(_mix(s))


def sketch(s: np.ndarray) -> np.ndarray:
    """SetSketch registers (unsigned 16 bit) of a set of hashes."""
    low = np.full(REGISTERS, np.uint64(2**64 - 1))
    for i in range(0, len(s), 512):
        np.minimum(low, ((s[i : i + 512, None] ^ _FLIP) * _SPREAD).min(axis=0), out=low)
    u = ((low >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    return np.clip(np.floor(1 - np.log(-np.log1p(-u) / RATE) / np.log(BASE)), 0, 65535).astype(np.uint16)


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = registers[: bands * rows].reshape(bands, rows).astype(np.uint64)
    return _mix((part * _PLACE[:rows]).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _PLACE[63]).view(np.int64)


def may_link(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float, doubt: float = 12.5) -> np.ndarray:
    """Pairs whose similarity can be ``threshold`` or more, by the joint likelihood of their registers and set sizes.

    A pair is left out where an estimate below the threshold is more likely than the threshold by ``doubt``
    in log likelihood (five standard deviations).
    """
    up, down = (a > b).sum(axis=-1)[..., None], (a < b).sum(axis=-1)[..., None]
    u = (na / (na + nb))[..., None]
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    grid = np.append(np.linspace(0, threshold, 20, endpoint=False), threshold)
    j = np.minimum(grid, np.minimum(u / v, v / u))
    pu, pd = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    like = up * np.log(pu + tiny) + down * np.log(pd + tiny) + (REGISTERS - up - down) * np.log(np.maximum(1 - pu - pd, tiny))
    best = like.argmax(axis=-1)
    return (best == len(grid) - 1) | (like.max(axis=-1) - like[..., -1] <= doubt)


_SKETCH = "doc_id long, n_shingles long, cls binary, registers binary, bands array<long>"
_SET = "doc_id long, cls binary, registers binary, items binary"


def _rows(batches: Iterator[pa.RecordBatch], size: int, full: bool, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            out: list[tuple] = []
            for i, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                tokens = (text or b"").lower().split()
                s = shingles(tokens, size, hashes)
                if not len(s):
                    out.append((i, b"", b"", b"") if full else (i, 0, None, None, None))
                    continue
                registers = sketch(s)
                cls = xxhash.xxh3_128_digest(b" ".join(tokens))
                out.append((i, cls, registers.tobytes(), s.tobytes()) if full else (i, len(s), cls, registers.tobytes(), band_keys(registers, bands, rows)))
            cols = list(zip(*out)) if out else [()] * (4 if full else 5)
            types = [pa.int64(), pa.binary(), pa.binary(), pa.binary()] if full else [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            names = ["doc_id", "cls", "registers", "items"] if full else ["doc_id", "n_shingles", "cls", "registers", "bands"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _confirm(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose full sets are similar enough: den * intersection >= num * union."""
    for batch in batches:
        keep = []
        for start in range(0, batch.num_rows, 200):
            part = batch.slice(start, 200)
            for x, y in zip(part.column("sa").to_pylist(), part.column("sb").to_pylist()):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(den * both >= num * (len(s) + len(t) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, num: int = 80, den: int = 100, block: int = 1024, items: int = 2_000_000,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; similarity num/den or more on word shingles links.

    Words are runs without blanks, A-Z in lower case. Texts with the same words are one class and are
    compared once, so copies cost nothing. In each bucket of equal register bands every class meets two
    centres; where a bucket still has several components, its classes are compared in blocks of about
    ``block`` classes and ``items`` shingles at most, and only pairs across components go on. Links are confirmed on the full sets.

    Null and blank texts have no shingles and link with nothing. Rows that share a doc_id are one
    document; a row with a null doc_id links with nothing, has a null component and is kept. An empty
    table gives an empty result. Other columns are not read.
    """
    bands, rows = bands_for(num / den)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sk = stash(texts.mapInArrow(lambda it: _rows(it, size, False, bands, rows), _SKETCH))
    usable = sk.where("n_shingles > 0 and doc_id is not null")
    classes = stash(usable.groupBy("cls").agg(F.min("doc_id").alias("rep")))
    reps = usable.join(classes, (usable.cls == classes.cls) & (usable.doc_id == classes.rep)).select("rep", "n_shingles", "bands")

    each = reps.select("rep", "n_shingles", F.explode("bands").alias("key"))
    me = F.struct(F.col("rep").alias("rep"), F.col("n_shingles").alias("n"))
    far = F.struct(F.xxhash64("rep").alias("h"), F.col("rep").alias("rep"), F.col("n_shingles").alias("n"))
    buckets = each.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.min(me).alias("c"), F.max(far).alias("f"),
    ).where("n > 1")
    # the same classes often meet in several bands; one bucket of them is enough
    buckets = stash(buckets.groupBy("n", "x", "c", "f").agg(F.min("key").alias("key")).select("key", "c", "f"))
    members = stash(each.join(buckets, "key").select("key", "rep", F.col("n_shingles").alias("n"), "c", "f"))

    active = stash(members.select("rep").distinct())
    full = texts.join(active, texts.doc_id == active.rep, "left_semi").mapInArrow(lambda it: _rows(it, size, True, bands, rows), _SET)
    sets = stash(full.where(F.length("items") > 0).dropDuplicates(["doc_id", "cls"]))

    def fits(x: str, y: str):
        return (F.least(x, y) * den >= F.greatest(x, y) * num)

    def confirm(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("sa"))
        right = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("sb"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
        return both.mapInArrow(lambda it: _confirm(it, num, den), "a long, b long").distinct()

    stars = members.where("rep <> c.rep").where(fits("n", "c.n")).select(F.col("c.rep").alias("a"), F.col("rep").alias("b")).union(
        members.where("rep <> f.rep").where(fits("n", "f.n")).select(F.col("f.rep").alias("a"), F.col("rep").alias("b"))
    )
    links = stash(confirm(stash(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())))
    joined = stash(components(links))

    labelled = stash(
        members.select("key", "rep", "n").join(joined, members.rep == joined.node, "left")
        .select("key", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    )
    open_keys = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    open_keys = stash(open_keys.select("key", F.greatest(F.ceil(F.col("k") / block), F.ceil(F.col("s") / items)).cast("int").alias("blocks")))
    links = links.union(_across(labelled.join(open_keys, "key"), sets, num, den).distinct())
    final = stash(components(links))
    where = stash(
        classes.join(final, classes.rep == final.node, "left").select("cls", F.coalesce("component", "rep").alias("component_id"))
    ).withColumnRenamed("cls", "_cls")
    for used in (classes, buckets, members, active, sets, labelled, open_keys, joined, final):
        discard(docs.sparkSession, used)  # the result reads ``sk`` and ``where`` only
    rest = sk.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("cls")).alias("cls"))
    # rows without a class would all meet under the null key
    salted = rest.withColumn("cls", F.coalesce("cls", F.concat(F.lit("-"), F.coalesce(F.col("doc_id"), F.monotonically_increasing_id()).cast("string")).cast("binary")))
    out = salted.join(where, salted.cls == where._cls, "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))


_GROUP = ["key", "i", "j"]
_LIKELY = pa.schema([("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("mine", pa.int32()), ("rep", pa.int64()), ("comp", pa.int64())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _across(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between components of a bucket; blocks of its classes meet block by block.

    Registers first tell which classes have a likely partner in another component; only their sets are
    then sent to the group, which compares them exactly and returns links that join components, at most
    one a class. No list of pairs is made.
    """
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int")
    dealt = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep", "n", "comp")
    regs = sets.select(F.col("doc_id").alias("rep"), "registers")

    def columns(g: pa.Table, *names: str) -> list[np.ndarray]:
        return [g.column(c).to_numpy() for c in names]

    def partners(x: int, n: np.ndarray, comp: np.ndarray, mine: np.ndarray, same: bool) -> np.ndarray:
        ok = (comp[x + 1 :] != comp[x]) & (np.minimum(n[x + 1 :], n[x]) * den >= np.maximum(n[x + 1 :], n[x]) * num)
        if not same:
            ok &= mine[x + 1 :] != mine[x]
        return np.flatnonzero(ok) + x + 1

    def likely(g: pa.Table) -> list[list]:
        n, comp, mine, i, j = columns(g, "n", "comp", "mine", "i", "j")
        reg = np.stack([np.frombuffer(r, np.uint16) for r in g.column("registers").to_pylist()])
        hit = np.zeros(len(n), bool)
        least = REGISTERS * num / den - 5.5 * np.sqrt(REGISTERS * num / den * (1 - num / den))
        for x in range(len(n)):
            y = partners(x, n, comp, mine, i[0] == j[0])
            y = y[(reg[y] == reg[x]).sum(axis=1) >= least]  # registers agree as often as sets are similar
            todo = y if not hit[x] else y[~hit[y]]
            if len(todo):
                ok = todo[may_link(reg[x][None], reg[todo], n[x : x + 1], n[todo], num / den)]
                hit[ok] = True
                hit[x] |= len(ok) > 0
        return [g.column(c).filter(pa.array(hit)).to_pylist() for c in _LIKELY.names]

    def exact(g: pa.Table) -> list[list]:
        rep, comp, mine, i, j = columns(g, "rep", "comp", "mine", "i", "j")
        comp = comp.copy()
        items = [np.frombuffer(r, np.uint64) for r in g.column("items").to_pylist()]
        n = np.array([len(s) for s in items])
        starts = np.append(0, np.cumsum(n)[:-1])
        vocabulary, place = np.unique(np.concatenate(items), return_inverse=True)
        a, b = [], []
        for x in range(len(n)):
            y = partners(x, n, comp, mine, i[0] == j[0])
            if not len(y):
                continue
            mark = np.zeros(len(vocabulary), np.int32)
            mark[place[starts[x] : starts[x] + n[x]]] = 1
            base = starts[y[0]]
            common = np.add.reduceat(mark[place[base:]], starts[y[0] :] - base)[y - y[0]]
            for z in y[den * common >= num * (n[x] + n[y] - common)]:
                if comp[z] != comp[x]:
                    a.append(min(rep[x], rep[z]))
                    b.append(max(rep[x], rep[z]))
                    comp[comp == comp[z]] = comp[x]
        return [a, b]

    near = in_groups(dealt.join(regs, "rep"), _GROUP, likely, _LIKELY, "key long, i int, j int, mine int, rep long, comp long")
    with_sets = stash(near).join(sets.select(F.col("doc_id").alias("rep"), "items"), "rep")
    return in_groups(with_sets, _GROUP, exact, _LINK, "a long, b long")
