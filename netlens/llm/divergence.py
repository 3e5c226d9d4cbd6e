"""How far the sources of a language differ in their terms, counted over digests; strings are read back for results only.

Terms are counted once a block of texts, whose strings are kept beside the counts; counts are exchanged with a
64 bit digest in the place of the string. Strings are read again for the digests that are kept; where the least
and the greatest string of a digest differ, its counts are split by string.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from netlens.llm.common import Places, discard, stash

SCALE = 1_000_000_000
#: Bytes of terms (ASCII letters in lower case, all bytes of other characters); the rest are blanks.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A row counts a term (alt tells terms of a block with one digest apart) in a group, or names a term of a block.
_COUNTS = "block long, digest long, alt int, lid long, gid long, n long, docs long, term binary"
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


class _Block:
    """Counts of the terms of some texts: arrays by (group, term), strings once a term."""

    def __init__(self, bits: int):
        self.bits, self.places = bits, Places()
        self.groups: dict[tuple[int, int], int] = {}
        self.key, self.n, self.docs = (np.zeros(0, np.int64) for _ in range(3))
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, lids: list, gids: list, texts: list[bytes]) -> None:
        terms = [t.translate(_BYTES).split() for t in texts]
        size = np.fromiter(map(len, terms), np.int64, len(terms))
        places = self.places
        flat = np.fromiter(map(places.__getitem__, chain.from_iterable(terms)), np.int64, int(size.sum()))
        one, n = np.unique(np.repeat(np.arange(len(terms)) << 32, size) | flat, return_counts=True)
        group = np.fromiter((self.groups.setdefault(g, len(self.groups)) for g in zip(lids, gids)), np.int64, len(gids))
        self.new.append(((group[one >> 32] << 32) | (one & 0xFFFFFFFF), n, np.ones(len(one), np.int64)))
        self.waiting += len(one)
        if self.waiting > max(1_000_000, len(self.key)):
            self.merge()

    def merge(self) -> None:
        key, n, docs = (np.concatenate(x) for x in zip((self.key, self.n, self.docs), *self.new))
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.key, self.n, self.docs = key[starts], *(np.add.reduceat(x[order], starts) if len(key) else x for x in (n, docs))
        self.new, self.waiting = [], 0

    def results(self, block: int) -> Iterator[pa.RecordBatch]:
        self.merge()
        strings = list(self.places)
        digest = (np.fromiter(map(xxhash.xxh3_64_intdigest, strings), np.uint64, len(strings)) >> np.uint64(64 - self.bits)).view(np.int64)
        order = np.argsort(digest, kind="stable")
        d = digest[order]
        first = np.flatnonzero(np.append(True, d[1:] != d[:-1])) if len(d) else np.zeros(0, np.int64)
        alt = np.zeros(len(d), np.int32)
        alt[order] = np.arange(len(d)) - np.repeat(first, np.diff(np.append(first, len(d))))
        ids = np.array(list(self.groups), np.int64).reshape(-1, 2)
        for at in range(0, len(self.key), 50_000):
            key = self.key[at : at + 50_000]
            g, t = key >> 32, key & 0xFFFFFFFF
            yield _rows([np.full(len(key), block), digest[t], alt[t], ids[g, 0], ids[g, 1], self.n[at : at + 50_000], self.docs[at : at + 50_000], None])
        for at in range(0, len(strings), 50_000):
            some = slice(at, at + 50_000)
            yield _rows([np.full(len(digest[some]), block), digest[some], alt[some], None, None, None, None, strings[some]])


def _rows(cols: list) -> pa.RecordBatch:
    size = len(cols[0])
    return pa.RecordBatch.from_arrays([pa.nulls(size, t) if c is None else pa.array(c, t) for c, t in zip(cols, _KINDS)], names=[c.split()[0] for c in _COUNTS.split(", ")])


def _count(batches: Iterator[pa.RecordBatch], bits: int, bound: int) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group, for as many texts as ``bound`` different terms or counts allow."""
    number, block = TaskContext.get().partitionId() << 32, _Block(bits)
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            block.add(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist())
            if len(block.places) > bound or len(block.key) > 4 * bound:
                yield from block.results(number)
                number, block = number + 1, _Block(bits)
    yield from block.results(number)


def _held(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Rows (digest, term) whose digest can be in the bit set."""
    width, words = sent.value
    for batch in batches:
        slot = batch.column(0).to_numpy().view(np.uint64) & np.uint64((1 << width) - 1)
        yield batch.filter(pa.array((words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1))


def _bit_set(digests: DataFrame, most: int = 27) -> tuple[int, np.ndarray]:
    """The last bits of each digest as a set of 2^most bits (16 MB) at most; a fuller one only lets more through."""
    width = min(most, max(16, (16 * digests.count()).bit_length()))
    slot = F.col("digest").bitwiseAND(F.lit((1 << width) - 1))
    bits = digests.groupBy(F.call_function("shiftright", slot, F.lit(6)).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    words = np.zeros(1 << (width - 6), np.uint64)
    words[bits.column("w").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)
    return width, words


def term_counts(docs: DataFrame, groups: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", bits: int = 64, bound: int = 600_000) -> DataFrame:
    """Counts by (block, digest, alt, lid, gid), and the terms by (block, digest, alt); ``groups`` numbers the groups and languages."""
    read = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))]
    rows = docs.select(*read).join(groups, ["lang", "source"]).select("lid", "gid", "text")
    return rows.mapInArrow(lambda it: _count(it, bits, bound), _COUNTS)


def _rate(n: Column, total: Column) -> Column:
    """1 + floor(10^9 * (n + 1) / total), exact for counts of any size."""
    wide = (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", wide, total.cast("decimal(20,0)")) + 1


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of whole numbers up to 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


_SHARED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64())])


def _shared(batches: Iterator[pa.RecordBatch], pairs: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows (digest, lid, sub, gid, p, p0) sorted by term, the first three columns: what the terms that two groups share add to the pair's value.

    p0 is the p of a term that the group lacks. Sums are kept until there are many of them.
    """
    kept = np.zeros((3, 0), np.int64)

    def merged(a: np.ndarray, b: np.ndarray, v: np.ndarray) -> np.ndarray:
        order = np.lexsort((b, a))
        a, b, v = a[order], b[order], v[order]
        new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        return np.stack([a[new], b[new], np.add.reduceat(v, new)])

    def sums(t: np.ndarray) -> Iterator[np.ndarray]:
        starts = np.flatnonzero(np.append(True, (t[:3, 1:] != t[:3, :-1]).any(axis=0)))
        size = np.diff(np.append(starts, t.shape[1]))
        many, first = np.repeat(size, size), np.repeat(starts, size)
        ends = np.cumsum(many)
        at = 0
        while at < len(many):
            to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + pairs, "right")), at + 1)
            m = many[at:to]
            i = np.repeat(np.arange(at, to), m)
            j = np.repeat(first[at:to] - np.cumsum(m) + m, m) + np.arange(len(i))
            i, j = i[i != j], j[i != j]
            if len(i):
                p, p0, q, q0 = t[4][i], t[5][i], t[4][j], t[5][j]
                yield merged(t[3][i], t[3][j], _f(p, q) - _f(p, q0) - _f(p0, q) + _f(p0, q0))
            at = to

    def results() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in kept], schema=_SHARED)

    rest = np.zeros((6, 0), np.int64)
    for batch in chain(batches, [None]):
        ready = rest
        if batch is not None:
            rest = np.concatenate([rest, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            cut = int(np.flatnonzero(np.append(True, (rest[:3, 1:] != rest[:3, :-1]).any(axis=0)))[-1]) if rest.shape[1] else 0
            ready, rest = rest[:, :cut], rest[:, cut:]
        if not ready.shape[1]:
            continue
        for new in sums(ready):
            kept = merged(*np.concatenate([kept, new], axis=1))
            if kept.shape[1] > pairs:
                yield results()
                kept = kept[:, :0]
    yield results()


def source_divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 3, top: int = 200, bits: int = 64,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how a source's terms depart from another source's and from its language's.

    A language keeps the terms of at least ``least_docs`` of its documents. A term's share in a group is
    p = 1 + floor(10^9 * (count + 1) / (N + V)), over the N occurrences of the V kept terms. Part ``pair`` sums
    floor((p - q)^2 / q) over the kept terms for each other source of the language; part ``term`` lists the ``top``
    terms of a group whose p exceeds the language's q. Ranks go by value, then by the item's bytes.

    Every row is a document, rows that share an id as well. Null text, lang and source are read as ''; a group without
    terms has its pairs; a language with one source has none; an empty table gives an empty result. Other columns are
    not read. A term may be as long as a text. ``bits`` is the width of the digests: with fewer the result is the same,
    and more collisions are split.
    """
    zero, spark, term = F.lit(0).cast("long"), docs.sparkSession, ["digest", "lid", "sub"]
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]
    numbered = stash(docs.select(*names).distinct().withColumn("gid", F.monotonically_increasing_id()))
    groups = stash(numbered.join(numbered.groupBy("lang").agg(F.min("gid").alias("lid")), "lang"))
    every = stash(term_counts(docs, groups, text, lang, source, bits))
    counted, named = every.where("n is not null").drop("term"), every.where("term is not null").select("block", "digest", "alt", "term")

    # one exchange by digest counts terms by group and language, and leaves out those of too few documents
    alike, whole = Window.partitionBy("digest", "lid", "sub"), Window.partitionBy("digest", "lid", "sub").orderBy("gid")

    def enough(t: DataFrame) -> DataFrame:
        summed = t.groupBy("digest", "lid", "sub", "gid").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        full = summed.withColumns({"of": F.sum("docs").over(alike), "m": F.sum("n").over(alike), "first": F.row_number().over(whole) == 1})
        return full.where(F.col("of") >= least_docs).select(*term, "gid", "n", "m", "first")

    often = stash(enough(counted.select("digest", "lid", zero.alias("sub"), "gid", "n", "docs").repartition("digest")))

    # strings of those digests; where the least is not the greatest, the digest stands for several
    digests = stash(often.where("first").select("digest").distinct())
    sent = spark.sparkContext.broadcast(_bit_set(digests))
    near = named.select("digest", "term").mapInArrow(lambda it: _held(it, sent), "digest long, term binary")
    strings = stash(near.groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("greatest")))
    mixed = stash(strings.where("term <> greatest").select("digest"))
    labels = stash(named.join(mixed, "digest", "left_semi"))
    number = F.row_number().over(Window.partitionBy("digest").orderBy("term")).cast("long")
    subs = stash(labels.select("digest", "term").distinct().withColumn("sub", number))  # a digest's strings, from 1
    parted = counted.join(mixed, "digest", "left_semi").join(labels.join(subs, ["digest", "term"]).drop("term"), ["block", "digest", "alt"])
    n = stash(often.join(mixed, "digest", "left_anti").unionByName(enough(parted.select("digest", "lid", "sub", "gid", "n", "docs"))))

    size = n.groupBy("lid").agg(F.count_if("first").alias("v"), F.sum("n").alias("total"))
    size = size.select("lid", "v", (F.col("total") + F.col("v")).alias("all_of_lang"))
    of = groups.select("gid", "lid").join(n.groupBy("gid").agg(F.sum("n").alias("total")), "gid", "left").join(size, "lid", "left")
    of = of.withColumn("v", F.coalesce("v", zero)).withColumn("all_of_group", F.coalesce("total", zero) + F.col("v"))
    of = stash(of.withColumn("p0", F.when(F.col("v") > 0, _rate(zero, F.col("all_of_group")))).drop("total"))
    rated = n.join(of.drop("lid", "v"), "gid").withColumn("p", _rate(F.col("n"), F.col("all_of_group")))

    # terms above their language, text joined to those that can be among the first
    ahead = rated.withColumn("q", _rate(F.col("m"), F.col("all_of_lang"))).where("p > q")
    ahead = stash(ahead.select("gid", "digest", "sub", _apart(F.col("p"), F.col("q")).alias("value")))
    order = Window.partitionBy("gid").orderBy(F.desc("value"))
    least = ahead.select("gid", "value", F.row_number().over(order).alias("r")).where(F.col("r") <= top).groupBy("gid").agg(F.min("value").alias("least"))
    best = ahead.join(least, "gid").where("value >= least")
    text_of = strings.where("term = greatest").select("digest", "term", zero.alias("sub")).unionByName(subs.select("digest", "term", "sub"))
    place = Window.partitionBy("gid").orderBy(F.desc("value"), "item")
    terms = best.join(text_of, ["digest", "sub"]).select("gid", "value", F.col("term").cast("string").alias("item"))
    terms = terms.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))

    # pairs: all terms as if both groups lacked them, then what changes where one has them, and where both have them
    f00 = _apart(F.col("p0"), F.col("q0"))
    left, right = of.select("lid", F.col("gid").alias("a"), "p0", "v"), of.select("lid", F.col("gid").alias("b"), F.col("p0").alias("q0"))
    none = left.join(right, "lid").where("a <> b").select("a", "b", F.coalesce(F.col("v") * f00, zero).alias("value"))
    same = rated.groupBy("lid", "gid", "p", "p0").agg(F.count(F.lit(1)).alias("terms"))  # terms of one count add the same
    one = stash(same).join(right, "lid").where("gid <> b")
    has = one.groupBy(F.col("gid").alias("a"), "b").agg(F.sum(F.col("terms") * (_apart(F.col("p"), F.col("q0")) - f00)).alias("value"))
    lacks = one.groupBy(F.col("b").alias("a"), F.col("gid").alias("b")).agg(F.sum(F.col("terms") * (_apart(F.col("q0"), F.col("p")) - _apart(F.col("q0"), F.col("p0")))).alias("value"))
    dealt = rated.select(*term, "gid", "p", "p0").repartition("digest").sortWithinPartitions(*term)
    both = dealt.mapInArrow(_shared, "a long, b long, value long")
    pairs = none.unionByName(has).unionByName(lacks).unionByName(both).groupBy("a", "b").agg(F.sum("value").alias("value"))
    pairs = pairs.join(groups.select(F.col("gid").alias("b"), F.col("source").alias("item")), "b").select(F.col("a").alias("gid"), "value", "item")
    pairs = pairs.withColumn("rank", F.row_number().over(place)).withColumn("part", F.lit("pair"))

    out = stash(terms.unionByName(pairs).join(groups, "gid").select("lang", "source", "part", "item", "value", "rank"))
    for used in (every, numbered, groups, often, digests, strings, mixed, labels, subs, n, of, ahead):
        discard(spark, used)
    return out
