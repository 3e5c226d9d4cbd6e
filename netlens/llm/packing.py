"""Packing documents into sequences of bounded length by the sum-of-squares rule."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netlens.llm.common import in_groups, stash

# --- tokens -------------------------------------------------------------------------

#: A full stop or comma after a lower-case letter and before a blank is a token of its own anyway.
_TAIL = re.compile(rb"(?<=[a-z])([.,])(?=[ \n]|$)")
#: Letters that normalizing maps to one letter each, whatever stands beside them.
_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


class WordTokens(dict):
    """Ids of words by a tokenizer that drops blanks; a word's ids do not depend on its neighbours.

    word -> place in the tables ``start`` and ``size`` over ``flat``, the ids of all words met so far.
    ``settle`` fills the tables for the words met since its last call. Emptied when it passes ``bound``.
    """

    def __init__(self, path: str, bound: int = 1_000_000):
        from tokenizers import Tokenizer

        self.bound, self.tokenizer = bound, Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def words(self, text: bytes) -> list[bytes]:
        if text.isascii() and not any(s in text for s in self.special) and b"<|" not in text:
            text = text.lower()  # as the tokenizer does; other letters are left to it
        return _TAIL.sub(rb" \1", text).split()

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def settle(self) -> None:
        new = [w.decode() for w in self.new]
        self.new.clear()
        # words of Latin-1 letters end with their only end-of-word id, so many are encoded as one text;
        # normalizing turns some other letters into a letter and a mark, where a word is cut
        plain = np.fromiter((_PLAIN.fullmatch(w) is not None for w in new), bool, len(new))
        letters = [w for w, k in zip(new, plain) if k]
        joined = self.encode([" ".join(letters[i : i + 50]) for i in range(0, len(letters), 50)])
        a = np.fromiter((i for e in joined for i in e), np.uint32)
        size_a = np.diff(np.flatnonzero(self.ends[a]) + 1, prepend=0)
        if len(size_a) != len(letters):
            raise ValueError("the tokenizer has no end-of-word ids")
        others = self.encode([w for w, k in zip(new, plain) if not k])
        size_b = np.fromiter(map(len, others), np.int64, len(others))
        b = np.fromiter((i for e in others for i in e), np.uint32)
        size, start = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        size[plain], size[~plain] = size_a, size_b
        start[plain], start[~plain] = np.cumsum(size_a) - size_a, len(a) + np.cumsum(size_b) - size_b
        self.start, self.size = np.append(self.start, len(self.flat) + start), np.append(self.size, size)
        self.flat = np.concatenate([self.flat, a, b])

    def ids(self, place: np.ndarray) -> np.ndarray:
        size = self.size[place]
        return self.flat[np.repeat(self.start[place] - np.cumsum(size) + size, size) + np.arange(size.sum())]


_TOKENS: dict[str, WordTokens] = {}  # one table a worker, kept from task to task


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    tokens = _TOKENS.get(path) or _TOKENS.setdefault(path, WordTokens(path))
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            if len(tokens) > tokens.bound:
                tokens.reset()
            texts = [tokens.words(t or b"") for t in part.column(2).cast(pa.binary()).to_pylist()]
            places = [np.fromiter(map(tokens.__getitem__, w), np.int64, len(w)) for w in texts]
            tokens.settle()
            out: list[tuple] = []
            for uid, doc_id, place in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), places):
                ids = np.append(tokens.ids(place), np.uint32(end)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    piece = ids[start : start + capacity].tobytes()
                    out.append((uid, doc_id, k, start, len(piece) // 4, zlib.crc32(piece), piece))
            types = [pa.int64(), part.schema.field(1).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def token_pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096, end: int = 1) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32, ids): a document's ids and the end id, cut only where longer than ``capacity``.

    ``tokenizer`` is the path of a word-level tokenizer file that each executor has. ``uid`` tells rows apart, also those
    with equal or null ids. ``ids`` are unsigned little-endian 32 bit numbers.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(
        lambda it: _pieces(it, tokenizer, capacity, end), "uid long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    )


# --- packing ------------------------------------------------------------------------

def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest first.

    An item goes where the sum over gaps of (open bins with that gap)^2 becomes smallest, a new bin being
    one of the choices; of equal choices it takes the smallest gap. Full bins are closed and do not count.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    count = np.zeros(capacity + 1, np.int64)
    opened: list[list[int]] = [[] for _ in range(capacity + 1)]
    made, never = 0, np.int64(1) << 60
    for i in order.tolist():
        s = int(sizes[i])
        change = 1 - 2 * count[s:capacity]
        change[1:] += 2 * count[1 : capacity - s] + 1
        change[count[s:capacity] == 0] = never
        g = s + int(change.argmin()) if s < capacity else capacity
        if s == capacity or change[g - s] > 2 * count[capacity - s] + 1:
            b, g, made = made, capacity, made + 1
        else:
            count[g] -= 1
            b = opened[g].pop()
        bins[i], offsets[i] = b, capacity - g
        if g > s:
            count[g - s] += 1
            opened[g - s].append(b)
    return bins, offsets


_PLACED = pa.schema([("uid", pa.int64()), ("piece", pa.int32()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])


def _place(rows: DataFrame, capacity: int, group: int, turn: int = 0) -> tuple[DataFrame, int]:
    """(uid, piece, length) -> their places; groups of about ``group`` rows, others each turn, are packed side by side."""
    groups = -(-rows.count() // group)
    dealt = rows.select("uid", "piece", "length", F.pmod(F.xxhash64("uid", "piece", *[F.lit(turn)] * (turn > 0)), F.lit(max(groups, 1)).cast("long")).cast("int").alias("g"))

    def handle(t: pa.Table) -> list:
        # the order of rows in a group must not depend on the run
        t = t.sort_by([("length", "descending"), ("uid", "ascending"), ("piece", "ascending")])
        bins, offsets = sum_of_squares(t.column("length").to_numpy(), capacity)
        g = t.column("g")[0].as_py()
        return [t.column("uid").to_pylist(), t.column("piece").to_pylist(), (bins + (g << 32)).tolist(), offsets.tolist(), t.column("length").to_pylist()]

    return in_groups(dealt, ["g"], handle, _PLACED, "uid long, piece int, sequence_id long, offset long, length long"), groups


def pack(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096, end: int = 1, group: int = 65536, with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece, with ``ids`` on demand.

    Pieces are dealt to groups of bounded size by a hash and packed by ``sum_of_squares``. What a group leaves half
    empty is packed again, as whole bins in other groups, until one group is left or a turn saves less than one bin in a
    thousand; bins that fit with no other drop out on the way. A null or empty text is the end id alone; rows with equal or null ids are packed each
    for itself; an empty table gives an empty result; other columns are not read.
    """
    pieces = token_pieces(docs, tokenizer, doc_id, text, capacity, end)
    pieces = stash(pieces if with_ids else pieces.drop("ids"))
    placed, groups = _place(pieces, capacity, group)
    placed = stash(placed.drop("length"))
    info = pieces.select("uid", "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids)
    out = info.join(placed, ["uid", "piece"])
    moved = None
    if groups > 1:
        bins = stash(out.groupBy("sequence_id").agg(F.sum("length").alias("length")))
        least = bins.agg(F.min("length")).first()[0]
        # uid is the bin's number now
        loose = stash(bins.where(F.col("length") + least <= capacity).select(F.col("sequence_id").alias("uid"), F.lit(0).alias("piece"), "length"))
        turn = 0
        while groups > 1:
            turn += 1
            again, groups = _place(loose, capacity, group, turn)
            again = stash(again)
            first = again.where("offset = 0").select("sequence_id", F.col("uid").alias("to"))
            step = again.join(first, "sequence_id").select("uid", "to", F.col("offset").alias("base"), "length")
            if moved is None:
                moved = stash(step.select("uid", "to", "base"))
            else:
                later = step.select(F.col("uid").alias("to"), F.col("to").alias("to2"), F.col("base").alias("base2"))
                moved = stash(moved.join(later, "to").select("uid", F.col("to2").alias("to"), (F.col("base") + F.col("base2")).alias("base")))
            bins = stash(step.groupBy("to").agg(F.sum("length").alias("length")).select(F.col("to").alias("uid"), F.lit(0).alias("piece"), "length"))
            before, (after, least) = again.count(), bins.agg(F.count(F.lit(1)), F.min("length")).first()
            if before - after < max(before // 1000, 1):
                break
            loose = bins.where(F.col("length") + least <= capacity)
    if moved is not None:
        out = out.join(moved.withColumnRenamed("uid", "_bin"), F.col("sequence_id") == F.col("_bin"), "left")
        out = out.withColumn("sequence_id", F.coalesce("to", "sequence_id")).withColumn("offset", F.col("offset") + F.coalesce("base", F.lit(0)))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, offsets) from ``pack(..., with_ids=True)``: the token ids of each sequence, as bytes."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    t = packed.groupBy("sequence_id").agg(parts.alias("p"))
    whole = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), ""))
    return t.select("sequence_id", whole.alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("p", lambda x: x["offset"]).alias("offsets"))
