"""Language identification by n-gram filters that hold a bit for each language."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from netlens.llm.common import stash

ORDERS = (1, 2, 3)
HASHES = 3


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """Character n-grams of the letters in lower case, other characters being one blank; empty without letters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return np.zeros(0, np.uint64)
    keep = letter | np.append(True, letter[:-1])
    c = np.concatenate([[32], np.where(letter, c, 32)[keep], [32]]).astype(np.uint64)
    out = [c[c != 32]]
    for n in ORDERS[1:]:
        g = np.zeros(len(c) - n + 1, np.uint64)
        for i in range(n):
            g = (g << np.uint64(21)) | c[i : len(c) - n + 1 + i]
        out.append(g)
    return np.concatenate(out)


def places(g: np.ndarray, slots: int) -> np.ndarray:
    """The HASHES slots of each n-gram, by double hashing; ``slots`` is a power of two."""
    x = (g ^ (g >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    step = (x >> np.uint64(32)) | np.uint64(1)
    return np.stack([(x + np.uint64(i) * step) & np.uint64(slots - 1) for i in range(HASHES)]).astype(np.int64)


_COUNT = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("c", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                by.setdefault(lang, []).append(grams(text))
            for lang, found in by.items():
                g, c = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(c.astype(np.int64))], schema=_COUNT)


class Filter:
    """The bit-sliced filter: at each slot a word of bits, one bit a language.

    The words at an n-gram's slots, combined by AND, tell all languages that may hold it. Its size is
    ``slots`` words for each 64 languages, whatever the corpus, so it can be sent to all executors.
    """

    def __init__(self, langs: list[str], bits: np.ndarray):
        self.langs, self.bits = langs, bits  # bits: (words, slots)
        self.false = np.array([((bits[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() ** HASHES for i in range(len(langs))])

    def predict(self, text: str | None) -> tuple[str, float]:
        g = grams(text) if text else np.zeros(0, np.uint64)
        if not len(g) or not self.langs:
            return "und", 0.0
        at = places(g, self.bits.shape[1])
        hits = np.zeros(len(self.langs))
        for w, bits in enumerate(self.bits):
            m = bits[at[0]]
            for p in at[1:]:
                m = m & bits[p]
            own = range(64 * w, min(64 * (w + 1), len(self.langs)))
            hits[own.start : own.stop] = [np.count_nonzero((m >> np.uint64(i % 64)) & np.uint64(1)) for i in own]
        # what the filter's false positives add is taken off
        true = np.clip((hits - len(g) * self.false) / np.maximum(1 - self.false, 1e-9), 0, None)
        best = int(true.argmax())
        return self.langs[best], float(true[best] / true.sum()) if true.sum() > 0 else 0.0


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", slots: int = 1 << 20, least: float = 1e-5, share: float = 0.1) -> Filter:
    """A filter from labelled texts: counts over all of them, joined by n-gram.

    A language holds an n-gram that is at least ``least`` of its n-grams and is there at least ``share`` times as
    frequent as in the language where it is most frequent. Null texts and languages are left out. Only the finished
    filter (at most ``slots`` rows for each 64 languages) and one row a language come to the driver.
    """
    t = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = stash(t.mapInArrow(_count, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c")))
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("c").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return Filter([], np.zeros((1, slots), np.uint64))
    index = F.create_map(*[x for i, name in enumerate(langs) for x in (F.lit(name), F.struct(F.lit(i).alias("i"), F.lit(float(totals[name])).alias("n")))])
    rated = counts.withColumn("l", index[F.col("lang")]).select("gram", "l.i", (F.col("c") / F.col("l.n")).alias("rate"))
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"))
    held = rated.join(top, "gram").where((F.col("rate") >= least) & (F.col("rate") >= share * F.col("top"))).select("gram", "i")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.column(1).to_numpy()
            at = places(b.column(0).to_numpy().astype(np.uint64), slots).ravel()
            bit = np.tile((np.uint64(1) << (i % 64).astype(np.uint64)).view(np.int64), HASHES)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(i // 64, HASHES).astype(np.int32)), pa.array(at), pa.array(bit)], names=["w", "slot", "bit"])

    made = held.mapInArrow(spread, "w int, slot long, bit long").groupBy("w", "slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros((-(-len(langs) // 64), slots), np.uint64)
    bits[made.column("w").to_numpy(), made.column("slot").to_numpy()] = made.column("bits").to_numpy().view(np.uint64)
    return Filter(langs, bits)


def predict_language(docs: DataFrame, model: Filter, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from the text alone. ``und`` and 0 for a null text or one without letters.

    ``score`` is the share of the best language in the corrected counts of all. Ties go to the first language by name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [sent.value.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in told], pa.string()), pa.array([s for _, s in told], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def fold(doc_id: Column) -> Column:
    """Remainder of crc32 of the id as text by 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from rows whose fold is known and not ``held``, applied to all rows.

    A null id is not held out and not learned from. Repeated rows count as often as they occur. With no labelled text
    every prediction is ``und``. An empty table gives an empty result; other columns are not read.
    """
    model = learn(docs.where(fold(F.col(doc_id)) != held), text, lang)
    out = predict_language(docs, model, doc_id, text)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")
