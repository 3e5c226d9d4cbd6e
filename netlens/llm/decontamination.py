"""Benchmark passages in a corpus, by a positional inverted index of the corpus.

The index is cut into shards of whole documents. A shard holds, for each of its words, the places of the word;
documents stand one after another in the numbering of places. A phrase is looked for in the shards that hold its
rarest word: the places of that word, less its offset, are intersected with those of the next rarest word, and so on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from netlens.llm.common import Places, discard, stash

#: Bytes of words (digits, ASCII letters in lower case, all bytes of other characters); the rest are blanks.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word of a shard: its places, as 32 bit differences. A document (no word): its first place and its number of words.
_INDEX = "shard long, word binary, n long, places binary, doc_id long, first long"
_KINDS = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
_NAMES = [c.split()[0] for c in _INDEX.split(", ")]


def _postings(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Index rows of shards of about ``most`` words; a longer document is a shard of its own."""
    shard = TaskContext.get().partitionId() << 32
    known = Places()
    flat: list[np.ndarray] = []
    rows: list[tuple] = []
    used = 0

    def close() -> Iterator[pa.RecordBatch]:
        ids = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        places = np.argsort(ids, kind="stable").astype(np.uint32)
        size = np.bincount(ids, minlength=len(known))
        ends = np.cumsum(size)
        starts = ends - size
        steps = np.diff(places, prepend=np.uint32(0))
        steps[starts] = places[starts]
        words = list(known)
        for at in range(0, len(words), 10_000):
            to = min(at + 10_000, len(words))
            lists = pa.Array.from_buffers(
                pa.binary(), to - at, [None, pa.py_buffer(((np.append(starts[at:to], ends[to - 1]) - starts[at]) * 4).astype(np.int32)), pa.py_buffer(steps[starts[at] : ends[to - 1]])]
            )
            yield _batch([np.full(to - at, shard), words[at:to], size[at:to], lists, None, None])
        for at in range(0, len(rows), 10_000):
            some = rows[at : at + 10_000]
            doc_id, first, n = zip(*some)
            yield _batch([np.full(len(some), shard), None, list(n), None, list(doc_id), list(first)])

    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                words = (text or b"").translate(_BYTES).split()
                if used and used + len(words) > most:
                    yield from close()
                    shard, used = shard + 1, 0
                    known, flat, rows = Places(), [], []
                rows.append((doc_id, used, len(words)))
                flat.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                used += len(words)
    yield from close()


def _batch(cols: list) -> pa.RecordBatch:
    size = len(cols[0])
    return pa.RecordBatch.from_arrays([pa.nulls(size, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, _KINDS)], names=_NAMES)


def positional_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = 1 << 20) -> DataFrame:
    """The index of all words of whole texts, and a row a document; A-Z are read in lower case, null texts have no words.

    Write it before it is read more than once. A shard has about ``most`` words, so its rows fit one task.
    """
    rows = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string"))
    return rows.mapInArrow(lambda it: _postings(it, most), _INDEX)


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = 10) -> DataFrame:
    """(item, words): each run of ``size`` words of an item, once an item; of an item with fewer words, all of them."""
    low = F.translate(F.col(text).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    t = benchmark.select(F.col(item_id).cast("string").alias("item"), F.regexp_extract_all(low, F.lit(f"({_WORD})"), 1).alias("w")).where(F.size("w") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    t = t.select("item", "w", F.explode(at).alias("i")).select("item", F.slice("w", F.col("i"), F.lit(size)).alias("words"))
    return t.distinct()


# --- search in a shard --------------------------------------------------------------

def _offset_matches(words: list[list[bytes]], size: dict[bytes, int], keys: np.ndarray, place_of: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, first place) of each exact occurrence; ``keys`` are (word << 32 | place), sorted."""
    longest = max(map(len, words))
    term, offset = np.full((len(words), longest), -1, np.int64), np.zeros((len(words), longest), np.int64)
    for k, phrase in enumerate(words):
        rare = sorted(range(len(phrase)), key=lambda i: (size.get(phrase[i], 0), i))
        term[k, : len(phrase)] = [place_of.get(phrase[i], len(place_of)) for i in rare]
        offset[k, : len(phrase)] = rare
    lo, hi = np.searchsorted(keys, term[:, 0] << 32), np.searchsorted(keys, (term[:, 0] + 1) << 32)
    n = hi - lo
    who = np.repeat(np.arange(len(words)), n)
    start = (keys[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())] & 0xFFFFFFFF) - offset[who, 0]
    who, start = who[start >= 0], start[start >= 0]
    for j in range(1, longest):
        t = term[who, j]
        want = (t << 32) | (start + offset[who, j])
        there = np.searchsorted(keys, want)
        ok = (t < 0) | (keys[np.minimum(there, len(keys) - 1)] == want)
        who, start = who[ok], start[ok]
    return who, start


def _near_matches(words: list[list[bytes]], size: dict[bytes, int], keys: np.ndarray, place_of: dict[bytes, int], slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, first, end) of each shortest stretch of at most ``slop`` further words that holds all words of a phrase, in any order."""
    found: list[tuple[int, int, int]] = []
    for k, phrase in enumerate(words):
        need = {w: phrase.count(w) for w in phrase}
        rare = sorted(need, key=lambda w: (size.get(w, 0), w))
        span = len(phrase) + slop
        if any(w not in place_of for w in rare):
            continue
        near = np.zeros(0, np.int64)
        for w in rare:
            t = place_of[w] << 32
            own = keys[np.searchsorted(keys, t) : np.searchsorted(keys, t + (1 << 32))] & 0xFFFFFFFF
            if w == rare[0]:
                anchors, lists = own, [own]
            else:  # anchors with enough of the word in reach
                a, b = np.searchsorted(own, anchors - span + 1), np.searchsorted(own, anchors + span)
                anchors = anchors[b - a >= need[w]]
                lists.append(own)
            if not len(anchors):
                break
        else:
            near = np.unique(np.concatenate([_reach(own, anchors, span) for own in lists]))
        if not len(near):
            continue
        label = np.empty(len(near), np.int64)
        for j, own in enumerate(lists):
            label[np.searchsorted(near, _reach(own, anchors, span))] = j
        lack, have, left = len(rare), [0] * len(rare), 0
        want = [need[w] for w in rare]
        for right, j in enumerate(label.tolist()):
            have[j] += 1
            lack -= have[j] == want[j]
            while not lack:
                if near[right] - near[left] < span and have[label[left]] == want[label[left]]:
                    found.append((k, int(near[left]), int(near[right]) + 1))
                have[label[left]] -= 1
                lack += have[label[left]] == want[label[left]] - 1
                left += 1
    who, first, end = np.array(found, np.int64).reshape(-1, 3).T
    return who, first, end


def _reach(own: np.ndarray, anchors: np.ndarray, span: int) -> np.ndarray:
    """Places of ``own`` less than ``span`` from an anchor."""
    at = np.searchsorted(anchors, own)
    after = anchors[np.minimum(at, len(anchors) - 1)] - own
    before = own - anchors[np.maximum(at - 1, 0)]
    return own[(np.abs(after) < span) | (np.abs(before) < span)]


_FOUND = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<first: long, end: long, item: string>>"
_FOUND_TYPE = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("item", pa.string())]))),
])


def _search(key, held: pa.Table, asked: pa.Table, slop: int | None, with_spans: bool) -> pa.Table:
    """Documents of a shard with the places that the phrases asked for cover."""
    is_doc = held.column("word").is_null()
    docs, held = held.filter(is_doc), held.filter(pc.invert(is_doc))
    docs = docs.sort_by([("first", "ascending"), ("n", "ascending")])
    first, n_words = docs.column("first").to_numpy(), docs.column("n").to_numpy()
    end = first + n_words
    who, start, stop = (np.zeros(0, np.int64) for _ in range(3))
    items = asked.column("item").to_pylist()
    if asked.num_rows and held.num_rows:
        phrases = asked.column("words").to_pylist()
        vocabulary = held.column("word").to_pylist()
        size = dict(zip(vocabulary, held.column("n").to_pylist()))
        place_of = {w: i for i, w in enumerate(vocabulary)}
        keys = np.concatenate([np.cumsum(np.frombuffer(p, np.uint32), dtype=np.int64) | (i << 32) for i, p in enumerate(held.column("places").to_pylist())])
        rarity = dict(zip(vocabulary, held.column("total").to_pylist()))
        distinct = {p: i for i, p in enumerate(dict.fromkeys(map(tuple, phrases)))}
        lists = [list(p) for p in distinct]
        if slop is None:
            who, start = _offset_matches(lists, rarity, keys, place_of)
            stop = start + np.fromiter(map(len, lists), np.int64, len(lists))[who]
        else:
            who, start, stop = _near_matches(lists, rarity, keys, place_of, slop)
        # places go on from document to document: an occurrence must end in the document it begins in
        doc = np.searchsorted(first, start, "right") - 1
        inside = stop <= end[doc]
        who, start, stop, doc = who[inside], start[inside], stop[inside], doc[inside]
        asking: dict[int, list[int]] = {}
        for row, p in enumerate(map(tuple, phrases)):
            asking.setdefault(distinct[p], []).append(row)
    n_hit = np.zeros(docs.num_rows, np.int64)
    named: dict[int, set] = {}
    spans: dict[int, list] = {}
    if len(who):
        cover = np.zeros(int(end.max()) + 1, np.int32)
        np.add.at(cover, start, 1)
        np.add.at(cover, stop, -1)
        total = np.append(0, np.cumsum(np.cumsum(cover)[:-1] > 0))
        n_hit = total[end] - total[first]
        for d, w in set(zip(doc.tolist(), who.tolist())):
            named.setdefault(d, set()).update(items[r] for r in asking[w])
        if with_spans:
            for d, w, a, b in zip(doc.tolist(), who.tolist(), start.tolist(), stop.tolist()):
                spans.setdefault(d, []).extend({"first": a - int(first[d]), "end": b - int(first[d]), "item": items[r]} for r in asking[w])
    order = lambda s: sorted(s, key=lambda x: (x["first"], x["end"], x["item"] or ""))
    return pa.table([
        docs.column("doc_id").combine_chunks(), pa.array(n_words), pa.array(n_hit),
        pa.array([sorted(i for i in named.get(d, ()) if i is not None) for d in range(docs.num_rows)], _FOUND_TYPE.field(3).type),
        pa.array([order(spans.get(d, ())) for d in range(docs.num_rows)], _FOUND_TYPE.field(4).type),
    ], schema=_FOUND_TYPE)


def find_phrases(index: DataFrame, phrases: DataFrame, slop: int | None = None, with_spans: bool = True) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) of every document of a written ``positional_index``.

    ``phrases`` has (item, words). Without ``slop`` the words must stand side by side; with it, all of them must stand in
    any order in a stretch with at most ``slop`` other words (proximity), and only shortest stretches count. ``n_hit`` counts
    the words inside occurrences, ``items`` lists the items found, by their bytes, and ``spans`` has each occurrence as places
    in the document, end exclusive. Items without an id count in ``n_hit`` only.

    A phrase goes to the shards that hold its rarest word by the count over all shards, with the lists of its words only.
    """
    spark = index.sparkSession
    terms = phrases.select(F.explode("words").alias("w")).distinct().select(F.encode("w", "UTF-8").alias("word"))
    held = index.where("word is not null").join(terms, "word", "left_semi")  # the lists of words asked for
    totals = stash(held.groupBy("word").agg(F.sum("n").alias("total")))
    asked = stash(phrases.withColumn("phrase", F.monotonically_increasing_id()))
    each = asked.select("phrase", F.explode(F.array_distinct("words")).alias("w")).select("phrase", F.encode("w", "UTF-8").alias("word"))
    rated = each.join(totals, "word", "left")
    rarest = rated.groupBy("phrase").agg(F.min_by("word", F.struct(F.coalesce("total", F.lit(0)), "word")).alias("word"), F.count_if(F.col("total").isNull()).alias("lack"))
    rarest = rarest.where("lack = 0").select("phrase", "word")  # a word that no document has is in no occurrence
    sent = rarest.join(held.select("word", "shard"), "word").join(asked, "phrase")
    sent = sent.select(F.col("shard").alias("at"), "item", F.transform("words", lambda w: F.encode(w, "UTF-8")).alias("words"))
    docs = index.where("word is null").select("shard", "word", "n", "places", "doc_id", "first", F.lit(None).cast("long").alias("total"))
    lists = held.join(totals, "word").select("shard", "word", "n", "places", "doc_id", "first", "total")
    both = docs.unionByName(lists).groupBy("shard").cogroup(sent.groupBy("at"))
    return both.applyInArrow(lambda k, a, b: _search(k, a, b, slop, with_spans), _FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", slop: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) of every document: the passages it shares with a benchmark.

    Words are runs of digits, letters and characters beyond ASCII, A-Z in lower case. A passage is ``size`` words in a row of
    an item, or the whole of a shorter item. Null texts have no words; rows that share an id are judged each for itself, rows
    without one as well; an empty corpus gives an empty result, an empty benchmark no hits; repeated items count once by id.
    Very long texts are read whole. Other columns are not read.
    """
    index = stash(positional_index(docs, doc_id, text))
    out = stash(find_phrases(index, windows(benchmark, item_id, item_text, size), slop))
    discard(docs.sparkSession, index)
    return out


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) from ``contaminated``."""
    joined: Column = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
