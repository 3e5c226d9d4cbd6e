"""License scans: winnowed fingerprints of templates find candidates, banded alignment measures them."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

# Notices and texts as their publishers word them.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
}

_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Index:
    """Inverted index of the templates: fingerprint -> (template, word position). As large as the templates."""

    names: list[str]
    words: list[np.ndarray]
    keys: np.ndarray
    template: np.ndarray
    at: np.ndarray
    first: np.ndarray
    gram: int


def hash_words(words: list[str], known: dict[str, int]) -> np.ndarray:
    def one(w: str) -> int:
        h = known.get(w)
        if h is None:
            if len(known) > 200_000:
                known.clear()
            h = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h

    return np.fromiter(map(one, words), np.uint64, len(words))


def fingerprints(h: np.ndarray, gram: int) -> np.ndarray:
    out = np.zeros(max(len(h) - gram + 1, 0), np.uint64)
    for i in range(gram):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - gram + 1 + i]
    return out ^ (out >> np.uint64(31))


def winnow(f: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest fingerprint of each window, the rightmost of equals; any run of window + gram - 1 words holds one."""
    n = max(len(f) - window + 1, 1)
    return np.unique([i + w - 1 - int(f[i : i + w][::-1].argmin()) for i in range(n) for w in [len(f[i : i + window])] if w])


def build_index(templates: Mapping[str, str], gram: int = 3, window: int = 3) -> Index:
    """Templates shorter than ``gram`` words cannot be found and are an error."""
    names, words, keys, template, at = list(templates), [], [], [], []
    for k, name in enumerate(names):
        h = hash_words(_WORD.findall(templates[name].lower()), {})
        if len(h) < gram:
            raise ValueError(f"template {name} has under {gram} words")
        f = fingerprints(h, gram)
        words.append(h)
        for i in winnow(f, window).astype(int):
            keys.append(f[i])
            template.append(k)
            at.append(i)
    keys_, order = np.array(keys, np.uint64), np.argsort(np.array(keys, np.uint64), kind="stable")
    return Index(names, words, keys_[order], np.array(template)[order], np.array(at)[order], np.unique(keys_), gram)


def _better(path: tuple[int, int, int]) -> tuple[int, int, int]:
    """More matches first, then the later start, then the earlier end."""
    return path[0], -path[1], -path[2]


def align(template: np.ndarray, doc: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """(matches, first, last + 1 in ``doc``): most equal words in order, within ``band`` of the diagonal, fewest words spanned.

    ``doc[i + shift]`` stands against ``template[i]``; the alignment may begin and end anywhere.
    """
    width = 2 * band + 1
    none = (0, 0, 0)  # (matches, -first, end) of the best path so far
    row = [none] * (width + 1)
    for i, w in enumerate(template.tolist()):
        new = [none] * (width + 1)
        for k in range(width):
            j = i + shift + k - band
            # row[k] is one word up the diagonal, row[k + 1] leaves out a template word, new[k - 1] a document word
            cand = max(row[k + 1], new[k - 1] if k else none, key=_better)
            if 0 <= j < len(doc) and doc[j] == w:
                before = row[k]
                cand = max(cand, (before[0] + 1, before[1] if before[0] else -j, j + 1), key=_better)
            new[k] = cand
        row = new
    best = max(row, key=_better)
    return best[0], -best[1], best[2]


def scan(text: str, index: Index, least: float, band: int, known: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(license, matched words, template words, start, end) in code points, best first where matches overlap, then by start."""
    words = _WORD.findall(text.lower())
    h = hash_words(words, known)
    f = fingerprints(h, index.gram)
    hit = np.flatnonzero(np.isin(f, index.first))
    if not len(hit):
        return []
    lo, hi = np.searchsorted(index.keys, f[hit], "left"), np.searchsorted(index.keys, f[hit], "right")
    seeds = sorted({(int(index.template[e]), int(p - index.at[e])) for p, a, b in zip(hit, lo, hi) for e in range(a, b)})
    found, last = [], (-1, 0)
    for k, shift in seeds:
        t = index.words[k]
        side = min(band, len(t) // 2)  # so that a short notice and the next one are two places
        if last[0] == k and shift - last[1] <= side // 2:  # the same place a few words on
            continue
        last = (k, shift)
        from_ = max(0, shift - side)
        part = h[from_ : max(0, shift + len(t) + side)]
        n, a, b = align(t, part, shift - from_, side)
        if n >= least * len(t):
            found.append((n, k, a + from_, b + from_))
    if not found:
        return []
    # a lowered text can differ in length from the text, so places come from the text itself
    spans = [m.span() for m in _WORD.finditer(text)]
    if len(spans) != len(words):
        spans = [m.span() for m in _WORD.finditer(text.lower())]
    out: list[tuple] = []
    taken: list[tuple[int, int]] = []
    for n, k, a, b in sorted(found, key=lambda x: (-x[0], x[2], x[1])):
        if all(b <= p or a >= q for p, q in taken):
            taken.append((a, b))
            out.append((index.names[k], n, len(index.words[k]), spans[a][0], spans[b - 1][1]))
    return sorted(out, key=lambda x: x[3])


_OUT = "doc_id long, license string, matched_words long, template_words long, coverage double, start long, end long"


def license_scan(
    docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, doc_id: str = "doc_id", text: str = "text", least: float = 0.8, band: int = 16, gram: int = 3, window: int = 3,
) -> DataFrame:
    """(doc_id, license, matched_words, template_words, coverage, start, end): a row for each place where a template stands.

    Words are runs of letters and digits in lower case. Templates are cut to winnowed fingerprints of ``gram`` words; all
    n-grams of every document are looked up, so each run of ``gram + window - 1`` words shared with a template is seen.
    A place is reported where an alignment within ``band`` words, or half the template, of a seed's diagonal matches ``least`` of the template;
    of overlapping places the one with most words stays. Null and empty texts have no rows; rows that repeat, or have a
    null id, are scanned each for itself; other columns are not read. Each row is handled by itself: nothing is shuffled.
    """
    index = build_index(templates, gram, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += [(i, name, n, m, n / m, s, e) for name, n, m, s, e in (scan(t, index, least, band, known) if t else [])]
            cols = list(zip(*rows)) or [()] * 7
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            names = ["doc_id", "license", "matched_words", "template_words", "coverage", "start", "end"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, _OUT)
