"""Quality rules whose cutoffs come from the corpus: fences from quantile sketches per language and source.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from netlens.llm.common import cell_floor, cell_of, stash, words


@dataclass(frozen=True)
class Rules:
    """Parameters of the adaptive rules.

    A document is an outlier when a figure lies beyond its group's upper fence
    ``q75 + width * max(q75 - q25, least spread)`` or, for word length, below the lower one.
    Groups with under ``support`` documents take the fences of their language, then of all.
    Spreads are in the units of FIGURES.
    """

    width: int = 3
    support: int = 200
    symbols: int = 60
    word_length: int = 60
    repeats: int = 150
    dup_lines: int = 150
    capitals: int = 60


#: name -> (numerator, denominator, scale)
FIGURES = {
    "symbols": ("n_symbols", "n_words", 1000),
    "word_length": ("word_chars", "n_words", 100),
    "repeats": ("n_repeat_words", "n_words", 1000),
    "dup_lines": ("n_dup_lines", "n_lines", 1000),
    "capitals": ("n_capitals", "word_chars", 1000),
}


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The counts of each text, one row in, one row out; nothing is shuffled.

    A null text has no words and all counts 0. A word is in ``n_repeat_words`` when it stands in a
    window of three words that the text holds twice or more. Windows are compared by a 64 bit hash.
    Repeated rows are measured each for itself. Memory of a row: about 100 bytes a word.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"),
        words(F.col(text)).alias("_w"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    rows = rows.select(
        "doc_id", "lang", "source", "n_symbols", "n_capitals",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.slice(
            F.transform("_w", lambda w, i: F.xxhash64(w, F.get(F.col("_w"), i + 1), F.get(F.col("_w"), i + 2))),
            F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0)),
        ).alias("_h"),
    )
    # only texts that hold some window twice go on to the sort
    rows = rows.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    same = lambda x, k: (F.get(F.col("_s"), k - 1)["h"] == x["h"]) | (F.get(F.col("_s"), k + 1)["h"] == x["h"])
    rows = rows.withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("_p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get(F.col("_p"), k + 1) - x, F.lit(3)))),
        F.lit(0), lambda a, x: a + x,
    )
    return rows.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"), "n_lines", "n_capitals",
    )


def figure(name: str) -> Column:
    top, bottom, scale = FIGURES[name]
    return F.when(F.col(bottom) > 0, F.floor(F.col(top) * scale / F.col(bottom))).otherwise(0).cast("long")


def fences(measured: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per (lang, source): the fences of each figure, from mergeable sketches of its group.

    The sketch of a group is its count per cell of each figure; sketches of sources add up to that of
    the language, those of languages to that of all. Texts without words are in none of them.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("figure"), cell_of(figure(n)).alias("cell")) for n in FIGURES])).alias("f")
    group = F.struct("lang", "source").alias("g")
    cells = stash(measured.where("n_words > 0").select(group, each).groupBy("g", "f").count())
    leaf = cells.select("g.lang", "g.source", "f.figure", "f.cell", "count")
    levels = [["lang", "source"], ["lang"], []]
    tables = []
    for keys in levels:
        part = leaf.groupBy(*keys, "figure", "cell").agg(F.sum("count").alias("n"))
        w = Window.partitionBy(*keys, "figure")
        part = part.withColumn("upto", F.sum("n").over(w.orderBy("cell"))).withColumn("all", F.sum("n").over(w))
        quarter = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("all"), F.col("cell")))
        q = part.groupBy(*keys, "figure").agg(quarter(1).alias("q1"), quarter(3).alias("q3"), F.max("all").alias("n"))
        q = q.select(*keys, "figure", cell_floor(F.col("q1")).alias("q1"), cell_floor(F.col("q3")).alias("q3"), "n")
        least = F.create_map(*[x for n in FIGURES for x in (F.lit(n), F.lit(getattr(rules, n)))])[F.col("figure")]
        spread = F.greatest(F.col("q3") - F.col("q1"), least) * rules.width
        q = q.withColumn("hi", F.col("q3") + spread).withColumn("lo", F.col("q1") - spread)
        name = "_".join(["at", *keys])
        tables.append(q.groupBy(*keys).agg(
            F.max("n").alias(f"{name}_n"),
            *[F.max(F.when(F.col("figure") == n, F.col(s))).alias(f"{name}_{s}_{n}") for n in FIGURES for s in ("lo", "hi")],
        ))
    out, by_lang, overall = tables
    out = out.join(by_lang.withColumnRenamed("lang", "l2"), F.col("lang").eqNullSafe(F.col("l2")), "left").drop("l2")
    out = out.join(F.broadcast(overall))  # one row
    pick = lambda s: F.when(F.col("at_lang_source_n") >= rules.support, F.col(f"at_lang_source_{s}")).when(F.col("at_lang_n") >= rules.support, F.col(f"at_lang_{s}")).otherwise(F.col(f"at_{s}"))
    return out.select("lang", "source", *[pick(f"{s}_{n}").alias(f"{s}_{n}") for n in FIGURES for s in ("lo", "hi")])


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", rules: Rules = Rules()) -> DataFrame:
    """Counts, base verdict and final verdict of every document.

    ``base_failed``: under 50 words, or more than half of the words in repeated windows. ``kept``: not
    base_failed, and no figure beyond the fences of its language and source. Null languages and sources
    are groups of their own; a null text fails; an empty table gives an empty result; rows that repeat
    are judged each for itself; other columns are not read, so clashing names do no harm.
    """
    m = stash(measure(docs, doc_id, text, lang, source))
    f = fences(m, rules).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    beyond = F.lit(False)
    for n in FIGURES:
        beyond = beyond | F.coalesce(figure(n) > F.col(f"hi_{n}"), F.lit(False))
    beyond = beyond | F.coalesce(figure("word_length") < F.col("lo_word_length"), F.lit(False))
    joined = m.join(f, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~beyond).alias("kept"),
    )
