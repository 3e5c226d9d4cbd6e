"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from netlens.llm.common import WORD, global_rank, stash

#: Sampling keys are whole numbers of LEVELS digits, each with DIGIT values.
LEVELS, DIGIT = 4, 1024


def text_weight(text: Column) -> Column:
    """Quality weight in (0, 1] of a text: its share of letters and blanks, from 0.1 on."""
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\s]+", ""))
    return F.coalesce(0.1 + 0.9 * plain / F.nullif(F.length(text), F.lit(0)), F.lit(0.1))


def sampling_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """1 - u^(1/weight) as a whole number, u uniform from a hash of the id: the smaller, the earlier it is drawn.

    It orders as the exponential variable -ln(u)/weight does.
    """
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 12), 16, 10).cast("double") + 0.5) / 2.0**48
    return F.least(F.floor((1 - F.pow(u, 1 / weight)) * float(DIGIT**LEVELS)), F.lit(DIGIT**LEVELS - 1)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): sources by code point, nulls last, weigh ``weights`` in turn.

    Targets stop at ``most`` times the source's size; the excess goes to the others by weight, round by
    round, until none is above. A round is one sum over the table of sources; all sources end at their
    stop where share > most.
    """
    ranked = global_rank(sizes, [F.col("source").asc_nulls_last()])
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    t = stash(ranked.select("source", "source_size", turn.alias("w"), (F.col("source_size") * most).alias("stop")))
    total = t.agg(F.sum("source_size")).first()[0] or 0
    rate, stopped = None, -1
    while True:
        full = F.lit(False) if rate is None else F.col("w") * rate >= F.col("stop")
        n, w, c = t.agg(F.count_if(full), F.sum(F.when(~full, F.col("w"))), F.sum(F.when(full, F.col("stop")))).first()
        if n == stopped or w is None:
            break
        rate, stopped = (share * total - (c or 0.0)) / w, n
    aim = F.col("stop") if rate is None else F.least(F.col("stop"), F.col("w") * rate)
    return t.select("source", "source_size", aim.alias("target"))


def mix_sources(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None,
    weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 11,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every row.

    A source gives as many complete epochs as fit its target; the rest is drawn by weight without
    replacement, in the order of the keys, until the sum of sizes meets the budget. ``taken`` counts words,
    so the last document drawn is taken in part; ``copies`` counts whole documents, that last one where
    over half of it is taken. Sums by digits of the key find the place where the budget ends, so that
    only rows of one key value are ever sorted by themselves.

    Null and blank texts have size 0 and take part in the draw without effect. Null sources are one source. Rows
    with equal keys follow by id and size; equal rows are alike. An empty table gives an empty result.
    ``weight`` is a column of ``docs`` above 0 (null: 0.1); without it the text's share of letters counts.
    """
    w = text_weight(F.col(text)) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(0.1)), F.lit(1e-6))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = stash(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), sampling_key(F.col(doc_id), w, seed).alias("x")))
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long")
    plan = stash(plan.withColumn("epochs", epochs).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("key", F.struct("source")))

    # the key, digit by digit, at which each source's budget ends; `before` is what smaller keys take
    ends = plan.select("key", "budget", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("before"))
    for level in range(1, LEVELS + 1):
        unit = DIGIT ** (LEVELS - level)
        cells = rows.select(F.struct("source").alias("key"), F.floor(F.col("x") / unit).alias("cell"), "size")
        cells = cells.join(ends, "key").where(F.floor(F.col("cell") / DIGIT) == F.col("at")).groupBy("key", "cell").agg(
            F.sum("size").alias("s"), F.first("budget").alias("budget"), F.first("before").alias("before"))
        upto = F.col("before") + F.sum("s").over(Window.partitionBy("key").orderBy("cell"))
        cells = cells.withColumn("upto", upto)
        # the first cell that reaches the budget, or the last one where none does
        step = cells.groupBy("key").agg(
            F.coalesce(F.min(F.when(F.col("upto") >= F.col("budget"), F.col("cell"))), F.max("cell")).alias("at"), F.first("budget").alias("budget"))
        ends = stash(step.join(cells.select("key", F.col("cell").alias("at"), (F.col("upto") - F.col("s")).alias("before")), ["key", "at"]).select("key", "budget", "at", "before"))

    ends = ends.select("key", "at", "before").join(plan, "key")
    here = rows.withColumn("key", F.struct("source")).join(ends.drop("source"), "key")
    tie = here.where("x = at")
    order = Window.partitionBy("key").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    tie = tie.withColumn("start", F.col("before") + F.sum("size").over(order) - F.col("size"))
    part = F.least(F.greatest(F.col("budget") - F.col("start"), F.lit(0.0)), F.col("size").cast("double"))
    tie = tie.withColumn("part", F.round(part).cast("long"))
    rest = here.where("x <> at").withColumn("part", F.when(F.col("x") < F.col("at"), F.col("size")).otherwise(F.lit(0).cast("long")))
    cols = ["doc_id", "size", "source_size", "target", "epochs", "part", "x", "at"]
    out = rest.select(*cols).union(tie.select(*cols))
    whole = F.when(F.col("size") > 0, (2 * F.col("part") > F.col("size")).cast("long")).otherwise((F.col("x") < F.col("at")).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), (F.col("epochs") + whole).alias("copies"))
