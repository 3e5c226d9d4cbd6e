"""Dataset construction: leak-free partitions, gates, audits, summaries."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from netlens.functions.columns import idiv, in_scope, safe_ratio
from netlens.operators.core import SECOND, materialize, previous, quantiles, to_long

# Fixed value: the cyclic pattern of time blocks.
PATTERN = ("train", "train", "validation", "train", "test")
GUARD = "descartada_guarda"
SETS = ("train", "validation", "test")
DUPLICATE_TOLERANCE = 0.02
REPORT_LIMIT = 100


# --- partitions ------------------------------------------------------------------------

def partition_blocks(rows: DataFrame, ts: str, block_us: int = 7200 * SECOND, guard_us: int = 60 * SECOND) -> DataFrame:
    """Assign time blocks cyclically; the head of every block but the first is a guard band."""
    span = rows.agg(F.min(ts).alias("_t0"), F.max(ts).alias("_t1"))
    x = rows.join(F.broadcast(span))  # one row
    blocks = F.greatest(F.lit(1).cast("long"), idiv(F.col("_t1") - F.col("_t0") + block_us - 1, block_us))
    index = F.least(idiv(F.col(ts) - F.col("_t0"), block_us), blocks - 1)
    into = F.col(ts) - F.col("_t0") - index * block_us
    name = F.element_at(F.array(*map(F.lit, PATTERN)), (F.pmod(index, F.lit(len(PATTERN))) + 1).cast("int"))
    part = F.when((index > 0) & (into < guard_us), F.lit(GUARD)).otherwise(name)
    return x.withColumn("partition", part).drop("_t0", "_t1")


def partition_report(rows: DataFrame, ts: str, block_us: int) -> DataFrame:
    """Counts per set with the hours covered, blocks, and the empty sets with a likely reason."""
    n = {p: F.count_if(F.col("partition") == p).alias(p) for p in (*SETS, GUARD)}
    hours = (F.max(ts) - F.min(ts)) / (3600 * SECOND)
    x = rows.agg(F.count(F.lit(1)).alias("rows"), *n.values(), F.round(hours, 2).alias("hours"),
                 F.greatest(F.lit(1).cast("long"), idiv(F.max(ts) - F.min(ts) + block_us - 1, block_us)).alias("blocks"))
    empty = F.array_join(F.array_compact(F.array(*[F.when(F.col(p) == 0, F.lit(p)) for p in SETS])), ",")
    x = x.withColumn("empty_sets", empty)
    why = F.when(F.col("empty_sets") == "", "").when(F.col("blocks") < len(PATTERN), "too few blocks for the pattern").otherwise("check the pattern")
    return x.withColumn("reason", why)


def check_leak(rows: DataFrame, ts: str, guard_us: int, slice_us: int, tie: str = "row_id") -> DataFrame:
    """Neighbours in time that belong to different sets and are closer than the guard."""
    x = rows.where(F.col("partition") != GUARD).withColumn("_k", F.lit(0))
    x = previous(x, ["_k"], [ts, "partition", tie], {ts: "prev_ts", "partition": "prev_partition"}, ts, slice_us)
    return x.where((F.col("prev_partition") != F.col("partition")) & (F.col(ts) - F.col("prev_ts") < guard_us)).drop("_k")


def first_leaks(leaks: DataFrame, ts: str, n: int = 5) -> DataFrame:
    """The report names the first few only."""
    return leaks.orderBy(ts).limit(n)


# --- assembly and gates --------------------------------------------------------------------

def fail_if(df: DataFrame, bad: Column, message: str) -> DataFrame:
    """Rows unchanged; the job fails on the first row for which ``bad`` holds."""
    return df.where(F.when(bad, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))


def assemble(features: DataFrame, partition_map: DataFrame, label: str) -> DataFrame:
    """Eligible rows with the partition of their episode.

    An episode missing from the map, or mapped twice, fails the job.
    """
    m = partition_map.groupBy("episode_id").agg(F.count_distinct("partition").alias("_n"), F.min("partition").alias("partition"))
    m = fail_if(m, F.col("_n") > 1, "episode in two partitions").drop("_n")
    x = features.where("eligible").join(m, "episode_id", "left")
    return fail_if(x, F.col("partition").isNull(), "episode without partition").withColumn("label", F.lit(label))


def fingerprint(names: list[str]) -> Column:
    """Exact identity of a feature vector (decimal text, so 1.0 and 1 agree)."""
    return F.concat_ws("|", *[F.coalesce(F.col(n).cast("decimal(38,18)").cast("string"), F.lit("~")) for n in names])


def duplicate_groups(rows: DataFrame, names: list[str]) -> DataFrame:
    """Vectors that occur more than once, with how many labels and partitions they touch."""
    g = rows.groupBy(fingerprint(names).alias("vector")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("labels"), F.count_distinct("partition").alias("partitions"))
    return g.where("n > 1")


def audit(rows: DataFrame, names: list[str], declared_constant: list[str]) -> DataFrame:
    """Long report (check, value, ok) of a dataset."""
    c = F.col
    wide = rows.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(c(n).isNull()).alias(f"missing:{n}") for n in names],
        *[(F.count_distinct(n) + F.max(c(n).isNull().cast("int"))).alias(f"distinct:{n}") for n in names],
        F.count_if(~c("label").isin("normal", "anomaly") | c("label").isNull()).alias("bad_labels"),
        F.count_if(~c("partition").isin(*SETS) | c("partition").isNull()).alias("bad_partitions"),
    )
    dup = duplicate_groups(rows, names).agg(
        F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("involved"),
        F.count_if(c("labels") > 1).alias("cross_label"), F.count_if(c("partitions") > 1).alias("cross_partition"))
    split = rows.groupBy("episode_id").agg(F.count_distinct("partition").alias("p")).agg(F.count_if(c("p") > 1).alias("split"))
    x = wide.join(F.broadcast(dup)).join(F.broadcast(split))  # one row each
    const = [F.when((c(f"`distinct:{n}`") <= 1) & F.lit(n not in declared_constant), 1).otherwise(0) for n in names]
    excess = c("involved") - c("groups")
    missing = reduce(lambda a, b: a + b, [c(f"`missing:{n}`") for n in names])
    items = [
        ("rows", c("rows"), F.lit(True)), ("missing_values", missing, missing == 0),
        *[(f"missing:{n}", c(f"`missing:{n}`"), c(f"`missing:{n}`") == 0) for n in names],
        ("undeclared_constants", sum(const[1:], const[0]), sum(const[1:], const[0]) == 0),
        ("duplicate_groups", c("groups"), F.lit(True)), ("duplicate_rows_involved", c("involved"), F.lit(True)), ("duplicate_excess", excess, F.lit(True)),
        ("duplicate_excess_ratio", F.round(safe_ratio(excess, c("rows")), 6), F.round(safe_ratio(excess, c("rows")), 6) <= DUPLICATE_TOLERANCE),
        ("duplicates_crossing_label", c("cross_label"), c("cross_label") == 0), ("duplicates_crossing_partition", c("cross_partition"), c("cross_partition") == 0),
        ("episodes_split", c("split"), c("split") == 0), ("invalid_labels", c("bad_labels"), c("bad_labels") == 0), ("invalid_partitions", c("bad_partitions"), c("bad_partitions") == 0),
    ]
    return x.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), v.cast("double").alias("value"), ok.alias("ok")) for n, v, ok in items])))


def validate_rows(rows: DataFrame, names: list[str], ratios: list[str], scope: str, key: list[str]) -> DataFrame:
    """Every row with the list of rules it breaks (empty = it may enter the dataset)."""
    c = F.col
    finite = lambda n: c(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    checks = [
        *[F.when(~finite(n), F.lit(f"{n}: not finite")).when(c(n) < 0, F.lit(f"{n}: negative")) for n in names],
        *[F.when(c(n) > 1, F.lit(f"{n}: ratio above 1")) for n in ratios],
        F.when(c("history_s") < 60, "history below 60 s"), F.when(c("window_us").isNull(), "window without time"),
        F.when(~in_scope(c("entity_ip"), scope), "outside the network"), F.when(~c("eligible"), "not eligible"),
    ]
    repeated = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    x = rows.join(repeated, key, "left")
    return x.withColumn("reasons", F.array_compact(F.array(*checks, F.when(c("_n") > 1, "repeated window")))).drop("_n")


def reconcile(ledgers: DataFrame, manifests: DataFrame, reports: DataFrame, rows: DataFrame) -> DataFrame:
    """Do ledger, manifest, report and rows of a campaign tell the same story?

    ledgers: campaign_id, purpose, rows_declared, output_hash, cell. manifests: campaign_id,
    status, complete, failures, drops, captured, parsed, records, expected. reports:
    campaign_id, rows_valid, partition. rows: campaign_id, partition.
    """
    c = F.col
    n = rows.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("partition").alias("n_parts"), F.min("partition").alias("row_partition"))
    has = lambda df, flag: df.withColumn(flag, F.lit(True))
    x = has(ledgers, "_l").join(has(manifests, "_m"), "campaign_id", "full_outer").join(has(reports, "_r"), "campaign_id", "full_outer").join(n, "campaign_id", "left")
    owner = lambda col, name: ledgers.where(c("purpose") == "experiment").groupBy(col).agg(F.min("campaign_id").alias(name))
    x = x.join(owner("cell", "_cell_owner"), "cell", "left").join(owner("output_hash", "_hash_owner"), "output_hash", "left")
    rules = [
        F.when(c("_l").isNull(), "no ledger"), F.when(c("_m").isNull(), "no manifest"), F.when(c("_r").isNull(), "no report"),
        F.when(c("purpose") != "experiment", "not an experiment"), F.when(c("status") != "completed", "manifest not completed"),
        F.when(~c("complete") | (c("failures") > 0) | (c("drops") > 0), "evidence incomplete"),
        F.when(c("captured") != c("parsed"), "captured and parsed packets differ"), F.when(c("records") != c("expected"), "event records differ"),
        F.when(c("rows_declared") != F.coalesce("n_rows", F.lit(0)), "ledger and rows differ"), F.when(c("rows_valid") != F.coalesce("n_rows", F.lit(0)), "report and rows differ"),
        F.when(c("n_parts") > 1, "rows in several partitions"), F.when(c("row_partition") != c("partition"), "partition differs from the report"),
        F.when(c("_cell_owner") != c("campaign_id"), "cell already claimed"), F.when(c("_hash_owner") != c("campaign_id"), "output repeated"),
    ]
    return x.select("campaign_id", F.array_compact(F.array(*rules)).alias("reasons")).withColumn("accepted", F.size("reasons") == 0)


def cells(profiles: DataFrame, repetitions: int, accepted: DataFrame) -> DataFrame:
    """Expected (profile, repetition) cells that nobody filled, and those claimed twice."""
    expected = profiles.select("profile").distinct().select("profile", F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("repetition"))
    keys = ["profile", "repetition"]
    missing = expected.join(accepted, keys, "left_anti").select(*keys, F.lit("missing").alias("state"), F.lit(0).cast("long").alias("claims"))
    twice = accepted.groupBy(*keys).agg(F.count(F.lit(1)).alias("claims")).where("claims > 1").select(*keys, F.lit("claimed again").alias("state"), "claims")
    return missing.unionByName(twice)


def duplicate_vectors(rows: DataFrame, names: list[str], order: list[str]) -> DataFrame:
    """Rows whose vector first appeared in another campaign, with that owner.

    The first owner comes from a map-side combined minimum, joined back.
    """
    x = rows.withColumn("vector", fingerprint(names))
    first = x.groupBy("vector").agg(F.min_by(F.struct("campaign_id", "partition"), F.struct(*order)).alias("o"), F.count(F.lit(1)).alias("c")).where("c > 1")
    y = x.join(first, "vector").where(F.col("o.campaign_id") != F.col("campaign_id"))
    return y.select(*order, F.col("o.campaign_id").alias("first_campaign"), F.col("o.partition").alias("first_partition"), "campaign_id", "partition",
                    (F.col("o.partition") != F.col("partition")).alias("cross_partition"))


def duplicate_report(duplicates: DataFrame, order: list[str], n: int = REPORT_LIMIT) -> DataFrame:
    return duplicates.orderBy(*order).limit(n)


def build_dataset(rows: DataFrame, verdicts: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of accepted campaigns only, in contract column order."""
    return rows.join(verdicts.where("accepted").select("campaign_id"), "campaign_id", "left_semi").select(*columns)


# --- summaries ------------------------------------------------------------------------------------

def repetition_summary(rows: DataFrame, names: list[str]) -> DataFrame:
    """Per feature: range, mean, median, distinct values, zero rows, campaigns with any non-zero."""
    long = to_long(rows, ["campaign_id"], names)
    agg = long.groupBy("feature").agg(
        F.round(F.min("value"), 8).alias("minimum"), F.round(F.max("value"), 8).alias("maximum"), F.round(F.avg("value"), 8).alias("mean"),
        F.count_distinct("value").alias("distinct_values"), F.count_if(F.col("value") == 0).alias("zero_rows"), F.count_if(F.col("value") != 0).alias("nonzero_rows"),
        F.count_distinct(F.when(F.col("value") != 0, F.col("campaign_id"))).alias("nonzero_campaigns"),
    )
    return agg.join(quantiles(long, ["feature"], "value", {"median": (0.5, "linear")}), "feature")


def campaign_shares(rows: DataFrame) -> DataFrame:
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    n = rows.groupBy("campaign_id").agg(F.count(F.lit(1)).alias("rows"))
    return n.join(F.broadcast(total)).select("campaign_id", "rows", F.round(F.col("rows") / F.col("total"), 8).alias("row_share"))  # one row


def dataset_summary(rows: DataFrame, names: list[str]) -> DataFrame:
    """Features (min, max, mean) and partitions (rows, episodes) in one long report."""
    f = to_long(rows, [], names).groupBy("feature").agg(F.round(F.min("value"), 6).alias("a"), F.round(F.max("value"), 6).alias("b"), F.round(F.avg("value"), 6).alias("c"))
    p = rows.groupBy("partition").agg(F.count(F.lit(1)).cast("double").alias("a"), F.count_distinct("episode_id").cast("double").alias("b"))
    return f.select(F.lit("feature").alias("section"), F.col("feature").alias("name"), "a", "b", "c").unionByName(
        p.select(F.lit("partition").alias("section"), F.col("partition").alias("name"), "a", "b", F.lit(None).cast("double").alias("c")))


def scope_candidates(rows: DataFrame, total_windows: int | Column) -> DataFrame:
    """Entities that look like infrastructure: presence, many peers, many protocols, address."""
    total = total_windows if isinstance(total_windows, Column) else F.lit(total_windows)
    n = rows.groupBy("entity_ip").agg(F.count(F.lit(1)).alias("windows"))
    m = n
    for c, name in (("unique_dst_ip_ratio_30s", "dst"), ("protocol_diversity_30s", "proto")):
        m = m.join(quantiles(rows, ["entity_ip"], c, {name: (0.5, "linear")}), "entity_ip", "left")
    last = F.element_at(F.split("entity_ip", r"\."), -1)
    presence = safe_ratio(F.col("windows"), total)
    points = (
        F.when(presence > 0.9, 2).otherwise(0) + F.when(F.col("dst") > 0.5, 2).otherwise(0)
        + F.when(F.col("proto") > 0.05, 1).otherwise(0) + F.when(last.isin("1", "2", "254"), 1).otherwise(0)
    )
    m = m.withColumns({"presence": F.round(presence, 3), "points": points})
    verdict = F.when(F.col("points") >= 3, "infraestructura_probable").when(F.col("points") >= 1, "indeterminado").otherwise("cliente")
    return m.withColumn("verdict", verdict).drop("dst", "proto")


def reconcile_counts(rows: DataFrame) -> DataFrame:
    """physical = excluded + guard + train + validation + test, with the difference."""
    c = F.col
    usable = c("eligible")
    x = rows.agg(
        F.count(F.lit(1)).alias("physical"), F.count_if(~usable).alias("excluded"), F.count_if(usable & (c("partition") == GUARD)).alias("guard"),
        *[F.count_if(usable & (c("partition") == p)).alias(p) for p in SETS])
    gap = c("physical") - c("excluded") - c("guard") - c("train") - c("validation") - c("test")
    return x.withColumn("difference", gap).withColumn("balanced", c("difference") == 0)


def episode_mean(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.groupBy("episode_id").agg(*[F.avg(n).alias(n) for n in names])


def collapse(rows: DataFrame, names: list[str], order: list[str]) -> DataFrame:
    """One row per exact vector, the first in order."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")
    return rows.groupBy(fingerprint(names).alias("vector")).agg(first).select("r.*")


def episode_weights(rows: DataFrame) -> DataFrame:
    """Each row weighs one over the size of its episode (joined counts, not a window)."""
    n = rows.groupBy("episode_id").agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(n, "episode_id").withColumn("weight", 1.0 / F.col("_n")).drop("_n")


def _prime_powers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, power) of each prime of each size, by trial division."""
    for b in batches:
        out: list[tuple[int, int]] = []
        for n in b.column(0).to_pylist():
            p = 2
            while n > 1:
                if p * p > n:
                    p = n
                power = 1
                while n % p == 0:
                    n, power = n // p, power * p
                if power > 1:
                    out.append((p, power))
                p += 1
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["p", "power"])


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(episode size, common multiple) -> how often a row of such an episode counts."""
    kind = pa.decimal128(38, 0)
    for b in batches:
        sizes, common = b.column(0).to_pylist(), b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([Decimal(int(c) // n) for n, c in zip(sizes, common)], kind)], names=["_n", "copies"])


def balance_lcm(rows: DataFrame) -> DataFrame:
    """Rows with ``copies``: how often each counts, so that every episode counts the same number (the LCM of the sizes).

    The LCM has the largest power of each prime over the distinct sizes; it and the copies are exact decimals, and an LCM of
    more than 38 digits is an error. Rows are not repeated: whoever needs them so expands ``copies``.
    """
    n = rows.groupBy("episode_id").agg(F.count(F.lit(1)).alias("_n"))
    sizes = materialize(n).select("_n").distinct()
    powers = sizes.mapInArrow(_prime_powers, "p long, power long").groupBy("p").agg(F.max("power").alias("power"))
    wide = "decimal(38,0)"
    # an LCM in range has less than forty prime powers, whatever the number of episodes
    common = powers.agg(F.aggregate(F.collect_list("power"), F.lit(1).cast(wide), lambda a, x: (a * x).cast(wide)).alias("common"))
    copies = sizes.join(F.broadcast(common)).mapInArrow(_copies, f"_n long, copies {wide}")
    return rows.join(n, "episode_id").join(copies, "_n").drop("_n")


def duration_distribution(rows: DataFrame, value: str, cuts: list[float]) -> DataFrame:
    """Order statistics and tail fractions of a duration, for all rows and for training."""
    x = rows.select(F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("partition") == "train", "train")))).alias("population"), value)
    ps = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    q = quantiles(x, ["population"], value, {n: (p, "trunc") for n, p in ps.items()})
    frac = lambda cond: F.round(F.count_if(cond) / F.count(F.lit(1)), 5)
    n = x.groupBy("population").agg(
        F.count(F.lit(1)).alias("n"), F.max(value).alias("max"), *[frac(F.col(value) > c).alias(f"above_{str(c).replace('.', '_')}") for c in cuts],
        frac(F.col(value) == 0).alias("zero"))
    return n.join(q, "population")
