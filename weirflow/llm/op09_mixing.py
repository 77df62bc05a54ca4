"""Mixing sources to target weights by weighted fair queueing.

Every document gets a virtual finish time, the tokens its source has sent once
the document is through, divided by the source's target weight. Documents are
shuffled within their source by a seeded hash; a source may be sent several
times (epochs). All finish times are then ordered globally and the order is cut
at the total budget.

Nothing here needs all rows of a source in one task: running sums are taken in
two levels, hash ranges of a source first and rows of a range after, and the
global order is cut by way of sums over ranges of finish times; only the range
that holds the cut is ordered row by row (again by ranges, see `_cut`).

Defined results: a null text has size 0; a null source is a source of its own,
last in order; rows that repeat are documents of their own; documents of size 0
are never taken; an empty table gives an empty result. Columns other than the
named ones pass through the operator untouched, also when named like its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, stored, table

#: Prefix of working columns, which no column of the input has.
P = "__mix_"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share=(3, 2), repeats: int = 2) -> DataFrame:
    """(source, source_size) -> (source, source_size, target), one row a source.

    Sources in code point order, null last, have the weights in turn. The
    budget share[0]/share[1] * all sizes is dealt by weight; no target passes
    repeats * source_size, and what that frees is dealt again by weight. The
    end of that process is target = min(cap, level * weight): with sources in
    order of cap / weight the first k are at their cap for the least k whose
    level keeps the rest below theirs, so one ordered pass over the (small)
    table of sources finds it. Where all caps together are below the budget,
    every source is at its cap.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by_fill = W.orderBy(F.col("cap") / F.col("w"), F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_fill.rowsBetween(W.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(0, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    dealt = (
        sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn.cast("int")))
        .withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share[0])) / F.lit(float(share[1])))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    )
    # The first source in order of cap / weight that its level does not fill sets the level of all.
    level = F.min(F.when(F.col("level") * F.col("w") < F.col("cap"), F.col("place"))).over(everything)
    placed = dealt.withColumn("place", F.row_number().over(by_fill)).withColumn("first", level)
    held = F.max(F.when(F.col("place") == F.col("first"), F.col("level"))).over(everything)
    return placed.withColumn("held", held).select(
        "source",
        "source_size",
        F.when(F.col("first").isNull() | (F.col("place") < F.col("first")), F.col("cap")).otherwise(F.col("held") * F.col("w")).alias("target"),
    )


def mix(docs: DataFrame, size: Column, source: Column, seed: int = 7, weights=(3, 1, 2), share=(3, 2), repeats: int = 2, range_rows: int = 512, hot: int = 64, with_columns=("doc_id",), shuffle_by=("doc_id",)) -> DataFrame:
    """docs with size, source_size, target, taken and the virtual finish times.

    Returns the columns named in with_columns plus size, source_size, target,
    finish (array: virtual finish time of the copy of each epoch, null for a
    source without a target) and taken. `taken` adds up the copies before the
    cut; the one copy that crosses the budget counts up to the budget.
    """
    kept = [F.col(f"`{c}`") for c in with_columns]
    if seed is None:
        raise ValueError("a seed is needed: reruns must agree")
    base = docs.select(*kept, size.alias(f"{P}size"), source.alias(f"{P}source"))
    # The place of a document in its source's shuffle; equal places fall back on size.
    base = base.withColumn(f"{P}h", F.xxhash64(*[F.col(f"`{c}`") for c in shuffle_by], F.lit(seed)))
    # Numbers tell apart rows that repeat each other; they are stored, so they stay.
    base = stored(base.withColumn(f"{P}n", F.monotonically_increasing_id()), "mix-base")
    n = base.count()
    ranges = max(1, min(1 << 20, 1 << max(0, (n // range_rows).bit_length())))
    base = base.withColumn(f"{P}r", F.shiftrightunsigned(f"{P}h", 64 - (ranges.bit_length() - 1)) if ranges > 1 else F.lit(0).cast("bigint"))
    # First level: sums by source and range, then running sums over the ranges of a source.
    by_range = base.groupBy(f"{P}source", f"{P}r").agg(F.sum(f"{P}size").alias(f"{P}sum"), F.count("*").alias(f"{P}rows"))
    before = W.partitionBy(f"{P}source").orderBy(f"{P}r").rowsBetween(W.unboundedPreceding, -1)
    by_range = by_range.withColumn(f"{P}before", F.coalesce(F.sum(f"{P}sum").over(before), F.lit(0)).cast("bigint"))
    sizes = base.groupBy(f"{P}source").agg(F.sum(f"{P}size").alias("source_size")).withColumnRenamed(f"{P}source", "source")
    targets = source_targets(sizes, weights, share, repeats).withColumnRenamed("source", f"{P}source2")
    by_range = by_range.join(targets, F.col(f"{P}source").eqNullSafe(F.col(f"{P}source2"))).drop(f"{P}source2", f"{P}sum")
    by_range = by_range.select(F.col(f"{P}source").alias(f"{P}s2"), F.col(f"{P}r").alias(f"{P}r2"), f"{P}before", f"{P}rows", F.col("source_size").alias(f"{P}total"), F.col("target").alias(f"{P}target"))
    by_range = stored(by_range, "mix-ranges")
    # Second level: rows of one range of one source, about range_rows of them.
    placed = base.join(by_range, F.col(f"{P}source").eqNullSafe(F.col(f"{P}s2")) & (F.col(f"{P}r") == F.col(f"{P}r2")))
    crowded = F.col(f"{P}rows") > hot * range_rows
    local = W.partitionBy(f"{P}source", f"{P}r").orderBy(f"{P}h", f"{P}size", f"{P}n").rowsBetween(W.unboundedPreceding, 0)
    if by_range.where(crowded).isEmpty():
        rows = placed.withColumn(f"{P}local", F.sum(f"{P}size").over(local))
    else:
        rows = placed.where(~crowded).withColumn(f"{P}local", F.sum(f"{P}size").over(local)).unionByName(_crowd(placed.where(crowded), range_rows))
    rows = rows.withColumn(f"{P}cum", F.col(f"{P}before") + F.col(f"{P}local"))
    ends = [F.col(f"{P}cum") + F.lit(e) * F.col(f"{P}total") for e in range(repeats)]
    finish = F.array(*[F.when(F.col(f"{P}target") > 0, x / F.col(f"{P}target")) for x in ends])
    rows = stored(rows.select(*kept, f"{P}source", f"{P}size", f"{P}h", f"{P}total", f"{P}target", finish.alias(f"{P}finish")), "mix-finish")
    cut = _cut(rows, share, repeats)
    if cut is None:
        taken = F.lit(0).cast("bigint")
    else:
        at, room = cut
        # Copies that finish before `at` are taken whole. Each source has at most one copy with words that finishes
        # at it (sources at their cap all end at 1); those share the room left, by source.
        taken = F.aggregate(f"{P}finish", F.lit(0).cast("bigint"), lambda a, f: a + F.when(f < F.lit(at), F.col(f"{P}size")).otherwise(F.lit(0)))
        if room:
            ties = F.exists(f"{P}finish", lambda f: f == F.lit(at)) & (F.col(f"{P}size") > 0)
            through = F.sum(f"{P}size").over(W.orderBy(F.col(f"{P}source").isNull(), F.col(f"{P}source").cast("binary"), f"{P}h").rowsBetween(W.unboundedPreceding, 0))
            share_of = rows.where(ties).withColumn("t", through).select(
                F.col(f"{P}source").alias(f"{P}s3"), F.greatest(F.lit(0), F.least(F.col(f"{P}size"), F.lit(room) - F.col("t") + F.col(f"{P}size"))).alias(f"{P}part")
            )
            rows = rows.join(share_of, ties & F.col(f"{P}source").eqNullSafe(F.col(f"{P}s3")), "left")
            taken = taken + F.coalesce(F.col(f"{P}part"), F.lit(0))
    return rows.select(
        *kept,
        F.col(f"{P}size").alias("size"),
        F.col(f"{P}total").cast("bigint").alias("source_size"),
        F.col(f"{P}target").alias("target"),
        F.col(f"{P}finish").alias("finish"),
        taken.cast("bigint").alias("taken"),
    )


def _crowd(rows: DataFrame, range_rows: int) -> DataFrame:
    """Running sums in ranges that rows with one id crowd: rows of one hash and
    size are interchangeable, so each chunk of their numbers is one entry of the
    running sum, and a row's place within its chunk tells the rest."""
    keys = [f"{P}source", f"{P}r", f"{P}h", f"{P}size", f"{P}chunk"]
    rows = rows.withColumn(f"{P}chunk", F.floor(F.col(f"{P}n") / range_rows).cast("bigint"))
    entries = rows.groupBy(*keys).agg((F.count("*") * F.col(f"{P}size")).alias("words"))
    before = W.partitionBy(f"{P}source", f"{P}r").orderBy(*keys[2:]).rowsBetween(W.unboundedPreceding, -1)
    entries = entries.withColumn("ahead", F.coalesce(F.sum("words").over(before), F.lit(0))).select(*[F.col(c).alias(f"__{k}") for k, c in enumerate(keys)], "ahead")
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(f"{P}n"))
    same = F.lit(True)
    for k, c in enumerate(keys):
        same = same & (F.col(c).eqNullSafe(F.col(f"__{k}")) if k == 0 else F.col(c) == F.col(f"__{k}"))
    found = rows.withColumn(f"{P}nth", nth).join(entries, same)
    return found.withColumn(f"{P}local", F.col("ahead") + F.col(f"{P}nth") * F.col(f"{P}size")).drop("ahead", f"{P}nth", f"{P}chunk", *[f"__{k}" for k in range(len(keys))])


def _cut(rows: DataFrame, share, repeats: int, pieces: int = 4096) -> tuple[float, int] | None:
    """Where the global order of finish times passes the budget: the finish
    time of the copy that crosses it and the words of that copy that fit.

    Each pass sums sizes over at most `pieces` equal ranges of the interval
    that still holds the cut and goes on within the range that crosses it, so
    the driver sees `pieces` numbers a pass, and the interval shrinks by that
    factor until it holds one finish time.
    """
    copies = rows.where(F.col(f"{P}size") > 0).select(F.col(f"{P}size").alias("n"), F.explode(f"{P}finish").alias("f")).where("f is not null")
    total, low, high = copies.agg(F.sum("n"), F.min("f"), F.max("f")).first()
    if total is None:
        return None
    budget = total // repeats * share[0] // share[1]
    if budget >= total:
        return float("inf"), None
    left = budget
    while True:
        width = (high - low) / pieces
        inside = copies.where(F.col("f").between(low, high))
        if width <= 0 or low + width == low:
            times = inside.groupBy("f").agg(F.sum("n").alias("n")).orderBy("f").collect()
        else:
            piece = F.least(F.floor((F.col("f") - F.lit(low)) / F.lit(width)), F.lit(pieces - 1)).alias("p")
            got = inside.groupBy(piece).agg(F.sum("n").alias("n"), F.min("f").alias("a"), F.max("f").alias("b"), F.count_distinct("f").alias("k")).orderBy("p").collect()
            for x in got:
                if x.n > left:
                    break
                left -= x.n
            low, high = x.a, x.b
            if x.k > pieces:
                continue
            times = copies.where(F.col("f").between(low, high)).groupBy("f").agg(F.sum("n").alias("n")).orderBy("f").collect()
        for x in times:
            if x.n > left:
                return x.f, left
            left -= x.n
        return float("inf"), None


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix(docs.withColumn("size", word_count(F.col("text"))).select("doc_id", "source", "size"), F.col("size"), F.col("source"), with_columns=("doc_id",))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
