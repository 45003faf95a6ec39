"""Exact quantiles and average ranks from one table of value counts, without a global sort.

Equal values are counted first, so a value that owns a third of the rows is one row. The counts are dealt into ranges
of the values (cut by the counts themselves, however often a value occurs) and written with the number of their range.
Totals of the ranges, a handful of numbers each, place every range; running totals inside a range place its values. The
plan is the same at every size; the ranges grow in number with ``spark.sql.shuffle.partitions`` and the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioguard.session import materialize


@dataclass(frozen=True)
class Quantile:
    """One wanted quantile of ``value``: overall, or per group of the shared grouping column; ``spread`` asks for the
    deviation too."""

    name: str
    value: Column
    p: float
    grouped: bool = False
    spread: bool = True


def _ranged(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``counts`` written in ranges of ``keys``, with the number of the range as ``b``."""
    return materialize(
        counts.repartitionByRange(*[F.col(k) for k in keys]).withColumn("b", F.spark_partition_id()), "value-counts")


def value_counts(df: DataFrame, wanted: Sequence[Quantile], by: Column | None = None) -> DataFrame:
    """``i, g, v, c, b``: how often each value ``v`` of request ``i`` is met in group ``g``, written in ranges ``b``.

    One scan for all requests; quantiles and ranks of any of them come from this table alone.
    """
    group = (by if by is not None else F.lit(None)).cast("string").alias("grp")
    flat = df.select(group, *[w.value.cast("double").alias(f"v{i}") for i, w in enumerate(wanted)])
    entries = F.array(*[
        F.when(F.col(f"v{i}").isNotNull() & (F.col("grp").isNotNull() if w.grouped else F.lit(True)), F.struct(
            F.lit(i).alias("i"), (F.col("grp") if w.grouped else F.lit("")).alias("g"), F.col(f"v{i}").alias("v")))
        for i, w in enumerate(wanted)])
    counts = flat.select(F.inline(F.array_compact(entries))).groupBy("i", "g", "v").agg(F.count("*").alias("c"))
    return _ranged(counts, ["i", "g", "v"])


def exact_quantiles(df: DataFrame, wanted: Sequence[Quantile], by: Column | None = None) -> DataFrame:
    """Linear-interpolated quantiles, one row per request and group: ``name, grp, n, mean, std, quantile``.

    ``grp`` is null for an overall request; rows whose ``by`` is null belong to no group. A request without any value
    gives no row, one without ``spread`` no ``std``. Only the ranges that hold a wanted place are ordered inside.
    """
    return quantiles_of(value_counts(df, wanted, by), wanted)


def quantiles_of(ranged: DataFrame, wanted: Sequence[Quantile]) -> DataFrame:
    """``exact_quantiles`` from written value counts."""
    totals = ranged.groupBy("i", "g", "b").agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.col("v")).alias("sv"))
    whole = Window.partitionBy("i", "g")
    before = whole.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    n = F.sum("t").over(whole)
    share = F.element_at(F.array(*[F.lit(float(w.p)) for w in wanted]), F.col("i") + 1)
    places = totals.select(
        "i", "g", "b", "t", n.alias("n"), (F.sum("sv").over(whole) / n).alias("mean"),
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("s")).withColumn("rank", share * (F.col("n") - 1))
    spreading = [i for i, w in enumerate(wanted) if w.spread]
    off = F.col("v") - F.col("mean")
    holding = places.where((F.col("s") <= F.ceil("rank")) & (F.col("s") + F.col("t") > F.floor("rank")))

    upto = Window.partitionBy("i", "g", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = ranged.join(holding, ["i", "g", "b"]).withColumn("end", F.col("s") + F.sum("c").over(upto))

    def value_at(position: Column) -> Column:
        return F.max(F.when((position >= F.col("end") - F.col("c")) & (position < F.col("end")), F.col("v")))

    picked = near.groupBy("i", "g").agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("rank").alias("rank"),
        value_at(F.floor("rank")).alias("low"), value_at(F.ceil("rank")).alias("high"))
    value = F.col("low") + (F.col("high") - F.col("low")) * (F.col("rank") - F.floor("rank"))
    names = F.array(*[F.lit(w.name) for w in wanted])
    of_groups = F.array(*[F.lit(w.grouped) for w in wanted])
    if spreading:
        spread = ranged.where(F.col("i").isin(spreading)).join(
            places.select("i", "g", "b", "mean"), ["i", "g", "b"]).groupBy("i", "g").agg(
            F.sum(F.col("c") * off * off).alias("squares"))
        picked = picked.join(spread, ["i", "g"], "left")
    else:
        picked = picked.withColumn("squares", F.lit(None).cast("double"))
    return picked.select(
        F.element_at(names, F.col("i") + 1).alias("name"),
        F.when(F.element_at(of_groups, F.col("i") + 1), F.col("g")).alias("grp"), "n", "mean",
        F.sqrt(F.col("squares") / F.col("n")).alias("std"), value.alias("quantile"))


def ordered_totals(df: DataFrame, value: Column, sums: dict[str, Column] | None = None) -> DataFrame:
    """Running totals over the distinct values in ascending order, without a global window.

    One row per distinct ``v``: ``c`` rows, ``below`` rows under it, ``n`` rows in all; each entry of ``sums`` adds
    its own total as ``name``, ``name_below`` and ``name_all``.
    """
    sums = sums or {}
    values = df.select(value.cast("double").alias("v"), *[c.alias(k) for k, c in sums.items()]).where("v is not null")
    counts = values.groupBy("v").agg(F.count("*").alias("c"), *[F.sum(k).alias(k) for k in sums])
    return _running(_ranged(counts, ["v"]), sums)


def _running(ranged: DataFrame, sums: Sequence[str]) -> DataFrame:
    tracked = {"c": ("below", "n"), **{k: (f"{k}_below", f"{k}_all") for k in sums}}
    totals = ranged.groupBy("b").agg(*[F.sum(k).alias(f"t_{k}") for k in tracked])
    before = Window.partitionBy(F.lit(0)).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    offsets = totals.select(
        "b",
        *[F.coalesce(F.sum(f"t_{k}").over(before), F.lit(0)).alias(f"s_{k}") for k in tracked],
        *[F.sum(f"t_{k}").over(everything).alias(total) for k, (_, total) in tracked.items()],
    )
    inside = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    running = [
        (F.col(f"s_{k}") + F.coalesce(F.sum(k).over(inside), F.lit(0))).alias(below)
        for k, (below, _) in tracked.items()
    ]
    # A row a range: no more than there are shuffle partitions.
    placed = ranged.join(F.broadcast(offsets), "b")
    return placed.select("v", *tracked, *running, *[total for _, total in tracked.values()])


def average_ranks(df: DataFrame, value: Column) -> DataFrame:
    """Average rank of every distinct value: ``v, c, n, rank``."""
    return _average(ordered_totals(df, value))


def ranks_of(ranged: DataFrame, request: int) -> DataFrame:
    """``average_ranks`` of an overall request from written value counts."""
    return _average(_running(ranged.where(F.col("i") == request).select("v", "c", "b"), ()))


def _average(placed: DataFrame) -> DataFrame:
    return placed.select("v", "c", "n", (F.col("below") + (F.col("c") + 1) / 2).alias("rank"))
