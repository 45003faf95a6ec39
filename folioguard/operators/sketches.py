"""Distinct counts from stored sketches that merge: the opt-in approximate count for large portfolios.

A sketch is a few kilobytes for each group (a file, a month), whatever the rows behind it. Counts of any union of groups
come from the sketches alone; new files add sketches, nothing is scanned again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioguard.functions.scalars import blank_to_null

LOG_BUCKETS = 14
#: Relative standard error of a merged estimate, 1.04 over the root of the number of buckets; three of them bound it.
STANDARD_ERROR = 1.04 / (1 << LOG_BUCKETS) ** 0.5


def distinct_sketches(
    df: DataFrame, columns: Sequence[str], by: Sequence[str | Column] = (), log_buckets: int = LOG_BUCKETS
) -> DataFrame:
    """``by``, column, records (rows with a value) and sketch: one row for each group and column.

    Text is counted trimmed, blank text is no value, as in the exact count. Groups with no value have an empty sketch.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in by]
    parts = []
    for c in columns:
        value = blank_to_null(F.col(c))
        parts.append(F.struct(
            F.lit(c).alias("column"), F.count(value).alias("records"), F.hll_sketch_agg(value, log_buckets).alias("sketch")))
    one = df.groupBy(*keys).agg(F.array(*parts).alias("parts"))
    names = one.columns[:-1]
    return one.select(*names, F.inline("parts"))


def merged_estimates(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by``, column, records and estimate, the approximate number of distinct values in the union of the sketches."""
    return sketches.groupBy(*by, "column").agg(
        F.sum("records").alias("records"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
