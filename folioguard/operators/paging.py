"""Deep pages of a sorted result through a directory of key ranges.

``offset`` sorts and counts off every row before the page, each time. Here the rows are sorted once into ranges of keys and
written; a directory says how many rows each range holds and how many lie before it. A page opens the one or two ranges it
lies in, whatever its number, and counts off places inside those only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioguard.session import materialize, staging_path

PAGE_ROWS = 250
RANGE_ROWS = 100_000
_RANGE, _PLACE = "__range", "__place"


@dataclass(frozen=True)
class PageDirectory:
    """``rows``: the written rows with their range; ``ranges``: range, records and records before it, a row each."""

    rows: DataFrame
    ranges: DataFrame
    order: tuple[Column, ...]

    def page(self, number: int, size: int = PAGE_ROWS) -> DataFrame:
        """Page ``number`` (from one) in order; empty past the end."""
        first = (number - 1) * size
        # The ranges a page meets: as many as it has rows at the very most.
        met = self.ranges.where((F.col("before") < first + size) & (F.col("before") + F.col("records") > first)).collect()
        if not met:
            return self.rows.where(F.lit(False)).drop(_RANGE)
        before = F.lit(0)
        for r in met:
            before = F.when(F.col(_RANGE) == r[_RANGE], r["before"]).otherwise(before)
        inside = Window.partitionBy(_RANGE).orderBy(*self.order)
        placed = self.rows.where(F.col(_RANGE).isin([r[_RANGE] for r in met])).withColumn(
            _PLACE, before + F.row_number().over(inside) - 1)
        return placed.where((F.col(_PLACE) >= first) & (F.col(_PLACE) < first + size)).orderBy(_PLACE).drop(_RANGE, _PLACE)


def page_directory(df: DataFrame, order: Sequence[Column | str], range_rows: int = RANGE_ROWS) -> PageDirectory:
    """Sort ``df`` once into ranges of about ``range_rows`` rows and write them, a folder a range.

    Rows that tie in ``order`` are told apart by a digest of the whole row; only copies of one row stay in one range, and
    their order among themselves shows nowhere.
    """
    spark = df.sparkSession
    keys = tuple(F.col(k) if isinstance(k, str) else k for k in order)
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    n = df.count()
    ranges = max(1, -(-n // range_rows))
    path = staging_path(spark, "pages")
    dealt = df.repartitionByRange(ranges, *keys, tie).withColumn(_RANGE, F.spark_partition_id())
    dealt.write.partitionBy(_RANGE).parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path)
    counted = rows.groupBy(_RANGE).agg(F.count("*").alias("records"))
    # A row a range.
    upto = Window.partitionBy(F.lit(0)).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    directory = counted.withColumn("before", F.coalesce(F.sum("records").over(upto), F.lit(0)))
    return PageDirectory(rows, materialize(directory, "page-directory"), (*keys, tie))
