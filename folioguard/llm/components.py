"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioguard.session import materialize


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, folder: str | None = None) -> DataFrame:
    """node and root, the smallest node of its component, for every node of ``links`` (a, b: bigint) but the roots.

    A large star hangs a node's larger neighbours on its smallest neighbour, a small star its smaller ones. Both keep
    components whole and need no more than the links' number of rows; they are repeated until nothing changes, about
    the logarithm of the longest path. Minima are summed up before the shuffle. Each round is written to the shared
    folder, so a lost executor costs no earlier round. Links of a node to itself and null ends are left out. The
    result reads tables in ``folder``.
    """
    edges = materialize(
        links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links",
        folder)
    seen = None
    while (now := _signature(edges)) != seen:
        seen = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("node")).where("b > a").select(
            F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large-star", folder)
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), "m")
        small = large.join(low, F.col("a") == F.col("node")).where("b != m").select(
            F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(
            small.union(low.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct(), "small-star", folder)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
