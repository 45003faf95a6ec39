"""Attach per-key facts to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

On = Sequence[tuple[Column, str]]


def attach(rows: DataFrame, facts: DataFrame, on: On, values: Sequence[str]) -> DataFrame:
    """Left-join ``facts`` (one row per key) to ``rows``; ``on`` pairs an expression over ``rows`` with a column of facts.

    A plain join at every size. Facts that are a written table have a known size, so the planner broadcasts them if
    they are small; else adaptive execution splits keys, or missing keys, that own a large share of the rows.
    """
    left = rows.select("*", *[e.alias(f"__k{i}") for i, (e, _) in enumerate(on)])
    right = facts.select(*[F.col(n).alias(f"__f{i}") for i, (_, n) in enumerate(on)], F.struct(*values).alias("__v"))
    joined = left.join(right, [F.col(f"__k{i}") == F.col(f"__f{i}") for i in range(len(on))], "left")
    return joined.select(*[F.col(c) for c in rows.columns], *[F.col("__v")[v].alias(v) for v in values])
