"""Set operations and keyed appends shared by the stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same(left: str, right: str, columns: Sequence[str]) -> Column:
    """All columns equal, nulls alike."""
    verdict = F.lit(True)
    for c in columns:
        verdict = verdict & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return verdict


def _same_key(keys: Sequence[str]) -> Column:
    return same("a", "b", keys)


def absent(new: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet: what an insert-if-absent appends. Null is a key like any other."""
    return new.alias("a").join(stored.select(*keys).alias("b"), _same_key(keys), "left_anti")


def conflicts(new: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is stored with other content."""
    rest = [c for c in new.columns if c not in keys]
    a, b = new.alias("a"), stored.alias("b")
    return a.join(b, _same_key(keys)).where(~same("a", "b", rest)).select(*[F.col(f"a.{c}") for c in new.columns])


def contradictions(new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that ``new`` itself holds with more than one content."""
    rest = [c for c in new.columns if c not in keys]
    if not rest:
        return new.select(*keys).limit(0)
    content = F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256)
    found = new.groupBy(*keys).agg(F.min(content).alias("first"), F.max(content).alias("last"))
    return found.where(F.col("first") != F.col("last")).select(*keys)


def append_absent(new: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Append to the table at ``path`` what it lacks, refuse other content under a key; returns the table.

    The refusal covers keys that are stored and keys that come twice in ``new``; nothing is written then.
    """
    spark = new.sparkSession
    if not contradictions(new, keys).isEmpty():
        raise ValueError("the rows to be stored contradict each other under one key")
    try:
        stored = spark.read.parquet(path)
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        new.dropDuplicates(list(keys)).write.parquet(path)
        return spark.read.parquet(path)
    if not conflicts(new, stored, keys).isEmpty():
        raise ValueError("a stored row conflicts with the new content of its key")
    absent(new, stored, keys).dropDuplicates(list(keys)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def difference(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows on one side only, multiplicity counted; empty when the two tables hold the same rows."""
    columns = expected.columns
    missing = expected.exceptAll(stored.select(columns)).withColumn("side", F.lit("missing"))
    extra = stored.select(columns).exceptAll(expected).withColumn("side", F.lit("unexpected"))
    return missing.unionByName(extra)


def repeated_requests(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Idempotency keys seen more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("requests")).where("requests > 1")


def in_tenant(rows: DataFrame, organization: str, workspace: str) -> DataFrame:
    """Rows of one tenant; prunes partitions on tables laid out by tenant."""
    return rows.where((F.col("organization_id") == organization) & (F.col("workspace_id") == workspace))
