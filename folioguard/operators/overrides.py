"""Time-bounded warning overrides: admission, effective quality, overlaps, replays."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioguard.functions.scalars import txt
from folioguard.operators.tables import same
from folioguard.session import materialize

SHORTEST = "INTERVAL 15 MINUTES"
LONGEST = "INTERVAL 90 DAYS"
ISSUE_KEY = ["validation_run_id", "issue_ordinal"]
TENANT = ["organization_id", "workspace_id"]
REQUEST_KEY = [*TENANT, "request_id"]
PAYLOAD = ["validation_run_id", "issue_ordinal", "overridden_by", "expires_at", "reason"]


def active_at(moment: Column, start: str = "overridden_at", end: str = "expires_at") -> Column:
    """Start included, end not."""
    return (F.col(start) <= moment) & (moment < F.col(end))


def bounded_text(c: Column, shortest: int = 1, longest: int = 1000) -> Column:
    """Trimmed already, no NUL, length in range."""
    return (c == txt(c)) & ~c.contains("\u0000") & F.char_length(c).between(shortest, longest)


def lifetime_ok(start: str = "overridden_at", end: str = "expires_at") -> Column:
    return (F.col(end) >= F.col(start) + F.expr(SHORTEST)) & (F.col(end) <= F.col(start) + F.expr(LONGEST))


def effective_quality(runs: DataFrame, overrides: DataFrame, moment: Column) -> DataFrame:
    """Warnings left after the overrides active at ``moment``, and the status that follows.

    Overrides are counted per run before the join, so a run with very many of them joins as one row.
    """
    active = overrides.where(active_at(moment)).groupBy("validation_run_id").agg(F.count("*").alias("__active"))
    joined = runs.join(active, "validation_run_id", "left")
    left = F.col("warn_count") - F.coalesce("__active", F.lit(0))
    return joined.select(
        "validation_run_id", "dataset_version_id", "composite_score",
        F.col("block_count").alias("blocking_issue_count"),
        F.col("warn_count").alias("warning_issue_count"),
        F.coalesce("__active", F.lit(0)).cast("long").alias("active_override_count"),
        left.alias("effective_warning_count"),
        F.col("info_count").alias("informational_issue_count"),
        F.when(F.col("block_count") > 0, "blocked").when(left != 0, "warn").otherwise("healthy").alias("status"),
    )


def warning_context(runs: DataFrame, issues: DataFrame) -> DataFrame:
    """Each issue with its run's tenant and dataset version."""
    return runs.select("validation_run_id", "organization_id", "workspace_id", "dataset_version_id").join(
        issues, "validation_run_id")


def split_requests(requests: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests on a warning that may be overridden, and the rest."""
    open_issues = issues.where((F.col("severity") == "warn") & F.col("override_allowed")).select(*ISSUE_KEY)
    return requests.join(open_issues, ISSUE_KEY, "left_semi"), requests.join(open_issues, ISSUE_KEY, "left_anti")


def judge_requests(requests: DataFrame, issues: DataFrame) -> DataFrame:
    """First reason to refuse each override request; null ``error_code`` is an admissible one."""
    known = issues.select(*ISSUE_KEY, "severity", "override_allowed")
    joined = requests.join(known, ISSUE_KEY, "left")
    code = (
        F.when(~bounded_text(F.col("reason"), shortest=10), "invalid_reason")
        .when(F.col("severity").isNull(), "validation_warning_not_found")
        .when((F.col("severity") != "warn") | ~F.col("override_allowed"), "warning_override_not_allowed")
        .when(~lifetime_ok(), "invalid_override_expiry")
    )
    return joined.withColumn("error_code", code).drop("severity", "override_allowed")


def overlapping(
    overrides: DataFrame, candidates: DataFrame, id_column: str = "override_id", ranges: int | None = None
) -> DataFrame:
    """Candidates whose validity meets another stored override of the same issue.

    Intervals of an issue are put in order of their start. One meets an earlier interval if the latest end before it is
    after its start, and a later one if the next start is before its end: two running values instead of pairs, whatever
    the intervals' lengths. A row stored under the candidate's own id is the candidate itself.

    The sorted intervals are dealt into ``ranges`` of rows (the session's shuffle partitions unless given), so an issue with
    very many of them lies in several. The running values inside a range start from what the ranges before and after it
    carry over: the latest end and the next start by issue, a row for each issue and range.
    """
    cuts = [*ISSUE_KEY, "overridden_at", "expires_at", id_column]
    rows = candidates.select(*cuts, F.lit(False).alias("__stored"), F.lit(True).alias("__asked")).unionByName(
        overrides.select(*cuts, F.lit(True).alias("__stored"), F.lit(False).alias("__asked")))
    one = rows.groupBy(*cuts).agg(F.max("__stored").alias("__stored"), F.max("__asked").alias("__asked"))
    dealt = one.repartitionByRange(*([ranges] if ranges else []), *[F.col(c) for c in cuts])
    ranged = materialize(dealt.withColumn("__range", F.spark_partition_id()), "interval-ranges")
    end = F.when(F.col("__stored"), F.col("expires_at"))
    start = F.when(F.col("__stored"), F.col("overridden_at"))
    by_range = Window.partitionBy(*ISSUE_KEY).orderBy("__range")
    carried = ranged.groupBy(*ISSUE_KEY, "__range").agg(F.max(end).alias("e"), F.min(start).alias("s")).select(
        *[F.col(c).alias(f"__{c}") for c in ISSUE_KEY], F.col("__range").alias("__of"),
        F.max("e").over(by_range.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
        F.min("s").over(by_range.rowsBetween(1, Window.unboundedFollowing)).alias("__after"))
    same_issue = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ISSUE_KEY], F.col("__range") == F.col("__of"))
    order = Window.partitionBy(*ISSUE_KEY, "__range").orderBy("overridden_at", "expires_at", id_column)
    marked = ranged.join(carried, same_issue).select(
        *cuts, "__asked",
        F.greatest("__before", F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))).alias("__latest"),
        F.least("__after", F.min(start).over(order.rowsBetween(1, Window.unboundedFollowing))).alias("__next"))
    hits = marked.where(F.col("__asked") & (
        (F.col("__latest") > F.col("overridden_at")) | (F.col("__next") < F.col("expires_at")))).select(id_column)
    return candidates.join(hits.distinct(), id_column, "left_semi")


def classify_requests(stored: DataFrame, requests: DataFrame, key: Sequence[str] = ("request_id",)) -> DataFrame:
    """``new``, ``replay`` (same content as the stored request) or ``conflict``."""
    a, b = requests.alias("a"), stored.withColumn("__there", F.lit(True)).alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    verdict = F.when(F.col("b.__there").isNull(), "new").when(same("a", "b", PAYLOAD), "replay").otherwise("conflict")
    return a.join(b, on, "left").select(*[F.col(f"a.{c}") for c in requests.columns], verdict.alias("outcome"))


def first_requests(requests: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The request that came first under each key; ``order`` should end in a column that breaks ties."""
    rest = [c for c in requests.columns if c not in key]
    return requests.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")
