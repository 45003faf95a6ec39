"""Dataset assessment: one wide aggregation per dataset, then arithmetic on its single row.

``by`` assesses many datasets of one shape at once, one result row per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioguard.fixed_values import (
    CAPABILITIES,
    DIMENSION_WEIGHTS,
    GOVERNED_NUMERIC,
    ISSUES,
    MODEL_INPUTS,
    QUALITY_DEFINITION,
    RULE_INPUTS,
)
from folioguard.functions.scalars import missing, n_if, num, present_text, r1, ts, type_of


def data_columns(df: DataFrame, by: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in by]


def row_digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """SHA-256 of a row: nulls and NaN alike, zero without a sign."""
    parts = []
    for name in columns:
        c = F.col(name)
        if isinstance(type_of(df, name), (T.FloatType, T.DoubleType)):
            c = F.when(~missing(df, name), c + F.lit(0.0))
        parts.append(c.alias(name))
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def duplicate_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact repeats of earlier rows, per key. Only digests are shuffled, and copies collapse before that."""
    digest = F.unhex(row_digest(df, data_columns(df, by)))  # 32 bytes
    groups = df.select(*by, digest.alias("__d")).groupBy(*by, "__d").agg(F.count("*").alias("__c"))
    return groups.groupBy(*by).agg(F.coalesce(F.sum(F.col("__c") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def missing_per_row(df: DataFrame, columns: Sequence[str]) -> Column:
    total = F.lit(0)
    for name in columns:
        total = total + missing(df, name).cast("int")
    return total


def evidence_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every count the assessment needs but the repeats, in one aggregation."""
    columns = data_columns(df, by)
    has = set(columns)
    zero = F.lit(0).cast("long")
    present, invalid = zero, zero
    for name in GOVERNED_NUMERIC:
        if name in has:
            there = ~missing(df, name)
            present = present + n_if(there)
            invalid = invalid + n_if(there & num(df, name).isNull())
    date_valid = date_invalid = zero
    if "date" in has:
        there, when = ~missing(df, "date"), ts(df, "date")
        date_valid, date_invalid = n_if(when.isNotNull()), n_if(there & when.isNull())
        present, invalid = present + n_if(there), invalid + date_invalid
    amount_valid = amount_invalid = zero
    if "transaction_amount" in has:
        amount = num(df, "transaction_amount")
        amount_valid = n_if(amount.isNotNull())
        amount_invalid = n_if(~missing(df, "transaction_amount") & amount.isNull())
    outcome_present = outcome_binary = status_present = customers = zero
    if "defaulted" in has:
        outcome_present = n_if(~missing(df, "defaulted"))
        outcome_binary = n_if(num(df, "defaulted").isin(0.0, 1.0))
    if "repayment_status" in has:
        status_present = n_if(present_text(F.col("repayment_status")))
    if "customer_id" in has:
        customers = n_if(present_text(F.col("customer_id")))
    counts = {
        "rows": F.count("*"),
        "missing_cells": F.coalesce(F.sum(missing_per_row(df, columns)), F.lit(0)).cast("long"),
        "governed_present": present,
        "governed_invalid": invalid,
        "date_valid": date_valid,
        "date_invalid": date_invalid,
        "amount_valid": amount_valid,
        "amount_invalid": amount_invalid,
        "outcome_present": outcome_present,
        "outcome_binary": outcome_binary,
        "status_present": status_present,
        "customer_present": customers,
    }
    aggregated = [c.alias(name) for name, c in counts.items()]
    return df.groupBy(*by).agg(*aggregated).withColumn("columns", F.lit(len(columns)))


def profile(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and repeats, one row per key."""
    counts = evidence_counts(df, by)
    repeats = duplicate_counts(df, by)
    if by:
        return counts.join(repeats, list(by))
    return counts.withColumn("duplicate_rows", repeats.scalar())


def quoted(text: str | None) -> str:
    """A SQL string literal."""
    if text is None:
        return "cast(null as string)"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def issue(code: str, applies: str, count: str = "null", columns: Sequence[str] = ()) -> str:
    """SQL: the issue as a struct where it applies, else null."""
    severity, dimension, column, message, recovery, capabilities, override = ISSUES[code]
    names = ", ".join(quoted(c) for c in capabilities)
    return (
        f"case when {applies} then named_struct('code', {quoted(code)}, 'severity', {quoted(severity)}, "
        f"'dimension', {quoted(dimension)}, 'column', {quoted(column)}, 'affected_count', cast({count} as bigint), "
        f"'message', {quoted(message.format(columns=', '.join(columns)))}, 'recovery', {quoted(recovery)}, "
        f"'capabilities', array({names}), 'masked_examples', cast(array() as array<string>), "
        f"'override_allowed', {str(override).lower()}) end")


def issue_struct(
    code: Column, severity: Column, dimension: Column, column: Column, count: Column, message: Column,
    recovery: Column, capabilities: Column, override: Column, examples: Column | None = None,
) -> Column:
    return F.struct(
        code.alias("code"),
        severity.alias("severity"),
        dimension.alias("dimension"),
        column.cast("string").alias("column"),
        count.cast("long").alias("affected_count"),
        message.alias("message"),
        recovery.alias("recovery"),
        capabilities.cast("array<string>").alias("capabilities"),
        (F.array().cast("array<string>") if examples is None else examples).alias("masked_examples"),
        override.alias("override_allowed"),
    )


def _issues(columns: Sequence[str]) -> Column:
    """Issues of a profile row, in reporting order."""
    has = set(columns)
    found = [
        issue("missing_values", "missing_cells > 0", "missing_cells"),
        issue("duplicate_rows", "duplicate_rows > 0", "duplicate_rows"),
    ]
    if "transaction_amount" in has:
        found += [
            issue("unparseable_transaction_amount", "amount_valid = 0", "amount_invalid"),
            issue("invalid_transaction_amount", "amount_valid > 0 and amount_invalid > 0", "amount_invalid"),
        ]
    else:
        found.append(issue("missing_transaction_amount", "true"))
    if "date" in has:
        found += [
            issue("unparseable_event_date", "date_valid = 0", "date_invalid"),
            issue("invalid_event_date", "date_valid > 0 and date_invalid > 0", "date_invalid"),
        ]
    else:
        found.append(issue("missing_event_date", "true"))
    if "customer_id" in has:
        found += [
            issue("empty_customer_id", "customer_present = 0", "rows"),
            issue("missing_customer_ids", "customer_present > 0 and customer_present < rows",
                  "rows - customer_present"),
        ]
    else:
        found.append(issue("missing_customer_id", "true"))
    found.append(issue("missing_repayment_outcome", "outcome_binary = 0 and status_present = 0"))
    absent = [m for m in MODEL_INPUTS if m not in has]
    if absent:
        found.append(issue("missing_model_inputs", "true", str(len(absent)), absent))
    if not has & {"defaulted", "repayment_status"}:
        found.append(issue("missing_model_target", "true"))
    absent = [m for m in RULE_INPUTS if m not in has]
    if absent:
        found.append(issue("missing_risk_rule_inputs", "true", str(len(absent)), absent))
    empty = "rows = 0" if columns else "true"
    return F.expr(
        f"case when {empty} then array({issue('empty_dataset', 'true')}) "
        f"else array_compact(array({', '.join(found)})) end")


def capability_results() -> Column:
    """Readiness of each capability from the ``issues`` column: blocked by the codes of its block issues."""
    names = ", ".join(quoted(c) for c in CAPABILITIES)
    return F.expr(
        f"transform(transform(array({names}), name -> named_struct('capability', name, 'codes', transform(filter("
        "issues, i -> i.severity = 'block' and array_contains(i.capabilities, name)), i -> i.code))), "
        "x -> named_struct('capability', x.capability, 'status', case when size(x.codes) > 0 then 'blocked' else "
        "'ready' end, 'blocking_issue_codes', x.codes))")


def assess(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per dataset: shape, six dimensions, composite, issues, capabilities."""
    columns = data_columns(df, by)
    rows = profile(df, by).withColumn("issues", _issues(columns))
    rows = rows.withColumn("capabilities", capability_results())
    c = F.col
    cells = c("rows") * c("columns")
    full = F.lit(100.0)
    ready = F.size(F.filter("capabilities", lambda x: x["status"] == "ready"))
    raw = {
        "completeness": F.when(cells > 0, (1 - c("missing_cells") / cells) * 100).otherwise(full),
        "validity": F.when(c("governed_present") > 0, (1 - c("governed_invalid") / c("governed_present")) * 100
                           ).otherwise(full),
        "uniqueness": (1 - c("duplicate_rows") / F.nullif(c("rows"), F.lit(0))) * 100,
        "consistency": F.when(c("outcome_present") > 0, c("outcome_binary") / c("outcome_present") * 100
                              ).otherwise(full),
        "timeliness": c("date_valid") / F.nullif(c("rows"), F.lit(0)) * 100 if "date" in columns else F.lit(0.0),
        "fitness": ready / len(CAPABILITIES) * 100,
    }
    empty = (c("rows") == 0) | F.lit(not columns)
    scores = {name: F.when(empty, 0.0).otherwise(r1(value)) for name, value in raw.items()}
    rows = rows.withColumns(scores)
    weighted = F.lit(0.0)
    for name, weight in DIMENSION_WEIGHTS.items():
        weighted = weighted + c(name) * weight
    return rows.withColumns({
        "composite_score": r1(weighted),
        "definition_version": F.lit(QUALITY_DEFINITION),
    })


def dimension_table(assessment: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    lines = [
        F.struct(F.lit(name).alias("dimension"), F.col(name).alias("score"), F.lit(weight).alias("weight"))
        for name, weight in DIMENSION_WEIGHTS.items()
    ]
    return assessment.select(*by, F.inline(F.array(*lines)))


def issue_table(assessment: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Issues in order, ``issue_ordinal`` from one."""
    return assessment.select(*by, "definition_version", F.posexplode("issues").alias("__p", "__i")).select(
        *by, (F.col("__p") + 1).alias("issue_ordinal"), "__i.*", "definition_version")


def capability_table(assessment: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return assessment.select(*by, F.inline("capabilities"))


def issue_export(assessment: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Issue feed for a spreadsheet: capabilities joined, no nested cells."""
    issues = issue_table(assessment, by)
    return issues.select(
        *by, F.col("code").alias("issue_code"), "severity", "dimension",
        F.coalesce("column", F.lit("")).alias("column"), "affected_count", "message", "recovery",
        F.array_join("capabilities", "|").alias("affected_capabilities"), "definition_version")


def severity_count(name: str) -> Column:
    return F.size(F.filter("issues", lambda i: i["severity"] == name)).cast("long")


def trust_summary(assessment: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unresolved issues by severity, blocked capabilities, and what they amount to."""
    blocked = F.size(F.filter("capabilities", lambda x: x["status"] == "blocked")).cast("long")
    rows = assessment.select(
        *by, "composite_score",
        severity_count("block").alias("block_count"),
        severity_count("warn").alias("warn_count"),
        severity_count("info").alias("info_count"),
        blocked.alias("blocked_capabilities"),
    )
    return rows.withColumn(
        "trust_status",
        F.when(F.col("blocked_capabilities") > 0, "blocked").when(F.col("warn_count") > 0, "warning").otherwise(
            "ready"))


def quality_summary(assessment: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shape, missing cells, repeats and composite on one row."""
    return assessment.select(
        *by, "rows", F.col("columns").cast("long").alias("columns"), F.col("missing_cells").alias("missing_values"),
        "duplicate_rows", F.col("composite_score").alias("score"))


def numeric_columns(df: DataFrame, share: float = 0.65) -> DataFrame:
    """Columns of which at least ``share`` of the rows parse as a number, from one aggregation."""
    ratios = [F.avg(num(df, c).isNotNull().cast("int")).alias(c) for c in df.columns]
    one = df.agg(*ratios)
    lines = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(c).alias("parseable_share"))
        for i, c in enumerate(df.columns)
    ])
    return one.select(F.inline(lines)).where(F.col("parseable_share") >= share)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: a content reference that does not depend on row order or partitioning.

    Each row is digested on its own; count, sum and parity of the leading digits make the whole.
    """
    schema = "\x1f".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    lead = F.conv(F.left(row_digest(df, df.columns), F.lit(15)), 16, 10).cast("long")
    rows = df.select(lead.alias("h"))
    material = F.concat_ws(
        "|", F.lit(schema), F.count("*").cast("string"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).cast("string"))
    return rows.agg(F.concat(F.lit("dataframe:sha256:"), F.sha2(material, 256)).alias("dataset_reference"))
