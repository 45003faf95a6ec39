"""Governed portfolio metrics: ten rows that stay unavailable rather than fall back to zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioguard.fixed_values import METRIC_NARRATIVES, METRICS, UNAVAILABLE
from folioguard.functions.scalars import blank_to_null, fill, money, n_if, num, percent1, thousands, ts
from folioguard.operators.profile import assess, quoted

NARRATED = (
    "transaction_value", "unique_customers", "non_default_outcome_share", "suspicious_records",
)


def reporting_period(df: DataFrame) -> DataFrame:
    """First and last parseable event date."""
    when = ts(df, "date").cast("date") if "date" in df.columns else F.lit(None).cast("date")
    return df.agg(F.min(when).alias("period_start"), F.max(when).alias("period_end"))


def portfolio_currency(df: DataFrame) -> DataFrame:
    """The one currency of the dataset; null when there is none or more than one."""
    code = F.upper(blank_to_null(F.col("currency"))) if "currency" in df.columns else F.lit(None).cast("string")
    return df.agg(F.when(F.min(code) == F.max(code), F.min(code)).alias("currency"))


def _values(df: DataFrame, currency: str | None) -> DataFrame:
    """Everything the metrics need beyond the assessment, in one aggregation."""
    none = F.lit(None)
    has = set(df.columns)
    amount = num(df, "transaction_amount") if "transaction_amount" in has else none.cast("double")
    outcome = num(df, "defaulted") if "defaulted" in has else none.cast("double")
    customer = blank_to_null(F.col("customer_id")) if "customer_id" in has else none.cast("string")
    when = ts(df, "date").cast("date") if "date" in has else none.cast("date")
    code = F.upper(blank_to_null(F.col("currency"))) if "currency" in has else none.cast("string")
    fixed = currency.strip().upper() if currency and currency.strip() else None
    # Grouped first by what has to be told apart: a minimum of texts beside a distinct count would sort every row.
    groups = df.groupBy(customer.alias("customer"), code.alias("code")).agg(
        F.sum(amount).alias("amount"), F.count(amount).alias("amounts"), n_if(outcome == 0).alias("zero"),
        F.min(when).alias("first"), F.max(when).alias("last"))
    return groups.agg(
        F.sum("amount").alias("amount_sum"),
        (F.sum("amount") / F.nullif(F.sum("amounts"), F.lit(0))).alias("amount_avg"),
        F.countDistinct("customer").alias("customers"),
        F.coalesce(F.sum("zero"), F.lit(0)).alias("outcome_zero"),
        F.min("first").alias("period_start"),
        F.max("last").alias("period_end"),
        (F.lit(fixed) if fixed else F.when(F.min("code") == F.max("code"), F.min("code"))).cast("string").alias(
            "currency"),
    )


def metric_table(
    df: DataFrame,
    anomalies: DataFrame | None = None,
    ruleset: str | None = None,
    currency: str | None = None,
    reference: str | None = None,
) -> DataFrame:
    """Ten metric rows for ``df``; the two rule counts need a rule result and its version."""
    has = set(df.columns)
    outputs = anomalies is not None and {"is_suspicious", "risk_level"} <= set(anomalies.columns)
    one = _values(df, currency).withColumn("__a", assess(df).select(F.struct("*")).scalar())
    if outputs:
        flag = F.coalesce("is_suspicious", F.lit(False))
        counted = anomalies.agg(F.struct(
            n_if(flag).alias("suspicious"), n_if(flag & (F.col("risk_level") == "High")).alias("high")))
        one = one.withColumn("__r", counted.scalar())
    else:
        one = one.withColumn("__r", F.struct(
            F.lit(None).cast("long").alias("suspicious"), F.lit(None).cast("long").alias("high")))
    def first_block(capability: str) -> str:
        """SQL: first block issue of a capability, null when it is ready."""
        return (
            f"get(filter(__a.issues, i -> i.severity = 'block' and array_contains(i.capabilities, '{capability}')), 0)")

    def reason(key: str) -> str:
        why, recovery = UNAVAILABLE[key]
        return f"named_struct('reason', {quoted(why)}, 'recovery', {quoted(recovery)})"

    def blocked_by(capability: str) -> str:
        hit = first_block(capability)
        return (
            f"case when {hit} is not null then named_struct('reason', {hit}.message, 'recovery', {hit}.recovery) end")

    never = "cast(null as struct<reason:string,recovery:string>)"
    if "transaction_amount" not in has:
        no_amount = reason("no_amount")
    else:
        no_amount = (
            f"coalesce({blocked_by('transaction_analytics')}, "
            f"case when currency is null then {reason('no_currency')} end)")
    if "defaulted" not in has:
        no_share = reason("no_outcome")
    else:
        no_share = f"case when __a.outcome_binary = 0 then {reason('no_valid_outcome')} end"
    if anomalies is None or not ruleset:
        no_rules = reason("no_rule_run")
    else:
        otherwise = never if outputs else reason("rule_output_incomplete")
        no_rules = f"coalesce({blocked_by('risk_rule_evaluation')}, {otherwise})"
    one = one.selectExpr(
        "*", f"{no_amount} as no_amount", f"{no_share} as no_share", f"{no_rules} as no_rules",
        f"{blocked_by('customer_analytics')} as no_customers", f"{never} as never",
        f"{first_block('transaction_analytics')} is null as amounts_ready",
        "case when exists(__a.capabilities, x -> x.status = 'blocked') then 'blocked' "
        "when size(__a.issues) > 0 then 'warn' else 'pass' end as observed")

    def warned(capability: str, extra: str = "false") -> str:
        hit = f"exists(__a.issues, i -> i.severity = 'warn' and array_contains(i.capabilities, '{capability}'))"
        return f"case when {hit} or {extra} then 'warn' else 'pass' end"

    amounts, rules = warned("transaction_analytics"), warned("risk_rule_evaluation")
    share = "bround(outcome_zero / nullif(__a.outcome_binary, 0) * 100, 1)"
    partly = "__a.outcome_binary < __a.rows"
    table = [
        ("records_processed", "__a.rows", "never", "observed"),
        ("data_quality_score", "__a.composite_score", "never", "observed"),
        ("missing_values", "__a.missing_cells", "never", "observed"),
        ("duplicate_rows", "__a.duplicate_rows", "never", "observed"),
        ("transaction_value", "coalesce(amount_sum, 0.0D)", "no_amount", amounts),
        ("average_transaction_value", "amount_avg", "no_amount", amounts),
        ("unique_customers", "customers", "no_customers", warned("customer_analytics")),
        ("non_default_outcome_share", share, "no_share", warned("repayment_analytics", partly)),
        ("suspicious_records", "__r.suspicious", "no_rules", rules),
        ("high_risk_records", "__r.high", "no_rules", rules),
    ]
    lines = []
    for ordinal, (metric_id, value, why, quality) in enumerate(table, 1):
        label, unit, definition, fields = METRICS[metric_id]
        available = f"{why} is null"
        source = f"array({', '.join(quoted(x) for x in fields)})"
        if metric_id == "transaction_value" and "transaction_amount" not in has:
            source = "array('transaction_amount')"
        elif metric_id == "transaction_value":
            lacking = "array('transaction_amount', 'currency')"
            source = f"case when currency is null and amounts_ready then {lacking} else {source} end"
        of_share = metric_id == "non_default_outcome_share"
        of_rules = metric_id in ("suspicious_records", "high_risk_records")
        # The amount itself names a period only when it is available; every other metric always does.
        dated = available if metric_id == "transaction_value" else "true"
        cells = {
            "ordinal": str(ordinal),
            "metric_id": quoted(metric_id),
            "label": quoted(label),
            "status": f"case when {available} then 'available' else 'unavailable' end",
            "value": f"case when {available} then cast({value} as double) end",
            "unit": quoted(unit),
            "currency": "currency" if unit == "currency" else quoted(None),
            "definition_version": quoted(definition),
            "source_reference": quoted(reference),
            "source_fields": source,
            "quality_status": f"case when {available} then {quality} else 'blocked' end",
            "period_start": f"case when {dated} then period_start end",
            "period_end": f"case when {dated} then period_end end",
            "numerator": f"cast({f'case when {available} then outcome_zero end' if of_share else 'null'} as bigint)",
            "denominator":
                f"cast({f'case when {available} then __a.outcome_binary end' if of_share else 'null'} as bigint)",
            "unavailable_reason": f"{why}.reason",
            "recovery": f"{why}.recovery",
            "logic_version": quoted(ruleset if of_rules else None),
        }
        lines.append(f"named_struct({', '.join(f'{quoted(k)}, {v}' for k, v in cells.items())})")
    return one.selectExpr(f"inline(array({', '.join(lines)}))")


def display_value() -> Column:
    """A metric value as text; an unavailable one is never shown as a number."""
    v = F.col("value")
    whole = F.col("metric_id") != "data_quality_score"
    shown = (
        F.when(F.col("unit") == "currency", money(F.col("currency"), v))
        .when(F.col("unit") == "percent", F.concat(percent1(v), F.lit("%")))
        .when(whole, thousands(v))
        .otherwise(v.cast("string"))
    )
    return F.when((F.col("status") == "unavailable") | v.isNull(), "Not available").otherwise(shown)


def unavailable_text() -> Column:
    return F.concat(
        F.col("label"), F.lit(" is unavailable: "), F.col("unavailable_reason"), F.lit(" Recovery: "),
        F.col("recovery"))


def report_feed(metrics: DataFrame) -> DataFrame:
    """Metric rows as a report shows them."""
    period = F.when(
        F.col("period_start").isNotNull(),
        F.concat(F.col("period_start").cast("string"), F.lit(" to "), F.col("period_end").cast("string")),
    ).otherwise("Not specified")
    logic = F.when(F.col("logic_version").isNotNull(), F.concat(F.lit("; logic "), F.col("logic_version")))
    lost = F.col("status") == "unavailable"
    interpretation = F.concat(F.col("unavailable_reason"), F.lit(" Recovery: "), F.col("recovery"))
    return metrics.select(
        "ordinal", "label", display_value().alias("display_value"), "unit", period.alias("period"), "quality_status",
        F.concat(F.col("definition_version"), F.coalesce(logic, F.lit(""))).alias("definition"),
        F.when(lost, interpretation).otherwise("").alias("interpretation"))


def metric_insights(metrics: DataFrame) -> DataFrame:
    """Five review notes, the quality note first; unavailable metrics say why."""
    quality = fill(METRIC_NARRATIVES["quality"], value=percent1(F.col("value")), status=F.col("quality_status"))
    not_revenue = F.when(F.col("metric_id") == "transaction_value", METRIC_NARRATIVES["not_revenue"]).otherwise("")
    available = fill(
        METRIC_NARRATIVES["available"], label=F.col("label"), value=display_value(),
        status=F.col("quality_status"), qualification=not_revenue, definition=F.col("definition_version"))
    text = (
        F.when(F.col("metric_id") == "data_quality_score", quality)
        .when(F.col("status") == "unavailable", unavailable_text())
        .otherwise(available)
    )
    wanted = ("data_quality_score", *NARRATED)
    place = F.lit(0)
    for i, metric_id in enumerate(wanted, 1):
        place = F.when(F.col("metric_id") == metric_id, i).otherwise(place)
    return metrics.where(F.col("metric_id").isin(*wanted)).select(
        place.alias("ordinal"), "metric_id", text.alias("insight"))


def coverage_sentence(coverage: DataFrame) -> DataFrame:
    """One row: evaluated of possible record-rule evaluations, as numbers and as a sentence."""
    from folioguard.fixed_values import KPI_NARRATIVES, RULESET_VERSION

    totals = coverage.agg(
        F.sum("evaluated_records").alias("evaluated"),
        F.sum(F.col("evaluated_records") + F.col("not_evaluated_records")).alias("possible"))
    return totals.withColumn("sentence", fill(
        KPI_NARRATIVES["rule_coverage"], evaluated=thousands(F.col("evaluated")), possible=thousands(F.col("possible")),
        ruleset=F.lit(RULESET_VERSION)))
