"""Seven transparent risk rules with a triggered / clear / not_evaluated status for every row."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from folioguard.fixed_values import REVIEW_COLUMNS, RULE_INPUTS, RULES, RULESET_VERSION
from folioguard.functions.keyed import attach
from folioguard.functions.scalars import clip, missing, n_if, num, present_text, r1
from folioguard.operators.quantiles import (
    Quantile, average_ranks, exact_quantiles, quantiles_of, ranks_of, value_counts)
from folioguard.session import materialize, together

RULE_IDS = [rule_id for rule_id, _ in RULES]


class CapabilityBlocked(ValueError):
    """The dataset lacks what an operation needs."""


def status_column(rule_id: str) -> str:
    return f"rule_{rule_id}_status"


def require_rule_inputs(df: DataFrame) -> None:
    """Refuse, before any job starts, a dataset without the rule input columns."""
    absent = [c for c in RULE_INPUTS if c not in df.columns]
    if absent:
        raise CapabilityBlocked(
            f"Risk rule evaluation is blocked: Risk-rule evaluation is missing required inputs: {', '.join(absent)}.")


def rule_readiness(columns: DataFrame) -> DataFrame:
    """The same guard for many datasets at once: ``dataset_id`` and one row a dataset with status, the absent inputs in
    order and the message; ``columns`` has dataset_id and normalized_column."""
    there = columns.where(F.col("normalized_column").isin(*RULE_INPUTS)).groupBy("dataset_id").agg(
        F.collect_set("normalized_column").alias("there"))  # at most the rule inputs
    wanted = F.array(*[F.lit(c) for c in RULE_INPUTS])
    absent = F.array_join(F.array_except(wanted, F.coalesce("there", F.array().cast("array<string>"))), ", ")
    rows = columns.select("dataset_id").distinct().join(there, "dataset_id", "left")
    return rows.select(
        "dataset_id", F.when(absent == "", "ready").otherwise("blocked").alias("status"), absent.alias("missing_inputs"),
        F.when(absent != "", F.concat(F.lit(
            "Risk rule evaluation is blocked: Risk-rule evaluation is missing required inputs: "), absent, F.lit("."))).alias(
            "message"))


def duplicate_key(df: DataFrame) -> tuple[list[str], Column] | None:
    """Columns that identify a record, and where they can be used."""
    if "transaction_id" in df.columns:
        return ["transaction_id"], present_text(F.col("transaction_id"))
    if {"customer_id", "date", "transaction_amount"} <= set(df.columns):
        usable = (
            present_text(F.col("customer_id"))
            & present_text(F.col("date"))
            & num(df, "transaction_amount").isNotNull()
        )
        return ["customer_id", "date", "transaction_amount"], usable
    return None


def repeated_keys(df: DataFrame) -> DataFrame | None:
    """Record keys held by more than one row, with the number of rows."""
    found = duplicate_key(df)
    if found is None:
        return None
    keys, usable = found
    return df.where(usable).groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def segment_medians(df: DataFrame) -> DataFrame:
    """Median amount per segment, segments as they are written, null left out."""
    wanted = [Quantile("segment_amount", num(df, "transaction_amount"), 0.5, grouped=True, spread=False)]
    return exact_quantiles(df, wanted, F.col("segment")).select(
        F.col("grp").alias("segment"), F.col("n").alias("records"), F.col("quantile").alias("median_amount"))


AMOUNT_REQUEST = 0


def _baseline_requests(df: DataFrame) -> tuple[list[Quantile], Column | None]:
    amount = num(df, "transaction_amount")
    wanted = [
        Quantile("amount", amount, 0.992, spread=False), Quantile("frequency", num(df, "transaction_frequency"), 0.992)]
    if "segment" in df.columns:
        return [*wanted, Quantile("segment_amount", amount, 0.5, grouped=True, spread=False)], F.col("segment")
    return [*wanted, Quantile("overall_amount", amount, 0.5, spread=False)], None


def rule_baselines(df: DataFrame) -> DataFrame:
    """Portfolio and segment baselines, from two numeric columns and the segment."""
    return exact_quantiles(df, *_baseline_requests(df))


def rule_thresholds(baselines: DataFrame) -> DataFrame:
    """One row: the two portfolio-wide thresholds."""
    amount = F.col("name") == "amount"
    frequency = F.col("name") == "frequency"
    return baselines.agg(
        F.max(F.when(amount, F.greatest(F.col("mean") * 4.5, F.col("quantile")))).alias("amount_threshold"),
        F.max(F.when(frequency, F.greatest(F.col("quantile"), F.col("mean") + F.col("std") * 2.4))).alias(
            "frequency_threshold"),
        F.max(F.when(F.col("name") == "overall_amount", F.col("quantile"))).alias("median_amount"),
    )


@dataclass(frozen=True)
class RuleFacts:
    """What the rules compare a row with: thresholds, and written tables of segment medians, repeated keys and ranks."""

    thresholds: Row
    baselines: DataFrame
    copies: DataFrame | None
    ranks: DataFrame | None


def rule_facts(df: DataFrame, ranks: bool = False) -> RuleFacts:
    """The facts of a portfolio. Amounts, amounts by segment and frequencies are counted in one scan; thresholds, medians
    and ranks all come from these written counts, side by side. Record keys are counted beside."""
    require_rule_inputs(df)
    wanted, by = _baseline_requests(df)
    repeated = repeated_keys(df)

    def from_counts():
        counts = value_counts(df, wanted, by)
        jobs = [lambda: materialize(quantiles_of(counts, wanted), "baselines")]
        if ranks:
            jobs.append(lambda: materialize(_percent_ranks(ranks_of(counts, AMOUNT_REQUEST)), "amount-ranks"))
        baselines, *ranked = together(*jobs)
        return rule_thresholds(baselines).first(), baselines, ranked[0] if ranked else None

    def keys():
        return None if repeated is None else materialize(repeated.withColumnRenamed("copies", "__copies"), "repeated-keys")

    (thresholds, baselines, ranked), copies = together(from_counts, keys)
    return RuleFacts(thresholds, baselines, copies, ranked)


def rule_statuses(df: DataFrame, facts: RuleFacts | None = None) -> DataFrame:
    """``df`` plus one status column per rule.

    The baselines and the repeated record keys are written, so the planner knows their size; while they are small, the
    pass that writes the statuses needs no shuffle.
    """
    facts = facts or rule_facts(df)
    limits, copies = facts.thresholds, facts.copies
    rows = df
    if "segment" in df.columns:
        medians = facts.baselines.where(F.col("name") == "segment_amount").select(
            F.col("grp").alias("segment"), F.col("quantile").alias("__median"))
        rows = attach(rows, medians, [(F.col("segment"), "segment")], ["__median"])
    else:
        rows = rows.withColumn("__median", F.lit(limits["median_amount"]).cast("double"))
    if copies is not None:
        on = [(F.col(k), k) for k in duplicate_key(df)[0]]
        rows = attach(rows, copies, on, ["__copies"])
    else:
        rows = rows.withColumn("__copies", F.lit(None).cast("long"))
    amount, income = num(df, "transaction_amount"), num(df, "income")
    loan, debt = num(df, "loan_amount"), num(df, "existing_debt")
    score, frequency = num(df, "repayment_history_score"), num(df, "transaction_frequency")
    earns = income.isNotNull() & (income > 0)
    spike = amount.isNotNull()
    if "segment" in df.columns:
        spike = spike & present_text(F.col("segment"))
    found = duplicate_key(df)
    checks = {
        "unusually_high_amount": (
            amount.isNotNull(), amount > F.lit(limits["amount_threshold"]).cast("double")),
        "duplicate_record": (
            found[1] if found else F.lit(False), F.col("__copies") > 1),
        "spending_spike": (spike, amount > F.col("__median") * 4.2),
        "repayment_pattern": (score.isNotNull(), score < 36),
        "loan_to_income": (loan.isNotNull() & earns, loan > income * 2.15),
        "rapid_transactions": (
            frequency.isNotNull(), frequency > F.lit(limits["frequency_threshold"]).cast("double")),
        "debt_to_income": (debt.isNotNull() & earns, debt > income * 0.82),
    }
    statuses = {
        status_column(rule_id): F.when(~F.coalesce(checks[rule_id][0], F.lit(False)), "not_evaluated")
        .when(F.coalesce(checks[rule_id][1], F.lit(False)), "triggered")
        .otherwise("clear")
        for rule_id in RULE_IDS
    }
    return rows.withColumns(statuses).drop("__median", "__copies")


def _chosen(status: str, labels: Iterable[tuple[str, str]]) -> Column:
    return F.array_compact(
        F.array(*[F.when(F.col(status_column(rule_id)) == status, F.lit(text)) for rule_id, text in labels]))


def explain_rules(statuses: DataFrame) -> DataFrame:
    """Counts, coverage, notes, category and priority derived from the status columns."""
    triggered = _chosen("triggered", RULES)
    skipped = _chosen("not_evaluated", [(rule_id, rule_id) for rule_id in RULE_IDS])
    rows = statuses.withColumns({"__labels": triggered, "__skipped": skipped})
    n_labels, n_skipped = F.size("__labels"), F.size("__skipped")
    said = F.when(n_labels > 0, F.array_join("__labels", "; ")).otherwise("No evaluated rule triggered")
    unsaid = F.when(n_skipped > 0, F.concat(F.lit("Not evaluated: "), F.array_join("__skipped", ", ")))
    return rows.withColumns({
        "anomaly_notes": F.concat_ws("; ", said, unsaid),
        "rule_version": F.lit(RULESET_VERSION),
        "rules_evaluated_count": (F.lit(len(RULES)) - n_skipped).cast("long"),
        "rules_not_evaluated_count": n_skipped.cast("long"),
        "not_evaluated_rule_ids": F.array_join("__skipped", "|"),
        "rule_coverage_status": F.when(n_skipped == len(RULES), "none").when(n_skipped > 0, "partial").otherwise(
            "full"),
        "is_suspicious": n_labels > 0,
        "suspicious_category": F.coalesce(F.get("__labels", F.lit(0)), F.lit("Normal")),
        "risk_level": F.when(n_labels >= 3, "High").when(n_labels == 2, "Medium").when(n_labels == 1, "Low").otherwise(
            "Normal"),
        "__triggered": n_labels,
    }).drop("__labels", "__skipped")


def _percent_ranks(ranked: DataFrame) -> DataFrame:
    return ranked.select(
        F.col("v").alias("transaction_amount"), F.col("c").alias("records"),
        (F.col("rank") / F.col("n")).alias("amount_rank"))


def amount_percent_ranks(df: DataFrame) -> DataFrame:
    """Average percent rank of every distinct amount: ``transaction_amount, records, amount_rank``."""
    return _percent_ranks(average_ranks(df, num(df, "transaction_amount")))


def attach_amount_rank(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """``rows`` plus ``amount_rank``: average rank over the number of amounts, zero where there is no amount."""
    known = ranks.select("transaction_amount", F.col("amount_rank").alias("__rank"))
    ranked = attach(rows, known, [(num(rows, "transaction_amount"), "transaction_amount")], ["__rank"])
    return ranked.withColumn("amount_rank", F.coalesce("__rank", F.lit(0.0))).drop("__rank")


def detect_anomalies(df: DataFrame) -> DataFrame:
    """Statuses, explanations and the 0-100 review score for every row of ``df``."""
    facts = rule_facts(df, ranks=True)
    rows = attach_amount_rank(explain_rules(rule_statuses(df, facts)), facts.ranks)
    shortfall = F.coalesce(clip(70 - num(df, "repayment_history_score"), 0.0, 70.0), F.lit(0.0)) / 70
    income = num(df, "income")
    burden = F.coalesce(clip(F.when(income > 0, num(df, "existing_debt") / income), 0.0, 1.0), F.lit(0.0))
    points = F.col("__triggered") * 24 + F.col("amount_rank") * 18 + shortfall * 32 + burden * 20
    score = F.when(F.col("rules_evaluated_count") > 0, r1(clip(points, 0.0, 100.0)))
    return rows.withColumn("anomaly_score", score).drop("__triggered", "amount_rank")


def flagged(df: DataFrame) -> DataFrame:
    """Rows at least one rule was triggered on; none when ``df`` is not a rule result."""
    if "is_suspicious" not in df.columns:
        return df.where(F.lit(False))
    return df.where(F.coalesce("is_suspicious", F.lit(False)))


def rule_coverage(statuses: DataFrame) -> DataFrame:
    """Per rule: evaluated, not evaluated, triggered, coverage. One aggregation row, turned into seven."""
    counts = []
    for rule_id in RULE_IDS:
        name = status_column(rule_id)
        status = F.col(name) if name in statuses.columns else F.lit("not_evaluated")
        counts += [n_if(status == "not_evaluated").alias(f"s_{rule_id}"), n_if(status == "triggered").alias(
            f"t_{rule_id}")]
    one = statuses.agg(F.count("*").alias("total"), *counts)
    lines = F.array(*[
        F.struct(
            F.lit(rule_id).alias("rule_id"),
            F.lit(label).alias("rule_label"),
            (F.col("total") - F.col(f"s_{rule_id}")).alias("evaluated_records"),
            F.col(f"s_{rule_id}").alias("not_evaluated_records"),
            F.col(f"t_{rule_id}").alias("triggered_records"),
            F.when(
                F.col("total") > 0, r1((F.col("total") - F.col(f"s_{rule_id}")) / F.col("total") * 100)
            ).otherwise(0.0).alias("coverage_percent"),
            F.lit(RULESET_VERSION).alias("rule_version"),
        )
        for rule_id, label in RULES
    ])
    return one.select(F.inline(lines))


def anomaly_summary(anomalies: DataFrame) -> DataFrame:
    """Flagged rows by category and priority, most frequent first."""
    return (
        flagged(anomalies)
        .groupBy("suspicious_category", "risk_level")
        .agg(F.count("*").alias("records"))
        .orderBy(F.desc("records"), "suspicious_category", "risk_level")
    )


def category_totals(anomalies: DataFrame) -> DataFrame:
    """Category by priority with a subtotal per category (``risk_level`` null), in one aggregation."""
    return (
        flagged(anomalies)
        .groupingSets([["suspicious_category", "risk_level"], ["suspicious_category"]],
                      "suspicious_category", "risk_level")
        .agg(F.count("*").alias("records"))
    )


def review_header(anomalies: DataFrame) -> DataFrame:
    """One row: flagged records, their share, high-priority flags, top score."""
    flag = F.coalesce("is_suspicious", F.lit(False))
    total = F.count("*")
    return anomalies.agg(
        n_if(flag).alias("flagged_records"),
        F.when(total > 0, r1(n_if(flag) / total * 100)).alias("flagged_share_percent"),
        n_if(flag & (F.col("risk_level") == "High")).alias("high_priority_flags"),
        F.coalesce(F.max(F.when(flag, F.col("anomaly_score"))), F.lit(0.0)).alias("top_anomaly_score"),
    )


def review_queue(
    anomalies: DataFrame, priority: str | None = None, category: str | None = None, query: str = ""
) -> DataFrame:
    """Flagged rows narrowed by priority, category and a literal, case-blind id search."""
    rows = flagged(anomalies)
    if priority:
        rows = rows.where(F.col("risk_level") == priority)
    if category:
        rows = rows.where(F.col("suspicious_category") == category)
    needle = query.strip().lower()
    if needle:
        hit = F.lit(False)
        for name in ("customer_id", "transaction_id"):
            if name in rows.columns:
                hit = hit | F.coalesce(F.lower(F.col(name).cast("string")).contains(needle), F.lit(False))
        rows = rows.where(hit)
    return rows


def display_columns(rows: DataFrame) -> DataFrame:
    """The review columns that are there."""
    return rows.select([c for c in REVIEW_COLUMNS if c in rows.columns])


def top_of_queue(rows: DataFrame, tie_breakers: Iterable[str], n: int = 250) -> DataFrame:
    """The ``n`` highest scores; ``tie_breakers`` make the cut repeatable."""
    return rows.orderBy(F.col("anomaly_score").desc_nulls_last(), *tie_breakers).limit(n)


def unevaluated_total(anomalies: DataFrame) -> DataFrame:
    """One row: how many record-rule evaluations could not be made."""
    if "rules_not_evaluated_count" not in anomalies.columns:
        return anomalies.agg(F.lit(0).cast("long").alias("not_evaluated"))
    return anomalies.agg(
        F.coalesce(F.sum(F.coalesce(num(anomalies, "rules_not_evaluated_count"), F.lit(0.0))), F.lit(0.0)).cast(
            "long").alias("not_evaluated"))


def missing_marks(df: DataFrame) -> dict[str, Column]:
    """Per column, where it is missing."""
    return {c: missing(df, c) for c in df.columns}
