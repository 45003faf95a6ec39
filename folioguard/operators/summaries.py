"""Chart tables and the older KPI record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioguard.fixed_values import KPI_NARRATIVES
from folioguard.functions.scalars import clip, fill, missing, n_if, num, r1, ts
from folioguard.operators.profile import assess
from folioguard.operators.quantiles import Quantile, exact_quantiles
from folioguard.operators.rules import flagged

DEFAULT_OUTCOMES = ((0, "Repaid"), (1, "Defaulted"))


def medians_of(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians of the parseable values, all from one pass; a column without any is left out."""
    there = [c for c in columns if c in df.columns]
    found = exact_quantiles(df, [Quantile(c, num(df, c), 0.5, spread=False) for c in there]).collect() if there else []
    return {r["name"]: r["quantile"] for r in found}


def _median_row(df: DataFrame, columns: Sequence[str]) -> DataFrame | None:
    """One struct of the same medians as a plan, null where nothing parses; None when no column is there."""
    there = [c for c in columns if c in df.columns]
    if not there:
        return None
    found = exact_quantiles(df, [Quantile(c, num(df, c), 0.5, spread=False) for c in there])
    return found.agg(F.struct(*[
        F.max(F.when(F.col("name") == c, F.col("quantile"))).alias(c) if c in there else F.lit(None).cast("double").alias(c)
        for c in columns]))


def imputed(df: DataFrame, column: str, default: float = 0.0, medians: dict[str, float] | None = None) -> Column:
    """Parseable values, the median elsewhere; ``default`` throughout when nothing parses."""
    if column not in df.columns:
        return F.lit(default)
    known = medians_of(df, [column]) if medians is None else medians
    return F.coalesce(num(df, column), F.lit(known.get(column, default)))


def kpi_record(df: DataFrame, anomalies: DataFrame | None = None) -> DataFrame:
    """The older ten-value KPI record. It imputes; the governed metrics do not."""
    customers = F.countDistinct("customer_id") if "customer_id" in df.columns else F.count("*")
    source = anomalies if anomalies is not None and "is_suspicious" in anomalies.columns else df
    no_rows = F.lit(0).cast("long")
    if source is not df:
        suspicious = n_if(F.col("is_suspicious"))
    elif "suspicious_category" in df.columns:
        # A missing category differs from "Normal" too.
        suspicious = n_if(~F.col("suspicious_category").eqNullSafe("Normal"))
    else:
        suspicious = no_rows
    high = n_if(F.col("risk_level") == "High") if "risk_level" in source.columns else no_rows
    flags = source.agg(F.struct(suspicious.alias("suspicious"), high.alias("high")))
    amount, outcome = (num(df, c) if c in df.columns else F.lit(None).cast("double") for c in (
        "transaction_amount", "defaulted"))
    sums = df.agg(
        F.count("*").alias("records_processed"), customers.alias("total_customers"),
        F.count(amount).alias("amounts"), F.sum(amount).alias("amount_sum"),
        F.count(outcome).alias("outcomes"), F.sum(clip(outcome, 0.0, 1.0)).alias("outcome_sum"))
    # The median stands for every value that does not parse, so it enters the sums times their number; it is worked out
    # beside them.
    medians = _median_row(df, ["transaction_amount", "defaulted"])
    one = sums.withColumn("__m", medians.scalar()) if medians is not None else sums.withColumn(
        "__m", F.struct(*[F.lit(None).cast("double").alias(c) for c in ("transaction_amount", "defaulted")]))
    n = F.col("records_processed")

    def filled(total: str, count: str, median: Column) -> Column:
        rest = (n - F.col(count)) * F.coalesce(median, F.lit(0.0))
        return F.coalesce(F.col(total), F.lit(0.0)) + F.when(n > F.col(count), rest).otherwise(0.0)

    revenue = filled("amount_sum", "amounts", F.col("__m")["transaction_amount"])
    defaults = filled("outcome_sum", "outcomes", clip(F.col("__m")["defaulted"], 0.0, 1.0))
    one = one.select(
        "records_processed", revenue.alias("total_revenue"), "total_customers",
        F.when(n > 0, revenue / n).otherwise(0.0).alias("average_transaction_value"),
        F.when(n > 0, r1((1 - defaults / n) * 100)).otherwise(0.0).alias("loan_repayment_rate"))
    one = one.withColumn("__f", flags.scalar()).withColumn("__q", assess(df).select(
        F.struct("composite_score", "missing_cells", "duplicate_rows")).scalar())
    return one.select(
        "records_processed", "total_revenue", "total_customers", "average_transaction_value", "loan_repayment_rate",
        F.col("__f")["high"].alias("high_risk_customers"),
        F.col("__f")["suspicious"].alias("suspicious_transactions"),
        F.col("__q")["composite_score"].alias("data_quality_score"),
        F.col("__q")["missing_cells"].alias("missing_values"),
        F.col("__q")["duplicate_rows"].alias("duplicate_rows"),
    )


def monthly_amount(df: DataFrame, impute: bool = True) -> DataFrame:
    """Amount per ``yyyy-MM``; rows without a parseable date fall in ``NaT``.

    ``impute`` puts the median in for missing amounts, as the older trend does; off, it follows the governed total.
    """
    if "date" in df.columns:
        month = F.coalesce(F.date_format(ts(df, "date"), "yyyy-MM"), F.lit("NaT"))
    elif "month" in df.columns:
        month = F.col("month").cast("string")
    else:
        month = F.lit("Unknown")
    amount = num(df, "transaction_amount") if "transaction_amount" in df.columns else F.lit(None).cast("double")
    medians = _median_row(df, ["transaction_amount"]) if impute else None
    months = df.select(month.alias("month"), amount.alias("a")).groupBy("month").agg(
        F.coalesce(F.sum("a"), F.lit(0.0)).alias("s"), (F.count("*") - F.count("a")).alias("lost"))
    median = F.coalesce(F.col("__m")["transaction_amount"], F.lit(0.0)) if medians is not None else F.lit(0.0)
    if medians is not None:
        months = months.withColumn("__m", medians.scalar())
    return months.select(
        "month", (F.col("s") + F.when(F.col("lost") > 0, F.col("lost") * median).otherwise(0.0)).alias("transaction_amount")
    ).orderBy("month")


def category_counts(df: DataFrame, column: str, value_name: str = "records") -> DataFrame:
    """Rows per category, missing as ``Unknown``, most frequent first."""
    label = F.when(missing(df, column), "Unknown").otherwise(F.col(column).cast("string"))
    return (
        df.select(label.alias(column)).groupBy(column).agg(F.count("*").alias(value_name))
        .orderBy(F.desc(value_name), column)
    )


def outcome_breakdown(df: DataFrame) -> DataFrame:
    """Counts of ``repayment_status``, or of a label made from the imputed ``defaulted``."""
    if "repayment_status" in df.columns:
        return category_counts(df, "repayment_status")
    outcome = clip(imputed(df, "defaulted"), 0.0, 1.0)
    label = F.lit("Unknown")
    for code, text in DEFAULT_OUTCOMES:
        label = F.when(outcome == code, text).otherwise(label)
    return category_counts(df.select(label.alias("repayment_status")), "repayment_status")


def top_segment_by_amount(df: DataFrame) -> DataFrame:
    """The segment with the largest (imputed) amount; ties go to the first name."""
    amount = imputed(df, "transaction_amount")
    totals = df.where(F.col("segment").isNotNull()).select("segment", amount.alias("a")).groupBy("segment").agg(
        F.sum("a").alias("total_amount"))
    return totals.orderBy(F.desc("total_amount"), "segment").limit(1)


def most_common_category(anomalies: DataFrame) -> DataFrame:
    """The commonest category among flagged rows, with its count."""
    return flagged(anomalies).groupBy("suspicious_category").agg(F.count("*").alias("records")).orderBy(
        F.desc("records"), "suspicious_category").limit(1)


def largest_segment(df: DataFrame) -> DataFrame:
    return category_counts(df, "segment").limit(1)


def equal_width_bins(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Right-closed equal-width bins over the parseable values, empty ones kept.

    The lowest edge moves down by a thousandth of the range, so the smallest value falls in the first bin. A
    column of one value is widened by a thousandth of it on both sides.
    """
    x = num(df, column)
    span = df.select(x.alias("x")).where("x is not null").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    pad = F.when(F.col("lo") != 0, F.abs("lo") * 0.001).otherwise(0.001)
    span = span.select(
        F.struct(
            F.when(flat, F.col("lo") - pad).otherwise(F.col("lo")).alias("lo"),
            F.when(flat, F.col("hi") + pad).otherwise(F.col("hi")).alias("hi"),
            flat.alias("flat")))
    rows = df.select(x.alias("x")).where("x is not null").withColumn("s", span.scalar())
    width = (F.col("s")["hi"] - F.col("s")["lo"]) / bins
    position = F.ceil((F.col("x") - F.col("s")["lo"]) / width)
    counted = rows.groupBy(F.least(F.greatest(position, F.lit(1)), F.lit(bins)).cast("int").alias("bin")).agg(
        F.count("*").alias("records"))
    spark = df.sparkSession
    grid = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin")).withColumn("s", span.scalar())
    step = (F.col("s")["hi"] - F.col("s")["lo"]) / bins
    low = F.col("s")["lo"] + (F.col("bin") - 1) * step
    widened = F.when((F.col("bin") == 1) & ~F.col("s")["flat"], low - (F.col("s")["hi"] - F.col("s")["lo"]) * 0.001)
    edges = grid.select(
        "bin", F.coalesce(widened, low).alias("low"), (F.col("s")["lo"] + F.col("bin") * step).alias("high"))
    return edges.join(counted, "bin", "left").select(
        "bin", "low", "high", F.coalesce("records", F.lit(0)).cast("long").alias("records"))


def page(df: DataFrame, order: list[str], number: int, size: int = 250) -> DataFrame:
    """Page ``number`` (from one) in a stable order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def filter_options(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-missing values, sorted."""
    return df.where(~missing(df, column)).select(column).distinct().orderBy(column)


def scope(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows equal to every given choice; a choice of None is no filter."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def kpi_insights(
    df: DataFrame, kpis: DataFrame, anomalies: DataFrame | None = None, model_metrics: dict[str, float] | None = None,
    keep: int = 7,
) -> DataFrame:
    """Up to ``keep`` rule-based notes, in order, from the KPI record and two arg-max facts."""
    k = kpis
    none = F.lit(None).cast("string")
    notes = []
    if {"segment", "transaction_amount"} <= set(df.columns):
        top = top_segment_by_amount(df).select("segment")
        k = k.withColumn("__segment", top.scalar())
        notes.append(F.when(F.col("__segment").isNotNull(), fill(
            KPI_NARRATIVES["top_segment"], segment=F.col("__segment"))))
    rate = F.col("suspicious_transactions") / F.greatest(F.col("records_processed"), F.lit(1)) * 100
    notes.append(
        F.when(rate > 15, KPI_NARRATIVES["suspicious_high"])
        .when(rate > 0, KPI_NARRATIVES["suspicious_some"])
        .otherwise(KPI_NARRATIVES["suspicious_none"]))
    repaid = F.col("loan_repayment_rate")
    notes.append(
        F.when(repaid >= 85, KPI_NARRATIVES["repayment_high"])
        .when(repaid >= 65, KPI_NARRATIVES["repayment_mid"])
        .otherwise(KPI_NARRATIVES["repayment_low"]))
    notes.append(
        F.when(F.col("data_quality_score") < 90, KPI_NARRATIVES["quality_low"]).otherwise(
            KPI_NARRATIVES["quality_ok"]))
    for name, slot, text in (("f1_score", "f1", "model_f1"), ("roc_auc", "auc", "model_auc")):
        if model_metrics and model_metrics.get(name) is not None:
            shown = F.lit(f"{model_metrics[name]:.2f}")
            notes.append(fill(KPI_NARRATIVES[text], **{slot: shown}))
    if anomalies is not None and "suspicious_category" in anomalies.columns:
        k = k.withColumn("__pattern", most_common_category(anomalies).select("suspicious_category").scalar())
        notes.append(F.when(F.col("__pattern").isNotNull(), fill(
            KPI_NARRATIVES["top_pattern"], category=F.lower("__pattern"))).otherwise(none))
    kept = F.slice(F.array_compact(F.array(*notes)), 1, keep)
    return k.select(F.posexplode(kept).alias("p", "insight")).select((F.col("p") + 1).alias("ordinal"), "insight")


def legacy_currency(c: Column) -> Column:
    """``NGN 1,234``."""
    return F.concat(F.lit("NGN "), F.format_number(F.bround(c, 0).cast("decimal(38,0)"), 0))


def period_label(df: DataFrame) -> DataFrame:
    """``05 Jan 2026 - 31 Mar 2026``, or that there is none."""
    when = ts(df, "date") if "date" in df.columns else F.lit(None).cast("timestamp")
    first, last = F.date_format(F.min(when), "dd MMM yyyy"), F.date_format(F.max(when), "dd MMM yyyy")
    return df.agg(F.coalesce(F.concat(first, F.lit(" - "), last), F.lit("Not available")).alias("period_label"))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Rows numbered from one inside each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


