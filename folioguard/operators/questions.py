"""Answers to business questions: intent by keyword precedence, facts from one row, text from fixed templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioguard.fixed_values import ANSWERS, QUESTION_INTENTS
from folioguard.functions.scalars import fill, money, percent1, thousands
from folioguard.operators.rules import flagged, top_of_queue, unevaluated_total
from folioguard.operators.summaries import largest_segment, most_common_category

MODEL_MEASURES = ("accuracy", "precision", "recall", "f1_score", "roc_auc", "pr_auc")
_METRIC_FIELDS = (
    "label", "status", "value", "currency", "quality_status", "definition_version", "unavailable_reason", "recovery",
    "logic_version", "source_reference")


def normalized_question(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", " "))


def intent(c: Column) -> Column:
    """The first intent, in precedence order, one of whose keywords is in the question."""
    text = normalized_question(c)
    out = F.lit("fallback")
    for name, keywords in reversed(QUESTION_INTENTS):
        hit = F.lit(False)
        for keyword in keywords:
            hit = hit | text.contains(keyword)
        out = F.when(hit, name).otherwise(out)
    return F.when(text == "", "empty").otherwise(out)


def facts(df: DataFrame, anomalies: DataFrame, metrics: DataFrame, tie_breakers: list[str], dataset: str) -> DataFrame:
    """Everything the answers quote, on one row."""
    ids = (
        "suspicious_records", "transaction_value", "average_transaction_value", "data_quality_score",
        "missing_values", "duplicate_rows", "unique_customers",
    )
    one = metrics.agg(*[
        F.max(F.when(F.col("metric_id") == m, F.struct(*_METRIC_FIELDS))).alias(m) for m in ids])
    example = top_of_queue(flagged(anomalies), tie_breakers, 1)
    id_column = F.col("transaction_id") if "transaction_id" in anomalies.columns else F.lit("the top flagged record")
    one = one.withColumns({
        "category": most_common_category(anomalies).select(F.struct("suspicious_category", "records")).scalar(),
        "example": example.select(F.struct(
            F.coalesce(id_column, F.lit("None")).alias("transaction"), F.col("anomaly_notes").alias("notes"))).scalar(),
        "not_evaluated": unevaluated_total(anomalies).scalar(),
        "dataset": F.lit(dataset),
    })
    if "segment" in df.columns:
        return one.withColumn("segment", largest_segment(df).select("segment").scalar())
    return one.withColumn("segment", F.lit(None).cast("string"))


def answers(
    questions: DataFrame, column: str, one: DataFrame, model_metrics: dict[str, float] | None = None
) -> DataFrame:
    """``questions`` with ``intent`` and ``answer``; the facts are read once as a single value."""
    f = F.col("__f")
    caveat = F.when(
        f["not_evaluated"] > 0, fill(ANSWERS["caveat"], count=thousands(f["not_evaluated"]))).otherwise("")

    def lost(metric: str) -> Column:
        m = f[metric]
        text = fill(
            ANSWERS["unavailable"], label=m["label"], reason=m["unavailable_reason"], recovery=m["recovery"])
        return F.when(m["status"] == "unavailable", text)

    def shown(metric: str) -> Column:
        m = f[metric]
        none = (m["status"] == "unavailable") | m["value"].isNull()
        return F.when(none, "Not available").otherwise(money(m["currency"], m["value"]))

    risk = f["suspicious_records"]
    quality = f["data_quality_score"]
    if model_metrics:
        model = fill(ANSWERS["model"], **{
            k: F.lit(f"{model_metrics.get(k, float('nan')):.2f}") for k in MODEL_MEASURES})
    else:
        model = F.lit(ANSWERS["model_none"])
    before = F.concat(F.lit("Before recommending a risk action, "), F.lower(lost("suspicious_records")))
    texts = {
        "empty": F.lit(ANSWERS["empty"]),
        "biggest_risk": F.coalesce(
            lost("suspicious_records"),
            F.when(f["category"].isNull(), fill(
                ANSWERS["biggest_risk_none"], ruleset=risk["logic_version"], dataset=f["dataset"], caveat=caveat)),
            fill(ANSWERS["biggest_risk"], category=F.lower(f["category"]["suspicious_category"]),
                 count=thousands(f["category"]["records"]), caveat=caveat)),
        "next_action": F.coalesce(
            F.when(risk["status"] == "unavailable", before),
            F.when(risk["value"] > 0, ANSWERS["next_action"]),
            F.lit(ANSWERS["next_action_none"])),
        "why_flagged": F.coalesce(
            lost("suspicious_records"),
            F.when(f["category"].isNull(), fill(ANSWERS["why_flagged_none"], caveat=caveat)),
            fill(ANSWERS["why_flagged"], transaction=f["example"]["transaction"],
                 notes=F.lower(f["example"]["notes"]), caveat=caveat)),
        "transaction_value": F.coalesce(
            lost("transaction_value"),
            fill(ANSWERS["transaction_value"], total=shown("transaction_value"),
                 average=shown("average_transaction_value"),
                 definition=f["transaction_value"]["definition_version"],
                 dataset=F.coalesce(f["transaction_value"]["source_reference"], f["dataset"]))),
        "data_quality": fill(
            ANSWERS["data_quality"], score=percent1(quality["value"]), status=quality["quality_status"],
            missing=thousands(f["missing_values"]["value"]), duplicates=thousands(f["duplicate_rows"]["value"])),
        "model": model,
        "segment": F.coalesce(
            lost("unique_customers"),
            F.when(f["segment"].isNotNull(), fill(
                ANSWERS["segment"], segment=f["segment"], customers=thousands(f["unique_customers"]["value"]))),
            fill(ANSWERS["segment_none"], customers=thousands(f["unique_customers"]["value"]))),
    }
    answer = F.lit(ANSWERS["fallback"])
    for name, text in texts.items():
        answer = F.when(F.col("intent") == name, text).otherwise(answer)
    rows = questions.withColumn("intent", intent(F.col(column)))
    rows = rows.withColumn("__f", one.select(F.struct("*")).scalar())
    return rows.withColumn("answer", answer).drop("__f")


