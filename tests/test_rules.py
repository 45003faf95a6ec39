import pytest
from pyspark.sql import functions as F

from tests.conftest import frame, portfolio_row
from folioguard.fixed_values import RULES, RULESET_VERSION
from folioguard.operators import rules as R
from folioguard.sources.portfolio import portfolio


def two_rows(spark):
    return frame(spark, [
        portfolio_row(transaction_id="T1", repayment_history_score=20.0),
        portfolio_row(transaction_id=None, transaction_amount=None, loan_amount=None),
    ])


def test_missing_evidence_is_not_a_clear_result(spark):
    rows = {r["transaction_id"]: r for r in R.detect_anomalies(two_rows(spark)).collect()}
    poor = rows[None]
    assert poor["rule_unusually_high_amount_status"] == "not_evaluated"
    assert poor["rule_loan_to_income_status"] == "not_evaluated"
    assert poor["rule_repayment_pattern_status"] == "clear"
    assert poor["rules_not_evaluated_count"] == 4
    assert poor["rule_coverage_status"] == "partial"
    assert poor["anomaly_notes"].startswith("No evaluated rule triggered; Not evaluated: unusually_high_amount")
    good = rows["T1"]
    assert (good["is_suspicious"], good["risk_level"]) == (True, "Low")
    assert good["suspicious_category"] == "High-risk repayment pattern"
    assert good["rule_version"] == RULESET_VERSION
    assert good["rule_coverage_status"] == "full"


def test_nothing_evaluated_has_no_score(spark):
    names = [f"{c} double" for c in (
        "transaction_amount", "income", "loan_amount", "existing_debt", "repayment_history_score",
        "transaction_frequency")]
    df = spark.createDataFrame([(None,) * 6, (None,) * 6], ", ".join(names))
    for r in R.detect_anomalies(df).collect():
        assert (r["rule_coverage_status"], r["anomaly_score"], r["is_suspicious"]) == ("none", None, False)


def test_repeats_without_transaction_ids(spark):
    df = frame(spark, [portfolio_row(), portfolio_row(), portfolio_row(customer_id=" "), portfolio_row(
        date="2026-02-02")]).drop("transaction_id")
    states = R.rule_statuses(df).groupBy("rule_duplicate_record_status").count().collect()
    assert {r[0]: r[1] for r in states} == {"triggered": 2, "not_evaluated": 1, "clear": 1}


def test_spike_without_segments_uses_the_overall_median(spark):
    amounts = [100.0] * 9 + [1000.0]
    df = frame(spark, [portfolio_row(transaction_id=f"T{i}", transaction_amount=a) for i, a in enumerate(amounts)])
    hit = R.rule_statuses(df.drop("segment")).where("rule_spending_spike_status = 'triggered'")
    assert [r["transaction_amount"] for r in hit.collect()] == [1000.0]


def test_absent_inputs_are_refused_before_any_job(spark):
    with pytest.raises(R.CapabilityBlocked, match="missing required inputs: income"):
        R.rule_statuses(two_rows(spark).drop("income"))


def test_statuses_part_the_rows(spark, sf_dir):
    rows = portfolio(spark, sf_dir)
    total = rows.count()
    for line in R.rule_coverage(R.rule_statuses(rows)).collect():
        assert line["evaluated_records"] + line["not_evaluated_records"] == total
        assert line["triggered_records"] <= line["evaluated_records"]


def test_the_score_is_planned_without_a_product(spark, sf_dir):
    plan = R.detect_anomalies(portfolio(spark, sf_dir, keep_key=True))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_summaries_agree(spark, sf_dir):
    rows = R.detect_anomalies(portfolio(spark, sf_dir)).persist()
    header = R.review_header(rows).first()
    summary = R.anomaly_summary(rows).collect()
    assert sum(r["records"] for r in summary) == header["flagged_records"] == R.flagged(rows).count()
    totals = R.category_totals(rows).where("risk_level is null").agg(F.sum("records")).first()[0]
    assert totals == header["flagged_records"]
    queue = R.top_of_queue(R.review_queue(rows, priority="Low"), ["transaction_id"], 5).collect()
    assert {r["risk_level"] for r in queue} == {"Low"}
    assert [r["anomaly_score"] for r in queue] == sorted((r["anomaly_score"] for r in queue), reverse=True)
    rows.unpersist()


def test_search_is_literal(spark):
    df = frame(spark, [portfolio_row(transaction_id="A.B"), portfolio_row(transaction_id="AxB")])
    marked = df.withColumn("is_suspicious", F.lit(True))
    assert [r["transaction_id"] for r in R.review_queue(marked, query=" a.b ").collect()] == ["A.B"]


def test_not_a_rule_result(spark):
    df = two_rows(spark)
    assert R.flagged(df).count() == 0
    assert R.unevaluated_total(df).first()["not_evaluated"] == 0
    assert len(R.rule_coverage(df).collect()) == len(RULES)
