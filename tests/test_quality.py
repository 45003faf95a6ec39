import datetime

from pyspark.sql import functions as F

from tests.conftest import PORTFOLIO, frame, portfolio_row
from folioguard.fixed_values import CAPABILITIES
from folioguard.operators import metrics as M
from folioguard.operators import profile as P
from folioguard.operators import summaries as S


def issues(df):
    return {r["code"]: r for r in P.issue_table(P.assess(df)).collect()}


def metrics(df, **more):
    return {r["metric_id"]: r for r in M.metric_table(df, **more).collect()}


def test_empty_dataset_blocks_everything(spark):
    one = P.assess(spark.createDataFrame([], PORTFOLIO)).first()
    assert [i["code"] for i in one["issues"]] == ["empty_dataset"]
    assert {c["status"] for c in one["capabilities"]} == {"blocked"}
    assert one["composite_score"] == 0 == one["validity"] == one["fitness"]


def test_complete_dataset_is_ready(spark):
    one = P.assess(frame(spark, [portfolio_row()])).first()
    assert one["issues"] == [] and one["composite_score"] == 100.0
    assert [c["capability"] for c in one["capabilities"]] == list(CAPABILITIES)


def test_unparseable_amounts_are_unavailable_not_zero(spark):
    df = spark.createDataFrame([("NGN 1,200", "2026-01-01"), ("n/k", "2026-01-02")], "transaction_amount string, "
                                                                                    "date string")
    assert issues(df)["unparseable_transaction_amount"]["affected_count"] == 2
    value = metrics(df, currency="NGN")["transaction_value"]
    assert (value["status"], value["value"], value["quality_status"]) == ("unavailable", None, "blocked")
    assert value["unavailable_reason"] == "Transaction amount contains no parseable numeric values."
    assert value["period_start"] is None


def test_partly_readable_columns_warn(spark):
    df = spark.createDataFrame(
        [("1", "2026-01-01", "c1"), ("x", "soon", " "), (None, None, None)],
        "transaction_amount string, date string, customer_id string")
    found = issues(df)
    assert found["invalid_transaction_amount"]["affected_count"] == 1
    assert found["invalid_event_date"]["affected_count"] == 1
    assert found["missing_customer_ids"]["affected_count"] == 2
    assert found["missing_values"]["affected_count"] == 3
    one = P.assess(df).first()
    assert (one["validity"], one["timeliness"]) == (50.0, 33.3)


def test_money_and_period(spark):
    df = frame(spark, [
        portfolio_row(currency="ngn"), portfolio_row(transaction_amount=800.0, date="2026-01-31", currency=" NGN ")])
    total = metrics(df)["transaction_value"]
    assert (total["value"], total["currency"]) == (2000.0, "NGN")
    assert (total["period_start"], total["period_end"]) == (datetime.date(2026, 1, 1), datetime.date(2026, 1, 31))
    assert metrics(df)["average_transaction_value"]["value"] == 1000.0


def test_mixed_currency_is_ambiguous(spark):
    df = frame(spark, [portfolio_row(), portfolio_row(currency="KES")])
    value = metrics(df)["transaction_value"]
    assert value["status"] == "unavailable" and value["source_fields"] == ["transaction_amount", "currency"]
    assert metrics(df, currency=" kes ")["transaction_value"]["currency"] == "KES"


def test_outcome_share_over_valid_rows(spark):
    rows = [("0",), ("1",), ("0",), ("unknown",), (None,)]
    share = metrics(spark.createDataFrame(rows, "defaulted string"))["non_default_outcome_share"]
    assert (share["value"], share["numerator"], share["denominator"]) == (66.7, 2, 3)
    assert share["quality_status"] == "warn"
    bad = metrics(spark.createDataFrame([("x",)], "defaulted string"))["non_default_outcome_share"]
    assert bad["unavailable_reason"] == "The defaulted outcome contains no valid binary values."


def test_rule_counts_need_a_versioned_run(spark):
    df = frame(spark, [portfolio_row()])
    assert metrics(df)["suspicious_records"]["status"] == "unavailable"
    incomplete = metrics(df, anomalies=df, ruleset="v1")["suspicious_records"]
    assert incomplete["unavailable_reason"] == "The risk-rule result is missing required output fields."


def test_every_metric_says_value_or_reason(spark):
    for df in (frame(spark, [portfolio_row()]), spark.createDataFrame([("x",)], "notes string")):
        for m in metrics(df).values():
            assert (m["status"] == "available") == (m["value"] is not None)
            assert (m["status"] == "unavailable") == (m["unavailable_reason"] is not None)


def test_fingerprint_ignores_order_and_partitions(spark):
    df = frame(spark, [portfolio_row(transaction_id=f"T{i}") for i in range(50)])
    same = P.fingerprint(df.orderBy("transaction_id", ascending=False).repartition(7)).first()[0]
    assert P.fingerprint(df).first()[0] == same
    other = df.where("transaction_id <> 'T7'").union(df.limit(1))
    assert P.fingerprint(other).first()[0] != same


def test_repeats_treat_missing_alike(spark):
    rows = [(1.0, None), (1.0, None), (float("nan"), "a"), (None, "a"), (0.0, "z"), (-0.0, "z"), (2.0, "q")]
    assert P.duplicate_counts(spark.createDataFrame(rows, "a double, b string")).first()[0] == 3


def test_many_datasets_in_one_pass(spark):
    rows = [portfolio_row(), portfolio_row(), portfolio_row(defaulted=None)]
    df = frame(spark, rows).withColumn("version", F.when(F.col("defaulted").isNull(), "y").otherwise("x"))
    found = {r["version"]: r for r in P.assess(df, by=["version"]).collect()}
    assert (found["x"]["duplicate_rows"], found["y"]["duplicate_rows"]) == (1, 0)
    assert [i["code"] for i in found["x"]["issues"]] == ["duplicate_rows"]
    assert [i["code"] for i in found["y"]["issues"]] == ["missing_values", "missing_repayment_outcome"]


def test_older_record_imputes(spark):
    df = frame(spark, [
        portfolio_row(transaction_amount=a, customer_id=c) for a, c in ((10.0, "a"), (None, "b"), (30.0, None))])
    one = S.kpi_record(df).first()
    assert (one["total_revenue"], one["total_customers"], one["loan_repayment_rate"]) == (60.0, 2, 100.0)
    assert S.monthly_amount(df).first()["transaction_amount"] == 60.0
    assert S.monthly_amount(df, impute=False).first()["transaction_amount"] == 40.0
    assert S.monthly_amount(df.drop("date")).first()["month"] == "Unknown"


def test_bins_keep_empty_ones(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 10.0, 100.0)], "x double")
    assert [r["records"] for r in S.equal_width_bins(df, "x").collect()] == [3, 0, 0, 0, 0, 0, 0, 0, 0, 1]
    flat = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert sum(r["records"] for r in S.equal_width_bins(flat, "x").collect()) == 2


def test_outcome_labels_and_counts(spark):
    df = spark.createDataFrame([("0", "x"), ("1", None), ("7", "x")], "defaulted string, c string")
    assert {r[0]: r[1] for r in S.outcome_breakdown(df).collect()} == {"Defaulted": 2, "Repaid": 1}
    assert [tuple(r) for r in S.category_counts(df, "c").collect()] == [("x", 2), ("Unknown", 1)]


def test_metric_values_do_not_sort_the_rows(spark):
    rows = [portfolio_row(customer_id=c, transaction_amount=a, currency=u) for c, a, u in [
        ("A", 1.0, "NGN"), ("A", 2.0, " ngn "), ("B", None, None), (None, 6.0, "NGN")]]
    values = M._values(frame(spark, rows), None)
    one = values.first()
    assert (one["amount_sum"], one["amount_avg"], one["customers"], one["currency"]) == (9.0, 3.0, 2, "NGN")
    plan = values._jdf.queryExecution().executedPlan().toString().splitlines()
    assert "HashAggregate" in [line for line in plan if "Aggregate" in line][-1]
    empty = M._values(frame(spark, []), None).first()
    assert (empty["amount_sum"], empty["amount_avg"], empty["customers"], empty["outcome_zero"]) == (None, None, 0, 0)
