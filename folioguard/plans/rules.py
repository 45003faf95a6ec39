"""Risk rules, their derived columns, review queue and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioguard.fixed_values import RULES, RULESET_VERSION
from folioguard.operators import rules as R
from folioguard.plans.registry import query
from folioguard.plans.sql import STATUS_SELECT, on_anomalies, on_portfolio, on_rules
from folioguard.sources.portfolio import portfolio

_KEYED = "o_orderkey, "
_COVERAGE = " union all ".join(
    f"select '{rule_id}' rule_id, '{label}' rule_label, count(*) filter (where s{i}<>'not_evaluated') "
    f"evaluated_records, count(*) filter (where s{i}='not_evaluated') not_evaluated_records, "
    f"count(*) filter (where s{i}='triggered') triggered_records, "
    f"round_even(count(*) filter (where s{i}<>'not_evaluated')/count(*)*100,1) coverage_percent, "
    f"'{RULESET_VERSION}' rule_version from ruled"
    for i, (rule_id, label) in enumerate(RULES, 1)
)


@query("a19_rule_coverage", on_rules(_COVERAGE))
def a19_rule_coverage(spark, sf_dir):
    return R.rule_coverage(R.rule_statuses(portfolio(spark, sf_dir)))


@query("r1_r8_rule_statuses", on_rules(f"select {_KEYED}{STATUS_SELECT} from ruled"))
def r1_r8_rule_statuses(spark, sf_dir):
    rows = R.rule_statuses(portfolio(spark, sf_dir, keep_key=True))
    return rows.select("o_orderkey", *[R.status_column(r) for r in R.RULE_IDS])


def _one_rule(number: int, rule_id: str) -> None:
    @query(
        f"r{number}_{rule_id}",
        on_rules(f"select s{number} status, count(*) records, round(sum(transaction_amount),2) amount "
                 "from ruled group by 1"))
    def run(spark, sf_dir):
        rows = R.rule_statuses(portfolio(spark, sf_dir))
        return rows.groupBy(F.col(R.status_column(rule_id)).alias("status")).agg(
            F.count("*").alias("records"), F.round(F.sum("transaction_amount"), 2).alias("amount"))


for _number, (_rule_id, _) in enumerate(RULES, 1):
    _one_rule(_number, _rule_id)


@query("r9_evaluated_counts", on_anomalies(
    "select rules_evaluated_count, rules_not_evaluated_count, count(*) records from anomalies group by 1,2"))
def r9_evaluated_counts(spark, sf_dir):
    rows = R.explain_rules(R.rule_statuses(portfolio(spark, sf_dir)))
    return rows.groupBy("rules_evaluated_count", "rules_not_evaluated_count").agg(F.count("*").alias("records"))


@query("r10_anomaly_score", on_anomalies("select o_orderkey, anomaly_score from anomalies"))
def r10_anomaly_score(spark, sf_dir):
    return R.detect_anomalies(portfolio(spark, sf_dir, keep_key=True)).select("o_orderkey", "anomaly_score")


@query("r11_not_evaluated_ids", on_anomalies(
    "select not_evaluated_rule_ids, count(*) records from anomalies group by 1"))
def r11_not_evaluated_ids(spark, sf_dir):
    rows = R.explain_rules(R.rule_statuses(portfolio(spark, sf_dir)))
    return rows.groupBy("not_evaluated_rule_ids").agg(F.count("*").alias("records"))


@query("r12_anomaly_notes", on_anomalies("select o_orderkey, anomaly_notes from anomalies"))
def r12_anomaly_notes(spark, sf_dir):
    rows = R.explain_rules(R.rule_statuses(portfolio(spark, sf_dir, keep_key=True)))
    return rows.select("o_orderkey", "anomaly_notes")


@query("r13_coverage_status", on_anomalies(
    "select rule_coverage_status, count(*) records from anomalies group by 1"))
def r13_coverage_status(spark, sf_dir):
    rows = R.explain_rules(R.rule_statuses(portfolio(spark, sf_dir)))
    return rows.groupBy("rule_coverage_status").agg(F.count("*").alias("records"))


@query("r14_r15_category_and_priority", on_anomalies(
    "select o_orderkey, cast(is_suspicious as int) is_suspicious, suspicious_category, risk_level, rule_version "
    "from anomalies"))
def r14_r15_category_and_priority(spark, sf_dir):
    rows = R.explain_rules(R.rule_statuses(portfolio(spark, sf_dir, keep_key=True)))
    return rows.select(
        "o_orderkey", F.col("is_suspicious").cast("int").alias("is_suspicious"), "suspicious_category", "risk_level",
        "rule_version")


@query("a20_anomaly_summary", on_anomalies(
    "select suspicious_category, risk_level, count(*) records from anomalies where is_suspicious group by 1,2"))
def a20_anomaly_summary(spark, sf_dir):
    return R.anomaly_summary(R.explain_rules(R.rule_statuses(portfolio(spark, sf_dir))))


@query("a21_category_totals", on_anomalies(
    "select suspicious_category, risk_level, count(*) records from anomalies where is_suspicious "
    "group by grouping sets ((suspicious_category, risk_level), (suspicious_category))"))
def a21_category_totals(spark, sf_dir):
    return R.category_totals(R.explain_rules(R.rule_statuses(portfolio(spark, sf_dir))))


@query("a22_unevaluated_total", on_anomalies(
    "select cast(sum(rules_not_evaluated_count) as bigint) not_evaluated from anomalies"))
def a22_unevaluated_total(spark, sf_dir):
    return R.unevaluated_total(R.explain_rules(R.rule_statuses(portfolio(spark, sf_dir))))


@query("a23_review_header", on_anomalies(
    "select count(*) filter (where is_suspicious) flagged_records, "
    "round_even(count(*) filter (where is_suspicious)/count(*)*100,1) flagged_share_percent, "
    "count(*) filter (where is_suspicious and risk_level='High') high_priority_flags, "
    "max(anomaly_score) filter (where is_suspicious) top_anomaly_score from anomalies"))
def a23_review_header(spark, sf_dir):
    return R.review_header(R.detect_anomalies(portfolio(spark, sf_dir)))


@query("w1_repeated_transactions", on_portfolio(
    "select transaction_id, count(*) copies from portfolio where trim(transaction_id)<>'' group by 1 "
    "having count(*)>1"))
def w1_repeated_transactions(spark, sf_dir):
    return R.repeated_keys(portfolio(spark, sf_dir))


@query("w1_repeated_by_customer_date_amount", on_portfolio(
    "select customer_id, date, transaction_amount, count(*) copies from portfolio "
    "where trim(customer_id)<>'' and trim(date)<>'' and transaction_amount is not null group by 1,2,3 "
    "having count(*)>1"))
def w1_repeated_by_customer_date_amount(spark, sf_dir):
    return R.repeated_keys(portfolio(spark, sf_dir).drop("transaction_id"))


@query("w2_segment_medians", on_portfolio(
    "select segment, count(transaction_amount) records, quantile_cont(transaction_amount,0.5) median_amount "
    "from portfolio where segment is not null group by 1"))
def w2_segment_medians(spark, sf_dir):
    return R.segment_medians(portfolio(spark, sf_dir))


@query("w3_amount_percent_rank", on_anomalies(
    "select o_orderkey, round(coalesce(ar/rn,0),9) amount_rank from portfolio left join ranks "
    "on transaction_amount=ra"))
def w3_amount_percent_rank(spark, sf_dir):
    rows = portfolio(spark, sf_dir, keep_key=True)
    ranked = R.attach_amount_rank(rows, R.amount_percent_ranks(rows))
    return ranked.select("o_orderkey", F.round("amount_rank", 9).alias("amount_rank"))


@query("j10_rule_thresholds", on_rules(
    "select round(ta,4) amount_threshold, round(tf,6) frequency_threshold from limits"))
def j10_rule_thresholds(spark, sf_dir):
    one = R.rule_thresholds(R.rule_baselines(portfolio(spark, sf_dir)))
    return one.select(
        F.round("amount_threshold", 4).alias("amount_threshold"),
        F.round("frequency_threshold", 6).alias("frequency_threshold"))


@query("p3_text_presence", on_portfolio(
    "select count(*) filter (where trim(transaction_id)<>'') transaction_id, "
    "count(*) filter (where trim(segment)<>'') segment, "
    "count(*) filter (where trim(employment_status)<>'') employment_status from portfolio"))
def p3_text_presence(spark, sf_dir):
    from folioguard.functions.scalars import n_if, present_text

    return portfolio(spark, sf_dir).agg(*[
        n_if(present_text(F.col(c))).alias(c) for c in ("transaction_id", "segment", "employment_status")])


@query("p8_queue_by_priority_and_category", on_anomalies(
    "select o_orderkey, transaction_id, risk_level, suspicious_category, anomaly_score from anomalies "
    "where is_suspicious and risk_level='Medium' and suspicious_category='High-risk repayment pattern'"))
def p8_queue_by_priority_and_category(spark, sf_dir):
    rows = R.detect_anomalies(portfolio(spark, sf_dir, keep_key=True))
    rows = R.review_queue(rows, priority="Medium", category="High-risk repayment pattern")
    return rows.select("o_orderkey", "transaction_id", "risk_level", "suspicious_category", "anomaly_score")


@query("p9_queue_search", on_anomalies(
    "select o_orderkey, customer_id, transaction_id, risk_level from anomalies where is_suspicious and "
    "(contains(lower(customer_id),'txn-12') or contains(lower(transaction_id),'txn-12'))"))
def p9_queue_search(spark, sf_dir):
    rows = R.explain_rules(R.rule_statuses(portfolio(spark, sf_dir, keep_key=True)))
    return R.review_queue(rows, query=" TXN-12 ").select("o_orderkey", "customer_id", "transaction_id", "risk_level")


@query("p10_flagged_rows", on_anomalies("select o_orderkey, suspicious_category from anomalies where is_suspicious"))
def p10_flagged_rows(spark, sf_dir):
    rows = R.explain_rules(R.rule_statuses(portfolio(spark, sf_dir, keep_key=True)))
    return R.flagged(rows).select("o_orderkey", "suspicious_category")


_DISPLAY = (
    "transaction_id, customer_id, date, transaction_amount, loan_amount, income, suspicious_category, risk_level, "
    "anomaly_score, rules_evaluated_count, rules_not_evaluated_count, not_evaluated_rule_ids, anomaly_notes")


@query("p16_display_columns", on_anomalies(f"select {_DISPLAY} from anomalies where is_suspicious"))
def p16_display_columns(spark, sf_dir):
    return R.display_columns(R.flagged(R.detect_anomalies(portfolio(spark, sf_dir))))


@query("t1_review_queue", on_anomalies(
    f"select {_DISPLAY} from anomalies where is_suspicious order by anomaly_score desc nulls last, o_orderkey "
    "limit 250"))
def t1_review_queue(spark, sf_dir):
    rows = R.flagged(R.detect_anomalies(portfolio(spark, sf_dir, keep_key=True)))
    return R.display_columns(R.top_of_queue(rows, ["o_orderkey"]))


@query("t2_top_flagged_record", on_anomalies(
    "select transaction_id, anomaly_score, anomaly_notes from anomalies where is_suspicious "
    "order by anomaly_score desc nulls last, o_orderkey limit 1"))
def t2_top_flagged_record(spark, sf_dir):
    rows = R.flagged(R.detect_anomalies(portfolio(spark, sf_dir, keep_key=True)))
    return R.top_of_queue(rows, ["o_orderkey"], 1).select("transaction_id", "anomaly_score", "anomaly_notes")


@query("t4_report_groups", on_anomalies(
    "select suspicious_category, risk_level, count(*) records from anomalies where is_suspicious group by 1,2 "
    "order by records desc, suspicious_category, risk_level limit 8"))
def t4_report_groups(spark, sf_dir):
    return R.anomaly_summary(R.explain_rules(R.rule_statuses(portfolio(spark, sf_dir)))).limit(8)


@query("t9_priorities_ascending", on_anomalies(
    "select risk_level, count(*) records from anomalies where is_suspicious group by 1 order by records, risk_level"))
def t9_priorities_ascending(spark, sf_dir):
    rows = R.flagged(R.explain_rules(R.rule_statuses(portfolio(spark, sf_dir))))
    return rows.groupBy("risk_level").agg(F.count("*").alias("records")).orderBy("records", "risk_level")
