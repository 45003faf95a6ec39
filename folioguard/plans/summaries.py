"""Chart tables, the older KPI record, options, pages and top-k lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioguard.operators import rules as R
from folioguard.operators import summaries as S
from folioguard.operators.paging import page_directory
from folioguard.operators.sketches import STANDARD_ERROR, distinct_sketches, merged_estimates
from folioguard.plans.quality import PROFILE
from folioguard.plans.registry import query
from folioguard.plans.sql import ANOMALY_CTES, PORTFOLIO_COLUMNS, on_anomalies, on_portfolio, with_ctes
from folioguard.session import materialize
from folioguard.sources.portfolio import portfolio, table

# The median may lie half a cent between two amounts, so sums with imputed amounts are compared to a tenth of a cent.
_MEDIAN = {
    "med": "select quantile_cont(transaction_amount,0.5) m from portfolio",
    "filled": "select p.*, coalesce(transaction_amount, m) amount from portfolio p, med",
}
_KPIS = {
    **PROFILE, **_MEDIAN,
    "kpis": """select n records_processed, round((select sum(amount) from filled),3) total_revenue,
 (select count(distinct customer_id) from portfolio) total_customers,
 round((select avg(amount) from filled),4) average_transaction_value,
 round_even((1-(select avg(defaulted) from portfolio))*100,1) loan_repayment_rate,
 (select count(*) filter (where risk_level='High') from anomalies) high_risk_customers,
 (select count(*) filter (where is_suspicious) from anomalies) suspicious_transactions,
 composite data_quality_score, missing_cells missing_values, duplicate_rows from score""",
}


def _kpis(spark, sf_dir):
    rows = portfolio(spark, sf_dir)
    anomalies = R.explain_rules(R.rule_statuses(rows))
    return rows, anomalies, S.kpi_record(rows, anomalies)


@query("a12_kpi_record", with_ctes(ANOMALY_CTES, "select * from kpis", **_KPIS))
def a12_kpi_record(spark, sf_dir):
    kpis = _kpis(spark, sf_dir)[2]
    return kpis.withColumns({
        "total_revenue": F.round("total_revenue", 3),
        "average_transaction_value": F.round("average_transaction_value", 4),
    })


@query("t8_kpi_insights", with_ctes(
    ANOMALY_CTES,
    """select ordinal, insight from (
 select 1 ordinal, concat(s,' is the strongest customer segment by total transaction value.') insight from seg
 union all select 2, case when suspicious_transactions/records_processed*100>15
   then 'Suspicious activity is high enough to justify manual review before approvals.'
   when suspicious_transactions>0
   then 'A focused review of flagged records would reduce operational and credit risk.'
   else 'No suspicious records were flagged by the current rule set.' end from kpis
 union all select 3, case when loan_repayment_rate>=85
   then 'The repayment profile is healthy, with most customers marked as repaid.'
   when loan_repayment_rate>=65 then 'Repayment performance is moderate; risk checks should stay active.'
   else 'Repayment performance is weak and approval rules should be tightened.' end from kpis
 union all select 4, case when data_quality_score<90
   then 'Data quality issues may affect model confidence; clean missing and duplicate records.'
   else 'The dataset quality score is strong enough for dashboard and model exploration.' end from kpis
 union all select 5, 'The selected model reached an F1-score of 0.71 on the test split.' from kpis
 union all select 6, 'The ROC-AUC score is 0.83, which helps show measurable model performance.' from kpis
 union all select 7, concat('The most common suspicious pattern is ', lower(c), '.') from pat)""",
    **_KPIS,
    seg="select segment s from filled where segment is not null group by 1 order by sum(amount) desc, 1 limit 1",
    pat="select suspicious_category c from anomalies where is_suspicious group by 1 order by count(*) desc, 1 limit 1"))
def t8_kpi_insights(spark, sf_dir):
    rows, anomalies, kpis = _kpis(spark, sf_dir)
    return S.kpi_insights(rows, kpis, anomalies, {"f1_score": 0.71, "roc_auc": 0.83})


@query("p2_median_imputation", on_portfolio(
    "select o_orderkey, amount, coalesce(income, (select quantile_cont(income,0.5) from portfolio)) income, "
    "0.0 absent from filled", **_MEDIAN))
def p2_median_imputation(spark, sf_dir):
    rows = portfolio(spark, sf_dir, keep_key=True)
    medians = S.medians_of(rows, ["transaction_amount", "income", "not_there"])
    amount, income, absent = (
        S.imputed(rows, c, medians=medians) for c in ("transaction_amount", "income", "not_there"))
    return rows.select("o_orderkey", amount.alias("amount"), income.alias("income"), absent.alias("absent"))


@query("a13_monthly_amount", on_portfolio(
    "select substr(date,1,7) as month, round(sum(amount),3) transaction_amount from filled group by 1", **_MEDIAN))
def a13_monthly_amount(spark, sf_dir):
    months = S.monthly_amount(portfolio(spark, sf_dir))
    return months.withColumn("transaction_amount", F.round("transaction_amount", 3))


@query("a13_monthly_amount_governed", on_portfolio(
    "select case when o_orderkey%13=0 then 'NaT' else substr(date,1,7) end as month, "
    "round(coalesce(sum(transaction_amount),0),2) transaction_amount from portfolio group by 1"))
def a13_monthly_amount_governed(spark, sf_dir):
    rows = portfolio(spark, sf_dir, keep_key=True)
    dated = rows.withColumn("date", F.when(F.col("o_orderkey") % 13 == 0, "10:30").otherwise(F.col("date")))
    return S.monthly_amount(dated, impute=False).withColumn("transaction_amount", F.round("transaction_amount", 2))


@query("f11_month_of_date", on_portfolio(
    "select o_orderkey, substr(date,1,7) as month from portfolio"))
def f11_month_of_date(spark, sf_dir):
    from folioguard.functions.scalars import ts

    rows = portfolio(spark, sf_dir, keep_key=True)
    return rows.select("o_orderkey", F.date_format(ts(rows, "date"), "yyyy-MM").alias("month"))


@query("a14_category_counts", on_portfolio(
    "select coalesce(segment,'Unknown') segment, count(*) records from portfolio group by 1"))
def a14_category_counts(spark, sf_dir):
    return S.category_counts(portfolio(spark, sf_dir), "segment")


@query("a15_outcome_breakdown", on_portfolio(
    "select case defaulted when 0 then 'Repaid' when 1 then 'Defaulted' else 'Unknown' end repayment_status, "
    "count(*) records from portfolio group by 1"))
def a15_outcome_breakdown(spark, sf_dir):
    return S.outcome_breakdown(portfolio(spark, sf_dir))


@query("a16_top_segment_by_amount", on_portfolio(
    "select segment, round(sum(amount),3) total_amount from filled where segment is not null group by 1 "
    "order by 2 desc, 1 limit 1", **_MEDIAN))
def a16_top_segment_by_amount(spark, sf_dir):
    return S.top_segment_by_amount(portfolio(spark, sf_dir)).select(
        "segment", F.round("total_amount", 3).alias("total_amount"))


@query("a17_most_common_category", on_anomalies(
    "select suspicious_category, count(*) records from anomalies where is_suspicious group by 1 "
    "order by 2 desc, 1 limit 1"))
def a17_most_common_category(spark, sf_dir):
    return S.most_common_category(R.explain_rules(R.rule_statuses(portfolio(spark, sf_dir))))


@query("a18_largest_segment", on_portfolio(
    "select coalesce(segment,'Unknown') segment, count(*) records from portfolio group by 1 order by 2 desc, 1 limit 1"))
def a18_largest_segment(spark, sf_dir):
    return S.largest_segment(portfolio(spark, sf_dir))


def _bins(n: int) -> str:
    return on_portfolio(
        "select bin, round(case when bin=1 then lo-(hi-lo)*0.001 else lo+(bin-1)*((hi-lo)/n) end,4) low, "
        "round(lo+bin*((hi-lo)/n),4) high, coalesce(records,0) records from grid cross join span left join counted "
        "using (bin)",
        span=f"select min(transaction_amount) lo, max(transaction_amount) hi, {n} n from portfolio",
        grid=f"select cast(unnest(generate_series(1,{n})) as int) bin",
        counted="select cast(least(greatest(ceil((transaction_amount-lo)/((hi-lo)/n)),1),n) as int) bin, "
                "count(*) records from portfolio, span where transaction_amount is not null group by 1")


def _rounded_bins(spark, sf_dir, n: int):
    bins = S.equal_width_bins(portfolio(spark, sf_dir), "transaction_amount", n)
    return bins.withColumns({"low": F.round("low", 4), "high": F.round("high", 4)})


@query("a24_amount_distribution", _bins(10))
def a24_amount_distribution(spark, sf_dir):
    return _rounded_bins(spark, sf_dir, 10)


@query("a25_amount_histogram", _bins(38))
def a25_amount_histogram(spark, sf_dir):
    return _rounded_bins(spark, sf_dir, 38)


@query("p7_scope_filter", on_portfolio(
    "select o_orderkey, customer_id, transaction_amount from portfolio where segment='BUILDING' and region='ASIA' "
    "and business_type=(select min(business_type) from portfolio where region='ASIA')"))
def p7_scope_filter(spark, sf_dir):
    rows = portfolio(spark, sf_dir, keep_key=True)
    first = rows.where("region = 'ASIA'").agg(F.min("business_type").alias("t")).first()["t"]
    return S.scope(rows, segment="BUILDING", region="ASIA", business_type=first).select(
        "o_orderkey", "customer_id", "transaction_amount")


@query("p18_filter_options", on_portfolio("""select 'segment' dimension, segment choice from (select distinct segment
 from portfolio where segment is not null) union all select 'region', region from (select distinct region from portfolio)
 union all select 'business_type', business_type from (select distinct business_type from portfolio)"""))
def p18_filter_options(spark, sf_dir):
    rows = portfolio(spark, sf_dir)
    options = [
        S.filter_options(rows, c).select(F.lit(c).alias("dimension"), F.col(c).alias("choice"))
        for c in ("segment", "region", "business_type")
    ]
    return options[0].unionByName(options[1]).unionByName(options[2])


@query("w5_evidence_page", on_portfolio(
    f"select {PORTFOLIO_COLUMNS}, o_orderkey from portfolio order by o_orderkey, transaction_id limit 250 offset 500"))
def w5_evidence_page(spark, sf_dir):
    return S.page(portfolio(spark, sf_dir, keep_key=True), ["o_orderkey", "transaction_id"], 3)


@query("w5_deep_page", """select l_orderkey, l_linenumber, l_extendedprice from lineitem
 order by l_extendedprice desc, l_orderkey, l_linenumber limit 250 offset 49750""")
def w5_deep_page(spark, sf_dir):
    """Page 200: one or two of the written ranges are opened."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    return page_directory(rows, order, range_rows=20_000).page(200)


_SKETCH_SQL = """select month, exact_customers, cast(1 as int) within_bound from (
 select strftime(o_orderdate, '%Y-%m') as month, count(distinct o_custkey) exact_customers from orders group by 1
 union all select 'all', count(distinct o_custkey) from orders)"""


@query("a6_merged_sketches", _SKETCH_SQL)
def a6_merged_sketches(spark, sf_dir):
    """Customers a month and over all months from monthly sketches, next to the exact counts: within three errors."""
    rows = table(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_custkey").cast("string").alias("customer_id"))
    sketches = materialize(distinct_sketches(rows, ["customer_id"], ["month"]), "sketches")
    found = merged_estimates(sketches, ["month"]).unionByName(
        merged_estimates(sketches).withColumn("month", F.lit("all")))
    exact = rows.groupBy("month").agg(F.countDistinct("customer_id").alias("exact_customers")).unionByName(
        rows.agg(F.lit("all").alias("month"), F.countDistinct("customer_id").alias("exact_customers")))
    off = F.abs(F.col("estimate") - F.col("exact_customers")) / F.greatest("exact_customers", F.lit(1))
    return found.join(exact, "month").select(
        "month", "exact_customers", (off <= 3 * STANDARD_ERROR).cast("int").alias("within_bound"))


@query("t3_top_segments", on_portfolio(
    "select coalesce(segment,'Unknown') segment, count(*) records from portfolio group by 1 order by 2 desc, 1 limit 8"))
def t3_top_segments(spark, sf_dir):
    return S.category_counts(portfolio(spark, sf_dir), "segment").limit(8)


@query("s17_preview", on_portfolio(
    f"select {PORTFOLIO_COLUMNS}, o_orderkey from portfolio order by o_orderkey limit 50"))
def s17_preview(spark, sf_dir):
    return portfolio(spark, sf_dir, keep_key=True).orderBy("o_orderkey").limit(50)


@query("f18_risk_bands", on_portfolio(
    "select case when repayment_history_score<=35 then 'Low' when repayment_history_score<=65 then 'Medium' "
    "when repayment_history_score<=100 then 'High' end band, count(*) records from portfolio group by 1"))
def f18_risk_bands(spark, sf_dir):
    from folioguard.functions.scalars import band

    return portfolio(spark, sf_dir).groupBy(band(F.col("repayment_history_score")).alias("band")).agg(
        F.count("*").alias("records"))


@query("f8_guarded_ratio", on_portfolio(
    "select o_orderkey, case when income>0 then round(least(greatest(existing_debt/income,0),1),9) end debt_ratio "
    "from portfolio"))
def f8_guarded_ratio(spark, sf_dir):
    from folioguard.functions.scalars import clip

    rows = portfolio(spark, sf_dir, keep_key=True)
    ratio = F.when(F.col("income") > 0, F.col("existing_debt") / F.col("income"))
    return rows.select("o_orderkey", F.round(clip(ratio, 0.0, 1.0), 9).alias("debt_ratio"))


@query("f15_legacy_currency", on_portfolio(
    "select o_orderkey, 'NGN ' || format('{:,}', cast(round_even(transaction_amount,0) as bigint)) amount_text "
    "from portfolio"))
def f15_legacy_currency(spark, sf_dir):
    rows = portfolio(spark, sf_dir, keep_key=True)
    return rows.select("o_orderkey", S.legacy_currency(F.col("transaction_amount")).alias("amount_text"))
