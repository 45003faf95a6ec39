"""Profile, issues, dimensions, capabilities, governed metrics and report feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioguard.fixed_values import DIMENSION_WEIGHTS, ISSUES, METRICS, QUALITY_DEFINITION, RULESET_VERSION
from folioguard.operators import metrics as M
from folioguard.operators import profile as P
from folioguard.operators import rules as R
from folioguard.plans.registry import query
from folioguard.plans.sql import ANOMALY_CTES, PORTFOLIO_COLUMNS, on_portfolio, with_ctes
from folioguard.sources.portfolio import portfolio, table

COLUMNS = [c.strip() for c in PORTFOLIO_COLUMNS.split(",")]
_MISSING = " + ".join(f"cast({c} is null as int)" for c in COLUMNS)
_GOVERNED = (
    "transaction_amount", "income", "loan_amount", "existing_debt", "transaction_frequency", "account_age_months",
    "repayment_history_score", "defaulted")
_PRESENT = " + ".join(f"count({c})" for c in (*_GOVERNED, "date"))
PROFILE = {
    "distinct_rows": f"select distinct {PORTFOLIO_COLUMNS} from portfolio",
    "prof": f"""select count(*) as n, cast(sum({_MISSING}) as bigint) missing_cells,
 (select count(*) from portfolio)-(select count(*) from distinct_rows) duplicate_rows,
 {_PRESENT} governed_present, count(date) date_valid, count(transaction_amount) amount_valid,
 count(defaulted) outcome_present, count(*) filter (where defaulted in (0,1)) outcome_binary,
 count(*) filter (where trim(customer_id)<>'') customer_present from portfolio""",
    "dims": f"""select n, missing_cells, duplicate_rows,
 round_even((1-missing_cells/(n*{len(COLUMNS)}))*100,1) completeness, 100.0 validity,
 round_even((1-duplicate_rows/n)*100,1) uniqueness, round_even(outcome_binary/outcome_present*100,1) consistency,
 round_even(date_valid/n*100,1) timeliness, 100.0 fitness from prof""",
    "score": """select *, round_even(completeness*0.25+validity*0.2+uniqueness*0.15+consistency*0.15
 +timeliness*0.1+fitness*0.15,1) composite from dims""",
}


def _quote(text: str | None) -> str:
    return "null" if text is None else "'" + text.replace("'", "''") + "'"


def _issue_sql(ordinal: int, code: str, count: str) -> str:
    severity, dimension, column, message, recovery, capabilities, override = ISSUES[code]
    return (
        f"select {ordinal} issue_ordinal, '{code}' code, '{severity}' severity, '{dimension}' dimension, "
        f"cast({_quote(column)} as varchar) \"column\", cast({count} as bigint) affected_count, {_quote(message)} "
        f"message, {_quote(recovery)} recovery, {_quote('|'.join(capabilities))} capabilities, "
        f"{int(override)} override_allowed from prof")


PROFILE["issues"] = " union all ".join([
    _issue_sql(1, "missing_values", "missing_cells") + " where missing_cells>0",
    _issue_sql(2, "duplicate_rows", "duplicate_rows") + " where duplicate_rows>0",
])


@query("a1_shape", on_portfolio(f"select count(*) as rows, cast({len(COLUMNS)} as bigint) as columns from portfolio"))
def a1_shape(spark, sf_dir):
    df = portfolio(spark, sf_dir)
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"))


@query("a2_missing_cells", on_portfolio(
    "select " + ", ".join(f"count(*)-count({c}) as {c}" for c in COLUMNS) + " from portfolio"))
def a2_missing_cells(spark, sf_dir):
    df = portfolio(spark, sf_dir)
    return df.agg(*[F.count(F.when(mark, 1)).alias(c) for c, mark in R.missing_marks(df).items()])


@query("a3_duplicate_rows", on_portfolio("select duplicate_rows from prof", **{
    k: PROFILE[k] for k in ("distinct_rows", "prof")}))
def a3_duplicate_rows(spark, sf_dir):
    return P.duplicate_counts(portfolio(spark, sf_dir))


@query("a26_dimensions", on_portfolio(" union all ".join(
    f"select '{d}' dimension, {d} score, cast({w} as double) weight from score"
    for d, w in DIMENSION_WEIGHTS.items()), **PROFILE))
def a26_dimensions(spark, sf_dir):
    return P.dimension_table(P.assess(portfolio(spark, sf_dir)))


@query("a27_composite_score", on_portfolio(
    f"select composite composite_score, '{QUALITY_DEFINITION}' definition_version from score", **PROFILE))
def a27_composite_score(spark, sf_dir):
    return P.assess(portfolio(spark, sf_dir)).select("composite_score", "definition_version")


@query("a28_issues", on_portfolio("select * from issues", **PROFILE))
def a28_issues(spark, sf_dir):
    issues = P.issue_table(P.assess(portfolio(spark, sf_dir)))
    return issues.select(
        "issue_ordinal", "code", "severity", "dimension", "column", "affected_count", "message", "recovery",
        F.array_join("capabilities", "|").alias("capabilities"), F.col("override_allowed").cast("int").alias(
            "override_allowed"))


# A dataset without a date, a customer or the loan: three capabilities blocked, with their reasons.
_NARROW = ["transaction_id", "segment", "transaction_amount", "income", "existing_debt", "repayment_history_score",
           "transaction_frequency"]
_NARROW_ABSENT_MODEL = [c for c in (
    "income", "loan_amount", "repayment_history_score", "existing_debt", "transaction_frequency",
    "account_age_months", "employment_status", "segment", "business_type", "region") if c not in _NARROW]
_NARROW_MISSING = " + ".join(f"cast({c} is null as int)" for c in _NARROW)
_NARROW_PROFILE = {
    "prof": f"""select count(*) as n, cast(sum({_NARROW_MISSING}) as bigint) missing_cells,
 count(*)-(select count(*) from (select distinct {', '.join(_NARROW)} from portfolio)) duplicate_rows from portfolio"""}
_NARROW_ISSUES = [
    ("missing_values", "missing_cells", " where missing_cells>0", ()),
    ("duplicate_rows", "duplicate_rows", " where duplicate_rows>0", ()),
    ("missing_event_date", "null", "", ()),
    ("missing_customer_id", "null", "", ()),
    ("missing_repayment_outcome", "null", "", ()),
    ("missing_model_inputs", str(len(_NARROW_ABSENT_MODEL)), "", _NARROW_ABSENT_MODEL),
    ("missing_model_target", "null", "", ()),
    ("missing_risk_rule_inputs", "1", "", ("loan_amount",)),
]


@query("a28_issues_of_narrow_dataset", on_portfolio(" union all ".join(
    _issue_sql(i, code, count).replace("{columns}", ", ".join(absent)) + where
    for i, (code, count, where, absent) in enumerate(_NARROW_ISSUES, 1)), **_NARROW_PROFILE))
def a28_issues_of_narrow_dataset(spark, sf_dir):
    issues = P.issue_table(P.assess(portfolio(spark, sf_dir).select(*_NARROW)))
    return issues.select(
        "issue_ordinal", "code", "severity", "dimension", "column", "affected_count", "message", "recovery",
        F.array_join("capabilities", "|").alias("capabilities"), F.col("override_allowed").cast("int").alias(
            "override_allowed"))


_NARROW_BLOCKED = {
    "quality_review": "",
    "transaction_analytics": "missing_event_date",
    "customer_analytics": "missing_customer_id",
    "repayment_analytics": "missing_repayment_outcome",
    "risk_rule_evaluation": "missing_risk_rule_inputs",
    "model_exploration": "missing_model_inputs|missing_model_target",
}


@query("a29_capabilities", on_portfolio(" union all ".join(
    f"select '{c}' capability, '{'blocked' if codes else 'ready'}' status, '{codes}' blocking_codes from prof "
    "where n>0" for c, codes in _NARROW_BLOCKED.items()), **_NARROW_PROFILE))
def a29_capabilities(spark, sf_dir):
    found = P.capability_table(P.assess(portfolio(spark, sf_dir).select(*_NARROW)))
    return found.select("capability", "status", F.array_join("blocking_issue_codes", "|").alias("blocking_codes"))


# Many datasets in one job: every region is one.
_BY_REGION = {
    "d": f"select distinct {PORTFOLIO_COLUMNS} from portfolio",
    "u": "select region, count(*) u from d group by 1",
    "g": f"""select region, count(*) n,
 cast(sum({" + ".join(f"cast({c} is null as int)" for c in COLUMNS if c != "region")}) as bigint) missing_cells
 from portfolio group by 1""",
}


@query("a26_dimensions_by_dataset", on_portfolio(
    "select region, n as rows, missing_cells, n-u as duplicate_rows, "
    f"round_even((1-missing_cells/(n*{len(COLUMNS) - 1}))*100,1) completeness, "
    "round_even((1-(n-u)/n)*100,1) uniqueness from g join u using (region)", **_BY_REGION))
def a26_dimensions_by_dataset(spark, sf_dir):
    found = P.assess(portfolio(spark, sf_dir), by=["region"])
    return found.select("region", "rows", "missing_cells", "duplicate_rows", "completeness", "uniqueness")


@query("a35_quality_summary", on_portfolio(
    f"select n as rows, cast({len(COLUMNS)} as bigint) as columns, missing_cells missing_values, duplicate_rows, "
    "composite score from score", **PROFILE))
def a35_quality_summary(spark, sf_dir):
    return P.quality_summary(P.assess(portfolio(spark, sf_dir)))


@query("a41_trust_summary", on_portfolio(
    "select composite composite_score, (select count(*) from issues where severity='block') block_count, "
    "(select count(*) from issues where severity='warn') warn_count, cast(0 as bigint) info_count, "
    "cast(0 as bigint) blocked_capabilities, 'warning' trust_status from score", **PROFILE))
def a41_trust_summary(spark, sf_dir):
    return P.trust_summary(P.assess(portfolio(spark, sf_dir)))


@query("t9_dimensions_ascending", on_portfolio(" union all ".join(
    f"select '{d}' dimension, {d} score from score" for d in DIMENSION_WEIGHTS), **PROFILE))
def t9_dimensions_ascending(spark, sf_dir):
    return P.dimension_table(P.assess(portfolio(spark, sf_dir))).select("dimension", "score").orderBy(
        "score", "dimension")


@query("q5_issue_export", on_portfolio(
    "select code issue_code, severity, dimension, coalesce(\"column\",'') \"column\", affected_count, message, "
    f"recovery, capabilities affected_capabilities, '{QUALITY_DEFINITION}' definition_version from issues", **PROFILE))
def q5_issue_export(spark, sf_dir):
    return P.issue_export(P.assess(portfolio(spark, sf_dir)))


# Numbers as text in five spellings, one of them no number: 80 % of the rows parse.
_AMOUNT_TEXT = """case when o_orderkey%5=0 then 'n/a' when o_orderkey%5=1 then concat('  ', cast(o_orderkey as varchar(20)))
 when o_orderkey%5=2 then concat(cast(o_orderkey as varchar(20)), '.50')
 when o_orderkey%5=3 then concat('+', cast(o_orderkey as varchar(20))) else concat(cast(o_orderkey as varchar(20)), 'e0')
 end"""
_CODE_TEXT = "case when o_orderkey%2=0 then '1,000' else cast(o_orderkey as varchar(20)) end"


@query("p17_numeric_columns",
       f"""with t as (select {_AMOUNT_TEXT} amount_text, {_CODE_TEXT} code_text, o_orderstatus, o_totalprice from orders),
 s as (select avg(cast(amount_text<>'n/a' as int)) a, avg(cast(code_text<>'1,000' as int)) b,
   avg(cast(try_cast(o_orderstatus as double) is not null as int)) c,
   avg(cast(o_totalprice is not null as int)) d from t),
 u as (select 0 "position", 'amount_text' "column", a parseable_share from s union all select 1,'code_text',b from s
   union all select 2,'o_orderstatus',c from s union all select 3,'o_totalprice',d from s)
 select * from u where parseable_share>=0.65""")
def p17_numeric_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return P.numeric_columns(orders.select(
        F.expr(_AMOUNT_TEXT).alias("amount_text"), F.expr(_CODE_TEXT).alias("code_text"), "o_orderstatus",
        "o_totalprice"))


@query("p1_numeric_coercion",
       f"""with t as (select o_orderkey, {_AMOUNT_TEXT} amount_text from orders)
 select o_orderkey, case when amount_text<>'n/a' then try_cast(trim(amount_text) as double) end amount from t""")
def p1_numeric_coercion(spark, sf_dir):
    from folioguard.functions.scalars import num

    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_AMOUNT_TEXT).alias("amount_text"))
    return rows.select("o_orderkey", num(rows, "amount_text").alias("amount"))


_PLAIN = ("customer_id", "transaction_id", "date", "segment", "region", "business_type", "employment_status",
          "transaction_frequency", "account_age_months", "defaulted", "currency")
_WHOLE = {"transaction_frequency": "bigint", "account_age_months": "bigint", "defaulted": "int"}
_ROW_JSON = "concat('{', array_to_string(list_filter([" + ", ".join(
    f"case when {c} is not null then concat('\"{c}\":', " + (
        f"cast({c} as varchar)" if c in _WHOLE else f"'\"', {c}, '\"'") + ") end" for c in _PLAIN
) + "], lambda x: x is not null), ','), '}')"
_SCHEMA = ", chr(31), ".join(f"'{c}:{_WHOLE.get(c, 'string')}'" for c in _PLAIN)


_REFERENCE = f"""select concat('dataframe:sha256:', sha256(concat({_SCHEMA}, '|', count(*), '|',
 sum(cast(h as hugeint)), '|', bit_xor(h)))) dataset_reference
 from (select cast(concat('0x', left(sha256({_ROW_JSON}),15)) as bigint) h from portfolio)"""


@query("a39_dataset_fingerprint", on_portfolio(_REFERENCE))
def a39_dataset_fingerprint(spark, sf_dir):
    return P.fingerprint(portfolio(spark, sf_dir).select(*_PLAIN))


# --- governed metrics ---
_FACTS = f"""select round(sum(transaction_amount),2) s, avg(transaction_amount) a,
 count(distinct case when trim(customer_id)<>'' then trim(customer_id) end) cu,
 count(*) filter (where defaulted=0) z, count(*) filter (where defaulted in (0,1)) b,
 min(date) p0, max(date) p1,
 case when min(upper(trim(currency)))=max(upper(trim(currency))) then min(upper(trim(currency))) end cur
 from portfolio"""
_VALUES = {
    "records_processed": "n", "data_quality_score": "composite", "missing_values": "missing_cells",
    "duplicate_rows": "duplicate_rows", "transaction_value": "s", "average_transaction_value": "round(a,4)",
    "unique_customers": "cu", "non_default_outcome_share": "round_even(z/b*100,1)",
    "suspicious_records": "(select count(*) filter (where is_suspicious) from anomalies)",
    "high_risk_records": "(select count(*) filter (where is_suspicious and risk_level='High') from anomalies)",
}
METRIC_CTES = {**PROFILE, "facts": _FACTS, "reference": _REFERENCE}
METRIC_CTES["metrics"] = " union all ".join(
    f"select {i} ordinal, '{m}' metric_id, '{label}' label, 'available' status, cast({_VALUES[m]} as double) value, "
    f"'{unit}' unit, {'cur' if unit == 'currency' else 'cast(null as varchar)'} currency, "
    f"'{definition}' definition_version, '{'|'.join(fields)}' source_fields, 'warn' quality_status, p0 period_start, "
    f"p1 period_end, cast({'z' if m == 'non_default_outcome_share' else 'null'} as bigint) numerator, "
    f"cast({'b' if m == 'non_default_outcome_share' else 'null'} as bigint) denominator, "
    + (f"'{RULESET_VERSION}'" if m in ("suspicious_records", "high_risk_records") else "cast(null as varchar)")
    + " logic_version, dataset_reference source_reference from score, facts, reference"
    for i, (m, (label, unit, definition, fields)) in enumerate(METRICS.items(), 1)
)


def on_metrics(body: str) -> str:
    return with_ctes(ANOMALY_CTES, body, **METRIC_CTES)


def metric_rows(spark, sf_dir):
    """The metric table of the portfolio, money rounded for comparison."""
    rows = portfolio(spark, sf_dir)
    anomalies = R.explain_rules(R.rule_statuses(rows))
    reference = P.fingerprint(rows.select(*_PLAIN)).first()["dataset_reference"]
    metrics = M.metric_table(rows, anomalies, RULESET_VERSION, reference=reference)
    digits = F.when(F.col("metric_id") == "transaction_value", F.round("value", 2)).when(
        F.col("metric_id") == "average_transaction_value", F.round("value", 4)).otherwise(F.col("value"))
    return metrics.withColumn("value", digits)


def _metric_query(name: str, ids: tuple[str, ...]) -> None:
    wanted = ", ".join(f"'{m}'" for m in ids)

    @query(name, on_metrics(f"select * from metrics where metric_id in ({wanted})"))
    def run(spark, sf_dir):
        rows = metric_rows(spark, sf_dir).where(F.col("metric_id").isin(*ids))
        return rows.select(
            "ordinal", "metric_id", "label", "status", "value", "unit", "currency", "definition_version",
            F.array_join("source_fields", "|").alias("source_fields"), "quality_status",
            F.col("period_start").cast("string").alias("period_start"),
            F.col("period_end").cast("string").alias("period_end"), "numerator", "denominator", "logic_version",
            "source_reference")


for _name, _ids in {
    "a4_transaction_value": ("transaction_value",),
    "a5_average_transaction_value": ("average_transaction_value",),
    "a6_unique_customers": ("unique_customers",),
    "a7_non_default_share": ("non_default_outcome_share",),
    "a8_rule_counts": ("suspicious_records", "high_risk_records"),
    "a9_observation_metrics": ("records_processed", "data_quality_score", "missing_values", "duplicate_rows"),
    "a4_a9_metric_table": tuple(METRICS),
}.items():
    _metric_query(_name, _ids)


@query("a4_a9_metrics_unavailable", on_portfolio(
    """select metric_id, status, quality_status, unavailable_reason, recovery from (values
 ('transaction_value','unavailable','blocked','Transaction currency is missing or ambiguous.',
  'Confirm one dataset currency or separate values by their mapped currency.'),
 ('average_transaction_value','unavailable','blocked','Transaction currency is missing or ambiguous.',
  'Confirm one dataset currency or separate values by their mapped currency.'),
 ('suspicious_records','unavailable','blocked',
  'No versioned risk-rule evaluation is attached to this metric snapshot.',
  'Run the approved rule set and provide its version before displaying rule-derived counts.'),
 ('high_risk_records','unavailable','blocked',
  'No versioned risk-rule evaluation is attached to this metric snapshot.',
  'Run the approved rule set and provide its version before displaying rule-derived counts.'))
 t(metric_id, status, quality_status, unavailable_reason, recovery)
 where (select count(distinct case when o_orderkey%3=0 then 'KES' else currency end) from portfolio)>1"""))
def a4_a9_metrics_unavailable(spark, sf_dir):
    rows = portfolio(spark, sf_dir, keep_key=True)
    mixed = rows.withColumn(
        "currency", F.when(F.col("o_orderkey") % 3 == 0, "KES").otherwise(F.col("currency"))).drop("o_orderkey")
    return M.metric_table(mixed).where("status = 'unavailable'").select(
        "metric_id", "status", "quality_status", "unavailable_reason", "recovery")


@query("a10_reporting_period", on_portfolio("select min(date) period_start, max(date) period_end from portfolio"))
def a10_reporting_period(spark, sf_dir):
    return M.reporting_period(portfolio(spark, sf_dir)).select(
        F.col("period_start").cast("string").alias("period_start"),
        F.col("period_end").cast("string").alias("period_end"))


@query("a10_period_label", on_portfolio(
    "select concat(strftime(min(cast(date as date)),'%d %b %Y'),' - ',strftime(max(cast(date as date)),'%d %b %Y')) "
    "period_label from portfolio"))
def a10_period_label(spark, sf_dir):
    from folioguard.operators.summaries import period_label

    return period_label(portfolio(spark, sf_dir))


@query("a11_portfolio_currency", on_portfolio("select upper(trim(min(currency))) currency from portfolio"))
def a11_portfolio_currency(spark, sf_dir):
    rows = portfolio(spark, sf_dir, keep_key=True)
    spelled = F.when(F.col("o_orderkey") % 2 == 0, " ngn ").otherwise(F.col("currency"))
    return M.portfolio_currency(rows.withColumn("currency", spelled))


_MONEY = "concat(currency, ' ', format('{:,}', cast(round_even(value,0) as bigint)))"
_SHOWN = (
    f"case when unit='currency' then {_MONEY} when unit='percent' then concat(format('{{:.1f}}', value), '%') "
    "else format('{:,}', cast(value as bigint)) end")


@query("q3_report_feed", on_metrics(
    f"select ordinal, label, {_SHOWN} display_value, unit, concat(period_start,' to ',period_end) as period, "
    "quality_status, concat(definition_version, case when logic_version is not null then concat('; logic ', "
    "logic_version) else '' end) definition, '' interpretation from metrics"))
def q3_report_feed(spark, sf_dir):
    return M.report_feed(metric_rows(spark, sf_dir))


@query("f15_display_values", on_metrics(f"select metric_id, {_SHOWN} display_value from metrics"))
def f15_display_values(spark, sf_dir):
    return metric_rows(spark, sf_dir).select("metric_id", M.display_value().alias("display_value"))


@query("f21_metric_insights", on_metrics(
    f"""select case metric_id when 'data_quality_score' then 1 when 'transaction_value' then 2
 when 'unique_customers' then 3 when 'non_default_outcome_share' then 4 else 5 end ordinal, metric_id,
 case when metric_id='data_quality_score' then concat('Composite data quality is ', format('{{:.1f}}', value), '% (',
  quality_status, '); review the six dimensions and blocking issues before relying on it.')
 else concat(label, ' is ', {_SHOWN}, ' (', quality_status, ').',
  case when metric_id='transaction_value' then ' This is not recognized revenue.' else '' end,
  ' Definition: ', definition_version, '.') end insight from metrics where metric_id in ('data_quality_score',
  'transaction_value','unique_customers','non_default_outcome_share','suspicious_records')"""))
def f21_metric_insights(spark, sf_dir):
    return M.metric_insights(metric_rows(spark, sf_dir))


@query("q4_coverage_sentence", with_ctes(
    ANOMALY_CTES,
    f"""select cast(e as bigint) evaluated, cast(p as bigint) possible, concat('Rule evidence coverage is ',
 format('{{:,}}', cast(e as bigint)), ' of ', format('{{:,}}', cast(p as bigint)),
 ' record-rule evaluations under {RULESET_VERSION}; non-evaluated rules are not clear results.') sentence
 from (select sum(rules_evaluated_count) e, sum(rules_evaluated_count+rules_not_evaluated_count) p from anomalies)"""))
def q4_coverage_sentence(spark, sf_dir):
    return M.coverage_sentence(R.rule_coverage(R.rule_statuses(portfolio(spark, sf_dir))))


