"""SQL text shared by the twins: the portfolio view and the rule result."""

from __future__ import annotations

from folioguard.fixed_values import RULES, RULESET_VERSION

PORTFOLIO_COLUMNS = (
    "customer_id, transaction_id, date, segment, region, business_type, employment_status, income, loan_amount, "
    "existing_debt, transaction_amount, transaction_frequency, account_age_months, repayment_history_score, "
    "defaulted, currency"
)

CTES = {
    "base": """select concat('CUST-', cast(o_custkey as varchar)) customer_id,
  case when o_orderkey%53=0 then null else concat('TXN-', cast(o_orderkey as varchar)) end transaction_id,
  strftime(o_orderdate,'%Y-%m-%d') date,
  case when o_orderkey%71=0 then null else c_mktsegment end segment,
  r_name region, n_name business_type,
  case when o_orderkey%59=0 then null else o_orderstatus end employment_status,
  case when c_acctbal>0 then round(c_acctbal*40,2) end income,
  round(c_acctbal*(1+o_orderkey%9)*10,2) loan_amount,
  case when c_acctbal>0 then round(c_acctbal*(o_orderkey%40),2) end existing_debt,
  case when o_orderkey%41=0 then null
       else round(o_totalprice*(case when o_orderkey%211=0 then 12 else 1 end),2) end transaction_amount,
  o_orderkey%97+(case when o_orderkey%173=0 then 400 else 0 end) transaction_frequency,
  o_custkey%96 account_age_months,
  case when o_orderkey%67=0 then null else cast((o_orderkey*37)%101 as double) end repayment_history_score,
  case when o_orderkey%10=0 then 1 else 0 end defaulted,
  'NGN' currency, o_orderkey
 from orders join customer on o_custkey=c_custkey
      join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey""",
    "portfolio": "select * from base union all select * from base where o_orderkey%97=0",
    "limits": """select greatest(avg(transaction_amount)*4.5, quantile_cont(transaction_amount,0.992)) ta,
  greatest(quantile_cont(transaction_frequency,0.992),
           avg(transaction_frequency)+stddev_pop(transaction_frequency)*2.4) tf from portfolio""",
    "medians": """select segment ms, quantile_cont(transaction_amount,0.5) med, count(transaction_amount) mn
 from portfolio where segment is not null group by 1""",
    "copies": """select transaction_id ct, count(*) cn from portfolio where trim(transaction_id)<>'' group by 1""",
    "ruled": """select p.*,
  case when transaction_amount is null then 'not_evaluated' when transaction_amount>ta then 'triggered'
       else 'clear' end s1,
  case when transaction_id is null or trim(transaction_id)='' then 'not_evaluated' when cn>1 then 'triggered'
       else 'clear' end s2,
  case when transaction_amount is null or segment is null or trim(segment)='' then 'not_evaluated'
       when transaction_amount>med*4.2 then 'triggered' else 'clear' end s3,
  case when repayment_history_score is null then 'not_evaluated' when repayment_history_score<36 then 'triggered'
       else 'clear' end s4,
  case when loan_amount is null or income is null or income<=0 then 'not_evaluated'
       when loan_amount>income*2.15 then 'triggered' else 'clear' end s5,
  case when transaction_frequency is null then 'not_evaluated' when transaction_frequency>tf then 'triggered'
       else 'clear' end s6,
  case when existing_debt is null or income is null or income<=0 then 'not_evaluated'
       when existing_debt>income*0.82 then 'triggered' else 'clear' end s7
 from portfolio p cross join limits left join medians on p.segment=ms left join copies on transaction_id=ct""",
    "ranks": """select transaction_amount ra, count(*) rc, min(r)+(count(*)-1)/2.0 ar, max(n) rn from (
  select transaction_amount, rank() over (order by transaction_amount) r, count(*) over () n
  from portfolio where transaction_amount is not null) group by 1""",
}
_PAIRS = [(f"s{i}", rule_id, label) for i, (rule_id, label) in enumerate(RULES, 1)]
_LABELS = "list_filter([" + ", ".join(
    f"case when {s}='triggered' then '{label}' end" for s, _, label in _PAIRS) + "], lambda x: x is not null)"
_SKIPPED = "list_filter([" + ", ".join(
    f"case when {s}='not_evaluated' then '{rule_id}' end" for s, rule_id, _ in _PAIRS) + "], lambda x: x is not null)"
CTES["labelled"] = f"select *, {_LABELS} labels, {_SKIPPED} skipped from ruled"
CTES["anomalies"] = f"""select l.*,
  concat(case when len(labels)>0 then array_to_string(labels,'; ') else 'No evaluated rule triggered' end,
         case when len(skipped)>0 then concat('; Not evaluated: ', array_to_string(skipped,', ')) else '' end)
    anomaly_notes,
  '{RULESET_VERSION}' rule_version,
  cast(7-len(skipped) as bigint) rules_evaluated_count,
  cast(len(skipped) as bigint) rules_not_evaluated_count,
  array_to_string(skipped,'|') not_evaluated_rule_ids,
  case when len(skipped)=7 then 'none' when len(skipped)>0 then 'partial' else 'full' end rule_coverage_status,
  len(labels)>0 is_suspicious,
  case when len(labels)>0 then labels[1] else 'Normal' end suspicious_category,
  case when len(labels)>=3 then 'High' when len(labels)=2 then 'Medium' when len(labels)=1 then 'Low' else 'Normal' end
    risk_level,
  case when len(skipped)<7 then round_even(least(greatest(
     len(labels)*24 + coalesce(ar/rn,0)*18
     + coalesce(least(greatest(70-repayment_history_score,0),70),0)/70*32
     + coalesce(least(greatest(case when income>0 then existing_debt/income end,0),1),0)*20, 0),100),1) end
    anomaly_score
 from labelled l left join ranks on transaction_amount=ra"""
RULE_CTES = ("base", "portfolio", "limits", "medians", "copies", "ruled")
ANOMALY_CTES = (*RULE_CTES, "ranks", "labelled", "anomalies")
STATUS_SELECT = ", ".join(f"{s} as rule_{rule_id}_status" for s, rule_id, _ in _PAIRS)


def with_ctes(names: tuple[str, ...], body: str, **extra: str) -> str:
    """``with a as (...), ... body``; ``extra`` CTEs follow the shared ones."""
    parts = [f"{name} as ({CTES[name]})" for name in names] + [f"{name} as ({text})" for name, text in extra.items()]
    return f"with {', '.join(parts)}\n{body}"


def on_portfolio(body: str, **extra: str) -> str:
    return with_ctes(("base", "portfolio"), body, **extra)


def on_rules(body: str, **extra: str) -> str:
    return with_ctes(RULE_CTES, body, **extra)


def on_anomalies(body: str, **extra: str) -> str:
    return with_ctes(ANOMALY_CTES, body, **extra)
