"""Mapping tables, validation runs, overrides, lifecycle checks and audit chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioguard.fixed_values import CONCEPT_CAPABILITIES
from folioguard.functions.scalars import (
    blank_to_null,
    integral,
    normalized_header,
    num_text,
    ts_text,
    txt,
)
from folioguard.operators import audit as U
from folioguard.operators import headers as H
from folioguard.operators import lifecycle as L
from folioguard.operators import mapping as P
from folioguard.operators import overrides as O
from folioguard.operators import tables as T
from folioguard.operators import validation as D
from folioguard.plans.registry import query
from folioguard.session import materialize, staging_path
from folioguard.sources.catalogue import derive, derived_sql, lexical_dataset, lexical_sql

MOMENT = "2024-01-20 12:00:00"
_NOW = f"timestamp '{MOMENT}'"


def with_tables(body: str, *names: str, **extra: str) -> str:
    parts = [f"{n} as ({derived_sql(n)})" for n in names] + [f"{n} as ({t})" for n, t in extra.items()]
    return f"with {', '.join(parts)}\n{body}"


def on_lexical(body: str, **extra: str) -> str:
    parts = [f"lex as ({lexical_sql()})"] + [f"{n} as ({t})" for n, t in extra.items()]
    return f"with {', '.join(parts)}\n{body}"


def _moment():
    return F.lit(MOMENT).cast("timestamp_ntz")


# --- confirmed mapping of the lexical dataset ---
FIELDS = [
    P.Field("client_id", "customer_id", "string", False),
    P.Field("txn_id", "transaction_id", "string", False),
    P.Field("txn_date", "date", "date", True),
    P.Field("txn_value", "transaction_amount", "decimal", True),
    P.Field("ccy", "currency", "string", False),
    P.Field("monthly_income", "income", "decimal", True),
    P.Field("repayment_score", "repayment_history_score", "integer", False),
    P.Field("is_default", "defaulted", "boolean", True),
    P.Field("loan_status", "repayment_status", "string", True),
]
BY = ["dataset_version_id"]
# What the defects of each column come to, by construction.
_MISSING = {
    "client_id": "v=3 and k%101=0", "txn_value": "k%9=0", "is_default": "k%8=6", "loan_status": "k%5=4",
}
_INVALID = {
    "txn_date": "k%8 in (5,6)", "txn_value": "k%9 in (1,3,5,6)", "repayment_score": "v=5 and k%4 in (2,3)",
    "is_default": "k%8 in (5,7)",
}
_EVIDENCE = " union all ".join(
    f"select dataset_version_id, {i} as position, '{f.concept}' concept, '{f.target_type}' target_type, "
    f"cast({f.nullable} as int) nullable, "
    f"count(*) filter (where {_MISSING.get(f.normalized_column, 'false')}) missing_count, "
    f"count(*) filter (where {_INVALID.get(f.normalized_column, 'false')}) invalid_count from lex group by 1"
    for i, f in enumerate(FIELDS))


@query("p4_canonical_projection", on_lexical(
    """select case when v=3 and k%101=0 then null else trim(client_id) end customer_id, txn_id transaction_id,
 trim(txn_date) date, nullif(trim(txn_value),'') transaction_amount, trim(ccy) currency, monthly_income income,
 repayment_score repayment_history_score,
 case lower(trim(is_default)) when '0' then 0 when '1' then 1 when 'true' then 1 when 'false' then 0 end defaulted,
 nullif(trim(loan_status),'') repayment_status, dataset_version_id from lex"""))
def p4_canonical_projection(spark, sf_dir):
    return P.canonicalize(lexical_dataset(spark, sf_dir), FIELDS, BY)


@query("p5_type_validity", on_lexical(
    """select transaction_id, cast(not (k%9 in (0,1,3,5,6)) as int) as decimal_ok,
 cast(k%9 not in (0,1,3,5,6) as int) integer_ok, cast(k%8 in (0,1,2,3,4) as int) boolean_ok,
 cast(k%8 not in (5,6) as int) date_ok from (select *, txn_id transaction_id from lex)"""))
def p5_type_validity(spark, sf_dir):
    rows = lexical_dataset(spark, sf_dir)

    def ok(column: str, kind: str):
        return P.valid_by_type(blank_to_null(F.col(column)), F.lit(kind)).cast("int").alias(f"{kind}_ok")

    return rows.select(
        F.col("txn_id").alias("transaction_id"), ok("txn_value", "decimal"), ok("txn_value", "integer"),
        ok("is_default", "boolean"), ok("txn_date", "date"))


@query("p6_mapped_columns_only", on_lexical("select txn_id, txn_value from lex"))
def p6_mapped_columns_only(spark, sf_dir):
    mapped = sorted(f.normalized_column for f in FIELDS if f.concept in ("transaction_id", "transaction_amount"))
    return lexical_dataset(spark, sf_dir).select(*mapped)


@query("f1_trim_case_blank", on_lexical(
    "select txn_id, lower(trim(client_id)) lowered, upper(trim(ccy)) uppered, nullif(trim(loan_status),'') stripped "
    "from lex"))
def f1_trim_case_blank(spark, sf_dir):
    return lexical_dataset(spark, sf_dir).select(
        "txn_id", F.lower(txt(F.col("client_id"))).alias("lowered"), F.upper(txt(F.col("ccy"))).alias("uppered"),
        blank_to_null(F.col("loan_status")).alias("stripped"))


@query("f2_collapse_to_snake_case", "select o_orderkey, trim(regexp_replace(lower(concat(o_orderpriority, ' ', "
       "o_orderstatus)),'[^0-9a-z]+','_','g'),'_') slug from orders")
def f2_collapse_to_snake_case(spark, sf_dir):
    from folioguard.sources.portfolio import table

    return table(spark, sf_dir, "orders").select(
        "o_orderkey", normalized_header(F.concat_ws(" ", "o_orderpriority", "o_orderstatus")).alias("slug"))


@query("f6_f7_mapped_outcomes", on_lexical(
    """select txn_id, case when k%8 in (0) then 0 when k%8 in (1,4) then 1 end from_defaulted,
 case lower(trim(loan_status)) when 'repaid' then 0 when 'defaulted' then 1 when 'charged off' then 1 end from_status
 from lex"""))
def f6_f7_mapped_outcomes(spark, sf_dir):
    from folioguard.operators.modeling import binary_outcome, status_outcome

    rows = lexical_dataset(spark, sf_dir).withColumnRenamed("is_default", "defaulted")
    return rows.select(
        "txn_id", binary_outcome(rows).alias("from_defaulted"), status_outcome(F.col("loan_status")).alias(
            "from_status"))


@query("f9_integral_values", on_lexical(
    "select txn_id, cast(case when v=5 then k%4 in (0,1) else true end as int) is_integral from lex"))
def f9_integral_values(spark, sf_dir):
    value = num_text(txt(F.col("repayment_score")))
    return lexical_dataset(spark, sf_dir).select(
        "txn_id", F.coalesce(integral(value), F.lit(False)).cast("int").alias("is_integral"))


@query("f10_mixed_dates", on_lexical(
    "select txn_id, case when k%8 in (5,6) then null else strftime(d,'%Y-%m-%d') end \"day\" from (select l.*, "
    "o_orderdate d from lex l join orders on o_orderkey=k)"))
def f10_mixed_dates(spark, sf_dir):
    return lexical_dataset(spark, sf_dir).select(
        "txn_id", F.date_format(ts_text(F.col("txn_date")), "yyyy-MM-dd").alias("day"))


@query("a30_field_evidence", on_lexical(_EVIDENCE))
def a30_field_evidence(spark, sf_dir):
    found = D.field_evidence(lexical_dataset(spark, sf_dir), FIELDS, BY)
    return found.withColumn("nullable", F.col("nullable").cast("int"))


_ISSUES = f"""select dataset_version_id, position, concept, code, severity, n from (
 select *, case when nullable=0 and missing_count>0 then 'missing_required_field' end c1,
  case when invalid_count>0 then case when nullable=0 then 'unparseable_required_field' else
   'unparseable_optional_field' end end c2 from ({_EVIDENCE})) t,
 lateral (select c1 code, 'block' severity, missing_count n where c1 is not null union all
  select c2, case when nullable=0 then 'block' else 'warn' end, invalid_count where c2 is not null)"""


@query("a30_mapping_issues", on_lexical(
    f"select dataset_version_id, row_number() over (partition by dataset_version_id order by position, code) ordinal, "
    f"concept, code, severity, n affected_count from ({_ISSUES})"))
def a30_mapping_issues(spark, sf_dir):
    found = D.mapping_issues(lexical_dataset(spark, sf_dir), FIELDS, BY)
    return found.select("dataset_version_id", F.posexplode("mapping_issues").alias("p", "i")).select(
        "dataset_version_id", (F.col("p") + 1).cast("long").alias("ordinal"), F.col("i.column").alias("concept"),
        "i.code", "i.severity", "i.affected_count")


@query("a31_masked_examples", on_lexical(
    """select dataset_version_id, concept, string_agg(concat('sha256:', left(sha256(x),16)), '|' order by x) examples
 from (select *, row_number() over (partition by dataset_version_id, concept order by x) rn from (
  select distinct dataset_version_id, 'date' concept, trim(txn_date) x from lex where k%8 in (5,6)
  union all select distinct dataset_version_id, 'transaction_amount', trim(txn_value) from lex where k%9 in (1,3,5,6)
  union all select distinct dataset_version_id, 'repayment_history_score', repayment_score from lex where v=5 and
   k%4 in (2,3) union all select distinct dataset_version_id, 'defaulted', trim(is_default) from lex where k%8 in (5,7)))
 where rn<=3 group by 1,2"""))
def a31_masked_examples(spark, sf_dir):
    found = D.masked_examples(lexical_dataset(spark, sf_dir), FIELDS, BY)
    return found.select("dataset_version_id", "concept", F.array_join("masked_examples", "|").alias("examples"))


def _runs(spark, sf_dir):
    """The nested runs, written once because several tables are made from them."""
    return materialize(D.validate(lexical_dataset(spark, sf_dir), FIELDS, BY), "runs")


# Issues of the assessment itself, per version: missing cells, repeats, and the two partly readable columns.
_OWN = """select dataset_version_id,
 sum((k%9=0)::int + (k%8 in (5,6,7))::int + (k%5=4)::int + (v=3 and k%101=0)::int) missing_cells,
 count(*) filter (where k%9 in (1,3,5,6)) bad_amounts, count(*) filter (where k%8 in (5,6)) bad_dates,
 count(*) filter (where v=3 and k%101=0) no_customer from lex group by 1"""


@query("u1_a30_all_issues", on_lexical(
    f"""select dataset_version_id, code, affected_count, severity from (
 select dataset_version_id, code, n affected_count, severity from ({_ISSUES})
 union all select dataset_version_id, 'missing_values', cast(missing_cells as bigint), 'warn' from own
  where missing_cells>0
 union all select dataset_version_id, 'invalid_transaction_amount', bad_amounts, 'warn' from own
 union all select dataset_version_id, 'invalid_event_date', bad_dates, 'warn' from own
 union all select dataset_version_id, 'missing_customer_ids', no_customer, 'warn' from own where no_customer>0
 union all select dataset_version_id, 'missing_model_inputs', 8, 'block' from own
 union all select dataset_version_id, 'missing_risk_rule_inputs', 3, 'block' from own)""", own=_OWN))
def u1_a30_all_issues(spark, sf_dir):
    return _runs(spark, sf_dir).select("dataset_version_id", F.inline("issues")).select(
        "dataset_version_id", "code", "affected_count", "severity")


@query("a32_verdicts", on_lexical(
    f"""select dataset_version_id, case when bool_or(severity='block') then 'blocked' else 'passed' end verdict,
 count(*) filter (where severity='block') + 2 block_count,
 count(*) filter (where severity='warn') + 3 + max(has) warn_count, cast(0 as bigint) info_count
 from ({_ISSUES}) join (select dataset_version_id, cast(no_customer>0 as bigint) has from own) using
 (dataset_version_id) group by 1""", own=_OWN))
def a32_verdicts(spark, sf_dir):
    return _runs(spark, sf_dir).select("dataset_version_id", "verdict", "block_count", "warn_count", "info_count")


@query("a32_verdicts_from_issue_table", with_tables(
    "select validation_run_id, count(*) filter (where severity='block') block_count, count(*) filter (where "
    "severity='warn') warn_count, count(*) filter (where severity='info') info_count, case when "
    "bool_or(severity='block') then 'blocked' else 'passed' end verdict from validation_issues group by 1",
    "validation_issues"))
def a32_verdicts_from_issue_table(spark, sf_dir):
    return D.verdicts(derive(spark, sf_dir, "validation_issues"))


@query("s13_w6_persisted_issues", on_lexical(
    f"""select dataset_version_id validation_run_id, row_number() over (partition by dataset_version_id order by part,
 position, code) issue_ordinal, code rule_id, severity from (
 select dataset_version_id, 0 part, position, code, severity from ({_ISSUES})
 union all select dataset_version_id, 1, 1, 'missing_values', 'warn' from own
 union all select dataset_version_id, 1, 2, 'invalid_transaction_amount', 'warn' from own
 union all select dataset_version_id, 1, 3, 'invalid_event_date', 'warn' from own
 union all select dataset_version_id, 1, 4, 'missing_customer_ids', 'warn' from own where no_customer>0
 union all select dataset_version_id, 1, 5, 'missing_model_inputs', 'block' from own
 union all select dataset_version_id, 1, 6, 'missing_risk_rule_inputs', 'block' from own)""", own=_OWN))
def s13_w6_persisted_issues(spark, sf_dir):
    details = D.detail_tables(_runs(spark, sf_dir), "dataset_version_id")
    folder = staging_path(spark, "runs")
    D.persist({"validation_issues": details["validation_issues"]}, folder)
    # A second delivery of the same run adds nothing.
    stored = D.persist({"validation_issues": details["validation_issues"]}, folder)["validation_issues"]
    return stored.select("validation_run_id", F.col("issue_ordinal").cast("long").alias("issue_ordinal"), "rule_id",
                         "severity")


@query("s14_u4_verified_detail", on_lexical(
    "select detail, cast(0 as bigint) missing, cast(0 as bigint) unexpected from (values ('validation_runs'), "
    "('validation_dimension_scores'), ('validation_capability_results'), ('validation_issues'), "
    "('validation_issue_capabilities'), ('validation_issue_examples')) t(detail) where (select count(*) from lex)>0"))
def s14_u4_verified_detail(spark, sf_dir):
    details = D.detail_tables(_runs(spark, sf_dir), "dataset_version_id")
    return D.verify(details, D.persist(details, staging_path(spark, "verify")))


@query("s15_artifact_conflicts", with_tables(
    "select dataset_version_id, row_count from changed where dataset_version_id in (select dataset_version_id from "
    "artifacts where row_count%10=0) and old is distinct from row_count", "artifacts",
    changed="select dataset_version_id, case when row_count%10=0 then row_count+1 else row_count end row_count, "
            "row_count old from artifacts"))
def s15_artifact_conflicts(spark, sf_dir):
    stored = derive(spark, sf_dir, "artifacts")
    again = stored.withColumn(
        "row_count", F.when(F.col("row_count") % 10 == 0, F.col("row_count") + 1).otherwise(F.col("row_count")))
    return T.conflicts(again, stored, ["dataset_version_id"]).select("dataset_version_id", "row_count")


@query("s15_insert_if_absent", with_tables("select dataset_version_id, artifact_sha256 from artifacts", "artifacts"))
def s15_insert_if_absent(spark, sf_dir):
    rows = derive(spark, sf_dir, "artifacts")
    path = staging_path(spark, "artifacts")
    early = rows.where(F.col("column_count") < 8)
    T.append_absent(early, path, ["dataset_version_id"])
    return T.append_absent(rows, path, ["dataset_version_id"]).select("dataset_version_id", "artifact_sha256")


_BATCH = "case when e%7=0 then null else e%40 end k, case when e%40=3 then e else e%40 end content"


@query("s15_contradictory_batch", f"""select k from (select {_BATCH.replace('e%', 'event_id%').replace('then e else', 'then event_id else')}
 from events) group by k having count(distinct content)>1""")
def s15_contradictory_batch(spark, sf_dir):
    """Keys that one delivery holds with different contents, the missing key among them."""
    from folioguard.sources.portfolio import table

    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("e"))
    batch = rows.selectExpr(*[x.strip() for x in _BATCH.split(", ")])
    return T.contradictions(batch, ["k"])


@query("s15_null_key_once", "select distinct case when event_id%7=0 then null else event_id%40 end k from events")
def s15_null_key_once(spark, sf_dir):
    """A second delivery adds nothing, under a missing key either."""
    from folioguard.sources.portfolio import table

    rows = table(spark, sf_dir, "events").selectExpr(
        "case when event_id%7=0 then null else event_id%40 end k").withColumn("content", F.lit("same"))
    path = staging_path(spark, "null-keys")
    T.append_absent(rows, path, ["k"])
    return T.append_absent(rows, path, ["k"]).select("k")


@query("s16_mapping_catalogue", with_tables(
    "select mapping_version_id, count(*) fields, count(*) filter (where nullable) nullable_fields, "
    "string_agg(concept, '|' order by position) concepts from mapping_fields group by 1", "mapping_fields"))
def s16_mapping_catalogue(spark, sf_dir):
    path = staging_path(spark, "mapping_fields")
    stored = T.append_absent(derive(spark, sf_dir, "mapping_fields"), path, ["mapping_version_id", "position"])
    ordered = F.array_sort(F.collect_list(F.struct("position", "concept")))
    return stored.groupBy("mapping_version_id").agg(
        F.count("*").alias("fields"), F.count(F.when(F.col("nullable"), 1)).alias("nullable_fields"),
        F.array_join(F.transform(ordered, lambda x: x["concept"]), "|").alias("concepts"))


@query("h4_mapping_checks", with_tables(
    """select mapping_version_id, field_count, case when pairs<>field_count or unknown>0 then 'mapping_column_mismatch'
 when concepts<>field_count then 'duplicate_governed_concept'
 when by_column and not has_currency then 'currency_column_mapping_required' end error_code from (
 select f.mapping_version_id, count(*) field_count,
  count(distinct concat(f.source_column,'|',f.normalized_column)) pairs, count(distinct concept) concepts,
  count(*) filter (where a.position is null) unknown, bool_or(currency_mode='column') by_column,
  bool_or(concept='currency') has_currency from mapping_fields f left join artifact_fields a
  on f.mapping_version_id=a.mapping_version_id and f.source_column=a.source_column and
  f.normalized_column=a.normalized_column group by 1)""", "mapping_fields", "artifact_fields"))
def h4_mapping_checks(spark, sf_dir):
    return P.check_mappings(derive(spark, sf_dir, "mapping_fields"), derive(spark, sf_dir, "artifact_fields"))


_ID = "concept in ('customer_id','transaction_id')"
_MONEY = "concept in ('transaction_amount','income','loan_amount','existing_debt')"
_NA = "'not_applicable'"


@query("h5_semantic_rules", with_tables(
    f"""select mapping_version_id, position, array_to_string(list_filter([
 case when currency_mode='fixed' and not coalesce(regexp_full_match(currency_code,'[A-Z]{{3}}'),false)
  then 'fixed_currency_code' end,
 case when currency_mode<>'fixed' and currency_code is not null then 'unexpected_currency_code' end,
 case when {_ID} and not (target_type='string' and unit='identifier' and currency_mode={_NA} and "period"={_NA} and
  amount_direction={_NA} and time_semantics={_NA}) then 'identifier_semantics' end,
 case when {_MONEY} and not (target_type='decimal' and unit='money' and currency_mode<>{_NA} and time_semantics={_NA})
  then 'money_semantics' end,
 case when concept='transaction_amount' and ("period"<>'transaction' or amount_direction={_NA})
  then 'amount_semantics' end,
 case when concept='currency' and not (target_type='string' and unit='currency_code' and currency_mode={_NA})
  then 'currency_semantics' end,
 case when concept='date' and not (target_type in ('date','datetime') and unit='temporal' and time_semantics<>{_NA})
  then 'date_semantics' end], lambda x: x is not null), '|') violations from mapping_fields""", "mapping_fields"))
def h5_semantic_rules(spark, sf_dir):
    checked = P.check_fields(derive(spark, sf_dir, "mapping_fields"))
    return checked.select("mapping_version_id", "position", F.array_join("violations", "|").alias("violations"))


_FIELD_JSON = "concat('{', " + ", ',', ".join(
    f"'\"{n}\":', " + (
        "cast(nullable as varchar)" if n == "nullable"
        else f"case when {n} is null then 'null' else concat('\"', {'\"period\"' if n == 'period' else n}, '\"') end")
    for n in P.HASHED_FIELD) + ", '}')"


@query("h7_f16_mapping_hashes", with_tables(
    f"""select mapping_version_id, concat('sha256:', sha256(concat('{{"fields":[',
 string_agg({_FIELD_JSON}, ',' order by position), '],"mapping_version_id":"', mapping_version_id, '"}}')))
 mapping_hash from mapping_fields group by 1""".replace("when period is null", 'when "period" is null'),
    "mapping_fields"))
def h7_f16_mapping_hashes(spark, sf_dir):
    return P.mapping_hashes(derive(spark, sf_dir, "mapping_fields"))


@query("u2_untrusted_fields", with_tables(
    "select mapping_version_id, source_column, normalized_column, concept from mapping_fields f where not exists "
    "(select 1 from artifact_fields a where a.mapping_version_id=f.mapping_version_id and "
    "a.source_column=f.source_column and a.normalized_column=f.normalized_column)", "mapping_fields",
    "artifact_fields"))
def u2_untrusted_fields(spark, sf_dir):
    return P.untrusted_fields(derive(spark, sf_dir, "mapping_fields"), derive(spark, sf_dir, "artifact_fields"))


@query("f22_concept_capabilities", with_tables(
    "select mapping_version_id, position, concept, capability from mapping_fields join (values " + ", ".join(
        f"('{c}','{x}')" for c, found in CONCEPT_CAPABILITIES.items() for x in found)
    + ") t(concept, capability) using (concept)", "mapping_fields"))
def f22_concept_capabilities(spark, sf_dir):
    return H.concept_capabilities(derive(spark, sf_dir, "mapping_fields")).select(
        "mapping_version_id", "position", "concept", "capability")


@query("t6_fields_in_order", with_tables(
    "select mapping_version_id, position, source_column from mapping_fields order by 1,2", "mapping_fields"))
def t6_fields_in_order(spark, sf_dir):
    fields = derive(spark, sf_dir, "mapping_fields")
    return fields.select("mapping_version_id", "position", "source_column").orderBy("mapping_version_id", "position")


# --- lifecycle joins ---
_KEY = "dataset_version_id, organization_id, workspace_id"


@query("j1_validation_context", with_tables(
    f"""select {_KEY}, v.revision, v.status, a.artifact_sha256, a.row_count, a.column_count, a.schema_fingerprint,
 m.mapping_version_id, r.validation_run_id from dataset_versions v join artifacts a using ({_KEY})
 join mapping_versions m using ({_KEY}) left join validation_runs r on r.mapping_version_id=m.mapping_version_id
 where a.schema_fingerprint=m.schema_fingerprint""", "dataset_versions", "artifacts", "mapping_versions",
    "validation_runs"))
def j1_validation_context(spark, sf_dir):
    return L.validation_context(*[derive(spark, sf_dir, n) for n in (
        "dataset_versions", "artifacts", "mapping_versions", "validation_runs")])


@query("j2_mapping_context", with_tables(
    f"select {_KEY}, dataset_id, revision, status, schema_fingerprint, column_count from dataset_versions "
    f"join artifacts using ({_KEY})", "dataset_versions", "artifacts"))
def j2_mapping_context(spark, sf_dir):
    return L.mapping_context(derive(spark, sf_dir, "dataset_versions"), derive(spark, sf_dir, "artifacts"))


@query("j3_warning_context", with_tables(
    "select validation_run_id, organization_id, workspace_id, dataset_version_id, issue_ordinal, rule_id, "
    "rule_version, severity, cast(override_allowed as int) override_allowed from validation_runs join "
    "validation_issues using (validation_run_id)", "validation_runs", "validation_issues"))
def j3_warning_context(spark, sf_dir):
    found = O.warning_context(derive(spark, sf_dir, "validation_runs"), derive(spark, sf_dir, "validation_issues"))
    return found.drop("affected_count").withColumn("override_allowed", F.col("override_allowed").cast("int"))


_EFFECTIVE = f"""select r.validation_run_id, dataset_version_id, composite_score, block_count blocking_issue_count,
 warn_count warning_issue_count,
 count(o.override_id) filter (where overridden_at<={_NOW} and expires_at>{_NOW}) active_override_count,
 info_count informational_issue_count from validation_runs r left join override_requests o
 on o.validation_run_id=r.validation_run_id group by all"""


@query("j4_a33_effective_quality", with_tables(
    f"""select *, warning_issue_count-active_override_count effective_warning_count, case when blocking_issue_count>0
 then 'blocked' when warning_issue_count-active_override_count<>0 then 'warn' else 'healthy' end status
 from ({_EFFECTIVE})""", "validation_runs", "override_requests"))
def j4_a33_effective_quality(spark, sf_dir):
    return O.effective_quality(
        derive(spark, sf_dir, "validation_runs"), derive(spark, sf_dir, "override_requests"), _moment())


@query("j5_overlapping_overrides", with_tables(
    """select override_id, validation_run_id, issue_ordinal from override_requests a where exists (select 1 from
 override_requests b where a.validation_run_id=b.validation_run_id and a.issue_ordinal=b.issue_ordinal and
 a.overridden_at<b.expires_at and b.overridden_at<a.expires_at and a.override_id<>b.override_id)""",
    "override_requests"))
def j5_overlapping_overrides(spark, sf_dir):
    rows = derive(spark, sf_dir, "override_requests")
    return O.overlapping(rows, rows).select("override_id", "validation_run_id", "issue_ordinal")


_CLAIM = f"""select job_id, cast(job_type not in ('dataset.scan','dataset.validate') or (job_type='dataset.scan' and
 exists (select 1 from dataset_versions v where v.dataset_version_id=j.dataset_version_id and
  v.organization_id=j.organization_id and v.workspace_id=j.workspace_id and v.status in ('uploaded','scanning')))
 or (job_type='dataset.validate' and exists (select 1 from dataset_versions v where
  v.dataset_version_id=j.dataset_version_id and v.organization_id=j.organization_id and v.workspace_id=j.workspace_id
  and (v.status='validating' or (v.status in ('ready','failed') and exists (select 1 from validation_runs r where
  r.validation_run_id=j.job_id and r.dataset_version_id=v.dataset_version_id))))) as int) claimable from jobs j"""


@query("j6_claimable_jobs", with_tables(_CLAIM, "jobs", "dataset_versions", "validation_runs"))
def j6_claimable_jobs(spark, sf_dir):
    ready, other = L.claimable_jobs(*[derive(spark, sf_dir, n) for n in (
        "jobs", "dataset_versions", "validation_runs")])
    return ready.select("job_id", F.lit(1).alias("claimable")).unionByName(
        other.select("job_id", F.lit(0).alias("claimable")))


@query("j7_settled_consistently", with_tables(
    f"""select {_KEY}, status, validation_run_id, verdict from dataset_versions join validation_runs using ({_KEY})
 where status = case verdict when 'passed' then 'ready' when 'blocked' then 'failed' end""", "dataset_versions",
    "validation_runs"))
def j7_settled_consistently(spark, sf_dir):
    return L.settled_consistently(derive(spark, sf_dir, "dataset_versions"), derive(spark, sf_dir, "validation_runs"))


@query("j8_upload_reconciliation", with_tables(
    """select dataset_version_id, v.object_key, case when s.object_key is null then 'upload_missing' when
 content_length=expected_bytes and lower(s.content_type)=v.content_type and lower(checksum_sha256)=expected_sha256
 then 'uploaded' else 'upload_metadata_mismatch' end outcome, case when s.object_key is null then status when
 content_length=expected_bytes and lower(s.content_type)=v.content_type and lower(checksum_sha256)=expected_sha256
 then 'uploaded' else 'quarantined' end next_status from dataset_versions v left join stored_objects s
 on v.object_key=s.object_key""", "dataset_versions", "stored_objects"))
def j8_upload_reconciliation(spark, sf_dir):
    return L.reconcile_uploads(
        derive(spark, sf_dir, "dataset_versions").drop("x"), derive(spark, sf_dir, "stored_objects"))


@query("j9_guarded_overrides", with_tables(
    """select override_id, cast(exists (select 1 from validation_issues i where
 i.validation_run_id=o.validation_run_id and i.issue_ordinal=o.issue_ordinal and severity='warn' and override_allowed)
 as int) accepted from override_requests o""", "override_requests", "validation_issues"))
def j9_guarded_overrides(spark, sf_dir):
    accepted, refused = O.split_requests(
        derive(spark, sf_dir, "override_requests"), derive(spark, sf_dir, "validation_issues"))
    return accepted.select("override_id", F.lit(1).alias("accepted")).unionByName(
        refused.select("override_id", F.lit(0).alias("accepted")))


@query("p14_tenant_scope", with_tables(
    "select dataset_version_id, status from dataset_versions where organization_id='org-3' and workspace_id='ws-13'",
    "dataset_versions"))
def p14_tenant_scope(spark, sf_dir):
    return T.in_tenant(derive(spark, sf_dir, "dataset_versions"), "org-3", "ws-13").select(
        "dataset_version_id", "status")


@query("p15_active_overrides", with_tables(
    f"select override_id from override_requests where overridden_at<={_NOW} and {_NOW}<expires_at",
    "override_requests"))
def p15_active_overrides(spark, sf_dir):
    return derive(spark, sf_dir, "override_requests").where(O.active_at(_moment())).select("override_id")


@query("f19_f20_override_admission", with_tables(
    """select override_id, case when not (reason=trim(reason) and length(reason) between 10 and 1000)
 then 'invalid_reason' when severity is null then 'validation_warning_not_found' when severity<>'warn' or not
 override_allowed then 'warning_override_not_allowed' when expires_at<overridden_at+interval 15 minute or
 expires_at>overridden_at+interval 90 day then 'invalid_override_expiry' end error_code from override_requests o
 left join validation_issues i on i.validation_run_id=o.validation_run_id and i.issue_ordinal=o.issue_ordinal""",
    "override_requests", "validation_issues"))
def f19_f20_override_admission(spark, sf_dir):
    judged = O.judge_requests(
        derive(spark, sf_dir, "override_requests"), derive(spark, sf_dir, "validation_issues"))
    return judged.select("override_id", "error_code")


@query("a42_repeated_requests", with_tables(
    "select organization_id, workspace_id, request_id, count(*) requests from override_requests group by 1, 2, 3 "
    "having count(*)>1", "override_requests"))
def a42_repeated_requests(spark, sf_dir):
    return T.repeated_requests(derive(spark, sf_dir, "override_requests"), O.REQUEST_KEY)


@query("a43_replay_or_conflict", with_tables(
    """select a.override_id, case when b.request_id is null then 'new' when
 a.validation_run_id is not distinct from b.validation_run_id and a.issue_ordinal is not distinct from b.issue_ordinal
 and a.overridden_by is not distinct from b.overridden_by and a.expires_at is not distinct from b.expires_at and
 a.reason is not distinct from b.reason then 'replay' else 'conflict' end outcome from override_requests a left join
 (select * from (select *, row_number() over (partition by organization_id, workspace_id, request_id
  order by overridden_at, override_id) rn from override_requests) where rn=1) b
 using (organization_id, workspace_id, request_id)""", "override_requests"))
def a43_replay_or_conflict(spark, sf_dir):
    rows = derive(spark, sf_dir, "override_requests")
    first = O.first_requests(rows, O.REQUEST_KEY, ["overridden_at", "override_id"])
    return O.classify_requests(first, rows, O.REQUEST_KEY).select("override_id", "outcome")


@query("w8_first_jobs", with_tables(
    "select dataset_version_id, job_id, job_type from (select *, row_number() over (partition by dataset_version_id "
    "order by created_at, job_id) rn from jobs) where rn=1", "jobs"))
def w8_first_jobs(spark, sf_dir):
    return L.first_jobs(derive(spark, sf_dir, "jobs"))


def _uuid(key: str, prefix: str, digest: str) -> str:
    """SQL for a UUID-shaped name made of a digest."""
    h = f"{digest}(concat('{prefix}-', cast({key} as varchar(20))))"
    return ("concat(" + ", '-', ".join(f"substr({h}, {at}, {n})" for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
            + ")")


_OWN, _MAPPING = _uuid("o_orderkey", "version", "md5"), _uuid("o_orderkey", "mapping", "md5")


def _reference_sql(kind: str = "o_orderkey%9") -> str:
    """A reference with one defect in each of several kinds."""
    schema = "sha256(concat('schema-', cast(o_custkey as varchar(20))))"

    def pair(key: str, value: str) -> str:
        return f"concat('\"{key}\":\"', {value}, '\"')"

    version, mapping, digest = (pair("dataset_version_id", _OWN), pair("mapping_version_id", _MAPPING),
                                pair("schema_fingerprint", schema))

    def whole(*parts: str) -> str:
        return "concat('{', " + ", ',', ".join(parts) + ", '}')"

    return f"""case {kind} when 0 then {whole(pair("dataset_version_id", _MAPPING), mapping, digest)}
 when 1 then {whole(version, digest)} when 2 then {whole(version, mapping, digest, pair("more", "'x'"))}
 when 3 then {whole(version, mapping, pair("schema_fingerprint", f"upper({schema})"))}
 when 4 then {whole(version, pair("mapping_version_id", "concat('mapping-', cast(o_orderkey as varchar(20)))"), digest)}
 when 5 then {whole(version, "concat('\"mapping_version_id\":', cast(o_orderkey as varchar(20)))", digest)}
 when 6 then '[]' else {whole(version, mapping, digest)} end"""


_JOB_TYPE = "case when o_orderkey%5=0 then 'dataset.scan' else 'dataset.validate' end"
_HEX = "'^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$'"


@query("f17_job_references", f"""with j as (select o_orderkey job_id, {_OWN} version, {_JOB_TYPE} job_type,
  {_reference_sql()} r from orders)
 select job_id, cast(coalesce(job_type='dataset.validate' and json_type(r)='OBJECT'
  and list_sort(json_keys(r))=['dataset_version_id','mapping_version_id','schema_fingerprint']
  and json_type(r,'$.dataset_version_id')='VARCHAR' and json_type(r,'$.mapping_version_id')='VARCHAR'
  and json_type(r,'$.schema_fingerprint')='VARCHAR' and r->>'$.dataset_version_id'=version
  and regexp_full_match(r->>'$.schema_fingerprint','[0-9a-f]{{64}}')
  and regexp_matches(r->>'$.dataset_version_id', {_HEX}) and regexp_matches(r->>'$.mapping_version_id', {_HEX}), false) as int)
  reference_ok from j""")
def f17_job_references(spark, sf_dir):
    from folioguard.sources.portfolio import table

    sha = _reference_sql().replace("sha256(", "sha2_256(").replace("sha2_256(concat('schema-', cast(o_custkey as varchar(20))))",
                                                               "sha2(concat('schema-', cast(o_custkey as varchar(20))), 256)")
    jobs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.expr(_OWN).alias("dataset_version_id"), F.expr(_JOB_TYPE).alias("job_type"),
        F.expr(sha).alias("input_reference"))
    return L.check_references(jobs).select("job_id", F.col("reference_ok").cast("int").alias("reference_ok"))


_CLAIMED = ("concat('quarantine/org-', cast(o_custkey%7 as varchar(20)), '/ws-', cast(o_custkey%3 as varchar(20)), '/ds/version-', "
            "cast(o_orderkey%4 as varchar(20)), '/original.csv')")


@query("f14_claimed_keys", f"""select o_orderkey, cast(o_custkey%7=o_custkey%5 and o_custkey%3=0 and o_orderkey%4=2 as int)
 key_matches from orders""")
def f14_claimed_keys(spark, sf_dir):
    """Keys against the organisation, workspace and version of the job that claims them."""
    from folioguard.sources.portfolio import table

    jobs = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.expr("concat('org-', cast(o_custkey%5 as varchar(20)))").alias("organization_id"),
        F.lit("ws-0").alias("workspace_id"), F.lit("version-2").alias("dataset_version_id"), F.expr(_CLAIMED).alias("object_key"))
    return L.match_claimed_keys(jobs).select("o_orderkey", F.col("key_matches").cast("int").alias("key_matches"))


_PATHS = ("case o_orderkey%4 when 0 then concat('quarantine/org-', cast(o_custkey as varchar(20)), '/ws/data set/v/"
          "original.csv') when 1 then concat('quarantine/org-', cast(o_custkey as varchar(20)), '/ws') else "
          "concat('quarantine/org-', cast(o_custkey as varchar(20)), '/ws-1/ds-1/version-', cast(o_orderkey as "
          "varchar(20)), '/original.csv') end")


@query("f14_object_keys", f"""select o_orderkey, cast(o_orderkey%4>1 as int) key_ok, case when o_orderkey%4>1 then
 concat('originals/org-', cast(o_custkey as varchar), '/ws-1/ds-1/version-', cast(o_orderkey as varchar),
 '/original.csv') end destination_key from orders""")
def f14_object_keys(spark, sf_dir):
    from folioguard.sources.portfolio import table

    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_PATHS).alias("object_key"))
    return L.parse_object_keys(rows).select("o_orderkey", F.col("key_ok").cast("int").alias("key_ok"),
                                            "destination_key")


# --- audit chain ---
_STAMP = "rtrim(rtrim(strftime(occurred_at,'%Y-%m-%dT%H:%M:%S.%f'),'0'),'.')"
_HEAD = "concat('{', " + ", ', ', ".join(
    f"'\"{n}\": ', " + (
        "cast(audit_sequence as varchar)" if n == "audit_sequence"
        else f"'\"', {_STAMP}, '+00:00\"'" if n == "occurred_at"
        else f"'\"', replace({n}, '\"', '\\\"'), '\"'")
    for n in U.TEXT_KEYS) + ", ', \"previous_event_hash\": \"')"
CHAIN = f"""with recursive p as ({derived_sql('audit_payloads')}),
 h as (select organization_id, workspace_id, audit_sequence, {_HEAD} head, row_number() over (partition by
  organization_id, workspace_id order by audit_sequence) rn from p),
 chain as (select organization_id, workspace_id, audit_sequence, rn, '{U.GENESIS}' previous_event_hash,
   sha256(concat(head, '{U.GENESIS}', '"}}')) event_hash from h where rn=1
  union all select h.organization_id, h.workspace_id, h.audit_sequence, h.rn, c.event_hash,
   sha256(concat(h.head, c.event_hash, '"}}')) from chain c join h on h.organization_id=c.organization_id and
   h.workspace_id=c.workspace_id and h.rn=c.rn+1)"""


@query("w7_audit_chain",
       f"{CHAIN} select organization_id, workspace_id, audit_sequence, previous_event_hash, event_hash from chain")
def w7_audit_chain(spark, sf_dir):
    return U.build_chain(derive(spark, sf_dir, "audit_payloads")).select(
        "organization_id", "workspace_id", "audit_sequence", "previous_event_hash", "event_hash")


@query("w7_audit_chain_check", with_tables(
    "select organization_id, workspace_id, count(*) events, count(*) filter (where audit_sequence%500=3) "
    "suspect_events from audit_payloads group by 1,2", "audit_payloads"))
def w7_audit_chain_check(spark, sf_dir):
    chained = U.build_chain(derive(spark, sf_dir, "audit_payloads"))
    altered = F.when(F.col("audit_sequence") % 500 == 3, "someone else").otherwise(F.col("actor_id"))
    return U.chain_summary(U.check_chain(chained.withColumn("actor_id", altered)))




# Stored chains with damage: a changed payload, a lost previous hash, a lost own hash.
_DAMAGE = {"actor_id": (11, "'someone else'"), "previous_event_hash": (7, "cast(null as varchar(64))"),
           "event_hash": (9, "cast(null as varchar(64))")}
_DAMAGED_SQL = f"""{CHAIN}, stored as (select c.organization_id, c.workspace_id, c.audit_sequence, h.head,
  case when c.audit_sequence%200=7 then null else c.previous_event_hash end previous_event_hash,
  case when c.audit_sequence%200=9 then null else c.event_hash end event_hash, c.audit_sequence%200=11 changed
  from chain c join h using (organization_id, workspace_id, audit_sequence)),
 claims as (select organization_id, workspace_id, previous_event_hash, count(*) n from stored group by 1,2,3),
 owners as (select organization_id, workspace_id, event_hash, min(audit_sequence) owner from stored
  where event_hash is not null group by 1,2,3),
 judged as (select s.*, o.owner, coalesce(s.previous_event_hash = '{U.GENESIS}', false) genesis,
   coalesce(changed or sha256(concat(head, s.previous_event_hash, '"}}')) <> s.event_hash
    or s.event_hash is null or s.previous_event_hash is null, true) altered, coalesce(c.n, 1) > 1 forked,
   coalesce(o.owner >= s.audit_sequence, false) out_of_order
  from stored s left join owners o on o.organization_id=s.organization_id and o.workspace_id=s.workspace_id
   and o.event_hash=s.previous_event_hash
  left join claims c on c.organization_id=s.organization_id and c.workspace_id=s.workspace_id
   and c.previous_event_hash=s.previous_event_hash),
 walked as (select organization_id, workspace_id, audit_sequence, cast(1 as bigint) place, genesis reaches_genesis,
   case when altered or forked or out_of_order then audit_sequence end first_broken from judged
   where genesis or owner is null
  union all select j.organization_id, j.workspace_id, j.audit_sequence, w.place+1, w.reaches_genesis,
   coalesce(w.first_broken, case when altered or forked or out_of_order then j.audit_sequence end)
   from walked w join judged j on j.organization_id=w.organization_id and j.workspace_id=w.workspace_id
   and j.owner=w.audit_sequence and not j.genesis)"""


def _damaged(spark, sf_dir):
    chained = U.build_chain(derive(spark, sf_dir, "audit_payloads"))
    place = F.col("audit_sequence") % 200
    return chained.withColumns({
        name: F.when(place == at, F.expr(value)).otherwise(F.col(name)) for name, (at, value) in _DAMAGE.items()})


@query("w7_broken_links", f"""{_DAMAGED_SQL} select w.*, concat_ws(',', case when altered then 'altered' end,
  case when not genesis and owner is null then 'unlinked' end, case when out_of_order then 'out_of_order' end,
  case when forked then 'forked' end, case when not reaches_genesis then 'unreachable' end,
  case when first_broken <> w.audit_sequence then 'broken_ancestor' end) findings
 from walked w join judged j using (organization_id, workspace_id, audit_sequence)""")
def w7_broken_links(spark, sf_dir):
    """Every event of damaged chains with its place and all findings, successors of a lost hash included."""
    return U.place_events(_damaged(spark, sf_dir), [*U.WORKSPACE, "audit_sequence"]).select(
        "organization_id", "workspace_id", "audit_sequence", "place", "reaches_genesis", "first_broken",
        F.array_join("findings", ",").alias("findings"))


@query("w7_intact_prefixes", f"""{_DAMAGED_SQL} select organization_id, workspace_id, count(*) events,
 coalesce(max(place) filter (where reaches_genesis and first_broken is null), 0) intact_events,
 min(first_broken) first_broken, count(*) filter (where not reaches_genesis) unreachable_events from walked group by 1, 2""")
def w7_intact_prefixes(spark, sf_dir):
    return U.intact_prefixes(U.place_events(_damaged(spark, sf_dir), [*U.WORKSPACE, "audit_sequence"]))
