"""Questions, models, admission, pseudonyms."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioguard.fixed_values import ANSWERS, MODEL_CATEGORICAL, MODEL_INPUTS, MODEL_NUMERIC, RULESET_VERSION
from folioguard.functions.hashing import key_pads, subject_digest
from folioguard.operators import metrics as M
from folioguard.operators import modeling as Y
from folioguard.operators import questions as Q
from folioguard.operators import rules as R
from folioguard.operators.model_tables import model_tables, score_by_tables, stored_bundle
from folioguard.operators.profile import fingerprint
from folioguard.plans.quality import _PLAIN, METRIC_CTES
from folioguard.plans.registry import query
from folioguard.plans.sql import ANOMALY_CTES, on_portfolio, with_ctes
from folioguard.sources.portfolio import portfolio, table
from folioguard.streaming import admission as X

# --- questions: every user turn, whole text, with an opening that carries an intent ---
_OPENING = """case conv_id%9 when 0 then 'What is the BIGGEST risk? ' when 1 then 'What should I do next? '
 when 2 then 'Why was this flagged? ' when 3 then 'How much money moved? ' when 4 then 'Any missing data? '
 when 5 then 'How good is the model? ' when 6 then 'Which segment is largest? ' else '' end"""
_QUESTION = f"case when conv_id%9=8 and turn%2=0 then ' ?! ' else concat({_OPENING}, text) end"
_TEXT = "trim(regexp_replace(lower(question),'[^a-z0-9 ]+',' ','g'))"


def _any(*keywords: str) -> str:
    return " or ".join(f"contains(t,'{k}')" for k in keywords)


_INTENT = f"""case when t='' then 'empty' when {_any('biggest risk', 'main risk', 'highest risk')} then 'biggest_risk'
 when {_any('what should', 'recommend', 'next action', 'do next')} then 'next_action'
 when {_any('why', 'flagged', 'suspicious')} then 'why_flagged'
 when {_any('revenue', 'money', 'transaction value', 'sales')} then 'transaction_value'
 when {_any('quality', 'missing', 'duplicate', 'clean')} then 'data_quality'
 when {_any('model', 'accuracy', 'precision', 'recall', 'f1', 'auc')} then 'model'
 when {_any('customers', 'segments', 'segment')} then 'segment' else 'fallback' end"""
_QUESTIONS = {
    "asked": f"select conv_id, turn, {_QUESTION} question from conversations where role='user'",
    "told": f"select *, {_INTENT} intent from (select *, {_TEXT} t from asked)",
}


def user_questions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select(
        "conv_id", "turn", F.expr(_QUESTION).alias("question"))


@query("q1_question_intents",
       f"with asked as ({_QUESTIONS['asked']}), told as ({_QUESTIONS['told']}) select conv_id, turn, intent from told")
def q1_question_intents(spark, sf_dir):
    return user_questions(spark, sf_dir).select("conv_id", "turn", Q.intent(F.col("question")).alias("intent"))


_CAVEAT = (
    "concat(' Coverage caveat: ', " + "format('{:,}', ne)" + ", ' record-rule evaluations were not evaluated because "
    "required evidence was missing or invalid.')")
_ANSWER = f"""case intent
 when 'empty' then 'Ask about risk, suspicious records, transaction value, data quality, model performance, or next actions.'
 when 'biggest_risk' then concat('The biggest risk is ', lower(cat), ', with ', format('{{:,}}', cn),
  ' records requiring review.', {_CAVEAT})
 when 'next_action' then 'Review high-priority rule records first, verify duplicate or abnormal evidence, and send loan-to-income pressure cases to an authorized reviewer.'
 when 'why_flagged' then concat(tx, ' was flagged because ', lower(notes), '.', {_CAVEAT})
 when 'transaction_value' then concat('Total transaction value is NGN ', format('{{:,}}', total),
  ', with an average of NGN ', format('{{:,}}', average),
  '. This is transaction value, not recognized revenue. Definition: portfolio.transaction-value/1.0.0; source: ',
  (select dataset_reference from reference), '.')
 when 'data_quality' then concat('The composite data quality score is ', format('{{:.1f}}', composite), '% (warn). I found ',
  format('{{:,}}', missing_cells), ' missing values and ', format('{{:,}}', duplicate_rows),
  ' duplicate rows. Review the six quality dimensions because a composite score never overrides a blocking issue.')
 when 'model' then '{ANSWERS["model_none"]}'
 when 'segment' then concat('The largest customer segment is ', seg, ', and total unique customers are ',
  format('{{:,}}', cu), '.')
 else 'Review the governed metric definitions, resolve dataset issues, inspect versioned rule evidence, and use the accessible report for a traceable summary.' end"""
_FACT_ROW = """select (select suspicious_category from anomalies where is_suspicious group by 1 order by count(*) desc, 1
  limit 1) cat, (select count(*) from anomalies where is_suspicious group by suspicious_category
  order by 1 desc, suspicious_category limit 1) cn,
 (select cast(sum(rules_not_evaluated_count) as bigint) from anomalies) ne,
 (select coalesce(transaction_id,'None') from anomalies where is_suspicious order by anomaly_score desc, o_orderkey
  limit 1) tx,
 (select anomaly_notes from anomalies where is_suspicious order by anomaly_score desc, o_orderkey limit 1) notes,
 (select cast(round_even(sum(transaction_amount),0) as bigint) from portfolio) total,
 (select cast(round_even(avg(transaction_amount),0) as bigint) from portfolio) average,
 (select coalesce(segment,'Unknown') from portfolio group by 1 order by count(*) desc, 1 limit 1) seg,
 (select cu from facts) cu, composite, missing_cells, duplicate_rows from score"""


def _answer_facts(spark, sf_dir):
    rows = portfolio(spark, sf_dir, keep_key=True)
    plain = rows.drop("o_orderkey")
    anomalies = R.detect_anomalies(rows)
    reference = fingerprint(plain.select(*_PLAIN)).first()["dataset_reference"]
    metrics = M.metric_table(plain, anomalies, RULESET_VERSION, reference=reference)
    return Q.facts(plain, anomalies, metrics, ["o_orderkey"], reference)


@query("q2_answers", with_ctes(
    ANOMALY_CTES, f"select conv_id, turn, intent, {_ANSWER} answer from told, one", **METRIC_CTES, **_QUESTIONS,
    one=_FACT_ROW))
def q2_answers(spark, sf_dir):
    """Answers without a model run, each with the reference of the dataset it is about."""
    told = Q.answers(user_questions(spark, sf_dir), "question", _answer_facts(spark, sf_dir))
    return told.select("conv_id", "turn", "intent", "answer")


@query("q2_model_answers")
def q2_model_answers(spark, sf_dir):
    """Answers about the model, from the holdout measures of the stored run."""
    measures = stored_bundle(portfolio(spark, sf_dir))[0].metrics.first().asDict()
    told = Q.answers(user_questions(spark, sf_dir), "question", _answer_facts(spark, sf_dir), measures)
    return told.where("intent = 'model'").select("conv_id", "turn", "answer")


# --- models ---
@query("a36_class_counts", on_portfolio(
    "select count(*) total_rows, count(defaulted) eligible_rows, count(*) filter (where defaulted=0) class_0, "
    "count(*) filter (where defaulted=1) class_1 from portfolio"))
def a36_class_counts(spark, sf_dir):
    counts, _, _ = Y.eligibility_counts(portfolio(spark, sf_dir))
    return counts.select("total_rows", "eligible_rows", "class_0", "class_1")


def _profile_sql() -> str:
    lines = []
    for i, n in enumerate(MODEL_INPUTS, 1):
        kind = "numeric" if n in MODEL_NUMERIC else "categorical"
        lines.append(
            f"select {i} as position, '{n}' \"column\", '{kind}' kind, count({n}) valid_count, count(*)-count({n}) "
            f"missing_count, cast(0 as bigint) invalid_count, count(distinct {n}) unique_count from portfolio")
    return " union all ".join(lines)


@query("a37_feature_profiles", on_portfolio(_profile_sql()))
def a37_feature_profiles(spark, sf_dir):
    counts, _, _ = Y.eligibility_counts(portfolio(spark, sf_dir))
    return Y.feature_profiles(counts)


@query("m1_a38_eligibility_issues", on_portfolio(
    """select * from (
 select 1 ordinal, 'unmapped_target_values' code, 'warn' severity,
  'Some outcome values are missing or outside the approved target mapping.' message, 'defaulted' "column",
  count(*) filter (where o_orderkey%6=0) "count" from portfolio
 union all select 2, 'excessive_feature_missingness', 'block', concat('income has ',
  format('{:.1f}', l/n*100), '% missing or invalid eligible values.'), 'income', l from (select
  count(*) filter (where income is null or o_orderkey%6 in (1,2,3)) l, count(*) n from portfolio where o_orderkey%6<>0)
 union all select 3, 'excessive_category_cardinality', 'block', concat('segment has ', format('{:,}', u),
  ' categories, above the prototype safety limit.'), 'segment', u from (select count(distinct customer_id) u
  from portfolio where o_orderkey%6<>0))"""))
def m1_a38_eligibility_issues(spark, sf_dir):
    rows = portfolio(spark, sf_dir, keep_key=True)
    key = F.col("o_orderkey") % 6
    poor = rows.withColumns({
        "defaulted": F.when(key == 0, "unknown").otherwise(F.col("defaulted").cast("string")),
        "income": F.when(key.isin(1, 2, 3), None).otherwise(F.col("income")),
        "segment": F.col("customer_id"),
    }).drop("o_orderkey")
    counts, column, definition = Y.eligibility_counts(poor)
    return Y.eligibility_issues(counts, definition, column).drop("recovery")


_PERCENT = "cast(concat('0x', left(sha256(concat('42|', {key})),8)) as bigint)%100"
_BAND = "case when {p}<60 then 'train' when {p}<80 then 'validation' else 'holdout' end"
_GROUP_SPLIT = _BAND.replace("{p}", _PERCENT.replace("{key}", "trim(customer_id)"))
_FRAME = {"frame": f"select *, cast(defaulted as double) label, {_GROUP_SPLIT} split from portfolio"}


@query("m2_group_split", on_portfolio("select o_orderkey, split from frame", **_FRAME))
def m2_group_split(spark, sf_dir):
    return Y.split_rows(portfolio(spark, sf_dir, keep_key=True))[0].select("o_orderkey", "split")


@query("m3_stratified_split", on_portfolio(
    "select o_orderkey, " + _BAND.replace("{p}", _PERCENT.replace(
        "{key}", "sha256(concat('{\"o_orderkey\":', o_orderkey, ',\"label\":', defaulted, '}'))")) + " split from "
    "portfolio"))
def m3_stratified_split(spark, sf_dir):
    rows = portfolio(spark, sf_dir, keep_key=True).select("o_orderkey", F.col("defaulted").alias("label"))
    return Y.split_rows(rows, by_group=False)[0].select("o_orderkey", "split")


@query("m4_split_classes", on_portfolio(
    "select split, count(*) as rows, count(*) filter (where label=0) class_0, count(*) filter (where label=1) class_1, "
    "cast(count(distinct label)=2 as int) both_classes from frame group by 1", **_FRAME))
def m4_split_classes(spark, sf_dir):
    rows = Y.split_rows(portfolio(spark, sf_dir))[0].withColumn("label", F.col("defaulted").cast("double"))
    return Y.split_classes(rows).withColumn("both_classes", F.col("both_classes").cast("int"))


@query("a40_u3_group_overlap", on_portfolio(
    "select count(*) group_overlap_count from (select customer_id from frame group by 1 having count(distinct split)>1)",
    **_FRAME))
def a40_u3_group_overlap(spark, sf_dir):
    return Y.split_overlap(Y.split_rows(portfolio(spark, sf_dir))[0])


def _frame(spark, sf_dir):
    rows = portfolio(spark, sf_dir)
    return Y.split_rows(Y.model_frame(rows, Y.resolve_target(rows)[0]))[0]


_NUMBERS = " union all ".join(
    f"select '{n}' feature, quantile_cont({n},0.5) m, avg(coalesce({n}, (select quantile_cont({n},0.5) from tr))) a, "
    f"stddev_pop(coalesce({n}, (select quantile_cont({n},0.5) from tr))) d from tr" for n in MODEL_NUMERIC)


@query("m5_imputation_and_scaling", on_portfolio(
    f"select feature, m median, round(a,6) mean, round(d,6) deviation from ({_NUMBERS})", **_FRAME,
    tr="select * from frame where split='train'"))
def m5_imputation_and_scaling(spark, sf_dir):
    train = _frame(spark, sf_dir).where("split = 'train'")
    learned = Y.learn_preparation(train)
    lines = [(n, learned.medians[n], learned.means[n], learned.deviations[n]) for n in MODEL_NUMERIC]
    out = spark.createDataFrame(lines, "feature string, median double, mean double, deviation double")
    return out.withColumns({"mean": F.round("mean", 6), "deviation": F.round("deviation", 6)})


@query("m6_category_modes", on_portfolio(" union all ".join(
    f"(select '{n}' feature, {n} mode from frame where split='train' and {n} is not null group by {n} "
    f"order by count(*) desc, {n} limit 1)" for n in MODEL_CATEGORICAL), **_FRAME))
def m6_category_modes(spark, sf_dir):
    train = _frame(spark, sf_dir).where("split = 'train'")
    learned = Y.learn_preparation(train)
    return spark.createDataFrame(list(learned.modes.items()), "feature string, mode string")


_SCORED = {
    "s": "select cast(defaulted as double) y, (coalesce(repayment_history_score,50)+1)/103.0 score, case when "
         "(coalesce(repayment_history_score,50)+1)/103.0>=0.5 then 1.0 else 0.0 end p from portfolio",
    "g": "select score, count(*) c, sum(y) pos from s group by 1",
    "t": "select *, sum(c) over (order by score) - c below, sum(pos) over (order by score) - pos pos_below, "
         "sum(c) over () n, sum(pos) over () np from g",
    "area": "select sum(pos*((below-pos_below)+(c-pos)/2))/max(np*(n-np)) roc_auc, "
            "sum(pos/np*(np-pos_below)/(n-below)) pr_auc from t",
}


def _fixed_scores(spark, sf_dir):
    """A score that is a plain function of the row, so that the measures can be checked; a row without a history counts
    as one in the middle."""
    rows = portfolio(spark, sf_dir)
    score = (F.coalesce("repayment_history_score", F.lit(50.0)) + 1) / 103.0
    return rows.select(
        F.col("defaulted").cast("double").alias("label"), score.alias("score"),
        F.when(score >= 0.5, 1.0).otherwise(0.0).alias("prediction"))


@query("m8_score_measures", on_portfolio(
    """select round(avg(cast(y=p as int)),4) accuracy, round(tp/(tp+fp),4) as precision, round(tp/(tp+fn),4) recall,
 round(2*tp/(2*tp+fp+fn),4) f1_score, round(max(roc_auc),4) roc_auc, round(max(pr_auc),4) pr_auc,
 round(avg((score-y)*(score-y)),4) brier_score,
 round(avg(-case when y=1 then ln(score) else ln(1-score) end),4) log_loss
 from s, area, (select sum(y*p) tp, sum((1-y)*p) fp, sum(y*(1-p)) fn from s) k group by tp, fp, fn""", **_SCORED))
def m8_score_measures(spark, sf_dir):
    scored = _fixed_scores(spark, sf_dir)
    return Y.score_measures(scored)


@query("m10_confusion_matrix", on_portfolio(
    "select label, prediction, (select count(*) from s where y=label and p=prediction) records from "
    "(values (0,0),(0,1),(1,0),(1,1)) v(label, prediction)", **_SCORED))
def m10_confusion_matrix(spark, sf_dir):
    return Y.confusion_matrix(_fixed_scores(spark, sf_dir))


def _trained(spark, sf_dir):
    """The run of exactly these rows, stored under their content reference; trained if there is none."""
    return stored_bundle(portfolio(spark, sf_dir))[0]


@query("t5_m7_m9_leaderboard")
def t5_m7_m9_leaderboard(spark, sf_dir):
    return _trained(spark, sf_dir).leaderboard


@query("m9_u5_holdout_measures")
def m9_u5_holdout_measures(spark, sf_dir):
    return _trained(spark, sf_dir).metrics


@query("m11_run_provenance")
def m11_run_provenance(spark, sf_dir):
    return _trained(spark, sf_dir).provenance.drop("generated_at")


_COMPLETE = " and ".join(f"{n} is not null" for n in MODEL_INPUTS)


@query("m7_scores_by_tables", on_portfolio(
    f"select distinct o_orderkey, cast(1 as int) as_fitted from portfolio where {_COMPLETE}"))
def m7_scores_by_tables(spark, sf_dir):
    """Complete records scored from the stored tables by joins; whether the fitted pipeline gives the same percentage."""
    one = portfolio(spark, sf_dir, keep_key=True).where(_COMPLETE).dropDuplicates(["o_orderkey"])
    bundle, path = stored_bundle(portfolio(spark, sf_dir))
    scored = score_by_tables(one, "o_orderkey", model_tables(spark, path))
    fitted = Y.score_records(bundle, one).select("o_orderkey", "model_score_percent")
    off = F.abs(F.col("score") * 100 - F.col("model_score_percent"))
    return scored.join(fitted, "o_orderkey").select("o_orderkey", (off <= 0.0501).cast("int").alias("as_fitted"))


_LACKING = ", ".join(f"case when {n} is null then '{n}' end" for n in MODEL_INPUTS)


@query("m12_batch_scoring_guard", on_portfolio(
    f"select o_orderkey, case when len(x)>0 then 'blocked' else 'scored' end status, array_to_string(x,', ') "
    "missing_inputs, cast(len(x)=0 as int) has_score, 'Manual review required' routing from (select o_orderkey, "
    f"list_filter([{_LACKING}], lambda v: v is not null) x from portfolio)"))
def m12_batch_scoring_guard(spark, sf_dir):
    rows = portfolio(spark, sf_dir, keep_key=True)
    return Y.score_records(_trained(spark, sf_dir), rows).select(
        "o_orderkey", "status", "missing_inputs", F.col("model_score_percent").isNotNull().cast("int").alias(
            "has_score"), "routing")


@query("p12_eligible_rows", on_portfolio(
    "select o_orderkey from portfolio where o_orderkey%6<>0"))
def p12_eligible_rows(spark, sf_dir):
    rows = portfolio(spark, sf_dir, keep_key=True)
    rows = rows.withColumn(
        "defaulted", F.when(F.col("o_orderkey") % 6 == 0, 3).otherwise(F.col("defaulted")))
    target = Y.resolve_target(rows)[0]
    return rows.where(target.isNotNull()).select("o_orderkey")


@query("p11_binary_outcomes", on_portfolio(
    "select o_orderkey, cast(o_orderkey%4<2 as int) is_binary from portfolio"))
def p11_binary_outcomes(spark, sf_dir):
    rows = portfolio(spark, sf_dir, keep_key=True).withColumn(
        "defaulted", F.expr("case o_orderkey%4 when 0 then '0' when 1 then ' 1.0 ' when 2 then 'x' else '2' end"))
    return rows.select("o_orderkey", Y.binary_outcome(rows).isNotNull().cast("int").alias("is_binary"))


# --- admission over the event stream ---
LIMIT, WINDOW = 3, 6 * 3600
_REQUEST = "concat('r-', cast(event_id%5 as varchar(20)))"
_KIND = "case when event_type='signup' then 'reset' else 'consume' end"


def admission_requests(events):
    """Events as requests of one scope: subject is the user, a few request ids repeat, sign-ups reset."""
    return events.select(
        F.lit("assistant_query_actor").alias("scope"), F.col("user_id").cast("string").alias("subject"),
        F.expr(_REQUEST).alias("request_id"), X.micros("ts").alias("at_micros"),
        F.expr(_KIND).alias("kind"), F.col("ts").cast("timestamp").alias("ts"))


def policies(spark):
    return X.policy_dimension(spark, {"assistant_query_actor": (LIMIT, WINDOW)})


_KEPT = f"list_filter(c.st, lambda e: e.t > h.t - {WINDOW * 1_000_000})"
_ADMISSION = f"""with recursive h as (select cast(user_id as varchar) subject, {_REQUEST} m, epoch_us(ts) t, {_KIND} kind,
 row_number() over (partition by user_id order by ts, {_REQUEST}) rn from events),
 z as (select subject, 0 rn, cast([] as struct(t bigint, m varchar)[]) st, cast(null as varchar) m,
  cast(null as bigint) t, cast(null as varchar) kind, cast(null as varchar) outcome, 0 remaining,
  cast(0 as bigint) wait from h where rn=1),
 w as (select * from z union all
  select subject, rn, case outcome when 'reset' then cast([] as struct(t bigint, m varchar)[])
   when 'admitted' then list_append(kept, {{'t': t, 'm': m}}) else kept end, m, t, kind, outcome,
   cast(case outcome when 'reset' then {LIMIT} when 'replayed' then {LIMIT}-len(kept)
    when 'admitted' then {LIMIT}-len(kept)-1 else 0 end as int),
   case outcome when 'denied' then greatest(1, cast(ceil((kept[1].t+{WINDOW * 1_000_000}-t)/1000000) as bigint)) else 0 end
  from (select h.subject, h.rn, h.m, h.t, h.kind, {_KEPT} kept, case when h.kind='reset' then 'reset'
   when list_contains(list_transform({_KEPT}, lambda e: e.m), h.m) then 'replayed'
   when len({_KEPT})<{LIMIT} then 'admitted' else 'denied' end outcome
   from w c join h on h.subject=c.subject and h.rn=c.rn+1))
 select subject, m request_id, t at_micros, kind, outcome, remaining, wait retry_after_seconds from w where rn>0"""


@query("x1_x3_admission", _ADMISSION)
def x1_x3_admission(spark, sf_dir):
    requests = admission_requests(table(spark, sf_dir, "events")).drop("ts")
    return X.admit(X.with_policy(requests, policies(spark))).drop("scope")


def admission_tick(events):
    """A request that is not decided but moves the watermark past all events."""
    return events.agg(F.max("ts").alias("last")).select(
        F.lit("").alias("scope"), F.lit("").alias("subject"), F.lit("").alias("request_id"),
        F.lit(0).cast("bigint").alias("at_micros"), F.lit(X.TICK).alias("kind"),
        (F.coalesce("last", F.lit("2000-01-01").cast("timestamp")).cast("timestamp") + F.expr("interval 9999 days")).alias("ts"))


STATE_PARTITIONS = 12


def _stream(spark, sf_dir, folders: int, late_by: str):
    """Decisions over events dealt out to ``folders`` micro-batches by id, so that each has events of the whole time."""
    from folioguard.session import staging_path

    session = X.with_state_store(spark, STATE_PARTITIONS)
    events = table(spark, sf_dir, "events")
    source, last = staging_path(spark, "requests"), staging_path(spark, "tick")
    for i in range(folders):
        admission_requests(events.where(F.pmod("event_id", F.lit(folders)) == i)).coalesce(1).write.parquet(f"{source}/p{i}")
    admission_tick(events).coalesce(1).write.parquet(f"{source}/p{folders}")
    requests = session.readStream.schema(X.REQUEST).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", True).parquet(source)
    decisions = X.admit_stream(X.with_policy(requests, policies(session)), late_by)
    out, checkpoint = staging_path(spark, "decisions"), staging_path(spark, "admission")
    job = decisions.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(X.DECISION).parquet(out).drop("scope")


@query("x1_admission_stream", _ADMISSION)
def x1_admission_stream(spark, sf_dir):
    """Two files out of order, nothing late: decided as the batch job does."""
    return _stream(spark, sf_dir, 2, "9000 days")


# The first file moves the watermark to its last event less an hour; what is older in the second comes late.
_LATE = f"""with edge as (select max(epoch_ms(ts)) - 3600000 as w from events where event_id%2=0),
 kept as (select * from events where event_id%2=0 or epoch_us(ts) > (select w*1000 from edge)),
 late as (select cast(user_id as varchar) subject, {_REQUEST} request_id, epoch_us(ts) at_micros, {_KIND} kind, 'late' outcome,
  0 remaining, cast(0 as bigint) retry_after_seconds from events
  where event_id%2=1 and epoch_us(ts) <= (select w*1000 from edge)),
 decided as ({_ADMISSION.replace("from events)", "from kept)")})
 select * from decided union all select * from late"""


@query("x1_late_requests", _LATE)
def x1_late_requests(spark, sf_dir):
    """The same two files with an hour allowed: every request has a row."""
    return _stream(spark, sf_dir, 2, "1 hour")


_SCOPES = tuple(X.ADMISSION_POLICIES)
_SCOPE_SQL = "case event_id%7 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(_SCOPES)) + " end"


@query("x4_policy_per_request", f"select event_id, scope, max_requests, window_seconds from (select event_id, "
       f"{_SCOPE_SQL} scope from events) join (values " + ", ".join(
           f"('{s}', {n}, cast({w} as bigint))" for s, (n, w) in X.ADMISSION_POLICIES.items())
       + ") t(scope, max_requests, window_seconds) using (scope)")
def x4_policy_per_request(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_SCOPE_SQL).alias("scope"))
    return X.with_policy(rows, X.policy_dimension(spark))


@query("x6_append_once", "select event_id, event_type from events")
def x6_append_once(spark, sf_dir):
    from folioguard.session import staging_path
    from folioguard.streaming.landing import append_once

    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    out = staging_path(spark, "events")
    # The first delivery is partial, the second brings everything again.
    append_once(events.where("event_type <> 'click'"), out, ["event_id"])
    return append_once(events, out, ["event_id"])


_KEY = b"a fixed demonstration key, 32 bytes or more"
_INNER, _OUTER = (pad.hex() for pad in key_pads(_KEY))


@query("f13_subject_pseudonyms",
       f"select event_id, sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(concat('subject', "
       "chr(10), event_type, chr(10), cast(user_id as varchar)))))) pseudonym from events")
def f13_subject_pseudonyms(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("u"))
    return rows.select("event_id", subject_digest(_KEY, F.col("event_type"), F.col("u")).alias("pseudonym"))


@query("x5_landed_files", "select cast(o_orderkey as varchar) order_key, o_orderstatus status, cast(o_custkey as "
                          "varchar) customer from orders")
def x5_landed_files(spark, sf_dir):
    from folioguard.session import staging_path
    from folioguard.streaming.landing import header_folder, land

    landing, out = staging_path(spark, "landing"), staging_path(spark, "landed")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("Order Key"), F.col("o_orderstatus").alias("Status"),
        F.col("o_custkey").alias("Customer"))
    rows.write.options(header=True, maxRecordsPerFile=50_000).csv(landing)
    # Run twice on one checkpoint: the second run finds nothing new.
    for _ in range(2):
        land(spark, landing, out, f"{out}/checkpoint").awaitTermination()
    folder = header_folder(["order_key", "status", "customer"])
    return spark.read.parquet(f"{out}/normalized/{folder}").select("order_key", "status", "customer")
