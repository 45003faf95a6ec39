import numpy as np
import pytest
from pyspark.sql import functions as F

from folioguard.fixed_values import MODEL_INPUTS
from folioguard.operators import modeling as Y
from folioguard.operators import questions as Q
from folioguard.sources import synthetic as G

POLICY = Y.EligibilityPolicy(min_rows=2, min_class_rows=1)


@pytest.fixture(scope="module")
def demo(spark):
    df = G.generate(spark, 1200, seed=17).persist()
    yield df
    df.unpersist()


def target_frame(spark, column, values):
    base = [(float(i), float(i), 50.0, 1.0, 3, 4, "Salaried", "Retail", "Shop", "Lagos", v) for i, v in enumerate(
        values)]
    names = list(MODEL_INPUTS) + [column]
    return spark.createDataFrame(base, ", ".join(
        f"{n} {'string' if n in Y.MODEL_CATEGORICAL or n == column else 'double'}" for n in names[:4]) + ", "
        "transaction_frequency long, account_age_months long, employment_status string, segment string, "
        f"business_type string, region string, {column} string")


@pytest.mark.parametrize("column, values, classes", [
    ("defaulted", ("0", "0", "unknown", None), (2, 0)),
    ("repayment_status", ("Repaid", " Defaulted ", "late", "mystery"), (1, 1)),
])
def test_only_known_outcomes_count(spark, column, values, classes):
    counts, found, definition = Y.eligibility_counts(target_frame(spark, column, values))
    one = counts.first()
    assert (one["class_0"], one["class_1"], found) == (*classes, column)
    issues = {r["code"]: r["count"] for r in Y.eligibility_issues(counts, definition, found, POLICY).collect()}
    assert issues["unmapped_target_values"] == 2
    assert ("single_target_class" in issues) == (column == "defaulted")


def test_status_serves_when_defaulted_has_no_valid_value(spark):
    df = target_frame(spark, "defaulted", ("x", "y")).withColumn("repayment_status", F.lit("paid"))
    assert Y.resolve_target(df)[1:] == ("repayment_status", "repayment_status.binary/1.0.0")
    counts, column, definition = Y.eligibility_counts(df.drop("repayment_status", "income"))
    codes = [r["code"] for r in Y.eligibility_issues(counts, definition, column).collect()]
    assert codes[:2] == ["missing_features", "missing_target"]


def test_no_customer_in_two_splits(spark, demo):
    rows, strategy = Y.split_rows(demo)
    assert strategy == Y.GROUP_SPLIT
    assert Y.split_overlap(rows).first()["group_overlap_count"] == 0
    shares = {r["split"]: r["count"] / 1200 for r in rows.groupBy("split").count().collect()}
    assert shares["train"] == pytest.approx(0.6, abs=0.06)
    again = Y.split_rows(demo.repartition(7))[0]
    assert rows.select("transaction_id", "split").exceptAll(again.select("transaction_id", "split")).isEmpty()
    assert Y.split_rows(demo.drop("customer_id"))[1] == Y.STRATIFIED_SPLIT


def brute(y, s, p):
    order = np.argsort(-s, kind="stable")
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    ap, last = 0.0, 0.0
    for t in sorted(set(s[order]), reverse=True):
        hit = s >= t
        recall = (y[hit] == 1).sum() / (y == 1).sum()
        ap += (recall - last) * (y[hit] == 1).mean()
        last = recall
    tp, fp, fn = ((y == 1) & (p == 1)).sum(), ((y == 0) & (p == 1)).sum(), ((y == 1) & (p == 0)).sum()
    return {
        "accuracy": (y == p).mean(), "precision": tp / (tp + fp), "recall": tp / (tp + fn),
        "f1_score": 2 * tp / (2 * tp + fp + fn), "roc_auc": auc, "pr_auc": ap, "brier_score": np.mean((s - y) ** 2),
        "log_loss": -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s)),
    }


def test_measures_match_brute_force(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(300) < 0.3).astype(float)
    s = np.clip((0.35 * y + 0.5 * rng.random(300)).round(2) + 0.01, 0.01, 0.99)
    p = (s >= 0.5).astype(float)
    df = spark.createDataFrame(
        [(float(a), float(b), float(c)) for a, b, c in zip(y, s, p)], "label double, score double, prediction double")
    got = Y.score_measures(df).first().asDict()
    assert got == pytest.approx({k: round(v, 4) for k, v in brute(y, s, p).items()}, abs=1.01e-4)


def test_training_end_to_end(spark, demo):
    bundle = Y.train(demo, only=["Decision Tree", "Logistic Regression"], policy=Y.EligibilityPolicy())
    board = bundle.leaderboard.collect()
    assert [r["f1_score"] for r in board] == sorted((r["f1_score"] for r in board), reverse=True)
    assert bundle.name == board[0]["model"]
    metrics = bundle.metrics.first().asDict()
    assert all(0 <= metrics[k] <= 1 for k in metrics if k != "log_loss")
    run = bundle.provenance.first()
    assert run["group_overlap_count"] == 0 and run["run_id"].startswith("model-run:sha256:")
    assert sum(r["records"] for r in bundle.confusion.collect()) == run["test_rows"]
    records = demo.withColumn("segment", F.when(F.col("transaction_id") == "TXN-200000", "never seen").otherwise(
        F.col("segment")))
    scored = Y.score_records(bundle, records).persist()
    assert scored.count() == 1200
    assert scored.where("(status = 'blocked') <> (model_score_percent is null)").isEmpty()
    assert set(r["missing_inputs"] for r in scored.where("status = 'blocked'").collect()) <= {
        "income", "employment_status", "income, employment_status"}


def test_training_refuses_poor_data(spark):
    with pytest.raises(Y.ModelBlocked, match="Only 2 eligible rows are available; this prototype requires 200."):
        Y.train(target_frame(spark, "defaulted", ("0", "1")))


def test_generated_rows_do_not_depend_on_partitions(spark, demo):
    again = G.generate(spark.newSession(), 1200, seed=17).repartition(3)
    assert demo.exceptAll(again).isEmpty()
    one = demo.agg(
        F.avg("defaulted").alias("d"), F.min("income").alias("low"), F.count("income").alias("n"),
        F.countDistinct("transaction_id").alias("t")).first()
    assert 0.02 < one["d"] < 0.6 and one["low"] >= 65000 and one["n"] < 1200 and one["t"] < 1200
    assert G.generate(spark, 100, seed=18).exceptAll(G.generate(spark, 100, seed=17)).count() > 90


def test_demo_source_prefers_the_file(spark, tmp_path):
    path = tmp_path / "demo.csv"
    assert G.load_demo(spark, str(path)).count() == 5000
    path.write_text("Customer ID,Income\nC1,5\n")
    assert G.load_demo(spark, str(path)).columns == ["customer_id", "income"]


@pytest.mark.parametrize("text, expected", [
    ("What's the BIGGEST   risk?", "fallback"), ("what is the biggest risk?", "biggest_risk"),
    ("What should we do about suspicious rows", "next_action"), ("suspicious?", "why_flagged"),
    ("Show me the money", "transaction_value"), ("duplicate rows", "data_quality"), ("F1 please", "model"),
    ("our customers", "segment"), ("??? !", "empty"), ("hello", "fallback"),
])
def test_intents(spark, text, expected):
    df = spark.createDataFrame([(text,)], "q string")
    assert df.select(Q.intent(F.col("q"))).first()[0] == expected


@pytest.mark.parametrize("name", ["Logistic Regression", "Decision Tree", "Random Forest"])
def test_scores_from_tables_are_those_of_the_model(spark, demo, tmp_path, name, monkeypatch):
    from folioguard.operators import model_tables as MT

    whole = Y.candidates

    def smaller(weight_sum, seed):
        found = whole(weight_sum, seed)
        found["Random Forest"].setNumTrees(9)
        return found

    monkeypatch.setattr(Y, "candidates", smaller)
    bundle = Y.train(demo, only=[name])
    MT.save_bundle(bundle, str(tmp_path / "run"))
    tables = MT.model_tables(spark, str(tmp_path / "run"))
    complete = demo.dropDuplicates(["transaction_id"]).where(
        " and ".join(f"{n} is not null" for n in Y.MODEL_INPUTS)).withColumn(
        "segment", F.when(F.col("transaction_id").endswith("7"), "never seen").otherwise(F.col("segment")))
    got = {r["transaction_id"]: r["score"] for r in MT.score_by_tables(complete, "transaction_id", tables).collect()}
    fitted = Y.apply_model(bundle.model, complete.withColumn("label", F.lit(0.0))).select("transaction_id", "score").collect()
    assert len(got) == len(fitted) > 100
    assert all(got[r["transaction_id"]] == pytest.approx(r["score"], abs=1e-9) for r in fitted)
    again = MT.load_bundle(spark, str(tmp_path / "run"))
    assert again.name == name and again.run_id == bundle.run_id
    assert again.metrics.first() == bundle.metrics.first()


def test_a_stored_run_is_of_exactly_these_rows(spark, demo, tmp_path, monkeypatch):
    from folioguard.operators import model_tables as MT

    calls = []

    def quick(df, seed, policy):
        calls.append(df.count())
        return Y.train(df, seed, only=["Decision Tree"], policy=policy)

    monkeypatch.setattr(MT, "train", quick)
    folder = str(tmp_path / "models")
    one, _ = MT.stored_bundle(demo, folder=folder)
    again, _ = MT.stored_bundle(demo.repartition(7), folder=folder)
    assert calls == [1200] and one.run_id == again.run_id
    changed, _ = MT.stored_bundle(demo.where("transaction_id <> 'TXN-200000'"), folder=folder)
    assert len(calls) == 2 and changed.run_id != one.run_id
    assert MT.load_bundle(spark, folder + "/nothing") is None


def test_training_rows_are_dealt_over_parts(spark):
    rows = spark.range(50_000, numPartitions=1).select(
        F.lit("same").alias("customer_id"), (F.col("id") % 7).cast("double").alias("income"),
        F.when(F.col("id") % 3 > 0, F.lit(1.0)).otherwise(0.0).alias("label"))
    dealt = Y.spread(rows, 50_000)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 3 and max(sizes) < 1.2 * Y.ROWS_PER_PART
    assert dealt.exceptAll(rows).isEmpty() and rows.exceptAll(dealt).isEmpty()
    assert Y.spread(rows, Y.ROWS_PER_PART) is rows


def test_records_walk_trees_without_a_row_for_every_level(spark):
    from folioguard.operators import model_tables as MT

    names = {n: i for i, n in enumerate(Y.MODEL_NUMERIC)}
    first, text = Y.MODEL_NUMERIC[0], Y.MODEL_CATEGORICAL[0]
    inputs = spark.createDataFrame(
        [(i, n, None, 7.0, None, 2.0, 4.0) for n, i in names.items()]
        + [(len(names), text, "a", None, "a", None, None), (len(names) + 1, text, "b", None, "a", None, None)], MT.INPUTS)
    nodes = spark.createDataFrame([
        (0, 0, 1, 2, names[first], 1.0, None, None, 2), (0, 1, None, None, None, None, None, 0.25, 2),
        (0, 2, 3, 4, len(names), None, [1.0], None, 2), (0, 3, None, None, None, None, None, 0.5, 2),
        (0, 4, None, None, None, None, None, 1.0, 2), (1, 0, None, None, None, None, None, 0.0, 2)], MT.NODES)
    tables = {"inputs": inputs, "nodes": nodes}
    rows = [("low", 6.0, "b"), ("high a", 7.0, "a"), ("high b", 6.1, "b"), ("nothing", None, None), (None, 100.0, "odd")]
    kinds = ", ".join(f"{n} {'double' if n in names else 'string'}" for n in MODEL_INPUTS)
    records = spark.createDataFrame(
        [(k, *[v if n == first else t if n == text else None for n in MODEL_INPUTS]) for k, v, t in rows], f"k string, {kinds}")
    scored = MT.score_by_tables(records, "k", tables)
    assert {r["k"]: r["score"] for r in scored.collect()} == {
        "low": 0.125, "high a": 0.25, "high b": 0.5, "nothing": 0.25, None: 0.5}
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Generate" not in plan  # no row for a tree or a level
    with pytest.raises(Exception, match="a key is repeated"):
        MT.score_by_tables(records.unionByName(records), "k", tables).collect()


def test_rows_are_read_once_for_counts_and_scores(spark, demo, monkeypatch):
    labels = []

    def noted(df, label, folder=None):
        labels.append(label)
        return materialize(df, label, folder)

    materialize = Y.materialize
    monkeypatch.setattr(Y, "materialize", noted)
    bundle = Y.train(demo, only=["Decision Tree", "Logistic Regression"])
    assert labels.count("model-rows") == 1 and labels.count("model-frame") == 1 and labels.count("scores") == 3
    assert sum(r["records"] for r in bundle.confusion.collect()) == bundle.provenance.first()["test_rows"]
    assert Y.candidates(1.0, 42)["Random Forest"].getCacheNodeIds()
