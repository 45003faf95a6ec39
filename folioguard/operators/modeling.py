"""Outcome mapping, eligibility, group-safe splits, three candidate models, their measures, and batch scoring."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioguard.fixed_values import (
    FEATURE_DEFINITION,
    GROUP_SPLIT,
    MODEL_CATEGORICAL,
    MODEL_CODE_VERSION,
    MODEL_INPUTS,
    MODEL_ISSUES,
    MODEL_NUMERIC,
    REPAYMENT_STATUS_OUTCOMES,
    SCORE_EXPLANATION,
    SCORE_ROUTING,
    SCORE_SEMANTICS,
    STRATIFIED_SPLIT,
    TARGET_DEFINITIONS,
)
from folioguard.functions.scalars import blank_to_null, fill, missing, n_if, num, r1, thousands, txt
from folioguard.operators.profile import fingerprint, row_digest
from folioguard.operators.quantiles import Quantile, exact_quantiles, ordered_totals
from folioguard.session import materialize

SPLITS = (("train", 60), ("validation", 80), ("holdout", 100))
ROWS_PER_PART = 20_000
TINY = 2.220446049250313e-16


class ModelBlocked(ValueError):
    """Training was asked for on data that does not allow it."""


@dataclass(frozen=True)
class EligibilityPolicy:
    min_rows: int = 200
    min_class_rows: int = 30
    max_missing_rate: float = 0.40
    max_categories: int = 100


def binary_outcome(df: DataFrame) -> Column:
    value = num(df, "defaulted")
    return F.when(value.isin(0.0, 1.0), value).cast("int")


def status_outcome(c: Column) -> Column:
    label = F.lower(txt(c))
    out = F.lit(None).cast("int")
    for spelled, value in REPAYMENT_STATUS_OUTCOMES.items():
        out = F.when(label == spelled, value).otherwise(out)
    return out


def resolve_target(df: DataFrame) -> tuple[Column, str | None, str | None]:
    """Outcome expression, its column and definition.

    ``defaulted`` wins while it holds any valid value, else ``repayment_status``; one aggregation decides.
    """
    options = {}
    if "defaulted" in df.columns:
        options["defaulted"] = binary_outcome(df)
    if "repayment_status" in df.columns:
        options["repayment_status"] = status_outcome(F.col("repayment_status"))
    if options:
        found = df.agg(*[F.count(c).alias(name) for name, c in options.items()]).first()
        for name, c in options.items():
            if found[name]:
                return c, name, TARGET_DEFINITIONS[name]
    return F.lit(None).cast("int"), None, None


# --- eligibility ---
def _feature_value(df: DataFrame, name: str) -> tuple[Column, Column]:
    """Usable value and invalid mark of a model input."""
    if name in MODEL_NUMERIC:
        value = num(df, name)
        return value, ~missing(df, name) & value.isNull()
    value = blank_to_null(F.col(name))
    return value, ~missing(df, name) & value.isNull()


def eligibility_counts(df: DataFrame) -> tuple[DataFrame, str | None, str | None]:
    """One row of counts over the rows with a usable outcome."""
    target, column, definition = resolve_target(df)
    rows = df.withColumn("__y", target)
    has = F.col("__y").isNotNull()
    counts = [
        F.count("*").alias("total_rows"),
        n_if(has).alias("eligible_rows"),
        n_if(F.col("__y") == 0).alias("class_0"),
        n_if(F.col("__y") == 1).alias("class_1"),
    ]
    values = []
    for name in MODEL_INPUTS:
        if name not in df.columns:
            continue
        value, invalid = _feature_value(df, name)
        counts += [
            n_if(has & value.isNotNull()).alias(f"{name}__valid"),
            n_if(has & missing(df, name)).alias(f"{name}__missing"),
            n_if(has & invalid).alias(f"{name}__invalid"),
        ]
        plain = (value + F.lit(0.0)).cast("string") if name in MODEL_NUMERIC else value
        values.append(F.when(value.isNotNull(), F.struct(F.lit(name).alias("c"), plain.alias("v"))))
    if not values:
        return rows.agg(*counts), column, definition
    # Distinct values of all inputs from one narrow aggregation, not one expanded row for each input.
    distinct = rows.where(has).select(F.inline(F.array_compact(F.array(*values)))).distinct().groupBy("c").agg(
        F.count("*").alias("n"))
    names = [n for n in MODEL_INPUTS if n in df.columns]
    uniques = distinct.agg(F.struct(*[
        F.coalesce(F.max(F.when(F.col("c") == n, F.col("n"))), F.lit(0)).alias(n) for n in names]))
    one = rows.agg(*counts).withColumn("__u", uniques.scalar())
    return one.select("*", *[F.col("__u")[n].alias(f"{n}__unique") for n in names]).drop("__u"), column, definition


def feature_profiles(counts: DataFrame) -> DataFrame:
    """One row per model input that is there."""
    names = [n for n in MODEL_INPUTS if f"{n}__valid" in counts.columns]
    lines = [
        F.struct(
            F.lit(i).alias("position"), F.lit(n).alias("column"),
            F.lit("numeric" if n in MODEL_NUMERIC else "categorical").alias("kind"),
            *[F.col(f"{n}__{part}").alias(f"{part}_count") for part in ("valid", "missing", "invalid", "unique")])
        for i, n in enumerate(names, 1)
    ]
    return counts.select(F.inline(F.array(*lines)))


def eligibility_issues(
    counts: DataFrame, definition: str | None, column: str | None, policy: EligibilityPolicy = EligibilityPolicy()
) -> DataFrame:
    """Issues in order; any block issue forbids training."""
    names = [n for n in MODEL_INPUTS if f"{n}__valid" in counts.columns]
    absent = [n for n in MODEL_INPUTS if n not in names]
    n, c0, c1 = F.col("eligible_rows"), F.col("class_0"), F.col("class_1")
    excluded = F.col("total_rows") - n

    def one(
        code: str, applies: Column, count: Column | None = None, where: str | None = None,
        parts: dict[str, Column] | None = None,
    ) -> Column:
        severity, message, recovery = MODEL_ISSUES[code]
        return F.when(applies, F.struct(
            F.lit(code).alias("code"), F.lit(severity).alias("severity"),
            (fill(message, **parts) if parts else F.lit(message)).alias("message"),
            F.lit(recovery).alias("recovery"), F.lit(where).cast("string").alias("column"),
            (F.lit(None) if count is None else count).cast("long").alias("count")))

    found = [
        one("missing_features", F.lit(bool(absent)), F.lit(len(absent)),
            parts={"columns": F.lit(", ".join(absent))}),
        one("missing_target", F.lit(definition is None)),
        one("unmapped_target_values", F.lit(definition is not None) & (excluded > 0), excluded, column),
        one("single_target_class", (n > 0) & ((c0 == 0) | (c1 == 0))),
        one("insufficient_rows", n < policy.min_rows, n,
            parts={"rows": thousands(n), "required": thousands(F.lit(policy.min_rows))}),
        one("insufficient_class_rows", (c0 > 0) & (c1 > 0) & (F.least(c0, c1) < policy.min_class_rows),
            parts={"required": thousands(F.lit(policy.min_class_rows))}),
    ]
    for name in names:
        lost = F.col(f"{name}__missing") + F.col(f"{name}__invalid")
        rate = F.when(n > 0, lost / n).otherwise(1.0)
        found.append(one(
            "excessive_feature_missingness", rate > policy.max_missing_rate, lost, name,
            {"column": F.lit(name), "rate": F.format_string("%.1f%%", rate * 100)}))
        if name in MODEL_CATEGORICAL:
            unique = F.col(f"{name}__unique")
            found.append(one(
                "excessive_category_cardinality", unique > policy.max_categories, unique, name,
                {"column": F.lit(name), "count": thousands(unique)}))
    return counts.select(F.posexplode(F.array_compact(F.array(*found))).alias("p", "i")).select(
        (F.col("p") + 1).alias("ordinal"), "i.*")


# --- splits ---
def hash_percent(c: Column, seed: int) -> Column:
    """0-99 from the leading digits of a SHA-256: the same on every engine and run."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), c), 256)
    return (F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long") % 100).cast("int")


def banded(percent: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, top in reversed(SPLITS):
        out = F.when(percent < top, name).otherwise(out)
    return out


def groups_usable(df: DataFrame) -> bool:
    """Every row has a customer id, and there are at least five of them."""
    if "customer_id" not in df.columns:
        return False
    group = blank_to_null(F.col("customer_id"))
    found = df.agg(
        n_if(group.isNull()).alias("blank"), F.approx_count_distinct(group).alias("about")).first()
    if found["blank"]:
        return False
    # The sketch is good to a few per cent; only near the bound does the exact count matter.
    return found["about"] >= 50 or df.select(group.alias("g")).distinct().limit(5).count() == 5


def split_rows(df: DataFrame, seed: int = 42, by_group: bool | None = None) -> tuple[DataFrame, str]:
    """``split`` column at about 60/20/20, and the strategy used.

    By customer when possible: the split is a function of the id alone, so no customer is in two splits and nothing
    is shuffled. Otherwise by row digest, which leaves the class shares as they are.
    """
    grouped = groups_usable(df) if by_group is None else by_group
    key = txt(F.col("customer_id")) if grouped else row_digest(df, df.columns)
    return df.withColumn("split", banded(hash_percent(key, seed))), GROUP_SPLIT if grouped else STRATIFIED_SPLIT


def split_overlap(rows: DataFrame) -> DataFrame:
    """One row: customers found in more than one split."""
    per = rows.groupBy(txt(F.col("customer_id")).alias("g")).agg(
        F.min("split").alias("a"), F.max("split").alias("b"))
    return per.agg(n_if(F.col("a") != F.col("b")).alias("group_overlap_count"))


def split_classes(rows: DataFrame) -> DataFrame:
    """Rows and classes per split; training needs both classes in each."""
    return rows.groupBy("split").agg(
        F.count("*").alias("rows"), n_if(F.col("label") == 0).alias("class_0"), n_if(F.col("label") == 1).alias(
            "class_1"),
        (F.countDistinct("label") == 2).alias("both_classes"))


# --- features ---
def model_frame(df: DataFrame, target: Column) -> DataFrame:
    """Rows with an outcome: typed inputs, ``label``, and the customer id when there is one."""
    keep = [F.col("customer_id")] if "customer_id" in df.columns else []
    return df.select(
        *keep, *[_feature_value(df, n)[0].alias(n) for n in MODEL_INPUTS], target.cast("double").alias("label"),
    ).where(F.col("label").isNotNull())


@dataclass(frozen=True)
class Preparation:
    """What imputing and scaling learned from the training rows."""

    medians: dict[str, float]
    means: dict[str, float]
    deviations: dict[str, float]
    modes: dict[str, str]

    def statement(self) -> str:
        """Every other column passes; inputs are imputed, numbers standardised as ``z_...``."""
        scaled = [
            f"(coalesce({n}, {self.medians[n]!r}D) - {self.means[n]!r}D) / {(self.deviations[n] or 1.0)!r}D AS z_{n}"
            for n in MODEL_NUMERIC
        ]
        filled = [
            f"coalesce({n}, '{self.modes[n].replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}') "
            f"AS c_{n}" for n in MODEL_CATEGORICAL
        ]
        return f"SELECT *, {', '.join(scaled + filled)} FROM __THIS__"


def learn_preparation(train: DataFrame) -> Preparation:
    """Medians, then mean and population deviation of the imputed values, and the commonest category.

    Ties between categories go to the first in order.
    """
    found = exact_quantiles(train, [Quantile(n, F.col(n), 0.5) for n in MODEL_NUMERIC]).collect()
    medians = {n: 0.0 for n in MODEL_NUMERIC} | {r["name"]: r["quantile"] for r in found}
    filled = {n: F.coalesce(F.col(n), F.lit(medians[n])) for n in MODEL_NUMERIC}
    moments = train.agg(
        *[F.avg(c).alias(f"m_{n}") for n, c in filled.items()],
        *[F.stddev_pop(c).alias(f"d_{n}") for n, c in filled.items()]).first()
    modes = {n: (mode_of(train, n) or "") for n in MODEL_CATEGORICAL}
    return Preparation(
        medians, {n: moments[f"m_{n}"] for n in MODEL_NUMERIC}, {n: moments[f"d_{n}"] for n in MODEL_NUMERIC}, modes)


def mode_of(df: DataFrame, column: str) -> str | None:
    top = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), column).limit(1).first()
    return top[column] if top else None


def feature_stages(preparation: Preparation) -> list:
    """Imputing, scaling and one-hot encoding; a category unseen in training becomes all zeros."""
    indexed = [f"i_{n}" for n in MODEL_CATEGORICAL]
    encoded = [f"h_{n}" for n in MODEL_CATEGORICAL]
    return [
        SQLTransformer(statement=preparation.statement()),
        StringIndexer(inputCols=[f"c_{n}" for n in MODEL_CATEGORICAL], outputCols=indexed, handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        VectorAssembler(inputCols=[f"z_{n}" for n in MODEL_NUMERIC] + encoded, outputCol="features"),
    ]


def candidates(weight_sum: float, seed: int) -> dict[str, object]:
    """The three class-balanced models, by display name.

    The penalty of the logistic model is one over the weight sum, an inverse strength of one per summed loss.
    """
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    return {
        "Logistic Regression": LogisticRegression(
            maxIter=1500, regParam=1.0 / weight_sum, standardization=False, **common),
        "Random Forest": RandomForestClassifier(
            numTrees=120, maxDepth=9, minInstancesPerNode=4, featureSubsetStrategy="sqrt", seed=seed, cacheNodeIds=True,
            **common),
        "Decision Tree": DecisionTreeClassifier(maxDepth=5, seed=seed, **common),
    }


def balanced(rows: DataFrame) -> DataFrame:
    """``weight``: rows over twice the rows of the own class."""
    n = rows.agg(F.count("*").alias("n"), n_if(F.col("label") == 1).alias("p")).first()
    positive, negative = n["n"] / (2 * n["p"]), n["n"] / (2 * (n["n"] - n["p"]))
    return rows.withColumn("weight", F.when(F.col("label") == 1, positive).otherwise(negative))


# --- measures ---
def score_measures(scored: DataFrame) -> DataFrame:
    """One row of eight measures from ``label``, ``prediction`` and ``score``, to four places.

    ROC area and average precision come from running totals over the distinct scores, ties shared.
    """
    y, p, s = F.col("label"), F.col("prediction"), F.col("score")
    right = F.least(F.greatest(s, F.lit(TINY)), F.lit(1 - TINY))
    base = scored.agg(
        F.avg((y == p).cast("double")).alias("accuracy"),
        n_if((y == 1) & (p == 1)).alias("tp"), n_if((y == 0) & (p == 1)).alias("fp"),
        n_if((y == 1) & (p == 0)).alias("fn"),
        F.avg((s - y) * (s - y)).alias("brier_score"),
        F.avg(-F.when(y == 1, F.log(right)).otherwise(F.log(1 - right))).alias("log_loss"),
    )
    placed = ordered_totals(scored, s, {"pos": y})
    c = F.col
    negatives_below = c("below") - c("pos_below")
    negatives = c("c") - c("pos")
    from_here = c("n") - c("below")
    areas = placed.agg(F.struct(
        (F.sum(c("pos") * (negatives_below + negatives / 2)) / F.max(c("pos_all") * (c("n") - c("pos_all")))).alias(
            "roc_auc"),
        F.sum(c("pos") / c("pos_all") * (c("pos_all") - c("pos_below")) / from_here).alias("pr_auc"),
    ))
    one = base.withColumn("__x", areas.scalar())

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(0.0)

    measures = {
        "accuracy": c("accuracy"),
        "precision": ratio(c("tp"), c("tp") + c("fp")),
        "recall": ratio(c("tp"), c("tp") + c("fn")),
        "f1_score": ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")),
        "roc_auc": c("__x")["roc_auc"],
        "pr_auc": c("__x")["pr_auc"],
        "brier_score": c("brier_score"),
        "log_loss": c("log_loss"),
    }
    return one.select([F.round(m, 4).alias(name) for name, m in measures.items()])


def confusion_matrix(scored: DataFrame) -> DataFrame:
    """Four cells, empty ones included."""
    cells = [(a, b) for a in (0, 1) for b in (0, 1)]
    one = scored.agg(*[
        n_if((F.col("label") == a) & (F.col("prediction") == b)).alias(f"n{a}{b}") for a, b in cells])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("label"), F.lit(b).alias("prediction"), F.col(f"n{a}{b}").alias("records"))
        for a, b in cells])))


# --- training and scoring ---
def spread(frame: DataFrame, rows: int) -> DataFrame:
    """``frame`` dealt evenly over parts of at most about ``ROWS_PER_PART`` rows, each in a fixed order.

    A fit passes over its rows for every level of the trees, with one task for each part. The narrow frame is so small
    that joins and scans leave it in one part, and a single task would grow all trees.
    """
    parts = -(-rows // ROWS_PER_PART)
    return frame if parts <= 1 else frame.repartition(parts).sortWithinPartitions(*frame.columns)


@dataclass
class ModelBundle:
    name: str
    model: PipelineModel
    leaderboard: DataFrame
    metrics: DataFrame
    confusion: DataFrame
    provenance: DataFrame
    preparation: Preparation | None = None  # known where the run was trained; the stored tables hold it
    feature_columns: list[str] = field(default_factory=lambda: list(MODEL_INPUTS))
    approval_status: str = "demonstration_unapproved"

    @property
    def run_id(self) -> str:
        return self.provenance.first()["run_id"]


def apply_model(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))


def rank_leaderboard(leaderboard: DataFrame) -> DataFrame:
    """Best F1 first, then best average precision, then name."""
    return leaderboard.orderBy(F.desc("f1_score"), F.desc("pr_auc"), "model")


def train(
    df: DataFrame, seed: int = 42, only: Sequence[str] | None = None, policy: EligibilityPolicy = EligibilityPolicy()
) -> ModelBundle:
    """Fit on training rows, choose on validation rows, refit on both, report on the holdout."""
    spark = df.sparkSession
    # Counts, usable groups and the reference each pass over all rows, so these are written once, dealt evenly.
    kept = materialize(df.repartition(spark.sparkContext.defaultParallelism), "model-rows")
    counts, column, definition = eligibility_counts(kept)
    counts = spark.createDataFrame(counts.collect(), counts.schema)
    held = eligibility_issues(counts, definition, column, policy).where("severity = 'block'").collect()
    if held:
        raise ModelBlocked("Model exploration is blocked: " + " ".join(r["message"] for r in held))
    target = resolve_target(kept)[0]
    frame, strategy = split_rows(model_frame(df, target), seed, groups_usable(model_frame(kept, target)))
    # Read many times by the fits, so it is written once.
    frame = materialize(spread(frame, counts.first()["eligible_rows"]), "model-frame")
    sizes = {r["split"]: r for r in split_classes(frame).collect()}
    for name, _ in SPLITS:
        if name not in sizes or not sizes[name]["both_classes"]:
            raise ModelBlocked(f"Model exploration is blocked: the {name} split does not contain both outcome classes.")
    rows = {name: sizes[name]["rows"] for name, _ in SPLITS}

    def prepared(part: DataFrame, learned: Preparation) -> tuple[PipelineModel, DataFrame]:
        weighted = balanced(part)
        features = Pipeline(stages=feature_stages(learned)).fit(weighted)
        return features, features.transform(weighted)

    def fitted(name: str, features: PipelineModel, ready: DataFrame, n: int) -> PipelineModel:
        return PipelineModel([*features.stages, candidates(float(n), seed)[name].fit(ready)])

    def scores(model: PipelineModel, part: DataFrame) -> DataFrame:
        # Written, because the measures read them several times and each would run the model again.
        return materialize(apply_model(model, part).select("label", "prediction", "score"), "scores")

    parts = {name: frame.where(F.col("split") == name) for name, _ in SPLITS}
    board = None
    ready = prepared(parts["train"], learn_preparation(parts["train"]))  # the same for all candidates
    for name in only or list(candidates(1.0, seed)):
        scored = scores(fitted(name, *ready, rows["train"]), parts["validation"])
        line = score_measures(scored).select(
            F.lit(name).alias("model"), F.lit("validation").alias("evaluation_split"), "*")
        board = line if board is None else board.unionByName(line)
    lines = rank_leaderboard(board).collect()
    board = spark.createDataFrame(lines, board.schema)
    best = lines[0]["model"]
    both = frame.where(F.col("split").isin("train", "validation"))
    learned = learn_preparation(both)
    final = fitted(best, *prepared(both, learned), rows["train"] + rows["validation"])
    tested = scores(final, parts["holdout"])
    overlap = 0
    if strategy == GROUP_SPLIT:
        overlap = split_overlap(frame).first()["group_overlap_count"]
    reference = fingerprint(kept).first()["dataset_reference"]
    material = F.concat_ws(
        "|", F.lit(reference), F.lit(definition), F.lit(str(seed)), F.lit(MODEL_CODE_VERSION), F.lit(best))
    provenance = spark.range(1).select(
        F.concat(F.lit("model-run:sha256:"), F.sha2(material, 256)).alias("run_id"),
        F.current_timestamp().alias("generated_at"),
        F.lit(reference).alias("dataset_reference"),
        F.lit(definition).alias("target_definition"),
        F.lit(FEATURE_DEFINITION).alias("feature_definition"),
        F.lit(strategy).alias("split_strategy"),
        F.lit("validation").alias("selection_split"),
        F.lit("holdout").alias("final_evaluation_split"),
        F.lit(seed).alias("random_state"),
        F.lit(rows["train"]).alias("train_rows"),
        F.lit(rows["validation"]).alias("validation_rows"),
        F.lit(rows["holdout"]).alias("test_rows"),
        F.lit(overlap).alias("group_overlap_count"),
        F.lit(spark.version).alias("spark_version"),
        F.lit(MODEL_CODE_VERSION).alias("code_version"),
        F.lit("f1_score").alias("selection_metric"),
        F.lit("uncalibrated_demonstration_score").alias("probability_status"),
    )
    return ModelBundle(
        best, final, board, score_measures(tested), confusion_matrix(tested), provenance, learned)


def score_records(bundle: ModelBundle, records: DataFrame) -> DataFrame:
    """Every record with its score, or ``blocked`` and the inputs it lacks; nothing is dropped."""
    lacking = F.array_compact(F.array(*[
        F.when(missing(records, n), F.lit(n)) if n in records.columns else F.lit(n) for n in MODEL_INPUTS]))
    typed = records
    for n in MODEL_INPUTS:
        kind = "double" if n in MODEL_NUMERIC else "string"
        typed = typed.withColumn(n, _feature_value(records, n)[0] if n in records.columns else F.lit(None).cast(kind))
    marked = typed.withColumn("missing_inputs", lacking)
    blocked = F.size("missing_inputs") > 0
    scored = apply_model(bundle.model, marked)
    return scored.select(
        *records.columns,
        F.when(blocked, "blocked").otherwise("scored").alias("status"),
        F.array_join("missing_inputs", ", ").alias("missing_inputs"),
        F.when(~blocked, r1(F.col("score") * 100)).alias("model_score_percent"),
        F.lit(SCORE_SEMANTICS).alias("score_semantics"),
        F.lit(SCORE_ROUTING).alias("routing"),
        F.lit("unavailable").alias("explanation_status"),
        F.lit(SCORE_EXPLANATION).alias("explanation"),
        F.lit(bundle.run_id).alias("run_id"),
    )
