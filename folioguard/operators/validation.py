"""Validation of mapped datasets into runs, their detail tables, and the checks on stored detail."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioguard.fixed_values import CONCEPT_CAPABILITIES, DIMENSION_WEIGHTS, MAPPING_ISSUES, VALIDATION_POLICY
from folioguard.functions.hashing import masked
from folioguard.functions.scalars import blank_to_null, n_if
from folioguard.operators.mapping import Field, canonicalize, valid_value
from folioguard.operators.profile import assess, capability_results, issue_struct, severity_count
from folioguard.operators.tables import append_absent, difference
from folioguard.session import materialize, together

DETAIL_KEYS = {
    "validation_runs": ["validation_run_id"],
    "validation_dimension_scores": ["validation_run_id", "dimension"],
    "validation_capability_results": ["validation_run_id", "capability"],
    "validation_issues": ["validation_run_id", "issue_ordinal"],
    "validation_issue_capabilities": ["validation_run_id", "issue_ordinal", "capability"],
    "validation_issue_examples": ["validation_run_id", "issue_ordinal", "example_ordinal"],
}


def stripped(lexical: DataFrame, fields: Sequence[Field], by: Sequence[str]) -> DataFrame:
    """The mapped columns without white space at the ends, blank as null."""
    return lexical.select(*by, *[
        blank_to_null(F.col(f.normalized_column)).alias(f"v{i}") for i, f in enumerate(fields)])


def cell_counts(lexical: DataFrame, fields: Sequence[Field], by: Sequence[str]) -> DataFrame:
    """``by``, i, value, lost, n: everything the evidence needs, from one scan in which a cell is parsed once.

    A row gives one line (i = -1) with a mark for each field in ``lost``, 1 where it is missing, and a line for each invalid cell
    with its field number and value. Lines are counted before they are shuffled, so what travels is the patterns of
    missing fields and the distinct invalid values.
    """
    marks, cells = [], []
    for i, f in enumerate(fields):
        v = F.col(f"v{i}")
        marks.append(F.when(v.isNull(), "1").otherwise("0"))
        cells.append(F.when(v.isNotNull() & ~valid_value(v, f.target_type), F.struct(
            F.lit(i).alias("i"), v.alias("value"), F.lit("").alias("lost"))))
    whole = F.struct(F.lit(-1).alias("i"), F.lit(None).cast("string").alias("value"), F.concat(*marks).alias("lost"))
    rows = stripped(lexical, fields, by)
    lines = rows.select(*by, F.inline(F.array_compact(F.array(whole, *cells))))
    return lines.groupBy(*by, "i", "value", "lost").agg(F.count("*").alias("n"))


def _lines(counts: DataFrame, fields: Sequence[Field], by: Sequence[str], *more: str) -> DataFrame:
    """A row per key and field."""
    lines = F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(f.concept).alias("concept"), F.lit(f.target_type).alias("target_type"),
            F.lit(f.nullable).alias("nullable"), F.col(f"m{i}").alias("missing_count"),
            F.col(f"i{i}").alias("invalid_count"))
        for i, f in enumerate(fields)
    ])
    return counts.select(*by, *more, F.inline(lines))


def _totals(cells: DataFrame, fields: Sequence[Field], by: Sequence[str]) -> DataFrame:
    def total(of: Column) -> Column:
        return F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0))

    return cells.groupBy(*by).agg(
        *[total(F.substring("lost", i + 1, 1) == "1").alias(f"m{i}") for i in range(len(fields))],
        *[total(F.col("i") == i).alias(f"i{i}") for i in range(len(fields))])


def field_evidence(lexical: DataFrame, fields: Sequence[Field], by: Sequence[str]) -> DataFrame:
    """Missing and invalid values per key and mapped field."""
    return _lines(_totals(cell_counts(lexical, fields, by), fields, by), fields, by)


def _smallest(cells: DataFrame, fields: Sequence[Field], by: Sequence[str], n: int) -> DataFrame:
    """The ``n`` smallest invalid values per key and field, hashed; every task keeps ``n`` before it shuffles."""
    place = F.row_number().over(Window.partitionBy(*by, "i").orderBy("value"))
    few = cells.where("i >= 0").withColumn("place", place).where(F.col("place") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("place", masked(F.col("value")).alias("m"))))
    concepts = F.array(*[F.lit(f.concept) for f in fields])
    return few.groupBy(*by, F.get(concepts, F.col("i")).alias("concept")).agg(
        F.transform(ordered, lambda x: x["m"]).alias("masked_examples"))


def masked_examples(lexical: DataFrame, fields: Sequence[Field], by: Sequence[str], n: int = 3) -> DataFrame:
    """The ``n`` smallest distinct invalid values per key and concept, hashed."""
    return _smallest(cell_counts(lexical, fields, by), fields, by, n)


def mapping_issues(lexical: DataFrame, fields: Sequence[Field], by: Sequence[str]) -> DataFrame:
    """Per key, the mapping-level issues in field order as one array."""
    # Written, because the two uses do not share a shuffle and each would parse every cell.
    cells = materialize(cell_counts(lexical, fields, by), "cell-counts")
    evidence = _lines(_totals(cells, fields, by), fields, by)
    rows = evidence.join(_smallest(cells, fields, by, 3), [*by, "concept"], "left")
    caps = F.lit(None).cast("array<string>")
    for concept, dependent in CONCEPT_CAPABILITIES.items():
        names = ("quality_review", *dependent)
        caps = F.when(F.col("concept") == concept, F.array(*[F.lit(c) for c in names])).otherwise(caps)

    def one(code: str, applies, count, examples=None):
        severity, dimension, message, recovery, override = MAPPING_ISSUES[code]
        head, tail = message.split("{concept}")
        return F.when(applies, issue_struct(
            F.lit(code), F.lit(severity), F.lit(dimension), F.col("concept"), count,
            F.concat(F.lit(head), F.col("concept"), F.lit(tail)), F.lit(recovery), caps, F.lit(override), examples))

    required = ~F.col("nullable")
    bad = F.col("invalid_count") > 0
    examples = F.coalesce("masked_examples", F.array().cast("array<string>"))
    found = F.array_compact(F.array(
        one("missing_required_field", required & (F.col("missing_count") > 0), F.col("missing_count")),
        one("unparseable_required_field", required & bad, F.col("invalid_count"), examples),
        one("unparseable_optional_field", ~required & bad, F.col("invalid_count"), examples),
    ))
    in_order = F.array_sort(F.collect_list(F.struct("position", found.alias("found"))))
    return rows.groupBy(*by).agg(
        F.flatten(F.transform(in_order, lambda x: x["found"])).alias("mapping_issues"))


def validate(lexical: DataFrame, fields: Sequence[Field], by: Sequence[str]) -> DataFrame:
    """One validation run per key: assessment of the canonical dataset with the mapping issues in front.

    Readiness is worked out again over all issues; the fitness score keeps its value from before.
    """
    # Written, because the counts and the repeats would each parse every cell.
    canonical, issues = together(
        lambda: materialize(canonicalize(lexical, fields, by), "canonical"), lambda: mapping_issues(lexical, fields, by))
    joined = assess(canonical, by).join(issues, list(by))
    runs = joined.withColumn("issues", F.concat("mapping_issues", "issues")).drop("mapping_issues", "capabilities")
    runs = runs.withColumn("capabilities", capability_results())
    review = F.filter("capabilities", lambda x: x["capability"] == "quality_review")
    passed = F.get(review, F.lit(0))["status"] == "ready"
    return runs.withColumns({
        "verdict": F.when(passed, "passed").otherwise("blocked"),
        "dataset_status": F.when(passed, "ready").otherwise("failed"),
        "block_count": severity_count("block"),
        "warn_count": severity_count("warn"),
        "info_count": severity_count("info"),
        "validation_policy_version": F.lit(VALIDATION_POLICY),
    })


def detail_tables(runs: DataFrame, run_id: str) -> dict[str, DataFrame]:
    """Six flat tables from the nested runs; ordinals start at one. ``run_id`` names the run's key column."""
    key = F.col(run_id).cast("string").alias("validation_run_id")
    issues = runs.select(key, "definition_version", F.posexplode("issues").alias("p", "i")).withColumn(
        "issue_ordinal", F.col("p") + 1)
    scores = F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("decimal(5,2)").alias("score"))
        for d in DIMENSION_WEIGHTS
    ])
    examples = issues.select(
        "validation_run_id", "issue_ordinal", F.posexplode("i.masked_examples").alias("q", "masked_hash"))
    return {
        "validation_runs": runs.select(
            key, "validation_policy_version", "definition_version", "verdict", "dataset_status",
            F.col("rows").alias("row_count"), F.col("columns").alias("column_count"),
            F.col("composite_score").cast("decimal(5,2)").alias("composite_score"), "block_count", "warn_count",
            "info_count"),
        "validation_dimension_scores": runs.select(key, F.inline(scores)),
        "validation_capability_results": runs.select(key, F.inline("capabilities")).select(
            "validation_run_id", "capability", "status"),
        "validation_issues": issues.select(
            "validation_run_id", "issue_ordinal", F.col("i.code").alias("rule_id"),
            F.col("definition_version").alias("rule_version"), "i.severity", "i.dimension",
            F.col("i.column").alias("normalized_column"), "i.affected_count", "i.message", "i.recovery",
            "i.override_allowed"),
        "validation_issue_capabilities": issues.select(
            "validation_run_id", "issue_ordinal", F.explode("i.capabilities").alias("capability")),
        "validation_issue_examples": examples.select(
            "validation_run_id", "issue_ordinal", (F.col("q") + 1).alias("example_ordinal"), "masked_hash"),
    }


def persist(details: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Append what each table lacks; running it again adds nothing."""
    return {
        name: append_absent(rows, f"{folder}/{name}", DETAIL_KEYS[name]) for name, rows in details.items()}


def verify(details: dict[str, DataFrame], stored: dict[str, DataFrame]) -> DataFrame:
    """Per table, rows that are missing or unexpected; all zero when the detail was stored exactly."""
    out = None
    for name, expected in details.items():
        gap = difference(expected, stored[name]).agg(
            n_if(F.col("side") == "missing").alias("missing"), n_if(F.col("side") == "unexpected").alias("unexpected"))
        line = gap.select(F.lit(name).alias("detail"), "missing", "unexpected")
        out = line if out is None else out.unionByName(line)
    return out


def verdicts(issues: DataFrame, key: str = "validation_run_id") -> DataFrame:
    """Severity counts per run, and whether a block issue stands in the way."""
    counts = issues.groupBy(key).agg(*[
        n_if(F.col("severity") == s).alias(f"{s}_count") for s in ("block", "warn", "info")])
    return counts.withColumn("verdict", F.when(F.col("block_count") > 0, "blocked").otherwise("passed"))
