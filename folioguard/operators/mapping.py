"""Confirmed mappings: checks over mapping tables, and the canonical form of a mapped dataset."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioguard.fixed_values import TARGET_TYPES
from folioguard.functions.scalars import blank_to_null, integral, num_text, ts_text
from folioguard.operators.headers import canonical_json

NONE = "not_applicable"
BOOLEAN_TEXT = {"0": 0, "1": 1, "false": 0, "true": 1}


@dataclass(frozen=True)
class Field:
    """One confirmed column of a dataset."""

    normalized_column: str
    concept: str
    target_type: str
    nullable: bool

    def __post_init__(self) -> None:
        if self.target_type not in TARGET_TYPES:
            raise ValueError(f"unknown target type {self.target_type}")


def valid_value(v: Column, target_type: str) -> Column:
    """Whether a present, stripped text fits its target type."""
    if target_type == "decimal":
        return num_text(v).isNotNull()
    if target_type == "integer":
        parsed = num_text(v)
        return parsed.isNotNull() & F.coalesce(integral(parsed), F.lit(False)) & ~F.isnan(parsed % 1)
    if target_type == "boolean":
        return F.lower(v).isin(*BOOLEAN_TEXT)
    if target_type in ("date", "datetime"):
        return ts_text(v).isNotNull()
    return v.isNotNull()


def valid_by_type(v: Column, target_type: Column) -> Column:
    """The same check when the target type is itself a column."""
    verdict = F.lit(None).cast("boolean")
    for name in TARGET_TYPES:
        verdict = F.when(target_type == name, valid_value(v, name)).otherwise(verdict)
    return v.isNotNull() & F.coalesce(verdict, F.lit(False))


def canonical_value(v: Column, target_type: str) -> Column:
    if target_type != "boolean":
        return v
    out = F.lit(None).cast("int")
    for spelled, value in BOOLEAN_TEXT.items():
        out = F.when(F.lower(v) == spelled, value).otherwise(out)
    return out


def canonicalize(lexical: DataFrame, fields: Sequence[Field], by: Sequence[str] = ()) -> DataFrame:
    """Only the mapped columns, stripped, blank as null, under their concept names."""
    return lexical.select(*by, *[
        canonical_value(blank_to_null(F.col(f.normalized_column)), f.target_type).alias(f.concept) for f in fields])


def semantic_violations() -> Column:
    """Codes of the consistency rules a mapping field breaks."""
    c = F.col
    concept, plain = c("concept"), lambda name: c(name) == NONE
    fixed = c("currency_mode") == "fixed"
    code_ok = F.coalesce(c("currency_code").rlike("^[A-Z]{3}$"), F.lit(False))
    identifier = (
        (c("target_type") == "string") & (c("unit") == "identifier") & plain("currency_mode") & plain("period")
        & plain("amount_direction") & plain("time_semantics"))
    money = (
        (c("target_type") == "decimal") & (c("unit") == "money") & ~plain("currency_mode") & plain("time_semantics"))
    currency = (c("target_type") == "string") & (c("unit") == "currency_code") & plain("currency_mode")
    dated = c("target_type").isin("date", "datetime") & (c("unit") == "temporal") & ~plain("time_semantics")
    rules = [
        ("empty_name", (F.trim("source_column") == "") | (F.trim("normalized_column") == "")),
        ("fixed_currency_code", fixed & ~code_ok),
        ("unexpected_currency_code", ~fixed & c("currency_code").isNotNull()),
        ("identifier_semantics", concept.isin("customer_id", "transaction_id") & ~identifier),
        ("money_semantics",
         concept.isin("transaction_amount", "income", "loan_amount", "existing_debt") & ~money),
        ("amount_semantics",
         (concept == "transaction_amount") & ((c("period") != "transaction") | plain("amount_direction"))),
        ("currency_semantics", (concept == "currency") & ~currency),
        ("date_semantics", (concept == "date") & ~dated),
    ]
    return F.array_compact(F.array(*[F.when(broken, code) for code, broken in rules]))


def check_fields(fields: DataFrame) -> DataFrame:
    """Each mapping field with the rules it breaks."""
    return fields.withColumn("violations", semantic_violations())


def check_mappings(fields: DataFrame, artifact_fields: DataFrame, key: str = "mapping_version_id") -> DataFrame:
    """First reason to refuse each submitted mapping; null ``error_code`` is an accepted one."""
    names = [key, "source_column", "normalized_column"]
    trusted = artifact_fields.select(*names).distinct().withColumn("__trusted", F.lit(1))
    offered = artifact_fields.groupBy(key).agg(F.count("*").alias("__offered"))
    marked = fields.join(trusted, names, "left")
    pair = F.struct("source_column", "normalized_column")
    one = marked.groupBy(key).agg(
        F.count("*").alias("field_count"),
        F.countDistinct(pair).alias("__pairs"),
        F.countDistinct("concept").alias("__concepts"),
        F.count("__trusted").alias("__known"),
        F.bool_or(F.col("currency_mode") == "column").alias("__by_column"),
        F.bool_or(F.col("concept") == "currency").alias("__has_currency"),
    )
    n = F.col("field_count")
    code = (
        F.when((n == 0) | (n > F.col("__offered")), "invalid_mapping_field_count")
        .when((F.col("__pairs") != n) | (F.col("__known") < n), "mapping_column_mismatch")
        .when(F.col("__concepts") != n, "duplicate_governed_concept")
        .when(F.col("__by_column") & ~F.col("__has_currency"), "currency_column_mapping_required")
    )
    return one.join(offered, key, "left").select(key, "field_count", code.alias("error_code"))


def untrusted_fields(fields: DataFrame, artifact_fields: DataFrame, key: str = "mapping_version_id") -> DataFrame:
    """Submitted columns the artifact does not have."""
    names = [key, "source_column", "normalized_column"]
    return fields.join(artifact_fields.select(*names), names, "left_anti").select(*names, "concept")


HASHED_FIELD = (
    "amount_direction", "concept", "currency_code", "currency_mode", "normalized_column", "nullable", "period",
    "source_column", "target_type", "time_semantics", "unit",
)


def mapping_hashes(fields: DataFrame, versions: DataFrame | None = None, key: str = "mapping_version_id") -> DataFrame:
    """SHA-256 of each mapping's canonical JSON, fields in position order.

    ``versions`` adds the version's own columns, in name order, as they stand in the mapping record.
    """
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("position", F.struct(*HASHED_FIELD).alias("f")))), lambda x: x["f"])
    grouped = fields.groupBy(key).agg(ordered.alias("fields"))
    if versions is not None:
        grouped = grouped.join(versions, key)
    payload = F.struct(*sorted(grouped.columns))
    return grouped.select(key, F.concat(F.lit("sha256:"), F.sha2(canonical_json(payload), 256)).alias("mapping_hash"))
