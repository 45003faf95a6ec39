"""Header catalogue: normal form, repeats, concept suggestions, schema fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioguard.fixed_values import CONCEPT_CAPABILITIES, CONCEPTS, HEADER_ALIASES, NORMALIZATION_VERSION
from folioguard.functions.scalars import normalized_header


def normalize_headers(headers: DataFrame, column: str = "source_column") -> DataFrame:
    return headers.withColumn("normalized_column", normalized_header(F.col(column)))


def suffix_collisions(headers: DataFrame, dataset: Sequence[str], position: str = "position") -> DataFrame:
    """``unique_column``: the normal form, with ``_2``, ``_3`` on repeats inside a dataset.

    A dataset holds at most a few hundred headers, so each window partition stays that small.
    """
    repeat = F.row_number().over(Window.partitionBy(*dataset, "normalized_column").orderBy(position))
    return headers.withColumn(
        "unique_column",
        F.when(repeat == 1, F.col("normalized_column")).otherwise(
            F.concat_ws("_", F.col("normalized_column"), repeat.cast("string"))))


def concept_dimension(spark: SparkSession) -> DataFrame:
    """Known names and the concept each suggests: 25 rows."""
    known = [(c, c, 1.0) for c in CONCEPTS] + [(alias, c, 0.85) for alias, c in HEADER_ALIASES.items()]
    return spark.createDataFrame(known, "normalized_column string, suggested_concept string, confidence double")


def capability_dimension(spark: SparkSession) -> DataFrame:
    """Concept to dependent capability: at most two rows per concept."""
    pairs = [(c, capability) for c, found in CONCEPT_CAPABILITIES.items() for capability in found]
    return spark.createDataFrame(pairs, "concept string, capability string")


def suggest_concepts(headers: DataFrame) -> DataFrame:
    """Exact name 1.0, known alias 0.85, else unmapped; a suggestion always awaits confirmation."""
    known = F.broadcast(concept_dimension(headers.sparkSession))  # fixed 25 rows
    found = headers.join(known, "normalized_column", "left")
    hit = F.col("suggested_concept").isNotNull()
    return found.withColumns({
        "confidence": F.coalesce("confidence", F.lit(0.0)),
        "status": F.when(hit, "suggested").otherwise("unmapped"),
        "confirmation_required": hit,
    })


def concept_capabilities(fields: DataFrame, concept: str = "concept") -> DataFrame:
    """Each mapped field with the capabilities that depend on it."""
    known = F.broadcast(capability_dimension(fields.sparkSession).withColumnRenamed("concept", "__c"))  # fixed rows
    return fields.join(known, F.col(concept) == F.col("__c")).drop("__c")


def schema_fingerprints(headers: DataFrame, dataset: Sequence[str], position: str = "position") -> DataFrame:
    """SHA-256 of the canonical JSON of each dataset's fields, in column order."""
    field = F.struct(
        F.col(position).alias("p"),
        F.struct(
            F.col("normalized_column").alias("normalized"),
            F.lit(False).alias("nullable"),
            F.lit("string").alias("physical_type"),
            F.col("source_column").alias("source"),
        ).alias("f"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(field)), lambda x: x["f"])
    payload = F.to_json(F.struct(ordered.alias("fields"), F.lit(NORMALIZATION_VERSION).alias("normalization_version")))
    return headers.groupBy(*dataset).agg(
        F.sha2(payload, 256).alias("schema_fingerprint"), F.count("*").alias("column_count"))


def canonical_json(value: Column) -> Column:
    """JSON with nulls written out; the struct's fields must already be in key order."""
    return F.to_json(value, {"ignoreNullFields": "false"})
