"""Lexical Parquet artifacts with lineage, and the catalogue that vouches for them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioguard.fixed_values import NORMALIZATION_VERSION
from folioguard.operators.headers import schema_fingerprints
from folioguard.operators.profile import fingerprint

ROW_GROUP_BYTES = 128 * 1024 * 1024


class ArtifactMismatch(ValueError):
    """The stored artifact is not the one the catalogue describes."""


def header_rows(spark: SparkSession, dataset: str, sources: Sequence[str], names: Sequence[str]) -> DataFrame:
    rows = [(dataset, i, s, n) for i, (s, n) in enumerate(zip(sources, names), 1)]
    return spark.createDataFrame(
        rows, "dataset_version_id string, position int, source_column string, normalized_column string")


def write_artifact(
    lexical: DataFrame, path: str, dataset_version_id: str, sources: Sequence[str] | None = None
) -> DataFrame:
    """Write an all-text table with lineage in its schema; returns its catalogue row.

    Part files are not byte-stable, so the content fingerprint identifies the artifact, not a file hash.
    """
    spark = lexical.sparkSession
    names = lexical.columns
    written_as = list(sources or names)
    headers = header_rows(spark, dataset_version_id, written_as, names)
    schema = schema_fingerprints(headers, ["dataset_version_id"]).first()["schema_fingerprint"]
    marked = lexical.select([
        F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n, metadata={
            "source": source, "normalization_version": NORMALIZATION_VERSION, "schema_fingerprint": schema})
        for n, source in zip(names, written_as)
    ])
    marked.write.options(compression="zstd", **{"parquet.block.size": ROW_GROUP_BYTES}).parquet(path)
    stored = spark.read.parquet(path)
    content = fingerprint(stored).first()["dataset_reference"]
    return stored.agg(
        F.lit(dataset_version_id).alias("dataset_version_id"),
        F.lit(path).alias("artifact_path"),
        F.lit(content).alias("content_fingerprint"),
        F.lit(schema).alias("schema_fingerprint"),
        F.count("*").alias("row_count"),
        F.lit(len(names)).alias("column_count"),
    )


def read_artifact(catalogue_row: DataFrame, mapped: Sequence[str]) -> DataFrame:
    """The mapped columns of a catalogued artifact, once its lineage and shape agree."""
    spark = catalogue_row.sparkSession
    entry = catalogue_row.first()
    stored = spark.read.parquet(entry["artifact_path"])
    marks = {f.metadata.get("schema_fingerprint") for f in stored.schema.fields}
    if marks != {entry["schema_fingerprint"]} or len(stored.columns) != entry["column_count"]:
        raise ArtifactMismatch("normalized_schema_mismatch")
    if not set(mapped) <= set(stored.columns) or stored.count() != entry["row_count"]:
        raise ArtifactMismatch("normalized_schema_mismatch")
    return stored.select(*sorted(mapped))


def verify_content(catalogue_row: DataFrame) -> bool:
    """True while the stored rows are the ones that were catalogued."""
    entry = catalogue_row.first()
    stored = catalogue_row.sparkSession.read.parquet(entry["artifact_path"])
    return fingerprint(stored).first()["dataset_reference"] == entry["content_fingerprint"]
