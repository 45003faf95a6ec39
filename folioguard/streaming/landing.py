"""Incremental file intake: files that land are audited once and normalised to lexical Parquet."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioguard.operators.tables import append_absent
from folioguard.session import materialize
from folioguard.sources.csv import read_lexical
from folioguard.sources.intake import FilePolicy, audit_files, audit_large_files, empty_files

# Files are read in ranges, so nothing bounds what lands.
UNBOUNDED = FilePolicy(max_bytes=2**60, max_rows=2**63 - 1, max_columns=2**31 - 1)
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def normalize_accepted(spark: SparkSession, audited: DataFrame, out: str) -> None:
    """Write the rows of accepted files, one Parquet folder per header set, files kept apart by digest.

    The number of files in a call is bounded by the trigger, so the list of their paths is too.
    """
    accepted = audited.where("error_code is null").select("path", "delimiter", "sha256", "normalized_headers")
    groups: dict[tuple, list] = {}
    for r in accepted.collect():
        groups.setdefault((r["delimiter"], tuple(r["normalized_headers"])), []).append(r)
    for (delimiter, headers), files in groups.items():
        digests = spark.createDataFrame([(f["path"], f["sha256"]) for f in files], "__path string, sha256 string")
        rows = read_lexical(
            spark, [f["path"] for f in files], delimiter, rename=lambda written, h=headers: _as_audited(written, h), path_column="__path")
        _write_group(rows, digests, f"{out}/{header_folder(headers)}")


def header_folder(headers: Sequence[str]) -> str:
    """The folder of a header set: named by a digest of all headers, in order."""
    return "headers-" + hashlib.sha256("\n".join(headers).encode("utf-8")).hexdigest()


def _as_audited(written: list[str], headers: Sequence[str]) -> list[str]:
    if len(written) != len(headers):
        raise ValueError(f"the audit saw {len(headers)} headers, the reader {len(written)}")
    return list(headers)


def _write_group(rows: DataFrame, digests: DataFrame, path: str) -> None:
    joined = rows.join(F.broadcast(digests), "__path").drop("__path")  # one row per file of the trigger
    joined.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
        "compression", "zstd").partitionBy("sha256").parquet(path)


def land(
    spark: SparkSession, landing: str, out: str, checkpoint: str, policy: FilePolicy = UNBOUNDED,
    files_per_trigger: int = 1000, report: FilePolicy = FilePolicy(), range_bytes: int | None = None,
) -> StreamingQuery:
    """Process what has landed and stop.

    Files beyond ``policy`` are refused. Those beyond the size, columns or rows of ``report`` land whole; ``over_limit`` of
    their audit row names the bound. A file is audited and read in ranges, so its size is no bound.
    The checkpoint remembers finished files. A micro-batch that is delivered twice changes nothing: the audit row is
    appended only if its path and digest are new, and a file's rows replace the partition named by its digest.
    """
    files = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_trigger).load(landing))

    def record(audited: DataFrame) -> None:
        over = F.when(F.col("length") > report.max_bytes, "file_too_large").when(
            F.col("column_count") > report.max_columns, "too_many_columns").when(
            F.col("data_rows") > report.max_rows, "too_many_rows")
        flat = audited.withColumns({
            "normalized_headers": F.array_join("normalized_headers", "|"), "over_limit": over})
        append_once(flat, f"{out}/audit", ["path", "sha256"])

    def process(batch: DataFrame, _: int) -> None:
        paths = [r["path"] for r in batch.select("path").collect()]  # bounded by the trigger
        if not paths:
            return
        session = batch.sparkSession
        audited = materialize(audit_large_files(session, paths, policy, range_bytes, with_empty=False), "audited")
        normalize_accepted(session, audited, f"{out}/normalized")
        record(audited)

    # The stream never sees empty files, so they are recorded on the way in.
    empty = empty_files(spark, landing)
    if not empty.isEmpty():
        record(audit_files(empty, policy))

    return files.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def append_once(batch: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """At-least-once delivery made idempotent by key."""
    return append_absent(batch, path, keys)
