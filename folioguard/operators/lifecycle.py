"""Consistency of dataset versions with artifacts, mappings, jobs, runs and stored objects."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


TENANT_KEY = ["dataset_version_id", "organization_id", "workspace_id"]
REFERENCE_KEYS = ("dataset_version_id", "mapping_version_id", "schema_fingerprint")
REFERENCE_TYPE = "map<string,string>"


def validation_context(
    versions: DataFrame, artifacts: DataFrame, mappings: DataFrame, runs: DataFrame
) -> DataFrame:
    """Version with artifact and mapping of one tenant, and the run of that mapping if there is one."""
    found = (
        versions.select(*TENANT_KEY, "revision", "status")
        .join(artifacts.select(*TENANT_KEY, "artifact_sha256", "row_count", "column_count", F.col(
            "schema_fingerprint")), TENANT_KEY)
        .join(mappings.select(*TENANT_KEY, "mapping_version_id", F.col("schema_fingerprint").alias("__mf")), TENANT_KEY)
    )
    found = found.where(F.col("schema_fingerprint") == F.col("__mf")).drop("__mf")
    return found.join(runs.select("mapping_version_id", "validation_run_id"), "mapping_version_id", "left")


def mapping_context(versions: DataFrame, artifacts: DataFrame) -> DataFrame:
    return versions.select(*TENANT_KEY, "dataset_id", "revision", "status").join(
        artifacts.select(*TENANT_KEY, "schema_fingerprint", "column_count"), TENANT_KEY)


def claimable_jobs(jobs: DataFrame, versions: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs whose dataset version is in a state they may run in, and the others."""
    scan = versions.where(F.col("status").isin("uploaded", "scanning")).select(*TENANT_KEY)
    waiting = versions.where(F.col("status") == "validating").select(*TENANT_KEY)
    settled = versions.where(F.col("status").isin("ready", "failed")).select(*TENANT_KEY)
    is_scan = F.col("job_type") == "dataset.scan"
    is_validate = F.col("job_type") == "dataset.validate"
    free = jobs.where(~is_scan & ~is_validate)
    scans = jobs.where(is_scan).join(scan, TENANT_KEY, "left_semi")
    first = jobs.where(is_validate).join(waiting, TENANT_KEY, "left_semi")
    own_run = runs.select(F.col("validation_run_id").alias("job_id"), *TENANT_KEY)
    again = jobs.where(is_validate).join(settled, TENANT_KEY, "left_semi").join(
        own_run, ["job_id", *TENANT_KEY], "left_semi")
    ready = free.unionByName(scans).unionByName(first).unionByName(again)
    return ready, jobs.join(ready.select("job_id"), "job_id", "left_anti")


def settled_consistently(versions: DataFrame, runs: DataFrame) -> DataFrame:
    """Versions whose status is the one their run's verdict demands."""
    joined = versions.select(*TENANT_KEY, "status").join(
        runs.select(*TENANT_KEY, "validation_run_id", "verdict"), TENANT_KEY)
    demanded = F.when(F.col("verdict") == "passed", "ready").when(F.col("verdict") == "blocked", "failed")
    return joined.where(F.col("status") == demanded)


def reconcile_uploads(reserved: DataFrame, stored: DataFrame) -> DataFrame:
    """Reserved against stored bytes, type (any case) and checksum (any case)."""
    facts = stored.select("object_key", "content_length", F.lower("content_type").alias("__type"), F.lower(
        "checksum_sha256").alias("__sum"))
    joined = reserved.join(facts, "object_key", "left")
    matches = (
        (F.col("content_length") == F.col("expected_bytes"))
        & (F.col("__type") == F.col("content_type"))
        & (F.col("__sum") == F.col("expected_sha256")))
    outcome = F.when(F.col("__sum").isNull(), "upload_missing").when(matches, "uploaded").otherwise(
        "upload_metadata_mismatch")
    return joined.select(
        "dataset_version_id", "object_key", outcome.alias("outcome"),
        F.when(outcome == "uploaded", "uploaded").when(
            outcome == "upload_metadata_mismatch", "quarantined").otherwise(F.col("status")).alias("next_status"))


def first_jobs(jobs: DataFrame) -> DataFrame:
    """Earliest job per version, ties by id."""
    return jobs.groupBy("dataset_version_id").agg(
        F.min_by(F.struct("job_id", "job_type"), F.struct("created_at", "job_id")).alias("j")).select(
        "dataset_version_id", "j.*")


def is_uuid(c: Column) -> Column:
    """Whether text spells a UUID: 32 hexadecimal digits with hyphens, braces or a ``urn:uuid:`` in any of the usual places."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "urn:|uuid:", ""), r"^[{}]+|[{}]+$", ""), "-", "")
    return F.coalesce(bare.rlike("^[0-9a-fA-F]{32}$"), F.lit(False))


def check_references(jobs: DataFrame) -> DataFrame:
    """``reference_ok`` of validation jobs: the job's type, exactly the expected keys with text in each, the job's own
    version, a digest in form, and a version and a mapping that are named by UUIDs."""
    parsed = jobs.withColumn("__r", F.from_json("input_reference", REFERENCE_TYPE))
    keys = F.map_keys("__r")
    wanted = F.array(*[F.lit(k) for k in REFERENCE_KEYS])
    exact = (F.size(F.array_except(keys, wanted)) == 0) & (F.size(F.array_except(wanted, keys)) == 0)
    own = F.element_at("__r", F.lit("dataset_version_id")) == F.col("dataset_version_id")
    digest = F.element_at("__r", F.lit("schema_fingerprint")).rlike("^[0-9a-f]{64}$")
    # A number or an object is no text, though the map above would show it as such.
    quoted = reduce(and_, [
        F.col("input_reference").rlike(rf'"{key}"\s*:\s*"') for key in REFERENCE_KEYS])
    named = is_uuid(F.element_at("__r", F.lit("dataset_version_id"))) & is_uuid(F.element_at("__r", F.lit("mapping_version_id")))
    typed = F.col("job_type") == "dataset.validate"
    ok = F.coalesce(typed & exact & own & digest & quoted & named, F.lit(False))
    return parsed.withColumn("reference_ok", ok).drop("__r")


def match_claimed_keys(jobs: DataFrame, column: str = "object_key") -> DataFrame:
    """``key_matches``: the key is well formed, and its organisation, workspace and version are those of the job."""
    parts = F.split(column, "/")
    same = reduce(and_, [F.get(parts, F.lit(at)).eqNullSafe(F.col(name)) for at, name in (
        (1, "organization_id"), (2, "workspace_id"), (4, "dataset_version_id"))])
    return jobs.withColumn("key_matches", F.coalesce(well_formed(parts) & same, F.lit(False)))


def well_formed(parts: Column) -> Column:
    component = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,127}$"
    return (
        (F.size(parts) == 6)
        & (F.get(parts, F.lit(0)) == "quarantine")
        & (F.get(parts, F.lit(5)) == "original.csv")
        & F.forall(F.slice(parts, 2, 4), lambda p: p.rlike(component)))


def parse_object_keys(rows: DataFrame, column: str = "object_key") -> DataFrame:
    """Six path parts: stage, organisation, workspace, dataset, version, file name; every id well formed."""
    parts = F.split(column, "/")
    ok = well_formed(parts)
    return rows.withColumns({
        "key_ok": F.coalesce(ok, F.lit(False)),
        "organization_id": F.get(parts, F.lit(1)),
        "workspace_id": F.get(parts, F.lit(2)),
        "destination_key": F.when(ok, F.concat(F.lit("originals/"), F.regexp_replace(column, "^quarantine/", ""))),
    })
