"""Governance tables derived from the supplied tables: versions, mappings, runs, issues, overrides, events.

Every column is one SQL expression that Spark and the checking engine both read, so both derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioguard.sources.portfolio import table

ROWS_PER_TASK = 250_000
_ORG = "concat('org-', cast({k}%5 as varchar(20)))"
_WS = "concat('ws-', cast({k}%25 as varchar(20)))"
_TENANT = {"organization_id": _ORG, "workspace_id": _WS}


def _tenant(key: str) -> dict[str, str]:
    return {name: text.format(k=key) for name, text in _TENANT.items()}


def text(key: str, prefix: str) -> str:
    return f"concat('{prefix}-', cast({key} as varchar(20)))"


# name -> (source table, explode count expression or None, {column: expression}); ``position`` is the exploded number.
TABLES: dict[str, tuple[str, str | None, dict[str, str]]] = {
    "dataset_versions": ("orders", None, {
        "dataset_version_id": text("o_orderkey", "version"),
        **_tenant("o_custkey"),
        "dataset_id": text("o_custkey", "dataset"),
        "status": "case o_orderkey%8 when 0 then 'upload_pending' when 1 then 'uploaded' when 2 then 'scanning' "
                  "when 3 then 'mapping_required' when 4 then 'validating' when 5 then 'ready' when 6 then 'failed' "
                  "else 'quarantined' end",
        "revision": "cast(1+o_orderkey%3 as int)",
        "object_key": text("o_orderkey", "object"),
        "expected_bytes": "cast(o_totalprice as bigint)",
        "content_type": "'text/csv'",
        "expected_sha256": "sha256({t})".replace("{t}", text("o_orderkey", "object")),
    }),
    "stored_objects": ("orders", None, {
        "object_key": "case when o_orderkey%11=0 then concat('lost-', cast(o_orderkey as varchar(20))) else "
                      + text("o_orderkey", "object") + " end",
        "content_length": "cast(o_totalprice as bigint)+case when o_orderkey%13=0 then 1 else 0 end",
        "content_type": "case when o_orderkey%2=0 then 'Text/CSV' when o_orderkey%17=1 then 'text/plain' "
                        "else 'text/csv' end",
        "checksum_sha256": "upper(sha256({t}))".replace("{t}", text("o_orderkey", "object")),
    }),
    "artifacts": ("orders", None, {
        "dataset_version_id": text("o_orderkey", "version"),
        **_tenant("o_custkey"),
        "artifact_sha256": "sha256({t})".replace("{t}", text("o_orderkey", "artifact")),
        "schema_fingerprint": "sha256({t})".replace("{t}", text("o_custkey", "schema")),
        "row_count": "cast(1+o_orderkey%1000 as bigint)",
        "column_count": "cast(1+o_orderkey%19 as int)",
    }),
    # The mapping of an order's dataset version; one in five versions has none yet.
    "mapping_versions": ("orders", None, {
        "mapping_version_id": text("o_orderkey", "mapping"),
        "dataset_version_id": "case when o_orderkey%5=0 then concat('unknown-', cast(o_orderkey as varchar(20))) else "
                              + text("o_orderkey", "version") + " end",
        **_tenant("o_custkey"),
        "schema_fingerprint": "sha256({t})".replace("{t}", text("o_custkey", "schema")),
        "confirmed_by": text("o_custkey%40", "actor"),
        "reason": "case when o_orderkey%2=0 then 'Confirmed against the source system.' else 'Reviewed by the owner.' "
                  "end",
    }),
    # Six fields per customer mapping, some of which break a rule.
    "mapping_fields": ("customer", "6", {
        "mapping_version_id": text("c_custkey", "mapping"),
        "position": "position",
        "source_column": "case when c_custkey%29=0 and position=6 then 'Unknown Column' else "
                         "concat('Column ', cast(case when c_custkey%31=0 and position=2 then 1 else position end as "
                         "varchar(20))) end",
        "normalized_column": "case when c_custkey%29=0 and position=6 then 'unknown_column' else "
                             "concat('column_', cast(case when c_custkey%31=0 and position=2 then 1 else position end "
                             "as varchar(20))) end",
        "concept": "case when c_custkey%37=0 and position=5 then 'customer_id' else case position "
                   "when 1 then 'customer_id' when 2 then 'date' when 3 then 'transaction_amount' "
                   "when 4 then 'income' when 5 then 'defaulted' else "
                   "case when c_custkey%3=0 then 'repayment_status' else 'currency' end end end",
        "target_type": "case when c_custkey%23=0 and position=2 then 'string' else case position when 1 then 'string' "
                       "when 2 then 'date' when 3 then 'decimal' when 4 then "
                       "case when c_custkey%19=0 then 'integer' else 'decimal' end "
                       "when 5 then 'boolean' else 'string' end end",
        "nullable": "position>3",
        "unit": "case when c_custkey%17=0 and position=6 then 'category' else case position when 1 then 'identifier' "
                "when 2 then 'temporal' when 3 then 'money' when 4 then 'money' when 5 then 'outcome' else "
                "case when c_custkey%3=0 then 'category' else 'currency_code' end end end",
        "currency_mode": "case position when 3 then case when c_custkey%2=0 then 'fixed' else 'column' end "
                         "when 4 then 'fixed' else 'not_applicable' end",
        "currency_code": "case when position=3 and c_custkey%2=0 then case when c_custkey%13=0 then 'ngn' else 'NGN' "
                         "end when position=4 then 'NGN' when position=1 and c_custkey%41=0 then 'NGN' end",
        "period": "case when position=3 then case when c_custkey%43=0 then 'monthly' else 'transaction' end "
                  "when position=4 then 'monthly' else 'not_applicable' end",
        "amount_direction": "case when position=3 then case when c_custkey%47=0 then 'not_applicable' else 'signed' "
                            "end else 'not_applicable' end",
        "time_semantics": "case when position=2 then case when c_custkey%53=0 then 'not_applicable' else 'event_time' "
                          "end else 'not_applicable' end",
    }),
    "artifact_fields": ("customer", "6", {
        "mapping_version_id": text("c_custkey", "mapping"),
        "position": "position",
        "source_column": "concat('Column ', cast(position as varchar(20)))",
        "normalized_column": "concat('column_', cast(position as varchar(20)))",
    }),
    "validation_runs": ("orders", None, {
        "validation_run_id": text("o_orderkey", "run"),
        **_tenant("o_custkey"),
        "dataset_version_id": text("o_orderkey", "version"),
        "mapping_version_id": "case when o_orderkey%7=0 then 'none' else " + text("o_orderkey", "mapping") + " end",
        "composite_score": "cast(o_orderkey%101 as double)",
        "verdict": "case when o_orderkey%4=0 then 'blocked' else 'passed' end",
        "block_count": "cast(case when o_orderkey%4=0 then 1 else 0 end as bigint)",
        "warn_count": "cast(1+o_orderkey%3 as bigint)",
        "info_count": "cast(o_orderkey%2 as bigint)",
    }),
    "validation_issues": ("orders", "3", {
        "validation_run_id": text("o_orderkey", "run"),
        "issue_ordinal": "position",
        "rule_id": "case position when 1 then 'missing_values' when 2 then 'duplicate_rows' else "
                   "'invalid_event_date' end",
        "rule_version": "'dataset-quality/1.0.0'",
        "severity": "case when (o_orderkey+position)%6=0 then 'block' when (o_orderkey+position)%6=1 then 'info' "
                    "else 'warn' end",
        "override_allowed": "(o_orderkey+position)%6>2",
        "affected_count": "cast(o_orderkey%50 as bigint)",
    }),
    # Events become override requests: about three per run, on one of its three issues.
    "override_requests": ("events", None, {
        "override_id": text("event_id", "override"),
        **_tenant("event_id-event_id%3"),
        "validation_run_id": text("cast((event_id-event_id%3)/3 as bigint)", "run"),
        "issue_ordinal": "cast(1+(event_id-event_id%2)%3 as int)",
        "overridden_by": text("user_id", "actor"),
        "overridden_at": "ts",
        "expires_at": "case event_id%6 when 0 then ts + interval 10 minute when 1 then ts + interval 15 minute "
                      "when 2 then ts + interval 1 day when 3 then ts + interval 30 day when 4 then ts + interval "
                      "90 day else ts + interval 91 day end",
        "request_id": text("event_id-event_id%4", "request"),
        "reason": "case event_id%5 when 0 then 'too short' when 1 then ' padded reason text ' when 2 then "
                  "'Accepted until the source is corrected.' else 'Reviewed with the data owner.' end",
    }),
    "jobs": ("orders", None, {
        "job_id": "case when o_orderkey%9=0 then concat('other-', cast(o_orderkey as varchar(20))) else "
                  + text("o_orderkey", "run") + " end",
        "dataset_version_id": text("o_orderkey", "version"),
        **_tenant("o_custkey"),
        "job_type": "case when o_orderkey%3=0 then 'dataset.scan' else 'dataset.validate' end",
        "created_at": "o_orderdate",
        "input_reference": "case when o_orderkey%6=0 then '{\"dataset_version_id\":\"x\"}' else "
                           "concat('{\"dataset_version_id\":\"', " + text("o_orderkey", "version")
                           + ", '\",\"mapping_version_id\":\"', " + text("o_orderkey", "mapping")
                           + ", '\",\"schema_fingerprint\":\"', "
                           + "sha256({t})".replace("{t}", text("o_custkey", "schema")) + ", '\"}') end",
    }),
    "audit_payloads": ("events", None, {
        "organization_id": text("user_id%5", "org"),
        "workspace_id": text("user_id", "ws"),
        "audit_sequence": "event_id",
        "event_id": text("event_id", "event"),
        "occurred_at": "ts",
        "actor_id": text("user_id%7", "actor"),
        "action": "concat('dataset.', event_type)",
        "target_type": "'dataset_version'",
        "target_id": text("event_id%1000", "version"),
        "request_id": text("event_id", "request"),
        "reason": "props",
        "before_hash": "concat('sha256:', sha256(event_type))",
        "after_hash": "concat('sha256:', sha256(cast(value as varchar(40))))",
    }),
}



def _dealt(rows: DataFrame, copies: int) -> DataFrame:
    """``rows`` dealt evenly so that no task makes many more than ``ROWS_PER_TASK`` rows of them.

    A small file is read by one task, and the rows it stands for may be many times its size. Parquet keeps the count.
    """
    parts = -(-rows.count() * copies // ROWS_PER_TASK)
    if parts <= 1:
        return rows
    return rows.withColumn("__deal", F.monotonically_increasing_id()).repartition(parts, "__deal").drop("__deal")


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Governance table ``name`` as Spark derives it."""
    source, copies, columns = TABLES[name]
    rows = table(spark, sf_dir, source)
    if copies:
        rows = _dealt(rows, int(copies)).withColumn("position", F.explode(F.sequence(F.lit(1), F.lit(int(copies)))))
    return rows.select([F.expr(spark_sql(e)).alias(n) for n, e in columns.items()])


def spark_sql(expression: str) -> str:
    """The shared expression in Spark's spelling: SHA-256 is the only difference."""
    out, rest = "", expression
    while "sha256(" in rest:
        head, tail = rest.split("sha256(", 1)
        depth = 1
        for i, ch in enumerate(tail):
            depth += (ch == "(") - (ch == ")")
            if depth == 0:
                break
        out += f"{head}sha2({spark_sql(tail[:i])}, 256)"
        rest = tail[i + 1:]
    return out + rest


def derived_sql(name: str) -> str:
    """The same table as SQL text for the checking engine."""
    source, copies, columns = TABLES[name]
    origin = source
    if copies:
        origin = f"(select *, cast(unnest(generate_series(1,{copies})) as int) as position from {source})"
    return f"select {', '.join(f'{e} as {n}' for n, e in columns.items())} from {origin}"


# A lexical dataset under source headers: twelve versions, each with its own defects.
LEXICAL = {
    "dataset_version_id": text("o_custkey%12", "version"),
    "client_id": "case when o_custkey%12=3 and o_orderkey%101=0 then '   ' else "
                 "concat(' CUST-', cast(o_custkey as varchar(20)), ' ') end",
    "txn_id": text("o_orderkey", "TXN"),
    "txn_date": "case o_orderkey%8 when 1 then replace({d},'-','/') when 2 then concat(substr({d},6,2),'/',"
                "substr({d},9,2),'/',substr({d},1,4)) when 3 then replace({d},'-','') when 4 then "
                "concat({d},' 10:30:00') when 5 then 'soon' when 6 then '10:30' else {d} end",
    "txn_value": "case o_orderkey%9 when 0 then '' when 1 then 'abc' when 2 then concat('  ', "
                 "cast(o_orderkey as varchar(20)), ' ') when 3 then '1,000' when 4 then "
                 "concat(cast(o_orderkey as varchar(20)),'e0') when 5 then 'nan' when 6 then '1d' else "
                 "cast(o_orderkey as varchar(20)) end",
    "ccy": "case when o_orderkey%2=0 then 'NGN' else ' ngn ' end",
    "monthly_income": "concat('+', cast(o_custkey as varchar(20)), '.25')",
    "repayment_score": "case when o_custkey%12=5 then case o_orderkey%4 when 0 then '12' when 1 then '12.0' "
                       "when 2 then '12.5' else 'x' end else cast(o_orderkey%101 as varchar(20)) end",
    "is_default": "case o_orderkey%8 when 0 then '0' when 1 then '1' when 2 then 'true' when 3 then 'FALSE' "
                  "when 4 then ' 1 ' when 5 then 'maybe' when 6 then '' else '2' end",
    "loan_status": "case o_orderkey%5 when 0 then 'Repaid' when 1 then ' DEFAULTED ' when 2 then 'charged off' "
                   "when 3 then 'mystery' else '' end",
}


def lexical_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dealt(table(spark, sf_dir, "orders"), 1)
    day = "date_format(o_orderdate,'yyyy-MM-dd')"
    return rows.select([F.expr(e.replace("{d}", day)).alias(n) for n, e in LEXICAL.items()])


def lexical_sql() -> str:
    day = "strftime(o_orderdate,'%Y-%m-%d')"
    columns = ", ".join(f"{e.replace('{d}', day)} as {n}" for n, e in LEXICAL.items())
    return f"select {columns}, o_orderkey k, o_custkey%12 v from orders"
