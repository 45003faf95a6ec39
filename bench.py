"""Headline timings, one JSON line.

The portfolio view is staged once as a Parquet table (timed as ``load_portfolio``); the other portfolio queries read
that table, as the calculations they are compared with start from loaded rows. ``*_x20`` repeats the staged rows
twenty times under new keys and amounts, which is above the bound for the small-input plans. Every query runs
``BENCH_RUNS`` times after a warm-up and the best run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from folioguard.fixed_values import RULESET_VERSION  # noqa: E402
from folioguard.operators import audit, metrics, overrides, privacy, profile, rules, summaries, validation  # noqa: E402
from folioguard.plans.flows import admission_requests, policies  # noqa: E402
from folioguard.plans.governance import BY, FIELDS  # noqa: E402
from folioguard.session import build_session, staging_path  # noqa: E402
from folioguard.sources.catalogue import derive, lexical_dataset  # noqa: E402
from folioguard.sources.portfolio import portfolio, table  # noqa: E402
from folioguard.streaming import admission  # noqa: E402

CPUS = int(os.environ.get("BENCH_CPUS", "8"))
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
COPIES = int(os.environ.get("BENCH_COPIES", "20"))


def stage(spark, rows, label, files):
    path = staging_path(spark, label)
    rows.repartition(files).write.parquet(path)
    return spark.read.parquet(path)


def repeated(rows, copies):
    """The rows ``copies`` times with keys and amounts of their own."""
    copy = F.col("__copy")
    return (
        rows.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        .withColumns({
            "transaction_id": F.concat("transaction_id", F.lit("-"), copy.cast("string")),
            "transaction_amount": F.round(F.col("transaction_amount") * (1 + copy / 1000), 2),
        })
        .drop("__copy"))


def main() -> None:
    spark = build_session(
        "folioguard-bench",
        master=f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": str(CPUS),
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.sql.execution.arrow.pyspark.enabled": "true",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    seconds: dict[str, float] = {}
    rows_per_second: dict[str, int] = {}

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    def timed(name, work, n_rows=None, runs=RUNS, warm=True):
        if warm:
            work()
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            work()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        if n_rows:
            rows_per_second[name] = int(n_rows / best)

    held = {}

    def load():
        held["portfolio"] = stage(spark, portfolio(spark, SF_DIR), "bench", CPUS)

    timed("load_portfolio", load)
    folio = held["portfolio"]
    n = folio.count()
    rows_per_second["load_portfolio"] = int(n / seconds["load_portfolio"])

    def rule_run():
        return rules.explain_rules(rules.rule_statuses(folio))

    timed("rule_coverage", lambda: rules.rule_coverage(rules.rule_statuses(folio)).collect(), n)
    timed("rule_evaluation", lambda: drain(rules.detect_anomalies(folio)), n)
    timed("kpi_record", lambda: summaries.kpi_record(folio).collect(), n)
    timed("assessment", lambda: profile.assess(folio).collect(), n)
    timed("governed_metrics", lambda: metrics.metric_table(folio, rule_run(), RULESET_VERSION).collect(), n)
    timed("monthly_amount", lambda: summaries.monthly_amount(folio).collect(), n)
    timed("anomaly_summary", lambda: rules.anomaly_summary(rule_run()).collect(), n)
    timed("fingerprint", lambda: profile.fingerprint(folio).collect(), n)

    documents = table(spark, SF_DIR, "documents")
    timed("privacy_findings", lambda: privacy.privacy_findings(documents).collect(), documents.count())
    lexical = lexical_dataset(spark, SF_DIR)
    timed("validation_runs", lambda: validation.validate(lexical, FIELDS, BY).collect(), lexical.count())
    events = table(spark, SF_DIR, "events")
    requests = admission.with_policy(admission_requests(events).drop("ts"), policies(spark))
    timed("admission", lambda: drain(admission.admit(requests)), events.count())
    timed("audit_chain", lambda: drain(audit.build_chain(derive(spark, SF_DIR, "audit_payloads"))), events.count())
    moment = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    timed("effective_quality", lambda: drain(overrides.effective_quality(
        derive(spark, SF_DIR, "validation_runs"), derive(spark, SF_DIR, "override_requests"), moment)))

    if COPIES > 1:
        large = stage(spark, repeated(folio, COPIES), "bench-large", 2 * CPUS)
        m = large.count()
        timed(f"rule_coverage_x{COPIES}", lambda: rules.rule_coverage(rules.rule_statuses(large)).collect(), m, 1,
              False)
        timed(f"rule_evaluation_x{COPIES}", lambda: drain(rules.detect_anomalies(large)), m, 1, False)
        timed(f"kpi_record_x{COPIES}", lambda: summaries.kpi_record(large).collect(), m, 1, False)
        timed(f"assessment_x{COPIES}", lambda: profile.assess(large).collect(), m, 1, False)

    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "portfolio_rows": n,
        "rows_per_second": rows_per_second,
        "cores": CPUS,
        "best_of": RUNS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
