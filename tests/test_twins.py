"""Registered queries next to their SQL twins; all of them with FOLIOGUARD_ALL_TWINS=1."""

import os

import pytest

from folioguard.plans import ORACLES, QUERIES
from tools.check_twins import compare, connect

CORE = (
    "a19_rule_coverage", "r1_r8_rule_statuses", "r10_anomaly_score", "a28_issues", "a4_a9_metric_table",
    "a13_monthly_amount", "a24_amount_distribution", "a34_privacy_findings", "s2_lexical_csv", "s4_file_audit",
    "h4_mapping_checks", "h7_f16_mapping_hashes", "u1_a30_all_issues", "j4_a33_effective_quality",
    "j5_overlapping_overrides", "w7_audit_chain", "m8_score_measures", "x1_x3_admission", "q2_answers",
)
NAMES = sorted(ORACLES) if os.environ.get("FOLIOGUARD_ALL_TWINS") else CORE


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, sf_dir, name):
    trouble = compare(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name])
    assert trouble in (None, "no rows")


def test_twins_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() == 7
    assert driver.queries().keys() >= driver.oracle_sql().keys()
