from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from folioguard.session import build_session  # noqa: E402

SF_DIR = os.environ.get("FOLIOGUARD_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "folioguard-tests",
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


PORTFOLIO = (
    "customer_id string, transaction_id string, date string, segment string, region string, business_type string, "
    "employment_status string, income double, loan_amount double, existing_debt double, transaction_amount double, "
    "transaction_frequency int, account_age_months int, repayment_history_score double, defaulted int, "
    "currency string"
)


def portfolio_row(**changes):
    row = {
        "customer_id": "CUST-1", "transaction_id": "TXN-1", "date": "2026-01-01", "segment": "Retail",
        "region": "Lagos", "business_type": "Shop", "employment_status": "Salaried", "income": 100000.0,
        "loan_amount": 50000.0, "existing_debt": 10000.0, "transaction_amount": 1200.0, "transaction_frequency": 12,
        "account_age_months": 24, "repayment_history_score": 80.0, "defaulted": 0, "currency": "NGN",
    }
    return {**row, **changes}


def frame(spark, rows, schema=PORTFOLIO):
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
