"""Demonstration portfolio generated on the executors: the same shares and shapes, not the same random draws."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioguard.functions.scalars import band
from folioguard.sources.csv import read_trusted

# --- fixed values: categories and their shares ---
SEGMENTS = (("Retail", 0.28), ("Market Trader", 0.24), ("SME", 0.19), ("Agriculture", 0.14), ("Services", 0.15))
EMPLOYMENT = (
    ("Salaried", 0.36), ("Self-employed", 0.33), ("Contract", 0.13), ("Informal", 0.13), ("Unemployed", 0.05))
REGIONS = ("Lagos", "Abuja", "Kano", "Accra", "Kumasi", "Nairobi", "Kigali")
BUSINESS_TYPES = ("Shop", "Transport", "Food", "Education", "Health", "Fintech Agent")
FIRST_DAY, DAYS = "2025-01-01", 516


def pick(u: Column, shares: tuple[tuple[str, float], ...]) -> Column:
    """Category by cumulative share of a uniform draw."""
    out, top = F.lit(shares[-1][0]), 1.0
    for name, share in reversed(shares):
        top -= share
        out = F.when(u < top + share, name).otherwise(out) if top + share < 1 - 1e-9 else F.lit(name)
    return out


def even(u: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.floor(u * len(names)) + 1).cast("int"))


def skewed_draws(rows: DataFrame, seed: int) -> DataFrame:
    """``gamma_amount`` and ``poisson_count``, which Spark has no function for, drawn per row key."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            gammas, counts = np.empty(len(batch)), np.empty(len(batch), dtype="int64")
            for i, key in enumerate(batch["id"].to_numpy()):
                # One generator per row: a task that runs again draws the same values.
                rng = np.random.default_rng([seed, int(key)])
                gammas[i], counts[i] = rng.gamma(2.4, 18500), rng.poisson(18)
            yield batch.assign(gamma_amount=gammas, poisson_count=counts)

    return rows.mapInPandas(draw, "id long, gamma_amount double, poisson_count long")


def generate(spark: SparkSession, rows: int = 5000, seed: int = 42) -> DataFrame:
    """``rows`` transactions with missing incomes and employments, and repeated rows."""

    def u(i: int) -> Column:
        # A uniform draw that depends on seed, draw and row only, not on the partitioning.
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(i), F.col("id")), F.lit(2**52)) / float(2**52)

    def normal(i: int) -> Column:
        return F.sqrt(-2 * F.log(1 - u(i))) * F.cos(2 * np.pi * u(i + 1))

    def bounded(c: Column, low: float, high: float) -> Column:
        return F.least(F.greatest(c, F.lit(low)), F.lit(high))

    # A share of the rows repeats the row before it: same source key, same draws.
    step = max(rows // max(rows // 500, 4), 2)
    keys = spark.range(rows).select(
        F.when((F.col("id") % step == step - 1), F.col("id") - 1).otherwise(F.col("id")).alias("id"))
    base = skewed_draws(keys, seed)
    base = base.withColumns({
        "income": bounded(F.round(F.exp(12.0 + 0.42 * normal(1)), 0), 65000.0, 950000.0),
        "segment": pick(u(3), SEGMENTS),
        "employment": pick(u(4), EMPLOYMENT),
        "repayment_history_score": F.round(bounded(72 + 18 * normal(5), 5.0, 100.0), 1),
    })
    base = base.withColumns({
        "existing_debt": F.round(F.col("income") * (0.02 + 0.63 * u(7)), 0),
        "loan_amount": F.round(F.col("income") * (0.18 + 2.22 * u(8)), 0),
        "transaction_amount": F.round(
            F.col("gamma_amount") * F.when(F.col("segment") == "SME", 1.45).when(
                F.col("segment") == "Retail", 1.05).otherwise(0.9), 0),
    })
    logit = (
        -2.4
        + 1.25 * F.col("loan_amount") / F.col("income")
        + 1.05 * F.col("existing_debt") / F.col("income")
        + 0.95 * F.col("employment").isin("Informal", "Unemployed").cast("double")
        - 0.035 * F.col("repayment_history_score")
        + 0.38 * normal(9)
    )
    base = base.withColumn("p", 1 / (1 + F.exp(-logit)))
    base = base.withColumns({
        "defaulted": (u(11) < F.col("p")).cast("int"),
        "risk_score": bounded(F.round(F.col("p") * 100, 1), 1.0, 99.0),
    })
    category = (
        F.when(u(12) < 1 / 160, "Duplicate customer details")
        .when(F.col("loan_amount") > F.col("income") * 1.55, "Loan-to-income mismatch")
        .when(F.col("repayment_history_score") < 42, "High-risk repayment pattern")
        .when(F.col("transaction_amount") > 3 * 2.4 * 18500, "Unusually high amount")
        .otherwise("Normal")
    )
    return base.select(
        F.concat(F.lit("CUST-"), F.floor(10000 + 3500 * u(13)).cast("string")).alias("customer_id"),
        F.concat(F.lit("TXN-"), (F.lit(200000) + F.col("id")).cast("string")).alias("transaction_id"),
        F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), F.floor(u(14) * DAYS).cast("int")), "yyyy-MM-dd").alias(
            "date"),
        "segment",
        even(u(15), REGIONS).alias("region"),
        even(u(16), BUSINESS_TYPES).alias("business_type"),
        F.when(u(17) >= 1 / 280, F.col("employment")).alias("employment_status"),
        F.when(u(18) >= 1 / 240, F.col("income")).alias("income"),
        "loan_amount", "existing_debt", "transaction_amount",
        (F.col("poisson_count") + 1 + F.floor(u(19) * 17)).cast("int").alias("transaction_frequency"),
        F.floor(2 + 94 * u(20)).cast("int").alias("account_age_months"),
        "repayment_history_score", "defaulted",
        F.when(F.col("defaulted") == 1, "Defaulted").otherwise("Repaid").alias("repayment_status"),
        "risk_score", band(F.col("risk_score")).alias("risk_level"), category.alias("suspicious_category"))


def load_demo(spark: SparkSession, path: str) -> DataFrame:
    """The demonstration CSV when it is there, else generated rows."""
    if os.path.exists(path):
        return read_trusted(spark, path)
    return generate(spark)
