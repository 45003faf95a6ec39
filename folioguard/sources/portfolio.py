"""The portfolio view over the supplied order and customer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PORTFOLIO_COLUMNS = (
    "customer_id", "transaction_id", "date", "segment", "region", "business_type", "employment_status", "income",
    "loan_amount", "existing_debt", "transaction_amount", "transaction_frequency", "account_age_months",
    "repayment_history_score", "defaulted", "currency",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def portfolio(spark: SparkSession, sf_dir: str, keep_key: bool = False) -> DataFrame:
    """Orders as portfolio transactions, with missing values, outliers and repeated rows.

    The joins carry no hint: Spark broadcasts a side when its file size allows it and shuffles otherwise.
    ``keep_key`` keeps ``o_orderkey`` as a tie-breaker.
    """
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    rows = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    key, balance = F.col("o_orderkey"), F.col("c_acctbal")
    rows = rows.select(
        F.concat(F.lit("CUST-"), F.col("o_custkey").cast("string")).alias("customer_id"),
        F.when(key % 53 != 0, F.concat(F.lit("TXN-"), key.cast("string"))).alias("transaction_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.when(key % 71 != 0, F.col("c_mktsegment")).alias("segment"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("business_type"),
        F.when(key % 59 != 0, F.col("o_orderstatus")).alias("employment_status"),
        F.when(balance > 0, F.round(balance * 40, 2)).alias("income"),
        F.round(balance * (1 + key % 9) * 10, 2).alias("loan_amount"),
        F.when(balance > 0, F.round(balance * (key % 40), 2)).alias("existing_debt"),
        F.when(
            key % 41 != 0, F.round(F.col("o_totalprice") * F.when(key % 211 == 0, 12).otherwise(1), 2)
        ).alias("transaction_amount"),
        (key % 97 + F.when(key % 173 == 0, 400).otherwise(0)).alias("transaction_frequency"),
        (F.col("o_custkey") % 96).alias("account_age_months"),
        F.when(key % 67 != 0, ((key * 37) % 101).cast("double")).alias("repayment_history_score"),
        F.when(key % 10 == 0, 1).otherwise(0).alias("defaulted"),
        F.lit("NGN").alias("currency"),
        key,
        F.explode(F.when(key % 97 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__copy"),
    ).drop("__copy")
    return rows if keep_key else rows.drop("o_orderkey")
