import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioguard.functions.keyed import attach
from folioguard.operators import quantiles as Z


def skewed(n=3000, seed=7):
    rng = np.random.default_rng(seed)
    group = np.where(rng.random(n) < 0.5, "hot", rng.choice(["a", "b", "c", "tiny"], n, p=[0.5, 0.3, 0.19, 0.01]))
    # A third of all values are the same number.
    value = np.where(rng.random(n) < 1 / 3, 42.0, rng.lognormal(3, 2, n).round(2))
    pdf = pd.DataFrame({"g": group, "v": value})
    pdf.loc[rng.choice(n, 50, replace=False), "v"] = np.nan
    pdf.loc[rng.choice(n, 50, replace=False), "g"] = None
    return pdf


def load(spark, pdf):
    rows = [tuple(None if pd.isna(x) else x for x in r) for r in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "g string, v double").repartition(5)


def expected_ranks(values):
    s = pd.Series(values).dropna()
    return dict(zip(s, s.rank()))


def test_quantiles_match_linear_interpolation(spark):
    pdf = skewed()
    wanted = [
        Z.Quantile("top", F.col("v"), 0.992), Z.Quantile("low", F.col("v"), 0.0), Z.Quantile("high", F.col("v"), 1.0),
        Z.Quantile("median", F.col("v"), 0.5, grouped=True)]
    got = {(r["name"], r["grp"]): r for r in Z.exact_quantiles(load(spark, pdf), wanted, F.col("g")).collect()}
    v = pdf["v"].dropna()
    for name, p in (("top", 0.992), ("low", 0.0), ("high", 1.0)):
        assert got[(name, None)]["quantile"] == pytest.approx(v.quantile(p), rel=1e-12)
        assert got[(name, None)]["n"] == len(v)
    medians = pdf.dropna().groupby("g")["v"].median()
    assert {k[1]: r["quantile"] for k, r in got.items() if k[0] == "median"} == pytest.approx(medians.to_dict())
    assert got[("top", None)]["std"] == pytest.approx(v.std(ddof=0))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.floats(-1e6, 1e6).map(lambda x: round(x, 3)), min_size=1, max_size=300), p=st.sampled_from(
    [0.0, 0.3, 0.5, 0.992, 1.0]))
def test_any_values(spark, values, p):
    df = load(spark, pd.DataFrame({"g": None, "v": values}))
    got = Z.exact_quantiles(df, [Z.Quantile("q", F.col("v"), p)]).first()
    assert got["quantile"] == pytest.approx(float(np.quantile(values, p)), rel=1e-9, abs=1e-9)


def test_average_ranks(spark):
    pdf = skewed()
    ranks = Z.average_ranks(load(spark, pdf), F.col("v")).collect()
    assert {r["v"]: r["rank"] for r in ranks} == expected_ranks(pdf["v"])
    assert {r["n"] for r in ranks} == {pdf["v"].notna().sum()}


def test_running_totals_carry_sums(spark):
    placed = Z.ordered_totals(load(spark, skewed(500)), F.col("v"), {"one": F.lit(1)}).collect()
    assert all(r["one_below"] == r["below"] and r["one_all"] == r["n"] for r in placed)


def test_no_values_at_all(spark):
    df = spark.createDataFrame([(None, None), ("a", None)], "g string, v double")
    assert Z.exact_quantiles(df, [Z.Quantile("q", F.col("v"), 0.5), Z.Quantile("r", F.col("v"), 0.5, True)],
                             F.col("g")).count() == 0
    assert Z.average_ranks(df, F.col("v")).count() == 0


def test_a_value_on_nearly_all_rows_leaves_even_ranges(spark):
    df = spark.range(200_000).select(F.when(F.col("id") % 100 > 0, 0.0).otherwise(F.col("id").cast("double")).alias("v"))
    counts = df.groupBy("v").agg(F.count("*").alias("c"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in Z._ranged(counts, ["v"]).groupBy("b").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 1.5 * min(sizes)
    assert Z.exact_quantiles(df, [Z.Quantile("q", F.col("v"), 0.995)]).first()["quantile"] == pytest.approx(100_000, rel=0.01)


def test_attach_keeps_every_row(spark):
    pdf = skewed(2000)
    rows = load(spark, pdf)
    facts = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("w"), F.first("g").alias("x"))
    got = attach(rows, facts, [(F.col("v"), "v")], ["w"]).toPandas()
    counts = pdf["v"].value_counts()
    assert len(got) == len(pdf)
    assert sorted(got["w"].fillna(-1).tolist()) == sorted(pdf["v"].map(counts).fillna(-1).tolist())
    assert (got["w"].isna() == got["v"].isna()).all()
