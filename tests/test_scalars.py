import datetime

import pytest
from pyspark.sql import functions as F

from folioguard.functions import hashing, scalars

NUMBERS = {
    "12": 12.0, " 12 ": 12.0, "1e3": 1000.0, "+5": 5.0, "5.": 5.0, ".5": 0.5, "-0.25": -0.25, "1,000": None,
    "1_000": None, "0x10": None, "True": None, "1d": None, "1f": None, "1.0D": None, "1e400": None, "nan": None,
    "": None, "abc": None, "inf": float("inf"), "-Infinity": float("-inf"),
}


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")


def results(df, expression):
    return [r["x"] for r in df.select("i", expression.alias("x")).orderBy("i").collect()]


def test_numbers_in_text(spark):
    df = column(spark, list(NUMBERS))
    assert results(df, scalars.num(df, "c")) == list(NUMBERS.values())


def test_nan_is_missing(spark):
    df = column(spark, [1.5, float("nan"), None], "double")
    assert results(df, scalars.num(df, "c")) == [1.5, None, None]
    assert results(df, scalars.missing(df, "c")) == [False, True, True]


@pytest.mark.parametrize("text, day", [
    ("2026-01-05", "2026-01-05"), ("2026/01/05", "2026-01-05"), ("01/02/2026", "2026-01-02"),
    ("13/02/2026", "2026-02-13"), ("5 Jan 2026", "2026-01-05"), ("Jan 5, 2026", "2026-01-05"),
    ("20260105", "2026-01-05"), ("2026-01-05T10:30:00Z", "2026-01-05"), ("2026-01-05 10:30", "2026-01-05"),
    (" 2026-01-05 ", "2026-01-05"), ("10:30", None), ("bad", None), ("2026-13-45", None), ("", None),
])
def test_dates(spark, text, day):
    df = column(spark, [text])
    expected = datetime.date.fromisoformat(day) if day else None
    assert results(df, scalars.ts(df, "c").cast("date")) == [expected]


def test_numeric_columns_hold_no_dates(spark):
    df = column(spark, [20260105], "long")
    assert results(df, scalars.ts(df, "c")) == [None]


def test_half_even_rounding(spark):
    df = column(spark, [0.25, 0.35, 2.45, 84.45, 36.05, None], "double")
    assert results(df, scalars.r1(F.col("c"))) == [0.2, 0.4, 2.4, 84.4, 36.0, None]


def test_text_edges(spark):
    df = column(spark, ["  a b \n", " \t", None, "\x1cx\x1f"])
    assert results(df, scalars.txt(F.col("c"))) == ["a b", "", None, "x"]
    assert results(df, scalars.present_text(F.col("c"))) == [True, False, False, True]


def test_headers(spark):
    df = column(spark, [" Customer ID ", "TXN--Value!", "***", "Café №1"])
    assert results(df, scalars.normalized_header(F.col("c"))) == ["customer_id", "txn_value", "unnamed", "caf_1"]


def test_money_and_bands(spark):
    df = column(spark, [1234567.5, 0.4], "double")
    assert results(df, scalars.money(F.lit("NGN"), F.col("c"))) == ["NGN 1,234,568", "NGN 0"]
    df = column(spark, [0.0, 35.0, 35.1, 65.0, 100.0, 101.0], "double")
    assert results(df, scalars.band(F.col("c"))) == ["Low", "Low", "Medium", "Medium", "High", None]


def test_keyed_digest_is_hmac(spark):
    import hashlib
    import hmac

    df = column(spark, ["alice", "żółw", "", None])
    for key in (b"k" * 32, b"long key " * 20):
        expected = [
            None if v is None else hmac.new(key, v.encode(), hashlib.sha256).hexdigest()
            for v in ("alice", "żółw", "", None)]
        assert results(df, hashing.keyed_digest(key, F.col("c"))) == expected
    with pytest.raises(ValueError):
        hashing.keyed_digest(b"short", F.col("c"))
