from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folioguard.operators import sketches as K
from folioguard.operators.paging import page_directory


@pytest.mark.parametrize("range_rows", [1, 37, 10_000])
def test_pages_are_those_of_a_sorted_list(spark, range_rows):
    rnd = random.Random(range_rows)
    rows = [(rnd.randrange(5), rnd.choice([None, "a", "b"]), i % 70) for i in range(200)]
    rows += [(1, "a", 3)] * 40
    df = spark.createDataFrame(rows, "k int, v string, i int").repartition(5)
    directory = page_directory(df, [F.col("k").desc(), "v", "i"], range_rows)
    ordered = sorted(rows, key=lambda r: (-r[0], r[1] is not None, r[1] or "", r[2]))
    size = 23
    for number in range(1, 12):
        page = [tuple(r) for r in directory.page(number, size).collect()]
        assert page == ordered[(number - 1) * size : number * size]
    assert directory.page(10_000).collect() == []


def test_a_deep_page_opens_few_ranges(spark):
    directory = page_directory(spark.range(20_000).withColumn("v", F.col("id") * 7), ["id"], 1_000)
    assert directory.ranges.count() == 20
    page = directory.page(60, 250)
    files = {f for f in page.inputFiles()}
    assert [r["id"] for r in page.collect()] == list(range(59 * 250, 60 * 250))
    assert 0 < len({f.split("__range=")[1].split("/")[0] for f in files if "__range=" in f})
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "__range" in plan.split("PartitionFilters")[1][:200]


def test_an_empty_result_has_no_page(spark):
    assert page_directory(spark.range(0), ["id"]).page(1).collect() == []


def test_merged_sketches_stay_within_the_bound_without_a_rescan(spark):
    rows = spark.range(60_000).select(
        (F.col("id") % 12).alias("month"), F.concat(F.lit(" c"), (F.col("id") * 13 % 23_456).cast("string")).alias("customer_id"),
        F.when(F.col("id") % 9 > 0, F.lit(" ")).otherwise(F.col("id").cast("string")).alias("other"))
    stored = K.distinct_sketches(rows, ["customer_id", "other"], ["month"]).cache()
    rows.unpersist()
    got = {r["column"]: r for r in K.merged_estimates(stored).collect()}
    exact = rows.agg(F.countDistinct("customer_id").alias("c")).first()["c"]
    assert abs(got["customer_id"]["estimate"] - exact) <= 3 * K.STANDARD_ERROR * exact
    assert got["customer_id"]["records"] == 60_000 and got["other"]["records"] == rows.where("other <> ' '").count()
    # Sketches of later files merge with the stored ones to the same estimate as one over all.
    later = K.distinct_sketches(rows.where("month < 3"), ["customer_id"], ["month"])
    both = stored.where("column = 'customer_id' and month >= 3").unionByName(later)
    assert K.merged_estimates(both).first()["estimate"] == got["customer_id"]["estimate"]
    months = K.merged_estimates(stored, ["month"]).where("column = 'customer_id'").collect()
    truth = {r["month"]: r["n"] for r in rows.groupBy("month").agg(F.countDistinct("customer_id").alias("n")).collect()}
    assert all(abs(r["estimate"] - truth[r["month"]]) <= 3 * K.STANDARD_ERROR * truth[r["month"]] for r in months)


def test_empty_groups_count_nothing(spark):
    empty = spark.createDataFrame([], "month string, customer_id string")
    assert K.merged_estimates(K.distinct_sketches(empty, ["customer_id"], ["month"])).collect() == []
    blank = spark.createDataFrame([("m", " "), ("m", None)], "month string, customer_id string")
    one = K.merged_estimates(K.distinct_sketches(blank, ["customer_id"], ["month"])).first()
    assert (one["records"], one["estimate"]) == (0, 0)
