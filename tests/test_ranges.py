"""Carrying forward and deep pages over ranges, against one window and one sort."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tagbill.operators import catalog, ranges


@pytest.mark.parametrize("within", [None, "sheet"])
def test_carry_forward_equals_one_window(spark, within):
    rng = random.Random(4)
    rows = [(s, i, rng.choice([None] * 8 + ["a", "b"])) for s in ("x", "y", "z") for i in range(400)]
    rows += [("only", 1, None), ("only", 2, None), (None, 5, "n"), (None, 6, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "sheet string, row int, head string").repartition(7)
    got = ranges.carry_forward(df, ["sheet", "row"], "head", "carried", within)
    assert got.columns == ["sheet", "row", "head", "carried"]
    w = Window.orderBy("sheet", "row") if within is None else Window.partitionBy("sheet").orderBy("row")
    want = df.withColumn("carried", F.last("head", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_carry_forward_of_structs_and_of_nothing(spark):
    df = spark.range(0, 5000).select("id", F.when(F.col("id") % 1999 == 1, F.struct(F.col("id").alias("h"))).alias("head"))
    got = ranges.carry_forward(df, ["id"], "head", "c").select("id", "c.h").collect()
    assert all(r.h == (None if r.id < 1 else (r.id - 1) // 1999 * 1999 + 1) for r in got) and len(got) == 5000
    assert ranges.carry_forward(df.limit(0), ["id"], "head", "c").collect() == []


def test_a_sheet_in_ranges_gives_the_same_rates(spark):
    from tagbill.sources.adapter import Domain
    sheet = Domain(spark, "/root/testdata/sf0.001").storage_sheet
    assert sorted(map(str, catalog.storage_rates(sheet, ranged=True).collect())) == sorted(map(str, catalog.storage_rates(sheet).collect()))


def test_deep_pages(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randrange(300), i) for i in range(3000)] + [(None, i) for i in range(5)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(6)
    path = f"{tmp_path}/p"
    ranges.write_pages(df, ["k", "v"], path)
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    for offset, limit in ((0, 25), (1, 1), (1490, 25), (2990, 25), (3004, 9), (4000, 5), (10, 2500)):
        got = [tuple(r) for r in ranges.page(spark, path, ["k", "v"], offset, limit).collect()]
        assert got == want[offset:offset + limit]
    assert len(ranges.pages_read(spark, path, 1490, 25)) <= 2


def test_an_offset_of_a_million_reads_one_range(spark, tmp_path):
    path = f"{tmp_path}/p"
    ranges.write_pages(spark.range(0, 2_000_000).select(((F.col("id") * 7919) % 2_000_000).alias("k")), ["k"], path)
    got = ranges.page(spark, path, ["k"], 1_000_003, 3)
    assert [r.k for r in got.collect()] == [1_000_003, 1_000_004, 1_000_005]
    assert len(ranges.pages_read(spark, path, 1_000_003, 3)) == 1
    assert "PartitionFilters: [" in got._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
