"""Ordered work over ranges instead of one task: carrying a value forward (W2) and deep pages (O1).

Both deal the rows into ranges of their order (a range partitioning: a sample finds the
bounds) and keep one small row per range; what a range needs from those before it comes from
these rows, and nothing but the range itself is read or sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def carry_forward(df: DataFrame, order: list[str], value: str, out: str, within: str | None = None) -> DataFrame:
    """``df`` with ``out``: the last non-null ``value`` up to each row in ``order`` (nulls first).

    ``within`` (the first column of ``order``) bounds the carry: a row takes no value from before its own sheet.
    Two passes: the last value of every range, carried over the ranges (as many as partitions), then the
    rows of each range after what it is handed. Rows that are equal in ``order`` follow each other as they come.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    dealt = cut_lineage(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    own = F.struct(F.struct(*order).alias("at"), F.col(value).alias("v"))
    last = dealt.groupBy("_range").agg(
        F.max(F.when(F.col(value).isNotNull(), own)).alias("_last"), *([F.max(within).alias("_end")] if within else []))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)          # one row a range
    handed = last.select("_range", F.last("_last", ignorenulls=True).over(before).alias("_in"))
    inner = Window.partitionBy("_range", *([within] if within else [])).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    took = F.col("_in.v")
    if within:
        took = F.when(F.col(f"_in.at.{within}").eqNullSafe(F.col(within)), took)
    return (dealt.join(handed, "_range").withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inner), took))
            .drop("_range", "_in"))


def write_pages(df: DataFrame, order: list[str], path: str) -> None:
    """Write ``df`` in ranges of ``order`` (nulls last), with the number of rows of each."""
    keys = [F.col(c).asc_nulls_last() for c in order]
    (df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()).sortWithinPartitions("_range", *keys)
     .write.partitionBy("_range").parquet(f"{path}/rows"))
    counts = df.sparkSession.read.parquet(f"{path}/rows").groupBy("_range").count()
    counts.coalesce(1).write.parquet(f"{path}/ranges")


def pages_read(spark: SparkSession, path: str, offset: int, limit: int) -> list[tuple[int, int]]:
    """(range, rows before it) of the ranges that hold rows ``offset`` to ``offset + limit``: few, whatever the offset."""
    before = F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spark.read.parquet(f"{path}/ranges").withColumn("first", before)               # one row a range
    hit = spans.filter((F.col("first") < offset + limit) & (F.col("first") + F.col("count") > offset)).orderBy("_range")
    return [(r["_range"], r["first"]) for r in hit.collect()]


def page(spark: SparkSession, path: str, order: list[str], offset: int, limit: int) -> DataFrame:
    """O1: rows ``offset`` to ``offset + limit`` of the order, reading only the ranges that hold them."""
    found = pages_read(spark, path, offset, limit)
    rows = spark.read.parquet(f"{path}/rows")
    rows = rows.filter(F.col("_range").isin([r for r, _ in found]))                         # prunes folders
    skip = offset - (found[0][1] if found else 0)
    return rows.orderBy(*[F.col(c).asc_nulls_last() for c in order]).offset(skip).limit(limit).drop("_range")
