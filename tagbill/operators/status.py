"""C1 ``v_repack_status`` and the status read API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.products import billable_product
from ..schemas import QTY_SUM

STATUS_COLUMNS = ["tagid", "role", "icrunidx", "productname", "fcreasonidx", "qnt", "uom",
                  "rundate", "wh_status", "shipped_qty", "billing_status"]
# Deterministic tie-break for "one row per tag" (the reference leaves it open).
TAG_TIEBREAK = ["rundate", "icrunidx", "fcreasonidx", "productname", "qnt", "uom"]


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, smallest ``order`` (nulls last) wins.

    ``row_number() = 1`` lets Spark insert a partial WindowGroupLimit before the
    shuffle, so each map task forwards at most one row per key even when a
    single key holds a large share of the rows.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def packing_billed_tags(billing_lines: DataFrame) -> DataFrame:
    """Tags with a packing/repack service line (STORAGE lines do not count)."""
    return (billing_lines
            .filter(F.col("tagid").isNotNull()
                    & (F.coalesce(F.col("charge_type"), F.lit("PACKING")) != "STORAGE"))
            .select(F.col("tagid").cast("long").alias("tagid")).distinct())


def consumed_tags(inputs: DataFrame) -> DataFrame:
    return inputs.filter(F.col("tagid").isNotNull()).select(F.col("tagid").cast("long")).distinct()


def status_tags(outputs: DataFrame, inputs: DataFrame, shipped: DataFrame | None = None) -> DataFrame:
    """Every produced tag, plus tags only ever consumed (J3 anti join).

    With ``shipped`` the input-only tags are restricted to shipped ones here (J3
    semi join); ``status_with_ship`` passes None and applies that restriction
    after its single join with ``shipped`` instead, so v_shipped is joined once.
    """
    cols = ["tagid", "icrunidx", "productname", "fcreasonidx", "qnt", "uom", "rundate"]
    out = outputs.filter(F.col("tagid").isNotNull()).withColumn("tagid", F.col("tagid").cast("long"))
    out = first_per_key(out.select(*cols), ["tagid"], TAG_TIEBREAK).withColumn("role", F.lit("output"))
    inp = inputs.filter(F.col("tagid").isNotNull()).withColumn("tagid", F.col("tagid").cast("long"))
    inp = inp.select(*cols).join(out.select("tagid"), "tagid", "left_anti")
    if shipped is not None:
        inp = inp.join(shipped.select("tagid"), "tagid", "left_semi")
    inp = first_per_key(inp, ["tagid"], TAG_TIEBREAK).withColumn("role", F.lit("input_only"))
    return out.unionByName(inp)


def wh_status(shipped_flag: Column, consumed_flag: Column) -> Column:
    return F.when(shipped_flag, "shipped").when(consumed_flag, "repacked").otherwise("on-hand")


def billing_status(billed_flag: Column, reason: Column, product: Column) -> Column:
    """billed > NULL reason → NULL > billable > not-billable (NULL predicate falls through)."""
    return (F.when(billed_flag, "billed")
            .when(reason.isNull(), F.lit(None))
            .when(reason.isin(39, 41) & billable_product(product), "billable")
            .otherwise("not-billable"))


def status_with_ship(outputs: DataFrame, inputs: DataFrame, shipped: DataFrame,
                     billing_lines: DataFrame) -> DataFrame:
    """Status rows plus the shipped tag's ship_date (J2; J4 reuses it, no second join)."""
    tags = status_tags(outputs, inputs)
    b = packing_billed_tags(billing_lines).withColumn("_b", F.lit(True))
    c = consumed_tags(inputs).withColumn("_c", F.lit(True))
    sh = shipped.select("tagid", "shipped_qty", "ship_date", F.lit(True).alias("_s"))
    j = (tags.join(sh, "tagid", "left")
         .filter((F.col("role") == "output") | F.col("_s").isNotNull())   # input-only: shipped ones
         .join(b, "tagid", "left").join(c, "tagid", "left"))
    return j.select(
        *[c_ for c_ in STATUS_COLUMNS if c_ not in ("wh_status", "shipped_qty", "billing_status")],
        wh_status(F.col("_s").isNotNull(), F.col("_c").isNotNull()).alias("wh_status"),
        "shipped_qty",
        billing_status(F.col("_b").isNotNull(), F.col("fcreasonidx"), F.col("productname"))
        .alias("billing_status"),
        "ship_date")


def repack_status(outputs, inputs, shipped, billing_lines) -> DataFrame:
    return status_with_ship(outputs, inputs, shipped, billing_lines).select(*STATUS_COLUMNS)


def status_summary(status: DataFrame) -> DataFrame:
    """A2 crosstab: wh_status × billing_status → tags, shipped qty."""
    return (status.groupBy("wh_status", "billing_status")
            .agg(F.count(F.lit(1)).alias("tags"),
                 F.sum("shipped_qty").cast(QTY_SUM).alias("shipped_qty"))
            .orderBy(F.col("wh_status").asc_nulls_last(), F.col("billing_status").asc_nulls_last()))


def billable_unbilled(status: DataFrame) -> DataFrame:
    """P9 ``v_billable_unbilled``."""
    return status.filter(F.col("billing_status") == "billable")


def unbilled_shipped(status: DataFrame) -> DataFrame:
    """P10: shipped and billing_status IS DISTINCT FROM 'billed'."""
    return status.filter((F.col("wh_status") == "shipped")
                         & ~F.col("billing_status").eqNullSafe("billed"))


def unbilled_shipped_by_status(status: DataFrame) -> DataFrame:
    """Unbilled shipped tags per billing status, NULL shown as '(no reason)'."""
    return (unbilled_shipped(status)
            .groupBy(F.coalesce("billing_status", F.lit("(no reason)")).alias("billing_status"))
            .agg(F.count(F.lit(1)).alias("tags")))


def already_billed(billing_lines: DataFrame) -> DataFrame:
    """Distinct tags recorded as billed, whatever the charge type."""
    return billing_lines.filter(F.col("tagid").isNotNull()).select("tagid").distinct()


def total_tags(summary: DataFrame) -> DataFrame:
    """All tags of the status summary."""
    return summary.agg(F.coalesce(F.sum("tags"), F.lit(0)).cast("long").alias("tags"))


def preview(df: DataFrame, n: int, *order: str) -> DataFrame:
    """O3: the first ``n`` rows of a listing in its order (a top-k, no full sort)."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(n)


PAGE_COLUMNS = ["tagid", "role", "icrunidx", "productname", "fcreasonidx", "uom", "rundate",
                "wh_status", "shipped_qty", "billing_status"]


def status_page(status: DataFrame, wh: str | None = None, billing: str | None = None,
                billing_null: bool = False, limit: int = 25, offset: int = 0) -> DataFrame:
    """P14 + O1: filtered page ``ORDER BY tagid LIMIT/OFFSET`` (a top-k, no full sort)."""
    df = status
    if wh:
        df = df.filter(F.col("wh_status") == wh)
    if billing_null:
        df = df.filter(F.col("billing_status").isNull())
    elif billing is not None:
        df = df.filter(F.col("billing_status") == billing)
    return df.select(*PAGE_COLUMNS).orderBy("tagid").offset(int(offset)).limit(int(limit))
