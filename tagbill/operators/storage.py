"""C3 ``v_storage_charges`` and its rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import billing_week
from ..schemas import MONEY, MONEY_SUM, QTY_SUM
from .charges import rate_lookup, scope

FREE_DAYS = 7  # fixed value: days of free storage before charges start
DAYS = T.DecimalType(5, 0)  # keeps qty(18,4) × rate(12,4) × days exact within 38 digits


def storage_billed_tags(billing_lines: DataFrame) -> DataFrame:
    return (billing_lines.filter(F.col("tagid").isNotNull() & (F.col("charge_type") == "STORAGE"))
            .select(F.col("tagid").cast("long").alias("tagid")).distinct())


def storage_charges(shipped: DataFrame, classification: DataFrame, storage_rates: DataFrame,
                    billing_lines: DataFrame) -> DataFrame:
    """One row per shipped pallet held longer than the free days.

    Rate join is plain equality (no trim/coalesce, unlike packing) with the
    GIRO fallback; ``billed`` looks only at STORAGE lines.
    """
    days = F.datediff("ship_date", "recv_date")
    sh = shipped.filter(F.col("recv_date").isNotNull() & F.col("ship_date").isNotNull()
                        & (days > FREE_DAYS))
    pc = classification.select("productname", F.col("type").alias("commtype"), "commodity",
                               "style", "bagtype")
    j = sh.join(pc, "productname", "left")
    j = rate_lookup(j, storage_rates, ["commtype", "commodity", "style"], "rate", "bagtype", False)
    j = j.join(storage_billed_tags(billing_lines).withColumn("_b", F.lit(True)), "tagid", "left")
    rate = F.coalesce("_rate_exact", "_rate_giro")
    billable_days = days - FREE_DAYS
    return j.select(
        "tagid", "sono", "lastconame", "productname", "commtype", "commodity", "style", "bagtype",
        "shipped_qty", "recv_date", "ship_date", billing_week("ship_date").alias("billing_week"),
        days.alias("days_in_storage"), F.lit(FREE_DAYS).alias("free_days"),
        billable_days.alias("billable_days"),
        rate.alias("rate"),
        F.round(F.col("shipped_qty") * rate * billable_days.cast(DAYS), 2).cast(MONEY).alias("amount"),
        rate.isNull().alias("rate_missing"),
        (F.col("_rate_giro").isNotNull() & F.col("_rate_exact").isNull()).alias("rate_giro_fallback"),
        F.col("_b").isNotNull().alias("billed"))


STORAGE_VIEW_COLUMNS = ["tagid", "sono", "lastconame", "commodity", "style", "bagtype",
                        "shipped_qty", "recv_date", "ship_date", "billing_week",
                        "days_in_storage", "billable_days", "rate", "amount", "rate_missing",
                        "billed"]


def storage_charges_scoped(storage: DataFrame, start=None, end=None, status="unbilled") -> DataFrame:
    """C4: period/status scope and the API projection, ``billing_week, amount DESC NULLS LAST``."""
    return (scope(storage, start, end, status).select(*STORAGE_VIEW_COLUMNS)
            .orderBy(F.col("billing_week").asc_nulls_last(), F.col("amount").desc_nulls_last()))


def storage_candidates(storage: DataFrame) -> DataFrame:
    """A12 ``v_storage_candidates``: unbilled storage per week."""
    return (storage.filter(~F.col("billed")).groupBy("billing_week")
            .agg(F.count(F.lit(1)).alias("pallets"),
                 F.coalesce(F.sum("amount"), F.lit(0)).cast(MONEY_SUM).alias("amount"),
                 F.count_if("rate_missing").alias("pallets_missing_rate"))
            .orderBy(F.col("billing_week").asc_nulls_last()))


def storage_summary(storage: DataFrame, start=None, end=None, status="all") -> DataFrame:
    """A10 (API rollup): rated pallets per (commodity, style, bagtype, rate); NULL groups kept."""
    return (storage_invoice_groups(storage, start, end, status)
            .orderBy(*[F.col(c).asc_nulls_last() for c in ("commodity", "style", "bagtype", "rate")]))


def storage_summary_header(storage: DataFrame, start: str, end: str, status="all") -> DataFrame:
    """A10 (API header): rated total, all pallets, pallets missing a rate, pallets billed."""
    s = scope(storage, start, end, status)
    return s.agg(
        F.coalesce(F.sum(F.when(~F.col("rate_missing"), F.col("amount"))), F.lit(0))
        .cast(MONEY_SUM).alias("total"),
        F.count(F.lit(1)).alias("pallets"),
        F.count_if("rate_missing").alias("pallets_missing_rate"),
        F.count_if("billed").alias("pallets_billed"),
    ).select(F.lit(start).alias("start"), F.lit(end).alias("end"), F.lit(status).alias("status"),
             "total", "pallets", "pallets_missing_rate", "pallets_billed")


def storage_invoice_groups(storage: DataFrame, start, end, status="all") -> DataFrame:
    """A10 (invoice): rated storage per (commodity, style, bagtype, rate) with carton-days."""
    rated = scope(storage, start, end, status).filter(~F.col("rate_missing"))
    return (rated.groupBy("commodity", "style", "bagtype", "rate")
            .agg(F.count(F.lit(1)).alias("pallets"),
                 F.sum(F.col("shipped_qty") * F.col("billable_days")).cast(QTY_SUM)
                 .alias("carton_days"),
                 F.sum("amount").cast(MONEY_SUM).alias("amount")))
