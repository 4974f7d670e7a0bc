"""C2 ``v_charges`` and its read API."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import billing_week
from ..schemas import MONEY, MONEY_SUM, QTY_SUM

CHARGE_COLUMNS = ["tagid", "icrunidx", "productname", "fcreasonidx", "transaction_type",
                  "ship_date", "billing_week", "type", "commodity", "style", "bagtype", "rate",
                  "shipped_qty", "amount", "rate_missing", "rate_giro_fallback", "billed"]


def rate_lookup(keys: DataFrame, rates: DataFrame, key_cols: list[str], rate_col: str,
                bag_col: str, null_safe_bag: bool) -> DataFrame:
    """Exact rate, GIRO fallback rate, both as columns.

    ``rates`` is unique on its key (see ``catalog.packing_rates``). Both lookups are
    equi-joins (one OR-join would degrade to a nested loop) without a hint: adaptive
    execution broadcasts a price list once it has measured its bytes.
    """
    ct, cm, st = key_cols
    # packing keys are compared trimmed on the rate side (J6/J7); storage keys as stored
    side = (lambda c: F.trim(F.col(c))) if null_safe_bag else F.col
    r = rates.select(side("commtype").alias("_ct"), side("commodity").alias("_cm"),
                     side("style").alias("_st"), side("bagtype").alias("_bt"),
                     F.col(rate_col).alias("_rate"))
    exact = r.select("_ct", "_cm", "_st",
                     (F.coalesce("_bt", F.lit("")) if null_safe_bag else F.col("_bt")).alias("_bt"),
                     F.col("_rate").alias("_rate_exact"))
    giro = r.filter(F.col("_bt") == "GIRO").select("_ct", "_cm", "_st",
                                                    F.col("_rate").alias("_rate_giro"))
    bag = F.coalesce(F.col(bag_col), F.lit("")) if null_safe_bag else F.col(bag_col)
    k = keys.withColumn("_kbt", bag)
    k = k.join(exact,
               (k[ct] == exact["_ct"]) & (k[cm] == exact["_cm"]) & (k[st] == exact["_st"])
               & (k["_kbt"] == exact["_bt"]), "left").drop("_ct", "_cm", "_st", "_bt", "_kbt")
    k = k.join(giro,
               (k[ct] == giro["_ct"]) & (k[cm] == giro["_cm"]) & (k[st] == giro["_st"]),
               "left").drop("_ct", "_cm", "_st")
    return k


def charges(status_ship: DataFrame, classification: DataFrame, rates: DataFrame) -> DataFrame:
    """One charge line per shipped tag that is billed or billable.

    ``status_ship`` is ``status.status_with_ship``: it already carries the ship
    date from the status join, so no second join with v_shipped is needed.
    """
    st = status_ship.filter((F.col("wh_status") == "shipped")
                            & F.col("billing_status").isin("billed", "billable"))
    pc = classification.select("productname", "type", "commodity", "style", "bagtype")
    j = st.join(pc, "productname", "left")
    j = rate_lookup(j, rates, ["type", "commodity", "style"], "charge", "bagtype", True)
    repack = F.col("fcreasonidx") == 41
    any_rate = F.coalesce("_rate_exact", "_rate_giro")
    return j.select(
        "tagid", "icrunidx", "productname", "fcreasonidx",
        F.when(F.col("fcreasonidx") == 39, "PACK").when(repack, "REPACK").otherwise("OTHER")
        .alias("transaction_type"),
        "ship_date", billing_week("ship_date").alias("billing_week"),
        "type", "commodity", "style", "bagtype",
        F.when(repack, F.lit(None)).otherwise(any_rate).alias("rate"),
        "shipped_qty",
        F.when(repack, F.lit(None)).otherwise(F.round(F.col("shipped_qty") * any_rate, 2))
        .cast(MONEY).alias("amount"),
        F.when(repack, F.lit(False)).otherwise(any_rate.isNull()).alias("rate_missing"),
        F.when(repack, F.lit(False))
        .otherwise(F.col("_rate_exact").isNull() & F.col("_rate_giro").isNotNull())
        .alias("rate_giro_fallback"),
        (F.col("billing_status") == "billed").alias("billed"))


def bill_lines(charges_df: DataFrame) -> DataFrame:
    """P11 ``v_bill_lines``: not yet billed."""
    return charges_df.filter(~F.col("billed"))


def billed_lines(charges_df: DataFrame) -> DataFrame:
    """P12 ``v_billed_lines``: already billed (reprint)."""
    return charges_df.filter(F.col("billed"))


def scope(df: DataFrame, start: str | None = None, end: str | None = None,
          status: str = "all") -> DataFrame:
    """Inclusive ship-date window (only when both ends given) × status."""
    if start and end:
        df = df.filter(F.col("ship_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if status == "unbilled":
        df = df.filter(~F.col("billed"))
    elif status == "billed":
        df = df.filter(F.col("billed"))
    return df


def bill_candidates(charges_df: DataFrame, start=None, end=None, status="unbilled") -> DataFrame:
    """A3/A4: week × transaction type → tags, qty, amount, tags missing a rate."""
    return (scope(charges_df, start, end, status)
            .groupBy("billing_week", "transaction_type")
            .agg(F.count(F.lit(1)).alias("tags"),
                 F.sum("shipped_qty").cast(QTY_SUM).alias("shipped_qty"),
                 F.sum("amount").cast(MONEY_SUM).alias("amount"),
                 F.count_if("rate_missing").alias("tags_missing_rate"))
            .orderBy(F.col("billing_week").asc_nulls_last(), "transaction_type"))


def period_service(charges_df: DataFrame, start: str, end: str, status="all") -> DataFrame:
    """A5: per transaction type → tags, qty, amount, tags missing rate, tags billed."""
    return (scope(charges_df, start, end, status)
            .groupBy("transaction_type")
            .agg(F.count(F.lit(1)).alias("tags"),
                 F.sum("shipped_qty").cast(QTY_SUM).alias("qty"),
                 F.sum("amount").cast(MONEY_SUM).alias("amount"),
                 F.count_if("rate_missing").alias("tags_missing_rate"),
                 F.count_if("billed").alias("tags_billed"))
            .orderBy("transaction_type"))


def week_lines(bill_lines_df: DataFrame, week=None) -> DataFrame:
    """P11 per week: one billing week's open lines, ``ORDER BY transaction_type, tagid``.

    ``week`` is a date text, or None for the oldest open week (a scalar subquery).
    """
    if week is None:
        target = bill_lines_df.select(F.min("billing_week")).scalar()
    else:
        target = F.lit(week).cast("date")
    return (bill_lines_df.filter(F.col("billing_week") == target)
            .orderBy("transaction_type", "tagid"))
