"""Weekly and period bills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import guarded_iso
from ..schemas import MONEY_SUM
from .charges import scope

SUMMARY_COLUMNS = ["billing_week", "service_amount", "labor_amount", "materials_amount",
                   "storage_amount", "total_amount"]


def _by_week_end(df: DataFrame, amount: str, name: str) -> DataFrame:
    d = df.filter(F.col("week_end").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    return d.select(guarded_iso("week_end").alias("billing_week"), F.lit(name).alias("k"),
                    F.col(amount).alias("amount"))


def bill_summary(bill_lines_df: DataFrame, storage: DataFrame, labor: DataFrame,
                 materials: DataFrame) -> DataFrame:
    """A14 ``v_bill_summary``: service + labor + materials + storage per billing week.

    The streams are tagged and unioned, and one aggregate by week sums them, so each
    is computed once and reduced map-side. A NULL week (tags without a ship date)
    matches no stream: it appears once with zeros.
    """
    u = (bill_lines_df.select("billing_week", F.lit("service_amount").alias("k"), "amount")
         .unionByName(storage.filter(~F.col("billed"))
                      .select("billing_week", F.lit("storage_amount").alias("k"), "amount"))
         .unionByName(_by_week_end(labor, "labor_charge", "labor_amount"))
         .unionByName(_by_week_end(materials, "materials_charge", "materials_amount")))
    known = F.col("billing_week").isNotNull()
    kinds = ("service_amount", "labor_amount", "materials_amount", "storage_amount")
    j = u.groupBy("billing_week").agg(*[
        F.coalesce(F.sum(F.when(known & (F.col("k") == c), F.col("amount"))), F.lit(0)).alias(c) for c in kinds])
    amt = {c: F.col(c) for c in kinds}
    return j.select(
        "billing_week",
        *[v.cast(MONEY_SUM).alias(k) for k, v in amt.items()],
        (amt["service_amount"] + amt["labor_amount"] + amt["materials_amount"]
         + amt["storage_amount"]).cast(MONEY_SUM).alias("total_amount"),
    ).orderBy(F.col("billing_week").asc_nulls_last())


def grand_totals(summary: DataFrame) -> DataFrame:
    """Totals of the weekly bill (all four streams)."""
    return summary.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast(MONEY_SUM).alias(c)
                         for c in SUMMARY_COLUMNS[1:]], F.count(F.lit(1)).alias("weeks"))


def period_bill_header(charges_df: DataFrame, storage: DataFrame, labor: DataFrame,
                       start: str, end: str, status: str = "all") -> DataFrame:
    """A8 ``for_period`` header as one row.

    Service and storage are scoped by ship date and status, labor by its
    ``week_end`` text (valid dates only). ``total`` leaves materials out, as the
    period bill does. The three sources are tagged, unioned and reduced by one
    global aggregate (no cross join of one-row results).
    """
    svc = scope(charges_df, start, end, status).select(
        F.lit("svc").alias("k"), "amount", "rate_missing", "billed")
    sto = scope(storage, start, end, status).select(
        F.lit("sto").alias("k"), "amount", "rate_missing", "billed")
    d = guarded_iso("week_end")
    lab = (labor.filter(F.col("week_end").rlike(r"^\d{4}-\d{2}-\d{2}$")
                        & d.between(F.lit(start).cast("date"), F.lit(end).cast("date")))
           .select(F.lit("lab").alias("k"), F.col("labor_charge").alias("amount"),
                   F.lit(False).alias("rate_missing"), F.lit(False).alias("billed")))
    u = svc.unionByName(sto).unionByName(lab)

    def total(kind):
        return F.coalesce(F.sum(F.when(F.col("k") == kind, F.col("amount"))), F.lit(0)).cast(MONEY_SUM)

    def count_of(kind, flag=None):
        cond = F.col("k") == kind
        if flag:
            cond = cond & F.col(flag)
        return F.count_if(cond)

    agg = u.agg(total("svc").alias("service_total"), total("lab").alias("labor_total"),
                total("sto").alias("storage_total"),
                count_of("sto").alias("storage_pallets"),
                count_of("sto", "rate_missing").alias("storage_missing_rate"),
                count_of("svc", "rate_missing").alias("tags_missing_rate"),
                count_of("svc", "billed").alias("tags_billed"))
    return agg.select(
        F.lit(start).alias("start"), F.lit(end).alias("end"), F.lit(status).alias("status"),
        "service_total", "labor_total", "storage_total", "storage_pallets",
        "storage_missing_rate",
        (F.col("service_total") + F.col("labor_total") + F.col("storage_total"))
        .cast(MONEY_SUM).alias("total"),
        "tags_missing_rate", "tags_billed")


def period_lines(charges_df: DataFrame, start: str, end: str, status: str = "all") -> DataFrame:
    """The period bill's line table, ``ORDER BY transaction_type, productname, tagid``."""
    return (scope(charges_df, start, end, status)
            .select("tagid", "productname", "transaction_type", "ship_date", "billing_week",
                    "commodity", "style", "bagtype", "rate", "shipped_qty", "amount",
                    "rate_missing", "billed")
            .orderBy("transaction_type", F.col("productname").asc_nulls_last(), "tagid"))


def candidate_totals(candidates: DataFrame) -> DataFrame:
    """Totals under the bill-candidates table (tags, cartons, amount, missing rates)."""
    return candidates.agg(F.coalesce(F.sum("tags"), F.lit(0)).cast("long").alias("tags"),
                          F.sum("shipped_qty").cast("decimal(38,4)").alias("shipped_qty"),
                          F.coalesce(F.sum("amount"), F.lit(0)).cast(MONEY_SUM).alias("amount"),
                          F.coalesce(F.sum("tags_missing_rate"), F.lit(0)).cast("long")
                          .alias("tags_missing_rate"))


def storage_totals(storage_rows: DataFrame) -> DataFrame:
    """Pallets, amount and pallets missing a rate under a storage listing."""
    return storage_rows.agg(F.count(F.lit(1)).alias("pallets"),
                            F.coalesce(F.sum("amount"), F.lit(0)).cast(MONEY_SUM).alias("amount"),
                            F.count_if("rate_missing").alias("pallets_missing_rate"))
