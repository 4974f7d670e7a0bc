"""Labor round trip: runs needing labor (A17, J11), labor rows (C6), requests (K6, K7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import LABOR_CHARGES, MONEY, QTY, QTY_SUM, RATE
from .state import align_to, one_per_key

REPACK_SUBJECT = "Repacks Needing Labor Charges"  # fixed value: mail subject phrase


def labor_needed(bill_lines_df: DataFrame, labor: DataFrame, week: str | None = None) -> DataFrame:
    """Unbilled REPACK lines per run that has no labor row yet.

    ``icrunidx NOT IN (non-null labor runs)``: an anti join on the key, plus the
    SQL rule for a NULL run id — it survives only when the labor table has no
    non-null run at all (checked with an EXISTS subquery, not a count).
    """
    lines = bill_lines_df.filter(F.col("transaction_type") == "REPACK")
    if week:
        lines = lines.filter(F.col("billing_week") == F.lit(week).cast("date"))
    lab = labor.filter(F.col("icrunidx").isNotNull()).select("icrunidx")
    kept = (lines.join(lab.distinct(), "icrunidx", "left_anti")
            .filter(F.col("icrunidx").isNotNull() | ~lab.exists()))
    return (kept.groupBy("icrunidx")
            .agg(F.min("productname").alias("productdescr"),
                 F.min(F.col("billing_week").cast("string")).alias("billing_week"),
                 F.sum("shipped_qty").cast(QTY_SUM).alias("quantity"))
            .orderBy(F.col("icrunidx").asc_nulls_last()))


def labor_rows(reply: DataFrame, week, hourly_rate: float | str = 0, keep: list[str] | None = None) -> DataFrame:
    """A labor reply for ``week`` (text, or a column naming each row's week) → labor rows.

    Non-numeric laborers/hours count as 0; ``labor_charge`` is rounded half-even
    on the exact decimal product. Columns of ``keep`` follow the labor columns.
    """
    def num(c):
        if c not in reply.columns:
            return F.lit(0).cast(QTY)
        return F.coalesce(F.expr(f"try_cast(`{c}` AS DECIMAL(18,4))"), F.lit(0).cast(QTY))

    rate = F.lit(str(hourly_rate)).cast(RATE)
    out = reply.select(
        *[F.col(c) for c in reply.columns if c not in ("num_laborers", "hours_per_laborer", "week_end")],
        *([F.col("week_end").alias("_week")] if "week_end" in reply.columns else []),
        num("num_laborers").alias("num_laborers"), num("hours_per_laborer").alias("hours_per_laborer"))
    week_col = F.lit(week) if isinstance(week, str) else week
    out = out.withColumn("week_end", week_col).withColumn("labor_rate", rate)
    out = out.withColumn("labor_charge", F.bround(F.col("num_laborers") * F.col("hours_per_laborer")
                                                  * F.col("labor_rate"), 2).cast(MONEY))
    kept = [reply.schema[c] for c in keep or []]
    return align_to(out, T.StructType([*LABOR_CHARGES.fields, *kept]))


def upsert_labor_requests(current: DataFrame, weeks: DataFrame) -> DataFrame:
    """K6: (re)send a request per week: status pending, sent now, received cleared."""
    fresh = weeks.select(
        "week", "to_address", F.col("run_count").cast("int").alias("run_count"),
        F.lit("pending").alias("status"), F.current_timestamp().alias("sent_at"),
        F.lit(None).cast("timestamp").alias("received_at"))
    fresh = one_per_key(fresh, "week")
    kept = current.join(fresh.select("week"), "week", "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


def mark_received(current: DataFrame, weeks: DataFrame) -> DataFrame:
    """K7: a reply arrived for these weeks → status received, received_at now."""
    got = weeks.select("week").distinct().withColumn("_got", F.lit(True))
    j = current.join(got, "week", "left")
    hit = F.col("_got").isNotNull()
    return j.select(
        "week", "to_address", "run_count",
        F.when(hit, F.lit("received")).otherwise(F.col("status")).alias("status"),
        "sent_at",
        F.when(hit, F.current_timestamp()).otherwise(F.col("received_at")).alias("received_at"))


def runs_needing_labor(needed: DataFrame) -> DataFrame:
    """How many repack runs still need a labor entry."""
    return needed.agg(F.count(F.lit(1)).alias("runs"))


def labor_status(requests: DataFrame) -> DataFrame:
    return requests.select("week", "to_address", "run_count", "status", "sent_at",
                           "received_at").orderBy(F.col("week").desc_nulls_last())
