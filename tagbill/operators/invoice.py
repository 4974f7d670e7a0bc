"""Invoice lines, orders to post and billed-line recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import BILLING_LINES, MONEY_SUM, QTY_SUM
from .charges import scope
from .state import align_to
from .storage import storage_invoice_groups

# Invoice layout and wording.
ROWS_PER_PAGE = 24                                     # rows that fit on one invoice page
NAMED_BAGS = ["COMBO", "NET", "POUCH"]                 # bag types spelled out on packing lines


def _words(*cols: str) -> Column:
    """Space-join the non-empty values (NULL and '' are skipped)."""
    return F.concat_ws(" ", *[F.nullif(F.col(c).cast("string"), F.lit("")) for c in cols])


def invoice_lines(charges_df: DataFrame, storage: DataFrame, start: str, end: str,
                  status: str = "all") -> DataFrame:
    """One invoice line per pack form and rate, with line and page numbers.

    Rated PACK/OTHER charges group by (type, commodity, style, bagtype, rate);
    storage groups by (commodity, style, bagtype, rate) billed on carton-days.
    The grouped table is bounded by the rate-key space, so numbering it with
    one ordered window is cheap whatever the input size.
    """
    rated = scope(charges_df, start, end, status).filter(
        ~F.col("rate_missing") & (F.col("transaction_type") != "REPACK"))
    pk = (rated.groupBy("transaction_type", "type", "commodity", "style", "bagtype", "rate")
          .agg(F.sum("shipped_qty").cast(QTY_SUM).alias("quantity"),
               F.sum("amount").cast(MONEY_SUM).alias("amount")))
    pk = pk.select(
        F.lit(1).alias("section"),
        F.concat(F.lit("PACKING SERVICES - "), _words("type", "commodity", "style"),
                 F.when(F.col("bagtype").isin(*NAMED_BAGS), F.concat(F.lit(" "), F.col("bagtype")))
                 .otherwise(F.lit(""))).alias("description"),
        F.coalesce("quantity", F.lit(0)).cast(QTY_SUM).alias("quantity"),
        F.coalesce("rate", F.lit(0)).cast("decimal(12,4)").alias("price"),
        F.coalesce("amount", F.lit(0)).cast(MONEY_SUM).alias("amount"),
        F.col("transaction_type").alias("k1"), F.col("commodity").alias("k2"),
        F.col("style").alias("k3"), F.lit(None).cast("string").alias("k4"))
    sg = storage_invoice_groups(storage, start, end, status).select(
        F.lit(2).alias("section"),
        F.concat(F.lit("COLD STORAGE - "), _words("commodity", "style", "bagtype")).alias("description"),
        F.coalesce("carton_days", F.lit(0)).cast(QTY_SUM).alias("quantity"),
        F.coalesce("rate", F.lit(0)).cast("decimal(12,4)").alias("price"),
        F.coalesce("amount", F.lit(0)).cast(MONEY_SUM).alias("amount"),
        F.lit(None).cast("string").alias("k1"), F.col("commodity").alias("k2"),
        F.col("style").alias("k3"), F.col("bagtype").alias("k4"))
    items = pk.unionByName(sg)
    w = Window.orderBy("section", *[F.col(k).asc_nulls_last() for k in ("k1", "k2", "k3", "k4")],
                       "description", "price")
    items = items.withColumn("line_no", F.row_number().over(w))
    return items.select(
        "line_no", (F.floor((F.col("line_no") - 1) / ROWS_PER_PAGE) + 1).cast("int").alias("page_no"),
        F.when(F.col("section") == 1, "PACKING").otherwise("STORAGE").alias("section"),
        "description", "quantity", "price", "amount")


def invoice_totals(charges_df: DataFrame, storage: DataFrame, start: str, end: str,
                   status: str = "all", invoice_date: str | None = None) -> DataFrame:
    """A11 + C11: line count, total, charges skipped for lack of a rate, and PO text.

    One aggregate over both sources gives the groups that become lines (see
    ``invoice_lines``) and the unrated rows beside them, so each source is read once.
    ``invoice_date`` is today unless given.
    """
    none = F.lit(None).cast("string")
    pk = scope(charges_df, start, end, status).select(
        F.lit("p").alias("k"), "transaction_type", "type", "commodity", "style", "bagtype", "rate",
        "amount", "rate_missing")
    sg = scope(storage, start, end, status).select(
        F.lit("s").alias("k"), none.alias("transaction_type"), none.alias("type"), "commodity", "style",
        "bagtype", "rate", "amount", "rate_missing")
    groups = (pk.unionByName(sg)
              .groupBy("k", "transaction_type", "type", "commodity", "style", "bagtype", "rate", "rate_missing")
              .agg(F.sum("amount").cast(MONEY_SUM).alias("amount"), F.count(F.lit(1)).alias("n")))
    line = ~F.col("rate_missing") & ((F.col("k") == "s") | (F.col("transaction_type") != "REPACK"))
    end_d = F.lit(end).cast("date")
    return groups.agg(
        F.count_if(line).alias("lines"),
        F.coalesce(F.sum(F.when(line, F.col("amount"))), F.lit(0)).cast(MONEY_SUM).alias("total"),
        F.coalesce(F.sum(F.when(F.col("rate_missing"), F.col("n"))), F.lit(0)).alias("skipped_no_rate"),
    ).select(F.lit(start).alias("start"), F.lit(end).alias("end"), "lines", "total",
             "skipped_no_rate",
             F.date_format(F.current_date() if invoice_date is None else F.lit(invoice_date).cast("date"),
                           "MMM dd, yyyy").alias("invoice_date"),
             F.date_format(end_d, "MMM dd, yyyy").alias("ship_date_label"),
             F.concat(F.lit("PACKING WE "), F.date_format(end_d, "MMddyy")).alias("cust_po"))


def orders_to_post(bill_lines_df: DataFrame, storage: DataFrame, week: str | None = None,
                   storage_charge_id: str | None = None, customer_id: str | None = None,
                   charge_id: str | None = None, comment: str | None = None) -> DataFrame:
    """A26 + C12: the service orders a week's posting would send, one per type.

    REPACK is billed on time and materials (nothing to post); STORAGE posts one
    order only when a storage charge id is configured. All four dates of the header
    are the week's, the quantity is 0; ``comment`` replaces the comment made here.
    """
    lines = bill_lines_df.filter(F.col("billing_week").isNotNull())
    sto = storage.filter(F.col("billing_week").isNotNull() & ~F.col("billed") & ~F.col("rate_missing"))
    if week:
        lines = lines.filter(F.col("billing_week") == F.lit(week).cast("date"))
        sto = sto.filter(F.col("billing_week") == F.lit(week).cast("date"))
    # an order's amount is the sum of its priced lines; no priced line → 0
    pk = lines.groupBy("billing_week", "transaction_type").agg(
        F.coalesce(F.sum("amount"), F.lit(0)).cast(MONEY_SUM).alias("amount"),
        F.count(F.lit(1)).alias("lines"))
    st = sto.groupBy("billing_week").agg(F.coalesce(F.sum("amount"), F.lit(0)).cast(MONEY_SUM).alias("amount"),
                                         F.count(F.lit(1)).alias("lines")) \
        .withColumn("transaction_type", F.lit("STORAGE"))
    orders = pk.unionByName(st)
    label = F.date_format("billing_week", "MM.dd.yyyy")
    txn = F.col("transaction_type")
    action = (F.when(txn == "REPACK", F.lit("skip: billed via time and materials"))
              .when((txn == "STORAGE") & F.lit(storage_charge_id is None),
                    F.lit("skip: no storage charge id"))
              .otherwise(F.lit("post")))
    given = F.lit(comment)
    made = F.when(txn == "STORAGE", F.concat(F.lit("STORAGE - "), label)) \
        .otherwise(F.concat(txn, F.lit(" SERVICES - "), label))
    return orders.select("billing_week", "transaction_type", "lines", "amount",
                         F.concat(txn, F.lit(" WE "), label).alias("po_number"),
                         F.coalesce(given, made).alias("comment"), action.alias("action"),
                         F.lit(customer_id).cast("string").alias("customer_id"),
                         F.when(txn == "STORAGE", F.lit(storage_charge_id)).otherwise(F.lit(charge_id))
                         .cast("string").alias("charge_id"),
                         *[F.col("billing_week").alias(c)
                           for c in ("ship_date", "order_date", "delivery_date", "week_end")],
                         F.lit(0).alias("quantity"))


def billed_rows_packing(bill_lines_df: DataFrame, week: str | None = None,
                        source: str = "standalone") -> DataFrame:
    """K3: lines of posted (non-REPACK) orders → billing-line rows, charge_type PACKING."""
    lines = bill_lines_df.filter(F.col("billing_week").isNotNull()
                                 & (F.col("transaction_type") != "REPACK"))
    if week:
        lines = lines.filter(F.col("billing_week") == F.lit(week).cast("date"))
    rows = lines.select(
        "tagid", "icrunidx", "productname", F.col("productname").alias("productdescr"),
        "fcreasonidx", "shipped_qty", F.col("shipped_qty").alias("qnt"),
        F.col("amount").alias("billed_amount"), F.col("ship_date").cast("string").alias("ship_date"),
        F.col("billing_week").cast("string").alias("week_end"),
        F.lit("PACKING").alias("charge_type"), F.lit(source).alias("source"))
    return align_to(rows, BILLING_LINES)


def billed_rows_storage(storage: DataFrame, week: str | None = None,
                        source: str = "standalone") -> DataFrame:
    """K4: unbilled, rated storage rows of a posted week → billing-line rows (STORAGE)."""
    s = storage.filter(F.col("billing_week").isNotNull() & ~F.col("billed") & ~F.col("rate_missing"))
    if week:
        s = s.filter(F.col("billing_week") == F.lit(week).cast("date"))
    rows = s.select("tagid", "sono", F.col("amount").alias("billed_amount"),
                    F.col("ship_date").cast("string").alias("ship_date"),
                    F.col("billing_week").cast("string").alias("week_end"),
                    F.lit("STORAGE").alias("charge_type"), F.lit(source).alias("source"))
    return align_to(rows, BILLING_LINES)


def record_billed(billing_lines: DataFrame, new_rows: DataFrame) -> DataFrame:
    """K2 append: the billing-lines table after recording ``new_rows``."""
    return align_to(billing_lines, BILLING_LINES).unionByName(align_to(new_rows, BILLING_LINES))


def meta_counts(tables: dict[str, DataFrame | None], billing_lines: DataFrame | None) -> DataFrame:
    """Row count per table and distinct billed tags (all charge types) in one job.

    A table that does not exist (``None``) counts 0.
    """
    present = {n: df for n, df in tables.items() if df is not None}
    if not present and billing_lines is None:            # an empty catalogue
        zeros = [F.lit(0).cast("long").alias(n) for n in [*tables, "billed_tags"]]
        return SparkSession.active().range(1).select(*zeros, F.lit(True).alias("db_ok"))
    parts = [df.select(F.lit(name).alias("k"), F.lit(None).cast("long").alias("tagid"))
             for name, df in present.items()]
    if billing_lines is not None:
        parts.append(billing_lines.filter(F.col("tagid").isNotNull())
                     .select(F.lit("billed").alias("k"), F.col("tagid").cast("long")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.agg(*[F.count_if(F.col("k") == name).alias(name) for name in tables],
                 F.count_distinct(F.when(F.col("k") == "billed", F.col("tagid"))).alias("billed_tags"),
                 F.lit(True).alias("db_ok"))


def normalize_items(items: DataFrame) -> DataFrame:
    """Invoice items as the renderer takes them — missing quantity/price count as 0,
    a missing amount is quantity × price; each item gets its page number."""
    q = F.coalesce(F.col("quantity"), F.lit(0))
    p = F.coalesce(F.col("price"), F.lit(0))
    out = items.withColumn("amount", F.coalesce(F.col("amount"), q * p))
    if "line_no" in items.columns:
        out = out.withColumn("page_no",
                             (F.floor((F.col("line_no") - 1) / ROWS_PER_PAGE) + 1).cast("int"))
    return out
