"""Weekly shipping charges with certificate debits.

Everything is keyed by ``week_folder`` (``WE mm.dd.yyyy``), so one job prices
every week at once; selecting one week is a filter on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import display_ship_date, week_folder_date
from ..schemas import MONEY, MONEY_SUM, SHIPPING_RUNS
from .state import upsert_supplied
from .store import Store, Update

# Report columns kept (in this order) and match reasons.
KEEP_COLS = ["shipdatetime", "sono", "chargedescr", "qnt", "rate", "amt"]
MATCH_FOUND = "Exact certificate match found"
MATCH_NONE = "No Exact Match found"
INSPECTION = "phytosanitary inspection"
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August",
          "September", "October", "November", "December"]


def trim_report(report: DataFrame, keys: tuple[str, ...] = ("week_folder",)) -> DataFrame:
    """Keep the six report columns, matched case-insensitively.

    A missing column is an error naming every missing one; the check reads only
    the schema (no job runs).
    """
    lower = {c.lower(): c for c in report.columns}
    missing = [c for c in KEEP_COLS if c not in lower]
    if missing:
        raise KeyError(f"Missing columns in report: {missing}. Got: {report.columns}")
    return report.select(*[F.col(f"`{k}`") for k in keys if k in report.columns],
                         *[F.col(f"`{lower[c]}`").alias(c) for c in KEEP_COLS])


def norm_certificate(c: Column) -> Column:
    """strip, drop spaces and dashes, upper-case."""
    return F.upper(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), "[ -]", ""))


def debit_match(certs: DataFrame) -> DataFrame:
    """The first debit row (array order) whose normalised number equals the certificate's.

    Evaluated inside each row with ``filter`` on the array: no explode, no shuffle.
    A match with no amount is still a match.
    """
    target = norm_certificate(F.col("current_certificate_number"))
    first = F.try_element_at(
        F.filter("debit_rows", lambda r: norm_certificate(r["certificate_number"]) == target), F.lit(1))
    hit = first.isNotNull()
    return certs.select(
        "week_folder", "file", "order_number",
        hit.alias("matched"),
        F.col("current_certificate_number"),
        first["certificate_number"].alias("matched_certificate_number"),
        first["date"].alias("debit_date"),
        first["debit_amount"].alias("debit_amount"),
        F.when(hit, F.lit(MATCH_FOUND)).otherwise(F.lit(MATCH_NONE)).alias("reason"))


def needs_review(results: DataFrame) -> Column:
    """No order number (NULL or 0) or no debit match."""
    return (F.coalesce(F.col("order_number"), F.lit(0)) == 0) | ~F.coalesce(F.col("matched"), F.lit(False))


def resolve(versions: DataFrame) -> DataFrame:
    """The last version (greatest ``seq``) of every file's record; a file without a result (``seq`` 0) is left out."""
    cols = [c for c in versions.columns if c not in ("file", "week_folder", "seq")]
    last = versions.groupBy("week_folder", "file").agg(
        F.max_by(F.struct(*cols), "seq").alias("_v"), F.min("seq").alias("_first"))
    return last.filter(F.col("_first") == 0).select("week_folder", "file", "_v.*")


def apply_corrections(results: DataFrame, corrections: DataFrame) -> DataFrame:
    """A correction replaces its file's record whole; the last one per file wins.

    Results and corrections are one set of versions, so one shuffle picks the record of each
    file. Corrections for files not in the run are ignored.
    """
    return resolve(results.withColumn("seq", F.lit(0)).unionByName(corrections.select(*results.columns, "seq")))


def combine(trimmed: DataFrame, results: DataFrame) -> DataFrame:
    """Shipping rows ⟕ certificate results on the week and numeric sono = order number.

    Several certificates for one order repeat that order's charge rows, as the
    reference does. Rows whose sono is not numeric match nothing (the reference's
    pandas merge would pair missing keys with missing keys; we keep them unmatched
    rather than emit every pairing of missing keys).
    """
    ph = results.select(
        F.col("week_folder").alias("_w"),
        F.expr("try_cast(order_number AS DOUBLE)").alias("_k"),
        F.col("current_certificate_number").alias("certificate_number"),
        "debit_date", "debit_amount", F.col("matched").alias("phyto_matched"))
    t = trimmed.withColumn("_s", F.expr("try_cast(sono AS DOUBLE)"))
    j = t.join(ph, (t["week_folder"] == ph["_w"]) & (t["_s"] == ph["_k"]), "left")
    return j.drop("_w", "_k", "_s")


def week_rollup(trimmed: DataFrame, results: DataFrame) -> DataFrame:
    """A20 + A21 + P18: certificate count, review count, total and status of each week, in one pass.

    The combined report repeats an order's charges for each of its certificates, so its amounts
    add up to the order's charges times its certificates (once, if it has none): charges and
    certificates are tagged, unioned and reduced by (week, order number), without the rows in
    between. Missing and non-numeric numbers are one key of their own, which pairs every charge
    without a number with every certificate without one, as the reference's merge does.
    """
    key = lambda c: F.expr(f"nullif(try_cast({c} AS DOUBLE), double('NaN'))")
    zero = F.lit(0).cast(MONEY_SUM)
    charge = trimmed.select("week_folder", key("sono").alias("k"), F.coalesce("amt", F.lit(0)).cast(MONEY_SUM).alias("amt"),
                            zero.alias("debit"), F.lit(0).alias("cert"), F.lit(False).alias("needs"))
    cert = results.select("week_folder", key("order_number").alias("k"), zero.alias("amt"),
                          F.coalesce("debit_amount", F.lit(0)).cast(MONEY_SUM).alias("debit"), F.lit(1).alias("cert"),
                          needs_review(results).alias("needs"))
    order = charge.unionByName(cert).groupBy("week_folder", "k").agg(
        F.sum("amt").alias("amt"), F.sum("debit").alias("debit"), F.sum("cert").alias("certs"), F.count_if("needs").alias("needs"))
    times = F.greatest(F.col("certs"), F.lit(1)).cast("decimal(20,0)")
    week = order.groupBy("week_folder").agg(
        F.sum("certs").alias("phyto_count"), F.sum("needs").alias("needs_review_count"),
        F.round(F.sum((F.col("amt").cast("decimal(28,2)") * times).cast(MONEY_SUM) + F.col("debit")), 2).cast(MONEY_SUM).alias("total"))
    return week.withColumn("status", F.when(F.col("needs_review_count") > 0, "needs_review").otherwise("built"))


def shipping_total(rollup: DataFrame) -> DataFrame:
    """What a week's combined charges and matched debits add up to."""
    return rollup.select("week_folder", "total")


def run_summary(rollup: DataFrame) -> DataFrame:
    """The summary of each week's run."""
    return rollup.select("week_folder", "phyto_count", "needs_review_count", "total", "status")


def sheet_rows(combined: DataFrame, results: DataFrame) -> DataFrame:
    """Invoice sheet rows — charge rows, then one inspection row per certificate."""
    a = combined.select(
        "week_folder", F.lit(1).alias("section"),
        display_ship_date(F.col("shipdatetime")).alias("ship_date"),
        F.col("sono").alias("order_no"), F.col("chargedescr").alias("material"),
        F.col("qnt").cast("decimal(18,4)").alias("qty"),
        F.col("rate").cast("decimal(18,4)").alias("cost_each"),
        F.col("amt").cast(MONEY).alias("total"))
    b = results.select(
        "week_folder", F.lit(2).alias("section"),
        display_ship_date(F.col("debit_date")).alias("ship_date"),
        F.col("order_number").cast("string").alias("order_no"), F.lit(INSPECTION).alias("material"),
        F.lit(1).cast("decimal(18,4)").alias("qty"),
        F.col("debit_amount").cast("decimal(18,4)").alias("cost_each"),
        F.col("debit_amount").cast(MONEY).alias("total"))
    return a.unionByName(b)


def order_header(totals: DataFrame) -> DataFrame:
    """The order a week would post; nothing when the amount is not positive."""
    return totals.select(
        "week_folder", week_folder_date("week_folder").alias("week_end"), "total",
        F.when(F.col("total") <= 0, F.lit("nothing to post")).otherwise(F.lit("post")).alias("action"))


def week_folders(names: DataFrame) -> DataFrame:
    """``WE mm.dd.yyyy`` folder names → date; others and invalid dates dropped, newest first."""
    d = names.select("week_folder", week_folder_date("week_folder").alias("date"))
    return d.filter(F.col("date").isNotNull()).orderBy(F.col("date").desc())


def folder_tree(folders: DataFrame, runs: DataFrame) -> DataFrame:
    """A22 + J15: year → month → weeks (newest first), each week annotated with its run."""
    j = folders.join(runs.select("week_folder", "status", "total"), "week_folder", "left")
    wk = j.select(F.year("date").alias("year"), F.month("date").alias("month"),
                  F.struct(F.col("date").alias("date"), "week_folder", "status", "total",
                           F.col("status").isNotNull().alias("has_run")).alias("w"))
    months = (wk.groupBy("year", "month")
              .agg(F.sort_array(F.collect_list("w"), asc=False).alias("weeks")))
    label = F.concat(F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.col("month")),
                     F.lit(" "), F.col("year").cast("string"))
    return (months.select("year", F.struct("month", label.alias("label"), "weeks").alias("m"))
            .groupBy("year").agg(F.sort_array(F.collect_list("m"), asc=False).alias("months"))
            .orderBy(F.col("year").desc()))


def tree_weeks(tree: DataFrame) -> DataFrame:
    """One row per week of a folder tree, with its month's and its own place (from 0)."""
    months = tree.select("year", F.posexplode("months").alias("month_place", "m"))
    return (months.select("year", "month_place", "m.month", "m.label", F.posexplode("m.weeks").alias("week_place", "w"))
            .select("year", "month_place", "month", "label", "week_place", "w.*"))


def latest_week_folder(folders: DataFrame) -> DataFrame:
    """The newest folder by its date — a max_by aggregate, no global sort."""
    return folders.agg(F.max_by("week_folder", "date").alias("week_folder"),
                       F.max("date").alias("date"))


RUN_LISTING = ["week_folder", "status", "total", "created_at"]


def run_listing(runs: DataFrame) -> DataFrame:
    """The runs, newest first; runs created at the same time go by folder."""
    return runs.select(*RUN_LISTING).orderBy(F.col("created_at").desc_nulls_last(), F.desc("week_folder"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The run created last, as one row (none without runs)."""
    return run_listing(runs).limit(1)


def mark_posted(runs: DataFrame, replies: DataFrame) -> DataFrame:
    """Store each week's ERP reply; only an ok reply sets status 'posted' and posted_at."""
    r = replies.select(F.col("week_folder").alias("_w"), F.col("ok").alias("_ok"),
                       F.col("erp_result").alias("_reply"))
    j = runs.join(r, runs["week_folder"] == r["_w"], "left")
    hit, ok = F.col("_w").isNotNull(), F.coalesce(F.col("_ok"), F.lit(False))
    return j.select(*[
        (F.when(hit & ok, F.lit("posted")).otherwise(F.col(c)) if c == "status"
         else F.when(hit, F.col("_reply")).otherwise(F.col(c)) if c == "erp_result"
         else F.when(hit & ok, F.current_timestamp()).otherwise(F.col(c)) if c == "posted_at"
         else F.col(c)).alias(c) for c in runs.columns])


def save_runs(store: Store, built: DataFrame, table: str = "shipping_runs") -> int:
    """Upsert built runs; columns that ``built`` does not have keep their stored values, an earlier error goes."""
    supplied = [*built.columns, "error"]
    fresh = built.withColumn("error", F.lit(None).cast("string"))
    return store.update({table: Update(fresh, lambda current, rows: upsert_supplied(
        current, rows, "week_folder", supplied, SHIPPING_RUNS))})


def save_errors(store: Store, failed: DataFrame, table: str = "shipping_runs") -> int:
    """A week whose build failed gets status ``error`` and the message; all else stays as stored."""
    fresh = failed.select("week_folder", F.lit("error").alias("status"), "error")
    return store.update({table: Update(fresh, lambda current, rows: upsert_supplied(
        current, rows, "week_folder", fresh.columns, SHIPPING_RUNS))})
