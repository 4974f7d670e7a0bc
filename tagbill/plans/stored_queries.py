"""Registered queries over stored tables: upserts into non-empty tables, refreshes, replies as streams.

Each writes its tables into a store of its own in the shared checkpoint folder, goes through the
life of the table (load, upsert, delete, read) and returns what is stored in the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import catalog, incremental, invoice, labor, ranges, rundetail, shipping
from ..operators.store import Store, Update
from ..schemas import LABOR_REQUESTS, SHIPPING_RUNS
from ..sources import reports
from ..sources.adapter import Domain
from .billing import Billing
from .oracle_sql import with_ctes
from .registry import _REPLIED_WEEKS, _RUN_BASE, ORACLE, _b, _scratch, register


def _store(spark, name: str) -> Store:
    return Store(spark, _scratch(spark, f"store-{name}"))


# ------------------------------------------------------------ classification
def stored_classification(spark, b: Billing) -> Store:
    """A stored dimension: first the produced names, then only the names not seen yet are parsed."""
    store = _store(spark, "classification")
    d = b.d
    catalog.refresh_classification(store, catalog.product_names(d.repack_outputs, d.repack_outputs, d.repack_outputs))
    catalog.refresh_classification(store, catalog.product_names(d.repack_outputs, d.repack_inputs, d.repack_lines))
    return store


@register("classification_stored", "SELECT * FROM classification")
def q_classification_stored(spark, sf):
    return stored_classification(spark, _b(spark, sf)).read(catalog.CLASSIFICATION)


@register("charges_stored", "SELECT * FROM charges")
def q_charges_stored(spark, sf):
    """C2 with the classification read from its stored table."""
    b = _b(spark, sf)
    return Billing(spark, sf, b.d, classification=stored_classification(spark, b).read(catalog.CLASSIFICATION)).charges


@register("storage_charges_stored", "SELECT * FROM storage_charges")
def q_storage_charges_stored(spark, sf):
    b = _b(spark, sf)
    return Billing(spark, sf, b.d, classification=stored_classification(spark, b).read(catalog.CLASSIFICATION)).storage_charges


# -------------------------------------------------------------- run detail
@register("run_store", _RUN_BASE + """
, saved AS (
  SELECT run_no, CASE WHEN run_no % 3 = 0 THEN 'submitted' ELSE status END AS status,
         CASE WHEN run_no % 3 = 0 THEN 'REVISED' ELSE note END AS note, varieties,
         CASE WHEN run_no % 3 = 0 THEN CAST(0 AS DECIMAL(18,2)) ELSE total END AS total,
         CASE WHEN run_no % 3 = 0 THEN 2 ELSE 1 END AS save
  FROM parents),
counted AS (
  SELECT run_no, count(*) AS lines, CAST(sum(total) AS DECIMAL(38,2)) AS material,
         count(*) AS labor_lines, CAST(sum(pay) AS DECIMAL(38,2)) AS labor,
         count(*) AS io_lines, CAST(sum(quantity) AS DECIMAL(38,4)) AS boxes,
         count(*) FILTER (WHERE seq = 1) AS defect_lines
  FROM m WHERE run_no % 3 <> 0 GROUP BY run_no)
SELECT s.run_no, status, note, varieties, total, CAST(make_timestamp(2024, 1, save, 0, 0, 0) AS TIMESTAMP) AS updated_at,
       coalesce(c.lines, 0) AS lines, c.material, coalesce(c.labor_lines, 0) AS labor_lines, c.labor,
       coalesce(c.io_lines, 0) AS io_lines, c.boxes, coalesce(c.defect_lines, 0) AS defect_lines
FROM saved s LEFT JOIN counted c ON c.run_no = s.run_no WHERE status = 'submitted'""")
def q_run_store(spark, sf):
    """Runs and their lines of all kinds stored, every third run saved again without lines, drafts deleted."""
    b = _b(spark, sf)
    store = _store(spark, "runs")
    rundetail.save_runs(store, b.runs_prepared, "2024-01-01")
    rundetail.save_runs(store, b.run_resave(every=3), "2024-01-02", ["run_no", "status", "note"])
    children = [f"run_{kind}" for kind in rundetail.CHILDREN]
    drafts = store.read("run").filter(F.col("status") == "draft").select("run_no")
    store.delete(["run", *children], drafts)
    for name in children:
        store.compact(name)
    of = lambda kind, *cols: store.read(f"run_{kind}").select(F.col("run_no").alias("_r"), *cols)
    one = F.lit(1)
    lines = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        of("material", one.alias("lines"), F.col("total").alias("material")),
        of("labor", one.alias("labor_lines"), F.col("total_pay").alias("labor")),
        of("io", one.alias("io_lines"), "boxes"), of("defect", one.alias("defect_lines"))])
    lines = lines.groupBy("_r").agg(
        *[F.count(c).alias(c) for c in ("lines", "labor_lines", "io_lines", "defect_lines")],
        *[F.sum(c).cast(f"decimal(38,{scale})").alias(c) for c, scale in (("material", 2), ("labor", 2), ("boxes", 4))])
    runs = store.read("run")
    counted = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return runs.join(lines, runs["run_no"] == lines["_r"], "left").select(
        "run_no", "status", "note", "varieties", "total", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
        counted("lines"), "material", counted("labor_lines"), "labor", counted("io_lines"), "boxes", counted("defect_lines"))


@register("material_prices_stored")
def q_material_prices_stored(spark, sf):
    """Prices upserted into the stored, seeded list."""
    store = _store(spark, "materials")
    store.replace_all({"material": (rundetail.ref_materials(spark), ["name"])}, buckets=4)
    prices = (_b(spark, sf).run_children("material").groupBy(F.col("material").alias("name"))
              .agg(F.min("category").alias("category"), F.max("price_per_unit").alias("default_price"))
              .withColumns({"unit_label": F.lit(None).cast("string"), "seq": F.lit(None).cast("int")}))
    store.update({"material": Update(prices, rundetail.upsert_material_prices)})
    return store.read("material")


ORACLE["material_prices_stored"] = ORACLE["material_price_upsert"]


@register("position_seeds", """
WITH used AS (
  SELECT DISTINCT ['Input Set-on', 'Grader', 'Packers', 'Machine Operator', 'Palletizers', 'Forklift Driver', 'Tally'][l_linenumber] AS name
  FROM lineitem),
seeds(name, seq) AS (VALUES ('Input Set-on', 1), ('Grader', 2), ('Packers', 3), ('Machine Operator', 4), ('Palletizers', 5),
  ('Forklift Driver', 6), ('Tally', 7), ('QC', 8), ('Clean Up', 9), ('Supervisor', 10))
SELECT coalesce(u.name, s.name) AS name, CASE WHEN u.name IS NULL THEN s.seq END AS seq
FROM seeds s FULL JOIN used u ON u.name = s.name""")
def q_position_seeds(spark, sf):
    """Positions that labor lines name, and the seeds that none does (with their place)."""
    used = _b(spark, sf).run_children("labor").select(F.col("position").alias("name")).distinct()
    return reports.seed_missing(used.withColumn("seq", F.lit(None).cast("int")), rundetail.ref_positions(spark))


@register("defect_seeds", """
WITH seeds(name, seq) AS (VALUES ('Scarring', 1), ('Scale', 2), ('Bruising', 3), ('Soft', 4), ('Stem Pulls', 5), ('Decay', 6),
  ('Sooty Mold', 7))
SELECT name, CASE WHEN name = 'Scarring' AND EXISTS (SELECT 1 FROM lineitem WHERE l_linenumber = 1) THEN NULL ELSE seq END AS seq,
       CASE WHEN name = 'Scarring' THEN (SELECT count(*) FROM lineitem WHERE l_linenumber = 1) ELSE 0 END AS lines
FROM seeds""")
def q_defect_seeds(spark, sf):
    """Defects that runs report, how often, and the seeds that none does."""
    used = _b(spark, sf).run_children("defect").groupBy(F.col("defect_type").alias("name")).agg(F.count(F.lit(1)).alias("lines"))
    return reports.seed_missing(used.select("name", F.lit(None).cast("int").alias("seq"), "lines"),
                                rundetail.ref_defects(spark).withColumn("lines", F.lit(0).cast("long")))


# ------------------------------------------------------------------- labor
@register("labor_requests_stored", f"""
WITH replied AS ({_REPLIED_WEEKS}),
sent AS (SELECT billing_week AS week, CAST(count(*) AS INTEGER) AS run_count FROM open_runs WHERE billing_week IS NOT NULL GROUP BY billing_week)
SELECT week, CASE WHEN run_count > 2 THEN 'ops-late' ELSE 'ops' END AS to_address, run_count,
       CASE WHEN run_count <= 2 AND week IN (SELECT week FROM replied) THEN 'received' ELSE 'pending' END AS status,
       run_count <= 2 AND week IN (SELECT week FROM replied) AS received
FROM sent""")
def q_labor_requests_stored(spark, sf):
    """K6/K7 on a stored table: requests sent, replies marked, then weeks of many runs sent once more (pending again)."""
    from ..streaming import labor_replies as lr
    b = _b(spark, sf)
    store = _store(spark, "requests")
    store.create("labor_requests", LABOR_REQUESTS, ["week"], buckets=8)
    weeks = (b.labor_needed().filter(F.col("billing_week").isNotNull()).groupBy(F.col("billing_week").alias("week"))
             .agg(F.count(F.lit(1)).alias("run_count")).withColumn("to_address", F.lit("ops")))
    store.update({"labor_requests": Update(weeks, labor.upsert_labor_requests)})
    replied = lr.accepted(lr.notifications_from_events(b.d.driver.table("events"))).select("week").distinct()
    store.update({"labor_requests": Update(replied, labor.mark_received)})
    again = store.read("labor_requests").filter(F.col("run_count") > 2).select("week", "run_count", F.lit("ops-late").alias("to_address"))
    store.update({"labor_requests": Update(again, labor.upsert_labor_requests)})
    return store.read("labor_requests").select("week", "to_address", "run_count", "status", F.col("received_at").isNotNull().alias("received"))


@register("labor_reply_scan", "SELECT * FROM reply_rows")
def q_labor_reply_scan(spark, sf):
    """Reply sheets written as CSV, read back as text, typed and priced."""
    path = _scratch(spark, "labor-reply")
    reports.write_csv(_b(spark, sf).labor_reply, path)
    return labor.labor_rows(reports.read_labor_reply(spark, path), F.col("_week"), "18.75")


def _reply_streams(spark, sf) -> dict[str, str]:
    """Half of the notifications, then the reply sheets (every fourth week's twice), then the other half and a redelivery."""
    from ..streaming import labor_replies as lr
    b = _b(spark, sf)
    base = _scratch(spark, "reply-join")
    notes = lr.notifications_from_events(b.d.driver.table("events"))
    half = F.pmod(F.xxhash64("message_id"), F.lit(2))
    rows = b.labor_reply.withColumn("sent_at", F.lit("2024-02-01").cast("timestamp"))
    first = (rows.filter(F.dayofmonth("week_end") < 8).withColumn("num_laborers", F.lit("99"))
             .withColumn("sent_at", F.lit("2024-01-01").cast("timestamp")))
    rows.limit(0).write.parquet(f"{base}/replies/none")
    notes.filter(half == 0).write.parquet(f"{base}/notes/0")
    dirs = lr.run_reply_join(spark, f"{base}/notes/*", f"{base}/replies/*", base)
    first.write.parquet(f"{base}/replies/0")
    rows.write.parquet(f"{base}/replies/1")
    lr.run_reply_join(spark, f"{base}/notes/*", f"{base}/replies/*", base)
    notes.filter(half == 1).write.parquet(f"{base}/notes/1")
    notes.filter(F.pmod(F.col("message_id").cast("long"), F.lit(7)) == 0).write.parquet(f"{base}/notes/2")
    return lr.run_reply_join(spark, f"{base}/notes/*", f"{base}/replies/*", base)


@register("labor_reply_join", f"SELECT * FROM reply_rows WHERE week_end IN ({_REPLIED_WEEKS})")
def q_labor_reply_join(spark, sf):
    """ST1/ST3: notifications and reply sheets joined as two streams; either comes first, a later sheet replaces."""
    from ..streaming import labor_replies as lr
    return lr.joined_labor(spark, _reply_streams(spark, sf)["labor"])


@register("labor_messages", """
SELECT CAST(event_id AS VARCHAR) AS message_id, strftime(DATE '1995-01-08' + CAST((event_id % 360) * 7 AS INTEGER), '%Y-%m-%d') AS week
FROM events WHERE event_type = 'purchase' AND event_id % 50 <> 0""")
def q_labor_messages(spark, sf):
    """ST2: the log of messages taken in, each once however often it was delivered."""
    return spark.read.parquet(_reply_streams(spark, sf)["messages"]).select("message_id", "week")


# -------------------------------------------------------- shipping charges
@register("shipping_runs_stored", """
SELECT week_folder, CASE WHEN phyto_count = 0 THEN 'error' WHEN total > 0 THEN 'posted' ELSE status END AS status, total,
       CASE WHEN phyto_count = 0 THEN 'no certificates in ' || week_folder END AS error,
       phyto_count > 0 AND total > 0 AS posted
FROM ship_summary""")
def q_shipping_runs_stored(spark, sf):
    """K12/K13 + P18 on a stored table: runs built, posted, and weeks whose build then fails marked ``error``
    (their total stays, as the failing build supplies status and error only)."""
    b = _b(spark, sf)
    store = _store(spark, "shipping-runs")
    b.ship_rollup = store.staged(b.ship_rollup)          # one row a week; five steps below start from it
    store.create("shipping_runs", SHIPPING_RUNS, ["week_folder"], buckets=8)
    shipping.save_runs(store, b.ship_summary.select("week_folder", "status", "total"))
    head = shipping.order_header(b.ship_totals).join(b.ship_summary.filter("phyto_count > 0").select("week_folder"), "week_folder")
    replies = head.select("week_folder", (F.col("action") == "post").alias("ok"), F.to_json(F.struct("action", "total")).alias("erp_result"))
    store.update({"shipping_runs": Update(replies, shipping.mark_posted)})
    failed = b.ship_summary.filter(F.col("phyto_count") == 0).select(
        "week_folder", F.concat(F.lit("no certificates in "), "week_folder").alias("error"))
    shipping.save_errors(store, failed)
    return store.read("shipping_runs").select("week_folder", "status", "total", "error", F.col("posted_at").isNotNull().alias("posted"))


# ----------------------------------------------------------- snapshot sets
@register("snapshot_set", """
SELECT 'repack_lines' AS name, count(*) AS n FROM repack_lines UNION ALL SELECT 'repack_inputs', count(*) FROM repack_inputs
UNION ALL SELECT 'repack_outputs', count(*) FROM repack_outputs UNION ALL SELECT 'shipping_raw', count(*) FROM shipping_raw
UNION ALL SELECT 'packing_rates', 0""")
def q_snapshot_set(spark, sf):
    """K1 + A18: four snapshot tables replaced twice in one commit each; counts read off the manifest, 0 for a table that isn't there."""
    d = _b(spark, sf).d
    store = _store(spark, "snapshots")
    whole = {"repack_lines": (d.repack_lines, ["icrunidx"]), "repack_inputs": (d.repack_inputs, ["tagid"]),
             "repack_outputs": (d.repack_outputs, ["tagid"]), "shipping_raw": (d.shipping_raw, ["pallet"])}
    store.replace_all({n: (df.limit(1), key) for n, (df, key) in whole.items()})
    store.replace_all(whole)
    counts = [(n, store.count(n)) for n in [*whole, "packing_rates"]]
    return spark.createDataFrame(counts, "name string, n long")


@register("snapshot_set_rows", "SELECT icrunidx, tagid, fcreasonidx, productname, qnt, uom, rundate FROM repack_outputs")
def q_snapshot_set_rows(spark, sf):
    d = _b(spark, sf).d
    store = _store(spark, "snapshots")
    store.replace_all({"repack_inputs": (d.repack_inputs, ["tagid"]), "repack_outputs": (d.repack_inputs, ["tagid"])})
    store.replace_all({"repack_inputs": (d.repack_inputs, ["tagid"]), "repack_outputs": (d.repack_outputs, ["tagid"])})
    return store.read("repack_outputs").select("icrunidx", "tagid", "fcreasonidx", "productname", "qnt", "uom", "rundate")


# ----------------------------------------------------- incremental refresh
class Later(Domain):
    """The next shipping report: every 100th pallet has more cartons, every 200th (from 13) is no longer in it."""

    @property
    def shipping_raw(self):
        raw = super().shipping_raw
        more = F.when(F.col("pallet") % 100 == 7, F.col("icqnt") + 5).otherwise(F.col("icqnt")).cast(raw.schema["icqnt"].dataType)
        return raw.withColumn("icqnt", more).filter(F.col("pallet").isNull() | (F.col("pallet") % 200 != 13))


_LATER = {"shipping_raw": lambda sql: f"""
SELECT * REPLACE (CAST(CASE WHEN pallet % 100 = 7 THEN icqnt + 5 ELSE icqnt END AS DECIMAL(18,4)) AS icqnt)
FROM ({sql}) r WHERE pallet IS NULL OR pallet % 200 <> 13"""}


def _refreshed(spark, sf) -> Store:
    b, later = _b(spark, sf), Later(spark, sf)
    dims = {"classification": b.classification, "packing_rates": b.packing_rates, "storage_rates": b.storage_rates}
    store = _store(spark, "views")
    of = lambda d: incremental.tag_inputs(d.shipping_raw, d.repack_outputs, d.repack_inputs, d.billing_lines)
    incremental.build(store, of(b.d), dims, b.d.labor_charges, b.d.repack_materials)
    incremental.refresh(store, of(later), dims, later.labor_charges, later.repack_materials)
    return store


@register("refreshed_shipped")
def q_refreshed_shipped(spark, sf):
    """ST4: A1 kept up to date from one report to the next."""
    return _refreshed(spark, sf).read("shipped")


@register("refreshed_bill_summary")
def q_refreshed_bill_summary(spark, sf):
    """ST4: A14 kept up to date from one report to the next."""
    return incremental.bill_summary(_refreshed(spark, sf))


ORACLE["refreshed_shipped"] = with_ctes("SELECT * FROM shipped", _LATER)
ORACLE["refreshed_bill_summary"] = with_ctes("SELECT * FROM bill_summary", _LATER)


# ------------------------------------------------------------ invoice items
@register("invoice_items_normalised", f"""
SELECT CAST(row_number() OVER (ORDER BY description, price, quantity) AS INTEGER) AS line_no, description, quantity, price,
       CAST(coalesce(amount, coalesce(quantity, 0) * coalesce(price, 0)) AS DECIMAL(38,4)) AS amount,
       CAST((row_number() OVER (ORDER BY description, price, quantity) - 1) // 24 + 1 AS INTEGER) AS page_no
FROM (SELECT chargedescr || ' ' || week_folder AS description, rate AS price, CAST(sum(qnt) AS DECIMAL(38,4)) AS quantity,
             CASE WHEN bool_or(amt IS NULL) THEN NULL ELSE CAST(sum(amt) AS DECIMAL(38,4)) END AS amount
      FROM ship_report GROUP BY chargedescr, week_folder, rate) x""")
def q_invoice_items_normalised(spark, sf):
    """Items of the shipping report by week, kind and price; those with a missing amount take quantity times price."""
    from pyspark.sql import Window
    items = (_b(spark, sf).ship_trimmed.groupBy(F.concat_ws(" ", "chargedescr", "week_folder").alias("description"), F.col("rate").alias("price"))
             .agg(F.sum("qnt").cast("decimal(38,4)").alias("quantity"), F.sum("amt").cast("decimal(38,4)").alias("_sum"),
                  F.bool_or(F.col("amt").isNull()).alias("_gap"))
             .withColumn("amount", F.when(~F.col("_gap"), F.col("_sum"))).drop("_sum", "_gap"))
    # the grouped lines are numbered in one window: as many as weeks times prices
    items = items.withColumn("line_no", F.row_number().over(Window.orderBy("description", "price", "quantity")))
    return invoice.normalize_items(items).select("line_no", "description", "quantity", "price",
                                                 F.col("amount").cast("decimal(38,4)").alias("amount"), "page_no")


# ------------------------------------------------------- ordered by ranges
@register("lines_carried_forward", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       last_value(head IGNORE NULLS) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, head
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head
FROM (SELECT *, CASE WHEN l_partkey % 50 = 0 THEN l_suppkey END AS head FROM lineitem) l""")
def q_lines_carried_forward(spark, sf):
    """Every line gets the supplier of the last line before it (or itself) of a part divisible by 50; one order over all lines."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "own"]
    li = _b(spark, sf).d.driver.table("lineitem").select(*order[:-1]).withColumn(
        "own", F.when(F.pmod("l_partkey", F.lit(50)) == 0, F.col("l_suppkey")))
    return ranges.carry_forward(li, order, "own", "head").drop("own")


@register("status_page_deep", """
SELECT tagid, role, icrunidx, productname, wh_status, billing_status FROM repack_status ORDER BY tagid LIMIT 25 OFFSET 900""")
def q_status_page_deep(spark, sf):
    """O1: a page far down the status listing, of a view written in ranges once and read by range."""
    path = _scratch(spark, "status-pages")
    ranges.write_pages(_b(spark, sf).repack_status.select("tagid", "role", "icrunidx", "productname", "wh_status", "billing_status"),
                       ["tagid"], path)
    return ranges.page(spark, path, ["tagid"], 900, 25)
