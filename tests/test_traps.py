"""Micro-tables with hand-computed answers, one per semantic trap."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from tagbill import schemas as S
from tagbill.functions.dates import billing_week, guarded_iso, guarded_mdy, week_folder_date
from tagbill.functions.products import bagtype, classify_columns
from tagbill.operators import catalog, charges, labor, rollups, shipped, status, storage


def _names(spark, names):
    return spark.createDataFrame([(n,) for n in names], "productname string")


def test_bagtype_rules(spark):
    cases = {
        "ORG MANDARIN 10/3LB NET BAG": "NET", "COV LEMON 8/3LB COMBO BAG": "COMBO",
        "COV ORANGE 15/2LB POUCH BAG": "POUCH", "ORG LEMON 12/2LB BAG": "GIRO",
        "ORG ORANGE 12/3 LB": "BULK", "ORG LEMON 18/2LB": "GIRO", "COV MANDARIN 12LB CLAM": "CLAM",
        "COV LEMON 25LB CARTON": "BULK", "NETTED 12/2LB BAG": "GIRO", None: "BULK",
    }
    df = spark.createDataFrame([(k,) for k in cases], "n string").select("n", bagtype("n").alias("b"))
    got = {r.n: r.b for r in df.collect()}
    assert got == cases


def test_classification_needs_llm(spark):
    df = _names(spark, ["ORG LEMON 12/2LB BAG", "Field Bin", "SETBACK BIN"]) \
        .select("productname", *classify_columns())
    got = {r.productname: r for r in df.collect()}
    assert (got["ORG LEMON 12/2LB BAG"].type, got["ORG LEMON 12/2LB BAG"].style) == ("ORG", "12/2LB")
    assert got["ORG LEMON 12/2LB BAG"].needs_llm is False
    assert got["Field Bin"].needs_llm is True


def test_dates(spark):
    df = spark.createDataFrame(
        [("08/03/1995 06:00", "2024-01-06"), ("TOTAL", "bad"), ("13/45/2026", "2024-13-45"),
         (None, "2024-01-07")], "s string, w string")
    r = df.select(guarded_mdy("s").alias("d"), guarded_iso("w").alias("w"),
                  billing_week(guarded_iso("w")).alias("bw")).collect()
    assert r[0].d == dt.date(1995, 8, 3) and r[0].bw == dt.date(2024, 1, 7)   # Saturday → Sunday
    assert r[1].d is None and r[1].w is None
    assert r[2].d is None and r[2].w is None
    assert r[3].bw == dt.date(2024, 1, 7)                                       # Sunday → itself
    f = spark.createDataFrame([("WE 05.17.2026",), ("WE 02.30.2026",), ("misc",)], "n string")
    assert [x.d for x in f.select(week_folder_date("n").alias("d")).collect()] == [
        dt.date(2026, 5, 17), None, None]


def _tags(spark, rows):
    return spark.createDataFrame(rows, S.REPACK_TAGS)


def _billing(spark, rows):
    full = [(t, None, None, None, None, None, None, None, None, None, None, ct, "t") for t, ct in rows]
    return spark.createDataFrame(full, S.BILLING_LINES)


def _shipped(spark, rows):
    return spark.createDataFrame(
        rows, "tagid long, shipped_qty decimal(18,4), sono string, lastconame string, "
              "ship_date date, recv_date date, productname string")


def test_status_and_charges(spark):
    d0 = dt.date(2024, 1, 1)
    outputs = _tags(spark, [
        (10, 1, 39, "ORG LEMON 12/2LB BAG", D("5"), "CS", d0),      # billable, exact rate
        (10, 2, None, "ORG LEMON 12/2LB BAG", D("5"), "CS", d0),    # NULL reason → NULL status
        (10, 3, 39, None, D("5"), "CS", d0),                        # NULL product → not-billable
        (10, 4, 12, "ORG LEMON 12/2LB BAG", D("5"), "CS", d0),      # billed reason 12 → OTHER
        (11, 5, 41, "ORG LEMON 25LB CARTON", D("5"), "CS", d0),     # repack: no rate, not missing
        (11, 6, 39, "ORG LEMON 25LB CARTON", D("5"), "CS", d0),     # BULK → GIRO fallback
        (11, 7, 39, "ORG LEMON 12LB CLAM", D("5"), "CS", d0),       # no rate at all
        (11, 8, 39, "COV LEMON Field Bin", D("5"), "CS", d0),       # bin → not-billable
    ])
    inputs = _tags(spark, [(11, 1, 39, "x", D("1"), "CS", d0), (12, 99, 39, "ORG LEMON 12/2LB BAG",
                                                                   D("1"), "CS", d0)])
    ship = _shipped(spark, [(t, D("2.665") if t == 1 else D("3"), "1", "C", dt.date(2024, 1, 10),
                             dt.date(2024, 1, 1), "p") for t in (1, 2, 3, 4, 5, 6, 7, 8, 99)])
    billing = _billing(spark, [(4, None), (6, "STORAGE")])
    st = status.status_with_ship(outputs, inputs, ship, billing)
    got = {r.tagid: (r.role, r.wh_status, r.billing_status) for r in st.collect()}
    assert got[1] == ("output", "shipped", "billable")
    assert got[2][2] is None
    assert got[3][2] == "not-billable"
    assert got[4][2] == "billed"
    assert got[6][2] == "billable"          # a STORAGE line does not make a tag packing-billed
    assert got[8][2] == "not-billable"
    assert got[99][0] == "input_only"

    cls = catalog.classification(_names(spark, ["ORG LEMON 12/2LB BAG", "ORG LEMON 25LB CARTON",
                                                "ORG LEMON 12LB CLAM"]))
    rates = catalog.packing_rates(spark.createDataFrame([
        ("ORG", "LEMON", " 12/2LB ", "GIRO", None, D("1.0000")),
        ("ORG", "LEMON", "12/2LB", "GIRO", "RPC", D("9.0000")),      # loses to the blank method
        ("ORG", "LEMON", "25LB", "GIRO", None, D("2.0000")),
    ], S.PACKING_RATES))
    assert rates.count() == 2
    ch = {r.tagid: r for r in charges.charges(st, cls, rates).collect()}
    assert set(ch) == {1, 4, 5, 6, 7, 99}        # 99: an input-only tag that shipped
    assert ch[1].amount == D("2.67") and ch[1].rate == D("1.0000")   # 2.665 → 2.67 (half up)
    assert ch[4].transaction_type == "OTHER" and ch[4].billed
    assert ch[5].rate is None and ch[5].amount is None and ch[5].rate_missing is False
    assert ch[6].rate_giro_fallback and ch[6].amount == D("6.00")
    assert ch[7].rate_missing and ch[7].amount is None


def test_bill_summary_null_week_and_labor_not_in(spark):
    lines = spark.createDataFrame(
        [(None, D("5.00"), 41, 7), (dt.date(2024, 1, 7), D("2.00"), 41, None)],
        "billing_week date, amount decimal(18,2), fcreasonidx int, icrunidx long") \
        .withColumn("transaction_type", F.lit("REPACK")).withColumn("productname", F.lit("p")) \
        .withColumn("shipped_qty", F.lit(D("1")).cast("decimal(18,4)"))
    sto = spark.createDataFrame([], "billing_week date, amount decimal(18,2), billed boolean")
    lab = spark.createDataFrame([(1, "2024-01-07", D("10.00")), (2, "bad", D("99.00"))],
                                "icrunidx long, week_end string, labor_charge decimal(18,2)")
    mat = spark.createDataFrame([], "icrunidx long, week_end string, materials_charge decimal(18,2)")
    out = {r.billing_week: r for r in rollups.bill_summary(lines, sto, lab, mat).collect()}
    assert out[None].service_amount == 0 and out[None].total_amount == 0   # NULL week vanishes
    assert out[dt.date(2024, 1, 7)].total_amount == D("12.00")
    # NOT IN: a NULL run survives only when the labor table has no non-null run
    needed = labor.labor_needed(lines, lab)
    assert [r.icrunidx for r in needed.collect()] == [7]
    empty = spark.createDataFrame([], "icrunidx long")
    assert sorted([r.icrunidx for r in labor.labor_needed(lines, empty).collect()],
                  key=lambda x: (x is None, x)) == [7, None]


def test_storage_days_and_sheet(spark):
    ship = _shipped(spark, [
        (1, D("10"), "1", "C", dt.date(2024, 1, 8), dt.date(2024, 1, 1), "ORG LEMON 12/2LB BAG"),  # 7 days
        (2, D("10"), "1", "C", dt.date(2024, 1, 9), dt.date(2024, 1, 1), "ORG LEMON 12/2LB BAG"),  # 8 days
        (3, D("10"), "1", "C", None, dt.date(2024, 1, 1), "ORG LEMON 12/2LB BAG"),
    ])
    sheet = spark.createDataFrame([
        ("S", 0, "12/2# BAG", "80", "0.75", None),                  # before any header: ignored
        ("S", 1, "ORGANIC LEMON COLD STORAGE RATES", None, None, None),
        ("S", 2, "12/2# BAG", "80", "0.75", None),                  # no bag keyword → BULK
        ("S", 3, "12/2# GIRO BAG", "80", "0.7500", "0.5"),          # d overrides c
        ("S", 4, "PACKING RATES (misc)", None, None, None),         # header without commodity
        ("S", 5, "12/2# GIRO BAG", "70", "0.1", None),              # duplicate key: first wins
        ("S", 6, "EURO TRAY", "70", "0.1", None),                   # no style → dropped
    ], S.STORAGE_SHEET)
    rates = {(r.style, r.bagtype): r.rate for r in catalog.storage_rates(sheet).collect()}
    assert rates == {("12/2LB", "BULK"): D("0.7500"), ("12/2LB", "GIRO"): D("0.5000")}
    cls = catalog.classification(_names(spark, ["ORG LEMON 12/2LB BAG"]))
    billing = _billing(spark, [(2, "STORAGE")])
    sc = {r.tagid: r for r in storage.storage_charges(
        ship, cls, catalog.storage_rates(sheet), billing).collect()}
    assert set(sc) == {2}
    assert sc[2].billable_days == 1 and sc[2].amount == D("5.00") and sc[2].billed


def test_shipped_aggregate(spark):
    raw = spark.createDataFrame([
        (1, 5, 1, D("2"), "9", "B", "01/05/2024 06:00", "01/01/2024", "p"),
        (1, 5, 1, D("3"), "10", "A", "TOTAL", "13/45/2024", "p"),
        (1, 3, 1, D("100"), "1", "A", "01/01/2024", "01/01/2024", "p"),   # footer record type
        (None, 5, 1, D("7"), "1", "A", "01/01/2024", "01/01/2024", "p"),
        (2, 5, 2, D("7"), "1", "A", "01/01/2024", "01/01/2024", "p"),     # other transaction
    ], S.SHIPPING_RAW)
    r = shipped.shipped(raw).collect()
    assert len(r) == 1 and r[0].shipped_qty == D("5") and r[0].sono == "10"
    assert r[0].ship_date == dt.date(2024, 1, 5) and r[0].recv_date == dt.date(2024, 1, 1)
