"""Upserts expressed as anti-join ∪ new."""

import datetime as dt
from decimal import Decimal as D

from tagbill import schemas as S
from tagbill.operators import catalog, labor, rundetail


def test_classification_upsert(spark):
    cur = spark.createDataFrame([("A", "ORG", "LEMON", "1LB", False, "BULK"),
                                 ("B", None, None, None, True, "BULK")],
                                "productname string, type string, commodity string, style string, "
                                "needs_llm boolean, bagtype string")
    fresh = catalog.classification(spark.createDataFrame([("B",), ("COV LEMON 12/2LB BAG",)], "productname string"))
    out = {r.productname: r for r in catalog.upsert_classification(cur, fresh).collect()}
    assert set(out) == {"A", "B", "COV LEMON 12/2LB BAG"}
    assert out["A"].type == "ORG" and out["COV LEMON 12/2LB BAG"].bagtype == "GIRO"


def test_labor_requests_roundtrip(spark):
    t0 = dt.datetime(2024, 1, 1)
    cur = spark.createDataFrame([("2024-01-07", "a", 2, "received", t0, t0),
                                 ("2024-01-14", "a", 1, "pending", t0, None)], S.LABOR_REQUESTS)
    weeks = spark.createDataFrame([("2024-01-07", "b", 3)], "week string, to_address string, run_count long")
    sent = labor.upsert_labor_requests(cur, weeks)
    got = {r.week: r for r in sent.collect()}
    assert got["2024-01-07"].status == "pending" and got["2024-01-07"].received_at is None
    assert got["2024-01-07"].to_address == "b" and got["2024-01-14"].to_address == "a"
    done = {r.week: r for r in labor.mark_received(sent, spark.createDataFrame(
        [("2024-01-14",)], "week string")).collect()}
    assert done["2024-01-14"].status == "received" and done["2024-01-14"].received_at is not None
    assert done["2024-01-07"].status == "pending"


def test_material_price_upsert(spark):
    cur = rundetail.ref_materials(spark)
    prices = spark.createDataFrame([("CHEP", None, D("16.5"), None, None), ("New", "other", D("1"), None, None)],
                                   "name string, category string, default_price decimal(12,4), "
                                   "unit_label string, seq int")
    out = {r.name: r for r in rundetail.upsert_material_prices(cur, prices).collect()}
    assert len(out) == 10
    assert out["CHEP"].default_price == D("16.5") and out["CHEP"].category == "pallet"   # kept
    assert out["CHEP"].unit_label == "pallet" and out["New"].seq is None


def test_meta_counts_missing_table(spark):
    from tagbill.operators import invoice
    t = spark.createDataFrame([(1,), (2,)], "x int")
    bl = spark.createDataFrame([(1, "A"), (1, "B"), (None, "C")], "tagid long, charge_type string")
    r = invoice.meta_counts({"a": t, "gone": None}, bl).first()
    assert (r.a, r.gone, r.billed_tags, r.db_ok) == (2, 0, 1, True)
