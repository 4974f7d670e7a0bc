"""Ingest and publish jobs: versioned snapshots, week partitions."""

import os

from pyspark.sql import functions as F

from tagbill.plans import jobs
from tagbill.plans.billing import Billing
from tagbill.sources import reports


def test_ingest_then_publish(spark, tmp_path):
    b = Billing(spark, "/root/testdata/sf0.001")
    d = b.d
    rep = str(tmp_path / "repack.csv")
    reports.write_csv(reports.repack_report_rows(d.repack_outputs, d.repack_inputs, d.repack_lines), rep)
    ship = str(tmp_path / "ship.csv")
    reports.write_csv(d.shipping_raw, ship)
    out = jobs.ingest_reports(spark, rep, ship, str(tmp_path / "snap"))
    assert set(out) == {"repack_lines", "repack_inputs", "repack_outputs", "shipping_raw"}
    outputs = spark.read.parquet(out["repack_outputs"])
    assert outputs.count() == d.repack_outputs.count()
    assert spark.read.parquet(out["shipping_raw"]).count() == d.shipping_raw.count()

    pub = jobs.publish_views(b, str(tmp_path / "views"), ["bill_summary"])
    assert any(n.startswith("billing_week=") for n in os.listdir(pub["bill_summary"]))
    back = jobs.read_view(spark, str(tmp_path / "views"), "bill_summary")
    assert back.count() == b.bill_summary.count()
    week = back.filter(F.col("billing_week").isNotNull()).first().billing_week
    one = back.filter(F.col("billing_week") == week)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(billing_week" in plan


def test_incremental_snapshot_refresh(spark, tmp_path):
    from tagbill.operators.state import read_snapshot
    from tagbill.streaming.snapshot_refresh import refresh_repack_snapshots
    d = Billing(spark, "/root/testdata/sf0.001").d
    rows = reports.repack_report_rows(d.repack_outputs, d.repack_inputs, d.repack_lines)
    inbox = tmp_path / "inbox"
    rows.coalesce(1).write.option("header", True).csv(str(inbox / "day1"))
    rows.filter(F.col("ICRunIdx").cast("long") < 100).coalesce(1).write.option("header", True) \
        .csv(str(inbox / "day2"))
    root, ck = str(tmp_path / "snap"), str(tmp_path / "ck")
    refresh_repack_snapshots(spark, str(inbox / "*"), root, ck)
    latest = read_snapshot(spark, f"{root}/repack_outputs")
    assert sorted(os.listdir(f"{root}/repack_outputs")) == ["v=0", "v=1"]
    assert latest.count() == d.repack_outputs.filter(F.col("icrunidx") < 100).count()
    # running again finds no new files: nothing changes
    refresh_repack_snapshots(spark, str(inbox / "*"), root, ck)
    assert sorted(os.listdir(f"{root}/repack_outputs")) == ["v=0", "v=1"]
