"""Report files: quoting, header order, many-file reports, one version space."""

import os

import pytest
from pyspark.sql import functions as F

from tagbill.operators import state
from tagbill.operators.catalog import upsert_classification
from tagbill.operators.labor import upsert_labor_requests
from tagbill.sources import reports
from tagbill.streaming.snapshot_refresh import refresh_repack_snapshots

HEADER = ["RecType", "OutputFlag", "ICRunIdx", "TagID", "FCReasonIdx", "ProductName", "Qnt", "UOM", "RunDate"]


def write_report(folder, files, rows_each, header=HEADER, first=0):
    os.makedirs(folder)
    for k in range(files):
        with open(f"{folder}/part-{k}.csv", "w") as f:
            f.write(",".join(header) + "\n")
            for i in range(rows_each):
                n = first + k * rows_each + i
                row = {"RecType": 2, "OutputFlag": "Y", "ICRunIdx": n // 4, "TagID": n, "FCReasonIdx": 39,
                       "ProductName": '"84"" X, Y"', "Qnt": 5, "UOM": "CS", "RunDate": "2024-01-07"}
                f.write(",".join(str(row[h]) for h in header) + "\n")


def outputs(spark, root):
    return state.read_snapshot(spark, f"{root}/repack_outputs")


def test_refresh_holds_the_whole_latest_report(spark, tmp_path):
    inbox, root, ck = (str(tmp_path / x) for x in ("inbox", "root", "ck"))
    old = spark.createDataFrame([(1,)], "tagid long")
    for _ in range(3):
        state.write_snapshot(old, f"{root}/repack_outputs")
    write_report(f"{inbox}/a", 4, 30)
    refresh_repack_snapshots(spark, inbox, root, ck)
    got = outputs(spark, root)
    assert got.count() == 120 and got.select("productname").distinct().collect()[0][0] == '84" X, Y'
    assert state.numbered_folders(spark, f"{root}/repack_outputs") == [0, 1, 2, 3]
    # the next report, with its columns in another order, replaces it
    write_report(f"{inbox}/b", 2, 10, header=HEADER[::-1], first=1000)
    refresh_repack_snapshots(spark, inbox, root, ck)
    assert outputs(spark, root).agg(F.min("tagid"), F.count("*")).first()[:] == (1000, 20)
    # replay after the batch had finished: nothing new; nothing landed: nothing new
    for name in os.listdir(f"{ck}/commits"):
        if name.strip(".").startswith("1"):
            os.remove(f"{ck}/commits/{name}")
    refresh_repack_snapshots(spark, inbox, root, ck)
    assert state.numbered_folders(spark, f"{root}/repack_outputs") == [0, 1, 2, 3, 4]


def test_refresh_fails_on_a_missing_column(spark, tmp_path):
    inbox, root, ck = (str(tmp_path / x) for x in ("inbox", "root", "ck"))
    write_report(f"{inbox}/a", 1, 3, header=HEADER[:-1])
    with pytest.raises(Exception, match="rundate"):
        refresh_repack_snapshots(spark, inbox, root, ck)
    assert outputs(spark, root) is None


def test_quoted_values_round_trip(spark, tmp_path):
    rows = [(1, '84" X, Y'), (2, "line\nfeed"), (3, "plain")]
    df = spark.createDataFrame(rows, "tagid long, productname string")
    path = str(tmp_path / "out")
    reports.write_csv(df, path)
    back = reports.read_report_csv(spark, path)
    assert sorted((int(r.tagid), r.productname) for r in back.collect()) == rows


def test_code_page_leaves_the_session_alone(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_bytes("Pallet,LastCoName\n1,Caf\xe9 \x80\n".encode("latin-1"))
    before = spark.conf.get("spark.sql.legacy.javaCharsets")
    assert reports.read_report_csv(spark, str(p), "windows-1252").first().lastconame == "Café €"
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == before


def test_upserts_take_one_row_per_key(spark):
    weeks = spark.createDataFrame([("2024-01-07", "a@x", 1), ("2024-01-07", "b@x", 3), ("2024-01-14", "a@x", 2)],
                                  "week string, to_address string, run_count int")
    none = upsert_labor_requests(weeks.limit(0).select(
        "week", "to_address", "run_count", F.lit("").alias("status"), F.lit(None).cast("timestamp").alias("sent_at"),
        F.lit(None).cast("timestamp").alias("received_at")), weeks)
    assert sorted((r.week, r.to_address) for r in none.collect()) == [("2024-01-07", "b@x"), ("2024-01-14", "a@x")]
    kind = "productname string, type string, commodity string, style string, needs_llm boolean, bagtype string"
    cur = spark.createDataFrame([("p", "ORG", "LEMON", None, True, "BULK"), ("q", None, None, None, True, "BULK")], kind)
    new = spark.createDataFrame([("p", "COV", "LEMON", "25LB", False, "BULK"), ("p", "ORG", "LEMON", "25LB", False, "BULK")], kind)
    got = {r.productname: r.type for r in upsert_classification(cur, new).collect()}
    assert got == {"p": "ORG", "q": None}


def test_documents_saved_together_keep_their_own_fields(spark):
    from tagbill.operators import rundetail
    from tagbill.plans.billing import Billing
    b = Billing(spark, "/root/testdata/sf0.001")
    current = b.run_parents.filter("run_no < 40")
    a, c = [r.run_no for r in current.select("run_no").orderBy("run_no").limit(2).collect()]
    saved = (b.run_parents.filter(F.col("run_no").isin(a, c))
             .withColumn("note", F.lit("NEW")).withColumn("status", F.lit("closed"))
             .withColumn("has", F.when(F.col("run_no") == a, F.array(F.lit("note"))).otherwise(F.array(F.lit("status")))))
    before = {r.run_no: r for r in current.collect()}
    after = {r.run_no: r for r in rundetail.upsert_parents(current, saved, "has").collect()}
    assert (after[a].note, after[a].status) == ("NEW", before[a].status)
    assert (after[c].note, after[c].status) == (before[c].note, "closed")
    assert set(after) == set(before)
