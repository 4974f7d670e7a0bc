"""Invoice items, export formats, state folders and the labor stream."""

import os
from decimal import Decimal as D

from pyspark.sql import functions as F

from tagbill import schemas as S
from tagbill.functions.text import money_text, qty_text
from tagbill.operators import invoice, rundetail, shipping, state

# The reference's 15 sample invoice lines (quantity, price).
SAMPLE_LINES = [(1577, "11.96"), (300, "10.90"), (60, "7.50"), (1452, "12.81"), (1341, "7.90"),
                (1369, "8.50"), (10, "12.50"), (126, "13.00"), (72, "11.49"), (120, "12.26"),
                (11, "9.01"), (300, "9.00"), (320, "10.51"), (4, "12.76"), (1980, "12.36")]


def test_invoice_sample_total(spark):
    df = spark.createDataFrame([(i + 1, D(q), D(p), None) for i, (q, p) in enumerate(SAMPLE_LINES)],
                               "line_no int, quantity decimal(18,4), price decimal(12,4), amount decimal(18,2)")
    out = invoice.normalize_items(df)
    assert out.agg(F.sum("amount")).first()[0] == D("98159.07")
    assert {r.page_no for r in out.collect()} == {1}
    assert invoice.ROWS_PER_PAGE == 24


def test_text_formats(spark):
    df = spark.createDataFrame([(D("1234.5"),), (D("3"),), (D("2.25"),)], "v decimal(18,4)")
    got = [(r.m, r.q) for r in df.select(money_text("v").alias("m"), qty_text("v").alias("q")).collect()]
    assert got == [("1,234.50", "1234.5"), ("3.00", "3"), ("2.25", "2.25")]


def test_run_rollups_worked_example(spark):
    # labor pays sum to 125.79, rate 0.20, materials 2 x 15.00 → 25.16 overhead, 180.95 total
    sub = spark.createDataFrame([(
        7, None, [(0, "Packers", None, None, None, None, None, None, D("100.00")),
                  (None, "Grader", None, None, None, None, None, None, D("25.79"))],
        [], None, [(1, "pallet", "CHEP", D("2"), D("15"), D("99.99"))], [])],
        "run_no long, overhead_rate decimal(12,4), labor array<struct<seq:int,position:string,"
        "num_workers:decimal(18,4),reg_hours:decimal(18,4),ot_hours:decimal(18,4),total_hours:decimal(18,4),"
        "reg_pay:decimal(18,2),ot_pay:decimal(18,2),total_pay:decimal(18,2)>>, io array<int>, "
        "material array<struct<seq:int,category:string,material:string,quantity:decimal(18,4),"
        "price_per_unit:decimal(12,4),total:decimal(18,2)>>, materials array<struct<seq:int,category:string,"
        "material:string,quantity:decimal(18,4),price_per_unit:decimal(12,4),total:decimal(18,2)>>, "
        "defect array<int>")
    r = rundetail.prepare(sub).first()
    assert (r.total_labor, r.overhead, r.new_materials, r.total) == (
        D("125.79"), D("25.16"), D("30.00"), D("180.95"))
    assert r.overhead_rate == D("0.2000")
    seqs = [x.seq for x in rundetail.child_rows(rundetail.prepare(sub), "labor").collect()]
    assert seqs == [0, 1]                      # missing seq → array position


def test_debit_match_first_in_order(spark):
    certs = spark.createDataFrame([
        ("WE 01.07.2024", "a.pdf", "S-C-1-CA", None, 5,
         [("X-9", "2024-01-01", D("1.00")), (" s c 1 ca", "2024-01-02", None), ("S-C-1-CA", "2024-01-03", D("3.00"))]),
        ("WE 01.07.2024", "b.pdf", "S-C-2-CA", None, 0, [("S-C-2-CA-4", "2024-01-01", D("1.00"))]),
    ], S.CERT_EXTRACTION)
    res = {r.file: r for r in shipping.debit_match(certs).collect()}
    assert res["a.pdf"].matched and res["a.pdf"].matched_certificate_number == " s c 1 ca"
    assert res["a.pdf"].debit_amount is None          # matched with no amount is still matched
    assert not res["b.pdf"].matched
    flags = shipping.debit_match(certs).select("file", shipping.needs_review(certs).alias("n"))
    assert {r.file: r.n for r in flags.collect()} == {"a.pdf": False, "b.pdf": True}


def test_snapshot_versions_and_append(spark, tmp_path):
    root = str(tmp_path / "lines")
    df = spark.createDataFrame([(1, "PACKING")], "tagid long, charge_type string")
    state.write_snapshot(df, root)
    state.write_snapshot(df.union(df), root)
    assert state.read_snapshot(spark, root).count() == 2
    assert sorted(os.listdir(root))[:2] == ["v=0", "v=1"]
    app = str(tmp_path / "app")
    state.append_aligned(spark, app, df, S.BILLING_LINES)
    out = state.append_aligned(spark, app, df.withColumn("extra", F.lit(1)), S.BILLING_LINES)
    assert out.count() == 2 and out.columns == [f.name for f in S.BILLING_LINES.fields]


def test_stream_replay_is_idempotent(spark, tmp_path):
    from tagbill.streaming import labor_replies as lr
    notes = spark.createDataFrame([
        ("1", "tagbill", "RE: Repacks Needing Labor Charges 2024-01-07", None, None),
        ("2", "tagbill", "Re: repacks needing labor charges", None, None),          # no week
        ("3", "other", "RE: Repacks Needing Labor Charges 2024-01-14", None, None),  # foreign state
        ("4", "tagbill", "RE: Repacks Needing Labor Charges 2024-01-07", None, None),
    ], S.NOTIFICATION)
    replies = spark.createDataFrame([(10, "p", D("5"), "2", "1.5", "2024-01-07"),
                                     (11, "p", D("5"), "x", "1.5", "2024-01-14")],
                                    "icrunidx long, productdescr string, quantity decimal(38,4), "
                                    "num_laborers string, hours_per_laborer string, week_end string")
    base = str(tmp_path / "s")
    notes.write.parquet(f"{base}/inbox/0")
    notes.write.parquet(f"{base}/inbox/1")          # the same notifications delivered again
    dirs = lr.run_labor_reply_stream(spark, f"{base}/inbox/*", replies, base, "20")
    rows = lr.labor_from_stream(spark, dirs["labor"]).collect()
    assert [(r.icrunidx, r.week_end, r.labor_charge) for r in rows] == [(10, "2024-01-07", D("60.00"))]
    ids = spark.read.parquet(f"{dirs['messages']}/epoch=*").select("message_id").collect()
    assert sorted(r.message_id for r in ids) == ["1", "4"]
    # a crash after the state was written, before the epoch was recorded: the epoch runs again
    for name in os.listdir(f"{base}/checkpoint/commits"):
        os.remove(f"{base}/checkpoint/commits/{name}")
    lr.run_labor_reply_stream(spark, f"{base}/inbox/*", replies, base, "20")
    again = lr.labor_from_stream(spark, dirs["labor"]).collect()
    assert [(r.icrunidx, r.labor_charge) for r in again] == [(10, D("60.00"))]
    ids = spark.read.parquet(f"{dirs['messages']}/epoch=*").select("message_id").collect()
    assert sorted(r.message_id for r in ids) == ["1", "4"]


def test_week_scoped_equals_filtered(spark):
    """A week argument is a filter on the all-weeks result (post, record, labor needed)."""
    from tagbill.operators import labor as lab
    from tagbill.plans.billing import Billing
    b = Billing(spark, "/root/testdata/sf0.001")
    week = (b.bill_lines.filter(F.col("billing_week").isNotNull())
            .agg(F.min("billing_week")).first()[0].isoformat())
    def key(df):
        return sorted(tuple(str(v) for v in r) for r in df.collect())
    allw = invoice.orders_to_post(b.bill_lines, b.storage_charges)
    one = invoice.orders_to_post(b.bill_lines, b.storage_charges, week)
    assert key(one) == key(allw.filter(F.col("billing_week") == week))
    rows = invoice.billed_rows_packing(b.bill_lines, week)
    assert key(rows) == key(invoice.billed_rows_packing(b.bill_lines).filter(F.col("week_end") == week))
    need = lab.labor_needed(b.bill_lines, b.d.labor_charges, week)
    assert all(r.billing_week == week for r in need.collect())


def test_append_ignores_unfinished_batch(spark, tmp_path):
    root = str(tmp_path / "bl")
    df = spark.createDataFrame([(1, "PACKING")], "tagid long, charge_type string")
    state.append_aligned(spark, root, df, S.BILLING_LINES)
    # a writer that died mid-way leaves a folder without _SUCCESS
    df.write.parquet(root + "/_batches/v=7")
    os.remove(root + "/_batches/v=7/_SUCCESS")
    out = state.append_aligned(spark, root, df, S.BILLING_LINES)
    assert out.count() == 2


def test_nested_documents_equal_nested_tables(spark):
    """Lines without seq take their place, ties sort by value, runs without lines have none."""
    from tagbill.operators import rundetail
    from tagbill.schemas import RUN_SUBMISSION
    defect = lambda seq, kind: {"seq": seq, "defect_type": kind, "value": "2"}
    docs = spark.createDataFrame([
        {"run_no": 1, "defect": [defect(3, "scar"), defect(None, "b"), defect(1, "a"), defect(1, "a")]},
        {"run_no": 2, "defect": []}, {"run_no": 3}], RUN_SUBMISSION)
    ready = rundetail.prepare(docs)
    by_row = rundetail.nested_documents(ready)
    by_table = rundetail.run_nested(rundetail.parent_rows(ready), {k: rundetail.child_rows(ready, k) for k in rundetail.CHILDREN})
    rows = by_row.orderBy("run_no").collect()
    assert rows == by_table.select(*by_row.columns).orderBy("run_no").collect()
    assert [(x.seq, x.defect_type) for x in rows[0].defect] == [(1, "a"), (1, "a"), (1, "b"), (3, "scar")]
    assert rows[1].defect is None and rows[2].labor is None
    lines = rundetail.nested_lines(by_row).orderBy("place").collect()
    assert [(r.run_no, r.kind, r.place, r.amount) for r in lines] == [(1, "defect", i, 2) for i in range(4)]
