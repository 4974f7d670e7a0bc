"""File sources: code page, JSON documents, reply sheets, seeding."""

import json
from decimal import Decimal as D

from tagbill.operators import labor, rundetail
from tagbill.sources import reports


def test_cp1252_shipping_report(spark, tmp_path):
    p = tmp_path / "ship.csv"
    p.write_bytes(" Pallet ,RecordType,TrxType,ICQnt,LastCoName\n"
                  "12,5,1,3,Caf\xe9 \x80 Co\nTotal:,x,,nan,\n".encode("latin-1"))
    df = reports.coerce_shipping(reports.read_report_csv(spark, str(p), reports.SHIPPING_ENCODING))
    rows = df.collect()
    assert df.columns == ["pallet", "recordtype", "trxtype", "icqnt", "lastconame"]
    assert rows[0].lastconame == "Café € Co" and rows[0].pallet == 12 and rows[0].icqnt == D("3")
    assert rows[1].pallet is None and rows[1].icqnt is None          # footer text and 'nan'


def test_json_documents(spark, tmp_path):
    run = {"run_no": 5, "overhead_rate": None, "labor": [{"total_pay": 10}],
           "material": [], "materials": [{"quantity": 2, "price_per_unit": 1.25}]}
    (tmp_path / "runs.json").write_text(json.dumps(run) + "\n")
    r = rundetail.prepare(reports.read_run_submissions(spark, str(tmp_path / "runs.json"))).first()
    assert (r.total_labor, r.new_materials, r.total) == (D("10.00"), D("2.50"), D("14.50"))
    cert = {"week_folder": "WE 01.07.2024", "file": "a.pdf", "current_certificate_number": "S-1",
            "order_number": 7, "debit_rows": [{"certificate_number": "s 1", "debit_amount": 2.5}]}
    (tmp_path / "c.json").write_text(json.dumps(cert) + "\n")
    c = reports.read_certificates(spark, str(tmp_path / "c.json")).first()
    assert c.debit_rows[0].debit_amount == D("2.50")


def test_labor_reply_sheet(spark, tmp_path):
    (tmp_path / "r.csv").write_text("ICRunIdx,ProductDescr,Quantity,Num_Laborers,Hours_Per_Laborer\n"
                                    "1,x,5,3,2.5\n2,y,5,,abc\n")
    rows = labor.labor_rows(reports.read_labor_reply(spark, str(tmp_path / "r.csv")), "2024-01-07", "18")
    got = sorted((r.icrunidx, r.labor_charge) for r in rows.collect())
    assert got == [(1, D("135.00")), (2, D("0.00"))]


def test_seed_missing(spark):
    cur = spark.createDataFrame([("Grader", 99)], "name string, seq int")
    out = {r.name: r.seq for r in reports.seed_missing(cur, rundetail.ref_positions(spark)).collect()}
    assert len(out) == 10 and out["Grader"] == 99
