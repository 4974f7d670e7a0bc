"""Properties over the driver's sf0.001 tables."""

from pyspark.sql import functions as F

from tagbill.operators import charges, invoice, rollups, status
from tagbill.plans.billing import Billing
from tagbill.plans.registry import PERIOD

SF = "/root/testdata/sf0.001"


def test_status_one_row_per_tag_and_crosstab_sums(spark):
    b = Billing(spark, SF)
    st = b.repack_status
    n, distinct = st.count(), st.select("tagid").distinct().count()
    assert n == distinct
    assert status.status_summary(st).agg(F.sum("tags")).first()[0] == n


def test_chain_keys_unique_and_rooted(spark):
    c = Billing(spark, SF).repack_chain()
    assert c.count() == c.select("shipped_tag", "tagid").distinct().count()
    roots = c.filter(F.col("depth") == 0)
    assert roots.filter(F.col("shipped_tag") != F.col("tagid")).count() == 0
    # every non-root node hangs off a node one level up for the same shipped tag
    assert c.agg(F.min("depth")).first()[0] == 0


def test_candidates_reconcile_with_period_bill(spark):
    b = Billing(spark, SF)
    s, e = PERIOD
    cand = charges.bill_candidates(b.charges, s, e, "all").agg(F.sum("amount")).first()[0] or 0
    head = rollups.period_bill_header(b.charges, b.storage_charges, b.d.labor_charges, s, e).first()
    assert cand == head.service_total


def test_recording_a_week_empties_it(spark):
    b = Billing(spark, SF)
    week = (b.bill_lines.filter((F.col("transaction_type") == "PACK") & F.col("billing_week").isNotNull())
            .agg(F.min("billing_week")).first()[0].isoformat())
    before = b.bill_lines.filter((F.col("billing_week") == week) & (F.col("transaction_type") != "REPACK"))
    assert before.count() > 0
    recorded = invoice.record_billed(b.d.billing_lines, invoice.billed_rows_packing(b.bill_lines, week))
    d = b.d
    d.__dict__["billing_lines"] = recorded
    again = Billing(spark, SF, domain=d).bill_lines
    left = again.filter((F.col("billing_week") == week) & (F.col("transaction_type") != "REPACK"))
    assert left.count() == 0
    # repacks are billed on time and materials and stay on the list
    assert (again.filter((F.col("billing_week") == week) & (F.col("transaction_type") == "REPACK")).count()
            == b.bill_lines.filter((F.col("billing_week") == week)
                                   & (F.col("transaction_type") == "REPACK")).count())
