"""Stored views after refreshes against a rebuild from the whole snapshot."""

import random

from pyspark.sql import functions as F

from tagbill.operators import incremental as inc
from tagbill.operators import rollups
from tagbill.operators.store import Store
from tagbill.plans.billing import Billing

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_refresh_equals_a_rebuild_and_touches_what_changed(spark, tmp_path):
    b = Billing(spark, SF)
    d = b.d
    dims = {"classification": b.classification.persist(), "packing_rates": b.packing_rates.persist(),
            "storage_rates": b.storage_rates.persist()}
    store = Store(spark, f"file://{tmp_path}/views")
    tables = inc.tag_inputs(d.shipping_raw, d.repack_outputs, d.repack_inputs, d.billing_lines)
    inc.build(store, tables, dims, d.labor_charges, d.repack_materials, buckets=16)
    assert rows(inc.bill_summary(store)) == rows(b.bill_summary) and rows(store.read("shipped")) == rows(b.shipped)

    same = inc.refresh(store, tables, dims, d.labor_charges, d.repack_materials)
    assert same == {"tags": 0, "weeks": 0, "version": 0}

    rng = random.Random(1)
    tags = [r[0] for r in b.shipped.select("tagid").collect()]
    up, gone, billed = set(rng.sample(tags, 3)), set(rng.sample(tags, 2)), set(rng.sample(tags, 2))
    raw = (d.shipping_raw.filter(~F.coalesce(F.col("pallet").isin(list(gone)), F.lit(False)))
           .withColumn("icqnt", F.when(F.col("pallet").isin(list(up)), F.col("icqnt") + 3).otherwise(F.col("icqnt")).cast("decimal(18,4)")))
    new = d.shipping_raw.limit(1).withColumn("pallet", F.lit(10**7).cast("long")).withColumn("recordtype", F.lit(5)).withColumn("trxtype", F.lit(1))
    raw = raw.unionByName(new.select(raw.columns))
    lines = d.billing_lines.unionByName(spark.createDataFrame([(t, "STORAGE") for t in billed], "tagid long, charge_type string"),
                                        allowMissingColumns=True)
    outputs = d.repack_outputs.filter(F.col("tagid") != min(tags))
    labor = d.labor_charges.withColumn("labor_charge", F.when(F.col("icrunidx") % 50 == 0, F.lit(1)).otherwise(F.col("labor_charge")).cast("decimal(18,2)"))
    tables = inc.tag_inputs(raw, outputs, d.repack_inputs, lines)
    got = inc.refresh(store, tables, dims, labor, d.repack_materials)
    assert len(up | gone | billed) <= got["tags"] <= len(up | gone | billed) + 2 and got["weeks"] < store.count("week_amounts") / 2
    before, after = store.manifest(0)["shipped"]["parts"], store.manifest()["shipped"]["parts"]
    assert sum(before.get(k) != after.get(k) for k in after) <= got["tags"] and got["version"] == 1

    sh, amounts = inc.tag_views(tables, **dims)
    assert rows(store.read("shipped")) == rows(sh) and rows(store.read("tag_amounts")) == rows(amounts)
    from tagbill.operators import charges, status, storage
    rated = charges.charges(status.status_with_ship(outputs, d.repack_inputs, sh, lines), dims["classification"], dims["packing_rates"])
    cold = storage.storage_charges(sh, dims["classification"], dims["storage_rates"], lines)
    want = rollups.bill_summary(charges.bill_lines(rated), cold, labor, d.repack_materials)
    assert rows(inc.bill_summary(store)) == rows(want)
    for df in dims.values():
        df.unpersist()
