"""Steps that must not be repeated or grow wide: what travels in a shuffle, and how often an input is worked out."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from tagbill.operators import incremental, rundetail
from tagbill.operators.store import Store, Update
from tagbill.plans import registry
from tagbill.plans.billing import Billing
from tagbill.session import ensure_checkpoint_dir

DAY = dt.datetime(1995, 3, 1)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Orders of up to seven lines; one repeats a line number, one has a line without, one no line at all."""
    sf = str(tmp_path_factory.mktemp("sf"))
    orders = [(k, k % 5, "FOP"[k % 3], 100.0 + k, DAY, f"{k % 5 + 1}-{'URGENT HIGH MEDIUM NONE LOW'.split()[k % 5]}") for k in range(1, 70)]
    lines = [(k, k * 3 % 11, k % 4, n, 5.0 + n, 10.5 * n, 0.02, "N", DAY) for k in range(1, 69) for n in range(1, k % 7 + 2)]
    lines += [(3, 1, 1, 1, 7.0, 3.25, 0.02, "N", DAY), (4, 2, 1, None, 8.0, 4.5, 0.02, "N", DAY), (None, 2, 1, 1, 8.0, 4.5, 0.02, "N", DAY)]
    parts = [(k, 900.0 + k, "ECONOMY BRASS", k % 9) for k in range(10)]
    for name, rows, schema in (
            ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
                               "o_orderpriority string"),
            ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                "l_extendedprice double, l_tax double, l_returnflag string, l_shipdate timestamp_ntz"),
            ("part", parts, "p_partkey long, p_retailprice double, p_type string, p_size int")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{sf}/{name}.parquet")
    return sf


def counted(spark, df):
    """``df``, and an accumulator of how many of its rows were worked out."""
    seen = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    return df.mapInArrow(pass_on, df.schema), seen


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_submissions_are_written_compressed(spark, tables):
    lines = registry.q_run_submission_scan(spark, tables)
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    assert glob.glob(f"{base}/run-submissions-*/*.json.gz") and not glob.glob(f"{base}/run-submissions-*/*.json")
    assert sorted(map(str, lines.collect())) == sorted(map(str, registry.q_run_nested_lines(spark, tables).collect()))


def test_an_update_works_its_rows_out_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.replace_all({"t": (spark.range(50).selectExpr("id AS k", "0 AS v"), ["k"])}, buckets=4)
    fresh, seen = counted(spark, spark.range(40, 60).selectExpr("id AS k", "1 AS v"))
    store.update({"t": Update(fresh)})
    assert seen.value == 20
    assert sorted(map(tuple, store.read("t").collect())) == [(k, int(k >= 40)) for k in range(60)]


def test_saving_runs_works_the_documents_out_once(spark, tables, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    b = Billing(spark, tables)
    prepared, seen = counted(spark, b.runs_prepared)
    rundetail.save_runs(store, prepared, "2024-01-01")
    assert seen.value == 69
    again, seen = counted(spark, b.run_resave())
    rundetail.save_runs(store, again, "2024-01-02", ["run_no", "status", "note"])
    assert seen.value == 2
    runs = {r.run_no: r for r in store.read("run").collect()}
    assert len(runs) == 69 and {k for k, r in runs.items() if r.note == "REVISED" and r.updated_at.day == 2} == {30, 60}
    assert all(r.updated_at.day == 1 and r.note == "CTN TO BAG" for k, r in runs.items() if k % 30)
    assert runs[30].varieties == "VALENCIA" and runs[30].total == 0 and runs[31].total > 0
    assert store.read("run_io").filter("run_no = 30").isEmpty() and not store.read("run_io").filter("run_no = 31").isEmpty()


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "64k")
    try:
        store = Store(spark, f"file://{tmp_path}/store")
        df = spark.range(0, 200_000, 1, 8).select(F.col("id").alias("k"), F.xxhash64("id").alias("v"))
        store.replace_all({"t": (df, ["k"])}, buckets=1)
    finally:
        spark.conf.set(size, before)
    assert len(glob.glob(f"{tmp_path}/store/data/t/_folder=*/_bucket=0/*.parquet")) > 1
    assert store.count("t") == 200_000 and store.read("t").agg(F.count_distinct("k")).first()[0] == 200_000


def test_epochs_share_one_evaluation_of_the_replies(spark, tmp_path):
    from tagbill.schemas import NOTIFICATION
    from tagbill.streaming import labor_replies as lr
    base = str(tmp_path)
    weeks = [f"2024-01-{d:02d}" for d in (7, 14, 21, 28)]
    notes = [(str(i), lr.CLIENT_STATE, f"RE: {lr.REPACK_SUBJECT} {weeks[i % 4]}", None, None) for i in range(12)]
    for i, n in enumerate(notes):                                       # twelve files: three epochs
        spark.createDataFrame([n], NOTIFICATION).coalesce(1).write.parquet(f"{base}/inbox/{i}")
    replies, seen = counted(spark, spark.createDataFrame(
        [(10 + i, "p", None, "2", "1.5", w) for i, w in enumerate(weeks)],
        "icrunidx long, productdescr string, quantity decimal(38,4), num_laborers string, hours_per_laborer string, week_end string"))
    dirs = lr.run_labor_reply_stream(spark, f"{base}/inbox/*", replies, base)
    assert seen.value == 4
    assert len(glob.glob(f"{base}/state/messages/epoch=*")) == 3
    assert sorted(r.icrunidx for r in lr.labor_from_stream(spark, dirs["labor"]).collect()) == [10, 11, 12, 13]


def test_shipping_runs_start_from_one_rollup(spark, tables, monkeypatch):
    made = []
    rollup = Billing.ship_rollup.func

    def counting(self):
        df, seen = counted(self.spark, rollup(self))
        made.append(seen)
        return df
    prop = type(Billing.ship_rollup)(counting)
    prop.__set_name__(Billing, "ship_rollup")
    monkeypatch.setattr(Billing, "ship_rollup", prop)
    from tagbill.plans import stored_queries
    out = stored_queries.q_shipping_runs_stored(spark, tables).collect()
    assert len(made) == 1 and made[0].value == len(out) > 0


def test_shipped_tags_are_worked_out_once(spark, tables, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    b = Billing(spark, tables)
    d = b.d
    made = []
    rows = incremental.shipped.shipped

    def counting(raw):
        df, seen = counted(spark, rows(raw))
        made.append(seen)
        return df
    monkeypatch.setattr(incremental.shipped, "shipped", counting)
    dims = {"classification": b.classification, "packing_rates": b.packing_rates, "storage_rates": b.storage_rates}
    of = lambda r: incremental.tag_inputs(r, d.repack_outputs, d.repack_inputs, d.billing_lines)
    incremental.build(store, of(d.shipping_raw), dims, d.labor_charges, d.repack_materials)
    want = rows(d.shipping_raw)
    assert [s.value for s in made] == [want.count()]
    incremental.refresh(store, of(d.shipping_raw.filter("pallet <> 5")), dims, d.labor_charges, d.repack_materials)
    assert len(made) == 2 and made[1].value <= 1                      # nothing is left of the one tag that changed
    want = want.filter("tagid <> 5")
    assert sorted(map(str, store.read("shipped").select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_a_digest_is_the_exact_sum_of_its_hashes(spark):
    df = spark.range(64).selectExpr("id % 3 AS _tag", "id AS a")
    want = {}
    for r in df.select("_tag", F.xxhash64(F.lit("t"), F.col("a").cast("string")).alias("h")).collect():
        want[r._tag] = want.get(r._tag, 0) + r.h
    got = incremental.digests({"t": df})
    assert {r.tagid: int(r.digest) for r in got.collect()} == want and "sum(cast" not in plan(got)
