"""The life of stored runs: lines of every kind are stored, replaced, deleted and compacted with their run."""

import datetime as dt
from decimal import Decimal

import pytest

from tagbill.operators import rundetail
from tagbill.plans import stored_queries

DAY = dt.datetime(1995, 3, 1)
NO_LINES = 40
PARTS = {k: 900.0 + k for k in range(10)}


def run_lines():
    """(run, part, line number, quantity, price): up to four lines, a line number that repeats and one that is missing."""
    lines = [(k, (k + n) % 10, n, 5.0 + n, 10.5 * n) for k in range(1, NO_LINES) for n in range(1, k % 4 + 2)]
    return [*lines, (8, 1, 1, 7.0, 3.25), (10, 2, None, 8.0, 4.5)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    orders = [(k, k % 5, "FO"[k % 2], 100.0 + k, DAY, "1-URGENT") for k in range(1, NO_LINES + 1)]
    lines = [(k, part, 1, n, quantity, pay, 0.02, "N", DAY) for k, part, n, quantity, pay in run_lines()]
    for name, rows, schema in (
            ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
                               "o_orderpriority string"),
            ("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                "l_extendedprice double, l_tax double, l_returnflag string, l_shipdate timestamp_ntz"),
            ("part", [(k, p, "ECONOMY BRASS", k) for k, p in PARTS.items()], "p_partkey long, p_retailprice double, p_type string, p_size int")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{sf}/{name}.parquet")
    return sf


@pytest.fixture(scope="module")
def stored(spark, tables):
    stores = []
    with pytest.MonkeyPatch.context() as patch:
        make = stored_queries._store
        patch.setattr(stored_queries, "_store", lambda *a: stores.append(make(*a)) or stores[-1])
        rows = stored_queries.q_run_store(spark, tables).collect()
    return stores[0], rows


def kept(k):
    """A run's lines stay if it was submitted at first and not saved again."""
    return k % 2 == 0 and k % 3 != 0


def test_lines_of_every_kind_follow_their_run(stored):
    store, _ = stored
    assert store.tables() == sorted(["run", *[f"run_{kind}" for kind in rundetail.CHILDREN]])
    for kind in rundetail.CHILDREN:
        want = sorted(k for k, _, n, *_ in run_lines() if kept(k) and (kind != "defect" or n == 1))
        assert sorted(r.run_no for r in store.read(f"run_{kind}").collect()) == want, kind
        assert not store.manifest()[f"run_{kind}"]["tombstones"], kind
    assert store.read("run").filter("status = 'draft'").isEmpty()


def test_every_third_run_is_saved_again(stored):
    _, rows = stored
    assert sorted(r.run_no for r in rows) == [k for k in range(1, NO_LINES + 1) if k % 2 == 0 or k % 3 == 0]
    assert all((r.note == "REVISED", r.updated_at.day == 2) == (r.run_no % 3 == 0,) * 2 for r in rows)
    assert {r.run_no for r in rows if r.total == 0} == {NO_LINES, *range(3, NO_LINES, 3)}


def test_the_sums_hold_every_line(stored):
    cents = Decimal("0.01")
    for r in stored[1]:
        lines = [x for x in run_lines() if x[0] == r.run_no and kept(r.run_no)]
        assert (r.lines, r.labor_lines, r.io_lines) == (len(lines),) * 3
        assert r.defect_lines == sum(n == 1 for _, _, n, *_ in lines)
        if not lines:
            assert r.material is r.labor is r.boxes is None
            continue
        priced = [Decimal(str(pay)) if n == 2 else (Decimal(str(q)) * Decimal(str(PARTS[part])) / 100).quantize(cents)
                  for _, part, n, q, pay in lines]
        assert r.material == sum(priced)
        assert r.labor == sum(Decimal(str(pay)) for *_, pay in lines) and r.boxes == sum(Decimal(str(q)) for _, _, _, q, _ in lines)
