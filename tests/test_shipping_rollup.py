"""The factorised weekly total against rows that are really built, missing numbers included."""

import random
from decimal import Decimal as D

import pandas as pd

from tagbill.operators import shipping

CERT = "week_folder string, file string, order_number long, matched boolean, debit_amount decimal(18,2)"


def merged_total(charges, certs):
    """Sum of amounts over the merged rows (missing pairs with missing) and of the certificates' debits."""
    left = pd.DataFrame(charges, columns=["sono", "amt"])
    left["k"] = pd.to_numeric(left["sono"], errors="coerce")
    total = sum((d for *_, d in certs if d is not None), D(0))
    if certs:
        right = pd.DataFrame({"k": pd.to_numeric(pd.Series([c[0] for c in certs], dtype=object), errors="coerce")})
        left = left.merge(right, how="left", on="k")
    return total + sum((a for a in left["amt"] if a is not None and a == a), D(0))


def test_totals_equal_the_merge(spark):
    rng = random.Random(8)
    weeks, charges, certs = [f"W{i}" for i in range(6)], [], []
    for w in weeks:
        for _ in range(rng.randint(0, 25)):
            charges.append((w, rng.choice(["1", "2", " 3", "x", None, "", "4.0", "NaN"]), rng.choice([None, D(rng.randrange(10**4)) / 100])))
        for i in range(rng.randint(0, 12)):
            certs.append((w, f"f{i}", rng.choice([None, 0, 1, 2, 3, 4, 9]), rng.choice([True, False, None]), rng.choice([None, D("7.25")])))
    trimmed = spark.createDataFrame(charges, "week_folder string, sono string, amt decimal(18,2)").repartition(3)
    results = spark.createDataFrame(certs, CERT).repartition(3)
    got = {r.week_folder: r for r in shipping.week_rollup(trimmed, results).collect()}
    assert set(got) == {r[0] for r in charges} | {r[0] for r in certs}
    for w, r in got.items():
        mine = [(n, m, d) for x, _, n, m, d in certs if x == w]
        assert r.total == merged_total([(s, a) for x, s, a in charges if x == w], mine)
        needs = sum(not n or not m for n, m, _ in mine)
        assert (r.phyto_count, r.needs_review_count, r.status) == (len(mine), needs, "needs_review" if needs else "built")


def test_the_last_correction_of_a_file_wins(spark):
    results = spark.createDataFrame([("w", "a", 0, None, None), ("w", "b", 2, True, D(1)), ("v", "a", None, False, None)], CERT)
    fixes = spark.createDataFrame([("w", "a", -1, True, D(1), 1), ("w", "a", 5, True, None, 2), ("w", "gone", 7, True, D(9), 1)], CERT + ", seq int")
    got = sorted((r.week_folder, r.file, r.order_number, r.matched) for r in shipping.apply_corrections(results, fixes).collect())
    assert got == [("v", "a", None, False), ("w", "a", 5, True), ("w", "b", 2, True)]
