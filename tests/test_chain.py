"""BFS lineage walk vs brute-force simple-path enumeration (the reference's semantics)."""

import datetime as dt
import random
from decimal import Decimal as D

from tagbill import schemas as S
from tagbill.operators.chain import repack_chain


def brute_force(shipped, outputs, inputs):
    """Enumerate every simple path like the recursive CTE, keep the shallowest row per key."""
    out_by_tag = {}
    for (tag, run, reason, prod, uom) in outputs:
        out_by_tag.setdefault(tag, []).append((run, reason, prod, uom))
    in_by_run = {}
    for (run, tag, qty) in inputs:
        in_by_run.setdefault(run, []).append((tag, qty))
    rows = []

    def walk(st, tag, run, reason, prod, uom, qty, depth, visited):
        rows.append((st, tag, run, reason, prod, uom, qty, depth))
        for (t2, q2) in in_by_run.get(run, []):
            for (r2, re2, p2, u2) in out_by_tag.get(t2, []):
                if t2 not in visited:
                    walk(st, t2, r2, re2, p2, u2, q2, depth + 1, visited | {t2})

    for (st, sq) in shipped:
        for (run, reason, prod, uom) in out_by_tag.get(st, []):
            walk(st, st, run, reason, prod, uom, sq, 0, {st})
    best = {}
    for r in rows:
        k = (r[0], r[1])
        rank = (r[7], r[2], r[3], r[4], r[5], r[6])
        if k not in best or rank < best[k][0]:
            best[k] = (rank, r)
    return sorted(v[1] for v in best.values())


def _graph(rng, n_tags, n_runs):
    outputs, inputs = [], []
    for t in range(n_tags):
        for run in rng.sample(range(n_runs), rng.choice([1, 1, 1, 2])):
            outputs.append((t, run, rng.choice([39, 41]), f"P{rng.randrange(3)}", "CS"))
    for run in range(n_runs):
        for t in rng.sample(range(n_tags + 2), rng.randrange(0, 4)):
            inputs.append((run, t, D(rng.randrange(1, 5))))
    shipped = [(t, D(rng.randrange(1, 50))) for t in rng.sample(range(n_tags + 2), 4)]
    return shipped, outputs, inputs


def test_bfs_matches_path_enumeration(spark):
    d0 = dt.date(2024, 1, 1)
    rng = random.Random(7)
    for _ in range(6):
        shipped, outputs, inputs = _graph(rng, n_tags=9, n_runs=6)
        sh = spark.createDataFrame([(t, q) for t, q in shipped],
                                   "tagid long, shipped_qty decimal(18,4)")
        out = spark.createDataFrame([(run, t, rs, p, D(1), u, d0) for (t, run, rs, p, u) in outputs],
                                    S.REPACK_TAGS)
        inp = spark.createDataFrame([(run, t, 39, "x", q, "CS", d0) for (run, t, q) in inputs],
                                    S.REPACK_TAGS)
        got = sorted(tuple(r)[:8] for r in repack_chain(sh, out, inp).collect())
        assert got == brute_force(shipped, outputs, inputs)


def test_cycle_and_self_consumption(spark):
    d0 = dt.date(2024, 1, 1)
    # 3-cycle of runs (tags 1→2→3→1) and a run that consumes its own output (tag 5)
    outputs = [(1, 10), (2, 20), (3, 30), (5, 50)]
    inputs = [(10, 2), (20, 3), (30, 1), (50, 5)]
    sh = spark.createDataFrame([(1, D(9)), (5, D(4))], "tagid long, shipped_qty decimal(18,4)")
    out = spark.createDataFrame([(r, t, 39, "P", D(1), "CS", d0) for t, r in outputs], S.REPACK_TAGS)
    inp = spark.createDataFrame([(r, t, 39, "P", D(2), "CS", d0) for r, t in inputs], S.REPACK_TAGS)
    got = sorted((r.shipped_tag, r.tagid, r.depth) for r in repack_chain(sh, out, inp).collect())
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (5, 5, 0)]
    one = repack_chain(sh, out, inp, shipped_tag=5).collect()
    assert [(r.shipped_tag, r.tagid) for r in one] == [(5, 5)]
    none = repack_chain(sh, out, inp, shipped_tag=12345).collect()
    assert none == []


def test_shipped_is_worked_out_once_and_shared_tags_keep_their_shallowest(spark):
    """tag 3 is consumed by two runs, tag 2 twice by one (once without a quantity), tag 9 never produced."""
    d0 = dt.date(2024, 1, 1)
    outputs = [(1, 10, 39, "P", "CS"), (2, 20, 41, "FIELD BIN", "CS"), (3, 30, 39, None, "CS"), (4, 40, None, "Q", "CS")]
    inputs = [(10, 2, None), (10, 2, D(7)), (10, 2, D(5)), (20, 3, D(1)), (10, 3, None), (30, 4, D(2)), (30, 1, D(3)), (20, 9, D(1))]
    worked = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            worked.add(b.num_rows)
            yield b
    sh = spark.createDataFrame([(1, D(8)), (3, D(9))], "tagid long, shipped_qty decimal(18,4)")
    sh = sh.mapInArrow(seen, sh.schema)
    out = spark.createDataFrame([(run, t, rs, p, D(1), u, d0) for t, run, rs, p, u in outputs], S.REPACK_TAGS)
    inp = spark.createDataFrame([(run, t, 39, "X", q, "CS", d0) for run, t, q in inputs], S.REPACK_TAGS)
    got = {(r.shipped_tag, r.tagid): (r.icrunidx, r.qty, r.depth, r.billable) for r in repack_chain(sh, out, inp).collect()}
    assert got == {(1, 1): (10, D(8), 0, True), (1, 2): (20, D(5), 1, False), (1, 3): (30, None, 1, None), (1, 4): (40, D(2), 2, None),
                   (3, 3): (30, D(9), 0, None), (3, 4): (40, D(2), 1, None), (3, 1): (10, D(3), 1, True), (3, 2): (20, D(5), 2, False)}
    assert worked.value == 2
