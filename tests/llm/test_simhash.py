import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tagbill.llm import queries, simhash
from tagbill.llm.common import load


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def groups(fps):
    """Smallest member of each fingerprint's group, by comparing all with all."""
    fps = sorted(set(fps))
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {f: root(f) for f in fps}


def check(rows, texts):
    """rows: (doc_id, fingerprint, component_id); texts: (doc_id, text)."""
    want = [(i, slow_fingerprint(t or "")) for i, t in texts]
    root = groups([f for _, f in want])
    least = {}
    for i, f in want:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    expected = [(i, f"{f:016x}", least.get(root[f])) for i, f in want]
    assert sorted(rows, key=str) == sorted(expected, key=str)


def test_query_against_all_pairs(spark, sf):
    texts = [(r.doc_id, r.text) for r in load(spark, sf, "documents").collect()]
    check([tuple(r) for r in queries.op10_simhash_near_dedup(spark, sf).collect()], texts)


def test_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    check([(r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in got], [(r.doc_id, r.text) for r in odd.collect()])
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).columns == none.columns
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and 1 in ids and 2 in ids and 3 not in ids and 4 not in ids


def near(rng, n, centres, most):
    out = []
    for _ in range(n):
        f = rng.choice(centres)
        for b in rng.sample(range(64), rng.randint(0, most)):
            f ^= 1 << b
        out.append(f)
    return out


@pytest.mark.parametrize("thresholds", [None, (0, 0, 0, 0, 0), (1, 0, 0, 0), (1, 0, 1), (2, -1, 1), (1, 2)])
def test_links_connect_all_within_distance(spark, thresholds):
    rng = random.Random(7)
    m = len(thresholds or ())
    plan = thresholds and simhash.Plan(tuple(tuple(range(64 * k // m, 64 * (k + 1) // m)) for k in range(m)), thresholds)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted(set(near(rng, 250, centres, 5) + [rng.getrandbits(64) for _ in range(40)]))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash.links(df, 4, block=40, plan=plan).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {f: root(f) for f in fps} == groups(fps)


def test_dense_group_emits_few_links(spark):
    rng = random.Random(9)
    fps = sorted(set(near(rng, 3000, [rng.getrandbits(64)], 2)))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    probes = len(fps) * 60
    assert simhash.links(df, 4).count() < probes
    roots = simhash.components(simhash.links(df, 4)).collect()
    assert len(roots) == len(fps) - 1 and len({r.root for r in roots}) == 1


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500)], "a long, b long")
    got = {r.fp: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}


def test_plans_keep_the_guarantee():
    rng = np.random.default_rng(0)
    for n in (0, 10, 10**5, 10**9):
        bits = rng.random((500, 64)) < rng.random(64)
        both = bits.astype(float).T @ bits * (n / 500)
        for d in (0, 1, 4, 6):
            plan = simhash.make_plan(n, both, d)
            assert sum(plan.thresholds) == d - len(plan.parts) + 1 and min(plan.thresholds) >= -1
            assert sorted(b for p in plan.parts for b in p) == list(range(64))
