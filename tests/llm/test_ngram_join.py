import itertools
import random

import numpy as np
import pytest

from tagbill.llm import ngram_join, queries
from tagbill.llm.common import load


def slow_set(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))


def slow_join(rows, width=3, percent=90):
    """(doc_id, n, component) of (doc_id, text) rows, by comparing all sets with all."""
    sets = [slow_set(t, width) for _, t in rows]
    distinct = sorted({s for s in sets if s}, key=len)
    parent = {s: s for s in distinct}

    def root(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if 100 * len(a) < percent * len(b):
                break
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                parent[root(a)] = root(b)
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[root(s)] = min(i, least.get(root(s), i))
    return sorted([(i, len(s), least.get(root(s)) if s else i) for (i, _), s in zip(rows, sets)], key=str)


def test_query_against_all_pairs(spark, sf):
    rows = [(r.doc_id, r.text) for r in load(spark, sf, "documents").collect()]
    got = sorted((tuple(r) for r in queries.op12_ngram_jaccard_join(spark, sf).collect()), key=str)
    assert got == slow_join(rows) and sum(c != i for i, _, c in got) > 5


def chains(rng, words, n, size, edits):
    """Texts that come from each other by a few edits, so that the ends of a chain differ widely."""
    text = rng.choices(words, k=size)
    found = []
    for _ in range(n):
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(text) + 1)
            text[at:at + rng.randint(0, 2)] = rng.choices(words, k=rng.randint(0, 2))
        found.append(" ".join(text))
    return found


@pytest.mark.parametrize("rounds,block,crowd", [(0, 2048, 64), (0, 5, 64), (1, 7, 0), (3, 2048, 3)])
def test_planted_chains_and_clusters(spark, rounds, block, crowd):
    rng = random.Random(block + rounds)
    words = [f"w{i}" for i in range(80)]
    texts = []
    for size in (3, 8, 12, 30, 31, 90, 400):
        texts += chains(rng, words, 12, size, 2)
        centre = chains(rng, words, 1, size, 0)[0]
        texts += [chains(rng, centre.split(" "), 1, 1, 0)[0] + " " + centre for _ in range(6)] + [centre.upper(), centre + "\n"]
    rows = list(enumerate(texts)) + [(900, ""), (901, None), (902, "w1"), (903, "w1 w2"), (904, "W2\tw1"), (905, "w1  w2"), (7, "w1"), (None, "w1 w2")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in ngram_join.join(docs, 3, 90, block, rounds, crowd).collect()), key=str)
    assert got == slow_join(rows)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for percent in (50, 90, 100):
        assert sorted((tuple(r) for r in ngram_join.join(odd, 3, percent).collect()), key=str) == slow_join(rows, 3, percent)
    assert ngram_join.join(none).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 90, 95, 100])
def test_linked_sets_meet_under_a_key(percent):
    rng = np.random.default_rng(percent)
    met = 0
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = np.unique(ngram_join.mix(rng.integers(0, 2**63, n).astype(np.uint64)))
        b = a[rng.random(len(a)) > rng.random() * 0.25]
        b = np.unique(np.concatenate((b, ngram_join.mix(rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 8))).astype(np.uint64)))))
        if len(b) and ngram_join.linked(len(a), len(b), len(np.intersect1d(a, b)), percent):
            assert np.intersect1d(ngram_join.block_keys(a, percent), ngram_join.block_keys(b, percent)).size
            met += len(a) != len(b) or bool((a != b).any())
    assert met > 10 or percent == 100


@pytest.mark.parametrize("few", [0, ngram_join.FEW, 1000])
def test_tree_finds_every_pair_within_the_bound(few, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW", few)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 9, (12, ngram_join.GROUPS))
    points = np.maximum(0, centres[rng.integers(0, 12, 500)] + rng.integers(-1, 2, (500, ngram_join.GROUPS)) * (rng.random((500, 1)) < 0.7))
    component = rng.integers(0, 200, 500)
    for percent in (70, 90):
        a, b = ngram_join.candidates(points, component, percent)
        want = {(i, j) for i, j in itertools.combinations(range(500), 2) if component[i] != component[j] and
                (100 + percent) * np.minimum(points[i], points[j]).sum() >= percent * (points[i].sum() + points[j].sum())}
        assert {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())} == want and len(a) == len(want) > 50


def test_count_bound_never_falls_below_the_overlap():
    rng = np.random.default_rng(5)
    for _ in range(200):
        pool = ngram_join.mix(rng.integers(0, 2**63, 300).astype(np.uint64))
        a, b = (np.unique(rng.choice(pool, int(rng.integers(1, 250)))) for _ in "ab")
        both = len(np.intersect1d(a, b))
        assert ngram_join.overlap(a, b) == both <= np.minimum(ngram_join.point(a), ngram_join.point(b)).sum()


@pytest.mark.parametrize("few", [0, 32])
def test_a_forest_joins_what_all_pairs_join(few, monkeypatch):
    """In dense groups, in which very many pairs are candidates: fewer pairs than components, and none is cut off."""
    monkeypatch.setattr(ngram_join, "FEW", few)
    rng = np.random.default_rng(5)
    points = np.concatenate([at + (rng.random((15, ngram_join.GROUPS)) < 0.02) for at in (2 * rng.integers(0, 20, (2, 1, ngram_join.GROUPS)))])
    component = rng.integers(0, 20, 30)

    def joined(a, b):
        of = component.copy()
        for x, y in zip(a.tolist(), b.tolist()):
            of[of == of[x]] = of[y]
        return {frozenset(np.flatnonzero(of == o).tolist()) for o in of}

    every = ngram_join.candidates(points, component, 90)
    some = ngram_join.candidates(points, component, 90, forest=True)
    assert len(every[0]) > 150 and len(some[0]) < len(set(component.tolist()))
    assert set(zip(*map(np.ndarray.tolist, some))) <= {(min(p), max(p)) for p in zip(*map(np.ndarray.tolist, every))}
    assert joined(*some) == joined(*every)


@pytest.mark.parametrize("sweeps", [0, 1, 3])
def test_sweeps_lose_no_link(spark, monkeypatch, sweeps):
    """A dense group meets under many keys; a sweep tells fewer pairs than it has rows, whatever is left is told at the end."""
    rng = random.Random(13)
    words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(300)]
    rows = list(enumerate(chains(rng, words, 60, 120, 1) + chains(rng, words, 20, 40, 3)))
    told = []
    searched = ngram_join._searched

    def counted(found, sets, percent, block, sweep=None):
        pairs = searched(found, sets, percent, block, sweep)
        told.append((sweep, found.count(), pairs.count()))
        return pairs

    monkeypatch.setattr(ngram_join, "_searched", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.join(docs, sweeps=sweeps).collect()), key=str)
    assert got == slow_join(rows)
    assert [s for s, _, _ in told] == [*range(sweeps), None][:len(told)]
    assert all(n < found for s, found, n in told if s is not None)
