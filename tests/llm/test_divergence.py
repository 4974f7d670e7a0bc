import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagbill.llm import divergence, queries
from tagbill.llm.common import load

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def slow_audit(rows, least=10, top=10):
    """The rows of audit() from (text, lang, source) rows."""
    seen, used, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        groups[lang].add(source)
        seen[lang].update(set(terms))
        used[lang, source].update(terms)
    found = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update(used[lang, s])

        def share(counts, kept=kept):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // total for t in kept}

        p, q = {s: share(used[lang, s]) for s in sources}, share(whole)
        apart = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in sources:
            pairs = [(o, sum(apart(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, apart(p[s][t], q[t])) for t in kept if used[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                found += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])]
    return sorted(found)


def test_query_against_brute_force(spark, sf):
    rows = [(r.text, r.lang, r.source) for r in load(spark, sf, "documents").collect()]
    want = slow_audit(rows)
    assert sorted(tuple(r) for r in queries.op11_source_divergence(spark, sf).collect()) == want
    assert sum(r[2] == "term" for r in want) > 300


def words(rng, n):
    parts = ["a", "Be", "é", "ß", "中文", "zz", "the", "İ", "\U0001F600"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(n)]


@pytest.mark.parametrize("levels,least", [((1,), 3), ((2, 3), 2), (divergence.LEVELS, 4)])
def test_levels_keep_exact_terms(spark, levels, least):
    rng = random.Random(least)
    pool = words(rng, 60) + ["x" * 70, "y" * 41 + "a", "y" * 41 + "b"]
    rows = [("".join(w + rng.choice(" 1-_\n\t.") for w in rng.choices(pool, k=rng.randint(0, 12))), rng.choice(["en", "de", None]),
             rng.choice(["s", "t", "", None, "é"])) for _ in range(90)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    got = sorted(tuple(r) for r in divergence.audit(docs, least, 4, levels, slice_terms=7).collect())
    assert got == slow_audit(rows, least, 4)


def test_odd_rows(spark, odd, none):
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    for least in (1, 2, 50):
        got = sorted(tuple(r) for r in divergence.audit(odd, least).collect())
        assert got == slow_audit(rows, least)
    assert divergence.audit(none).count() == 0
    two = odd.withColumn("source", F.when(F.col("doc_id") > 6, "a").otherwise("b")).withColumn("group", F.lit(1))
    rows = [(r.text, r.lang, r.source) for r in two.collect()]
    for least in (2, 50):
        assert sorted(tuple(r) for r in divergence.audit(two, least).collect()) == slow_audit(rows, least)


def test_a_full_bitmap_changes_nothing(spark, sf, monkeypatch):
    docs = load(spark, sf, "documents").limit(60)
    want = sorted(tuple(r) for r in divergence.audit(docs, 3).collect())
    monkeypatch.setattr(divergence, "left_over", lambda found: divergence.np.full(divergence.FILTER_BITS >> 6, -1))
    assert sorted(tuple(r) for r in divergence.audit(docs, 3).collect()) == want


def test_merging_one_term_over_many_rows():
    rows = pa.table([["en"] * 7, [b"a", b"b", b"b", b"b", b"b", b"c", b"c"], [[1], [2, 1], [1], [2], [2, 3], [9], [9]],
                     [[1], [1, 1], [1], [1], [1, 5], [2], [3]]], schema=divergence._COUNTS)
    for most in (1, 2, 3, 100):
        got = pa.Table.from_batches(list(divergence._merge_in_order(iter(rows.to_batches(max_chunksize=2)), most)), divergence._COUNTS)
        assert got.to_pydict() == {"lang": ["en"] * 3, "term": [b"a", b"b", b"c"], "groups": [[1], [1, 2, 3], [9]], "counts": [[1], [2, 3, 5], [5]]}


def test_scaled_is_exact():
    for total in (1, 7, 10**9 + 7, 10**14, 10**16):
        for n in (0, 1, total // 3, total - 1, total):
            assert int(divergence.scaled(divergence.np.array([n]), total)[0]) == 10**9 * n // total


@pytest.mark.parametrize("last", [0, 1, 3, 6, 40])
def test_terms_decided_before_are_not_built_again(last):
    texts = [b"", b"Ab abcde abcdef, abcdefg", b"..", "Stra\u00dfe \u00e4\u00f6\u00fc x abcdef".encode(), b"abcdefgh", b""]
    found = divergence.Stretch(texts, last)
    terms = found.terms.to_pylist()
    want = [(i, x.lower().encode() + b"\0") for i, t in enumerate(texts) for x in TERM.findall(t.decode())]
    assert [(int(d), terms[t]) for d, t in zip(found.doc, found.term)] == [x for x in want if len(x[1]) > last]
    assert all(len(t) > last for t in terms)
