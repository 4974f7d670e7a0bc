import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tagbill.llm import manifest, queries
from tagbill.llm.common import load


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def slow_leaf(r, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)])


def slow_tree(nodes, arity):
    """The root, and for each node its siblings' digests and the digests before it, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i in range(len(paths)):
            start = at[i] // arity * arity
            run = nodes[start:start + arity]
            paths[i].append((run[:at[i] - start], run[at[i] - start + 1:]))
            at[i] //= arity
        nodes = [H(*nodes[k:k + arity]) for k in range(0, len(nodes), arity)]
    return nodes[0], paths


def slow_manifest(rows, arity=16):
    """{leaf: {(subroot, root, siblings)}} of (source, key, leaf) rows; equal rows may change places."""
    sources = sorted({s for s, _, _ in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted(((k, d) for t, k, d in rows if t == s), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = (own, *slow_tree([d for _, d in own], arity))
    root, top = slow_tree([trees[s][1] for s in sources], arity) if sources else (None, [])
    found = []
    for s, above in zip(sources, top):
        own, subroot, paths = trees[s]
        found += [(s, k, d, subroot, root, path + above) for (k, d), path in zip(own, paths)]
    return found


def folded(start, path):
    for before, after in path:
        start = H(*before, start, *after)
    return start


def test_query_against_brute_force(spark, sf):
    docs = {r.doc_id: r for r in load(spark, sf, "documents").collect()}
    leaves = [(r.source, i, slow_leaf(r, r.text)) for i, r in docs.items()]
    want = []
    for _, i, leaf, subroot, root, path in slow_manifest(leaves):
        text = docs[i].text
        if text is not None and zlib.crc32(str(i).encode()) % 5 == 0:
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        end = folded(slow_leaf(docs[i], text), path)
        want.append((i, leaf, subroot, root, H(*[x for b, a in path for x in b + a]), end, end == root))
    got = [tuple(r) for r in queries.op13_merkle_manifest(spark, sf).collect()]
    assert sorted(got) == sorted(want) and 0 < sum(not r[-1] for r in got) < len(got) / 4


@pytest.mark.parametrize("levels,arity", [(1, 2), (2, 3), (2, 16)])
def test_every_shape_of_tree(spark, levels, arity):
    rng = random.Random(levels)
    rows = [(s, rng.choice([None, *range(9)]), H(str(rng.random()))) for s, n in
            [(None, 1), ("", 5), ("a", arity), ("é", arity ** 2 + 1), ("b", 70), ("A", arity ** levels), ("z", 2)] for _ in range(n)]
    rows += [rows[-1]] * 3
    leaves = spark.createDataFrame([(*r, 1) for r in rows], "source string, key long, digest string, level int").repartition(3)
    got = sorted((str(r.source), str(r.key), r.digest, r.subroot, r.root, str([(w.left, w.right) for w in r.witness]))
                 for r in manifest.manifest(leaves, levels, arity).collect())
    want = sorted((str(s), str(k), d, sub, root, str([("".join(b), "".join(a)) for b, a in path]))
                  for s, k, d, sub, root, path in slow_manifest(rows, arity))
    assert got == want


def test_odd_rows(spark, odd, none):
    leaves = lambda d: d.select("source", F.col("doc_id").alias("key"),
                                manifest.leaf(*map(F.col, manifest.COLUMNS)).alias("digest"), "y", "rank")
    got = manifest.manifest(leaves(odd)).withColumn("end", manifest.fold(F.col("digest"), F.col("witness"))).collect()
    rows = odd.collect()
    assert sorted(r.digest for r in got) == sorted(slow_leaf(r, r.text) for r in rows)
    assert all(r.end == r.root and r.n == len(rows) for r in got)
    assert manifest.manifest(leaves(none)).count() == 0
    alone = manifest.manifest(leaves(odd.filter("doc_id = 7"))).collect()
    assert [(r.digest, r.witness) for r in alone] == [(alone[0].root, [])]


def test_witnesses_grow_with_later_siblings():
    a = manifest.Appender(2, 2)
    for x in "abc":
        a.append(H(x))
    before = [[p.value() for p in w] for w in a.witness]
    assert before[0] == [{"left": "", "right": H("b")}, {"left": "", "right": ""}]
    a.append(H("d"))
    a.close()
    assert a.witness[0][1].value() == {"left": "", "right": H(H("c"), H("d"))} and a.top == [H(H(H("a"), H("b")), H(H("c"), H("d")))]
