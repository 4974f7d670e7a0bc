import collections
import hashlib
import itertools
import os
import random
import re
import secrets as entropy
import sys

import duckdb
import pytest

from tagbill.llm import packing, quality_rules, queries, secrets
from tagbill.llm.common import load

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "scripts"))
from oracle_check import duck_rows, spark_rows  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    assert spark_rows(queries.QUERIES[name](spark, sf)) == duck_rows(con, queries.ORACLE[name])


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if seen[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(hit), base)


def test_rules_on_odd_rows(odd, none):
    rows = quality_rules.judge(odd).collect()
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == sorted((str(r.doc_id), *slow_counts(r.text)) for r in odd.collect())
    assert {r.doc_id for r in rows if r.kept} == {1}
    assert quality_rules.keep(odd).columns == odd.columns and quality_rules.keep(odd).count() == 1
    assert quality_rules.judge(none).count() == 0


def test_rules_run_no_python(spark, sf):
    plan = quality_rules.judge(load(spark, sf, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def slow_base(text):
    found = []
    for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
                         r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_spans(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in load(spark, sf, "documents").collect()}
    total = 0
    for r in queries.op6_secret_scan(spark, sf).collect():
        spans = slow_base(texts[r.doc_id])
        kinds = collections.Counter(k for _, k, _ in spans)
        line = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds[0], kinds[1], kinds[2])
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("random")] == (line.split(",") if line else [])
        total += len(spans)
    assert total


def test_battery_tells_keys_from_text():
    rng = random.Random(4)
    alphabet = secrets.ALPHABETS["base64"]
    keys = ["".join(rng.choices(alphabet, k=40)) for _ in range(400)]
    ps = [secrets.battery(k, "base64") for k in keys]
    assert 0.35 < sum(ps) / len(ps) < 0.65 and sum(p < 0.05 for p in ps) < 40
    texts = ["ThisIsTheHouseOfTheRisingSunAndItWas1", "abcdefABCDEF0123456789abcdefABCDEF0123456789", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaB1"]
    assert all(secrets.battery(t, "base64") < 0.05 for t in texts[1:])
    assert secrets.encoding("onlyletters") is None and secrets.encoding("0123abcd") == "hex"


def test_random_spans_and_masking(spark):
    entropy_rows = ["key " + entropy.token_urlsafe(40).replace("-", "x").replace("_", "y") + " end" for _ in range(300)]
    plain = ["a path/to/some/file_name_number_1 and RunningTotalOfTheYear2024AndMore"] * 300
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(entropy_rows + plain)], "doc_id long, text string, n_chars long")
    found = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert sum(len(found[i].added) for i in range(300)) >= 270
    masked = {r.doc_id: r for r in secrets.mask(docs).collect()}
    assert sum(masked[i].text == "key [secret] end" for i in range(300)) >= 250
    assert all(r.n_chars == len(r.text) for r in masked.values()) and len(masked) == 600


def test_values_after_a_name_are_tested():
    key = "9fK2xQ7LpZ0vB4nT8sWc"
    for text, want in ((f"AUTH={key}", key), (f"http://h/?a=1&sig={key}&b=2", key), (f"{key}==", key), (f"A={key}=", key),
                       (f"/v1/x-{key}", f"x-{key}"), (f"x-{key}/+{key}", f"{key}/+{key}"), ("A=9fK2xQ7LpZ0vB4n=", "9fK2xQ7LpZ0vB4n")):
        assert [text[a:b] for a, b, *_ in secrets.find(text)[1]] == [want]


def test_masking_of_values_after_a_name(spark):
    keys = [entropy.token_urlsafe(40).replace("-", "x").replace("_", "y") for _ in range(300)]
    docs = spark.createDataFrame([(i, f"AUTH={k} end") for i, k in enumerate(keys)], "doc_id long, text string")
    assert sum(r.text == "AUTH=[secret] end" for r in secrets.mask(docs).collect()) >= 250


def test_secrets_on_odd_rows(odd, none):
    assert sorted(str(r.doc_id) for r in secrets.scan(odd).collect()) == sorted(str(r.doc_id) for r in odd.collect())
    assert secrets.mask(odd).collect().__len__() == odd.count() and secrets.mask(odd).columns == odd.columns
    assert secrets.scan(none).count() == 0 and secrets.mask(none).count() == 0


def test_cut_follows_the_histogram():
    flat, text = [10] * secrets.BINS, [0] * secrets.BINS
    text[0] = 5000
    import numpy as np
    assert secrets._cut(np.array(flat), 0.05) == 0.0
    assert 0 < secrets._cut(np.array(flat) + np.array(text), 0.05) < 0.05
    assert secrets._cut(np.array(text), 0.05) == 2.0 and secrets._cut(None, 0.05) == 0.01


def test_optimal_buckets_against_all_choices():
    rng = random.Random(5)
    for _ in range(200):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 8)))
        counts = [rng.randint(1, 30) for _ in lengths]
        k = rng.randint(1, 5)

        def total(bounds):
            return sum(n * min(b for b in bounds if b >= q) for q, n in zip(lengths, counts))

        best = min(total((*c, lengths[-1])) for r in range(min(k, len(lengths)))
                   for c in itertools.combinations(lengths[:-1], r))
        found = packing.optimal_buckets(lengths, counts, k)
        assert len(found) <= k and found == sorted(found) and found[-1] == lengths[-1] and total(found) == best


def test_packing_keeps_all_and_fills_batches(spark, sf, odd, none):
    p = packing.Params(max_length=512, budget=4096, buckets=6)
    old, packing.SHARD_ROWS = packing.SHARD_ROWS, 20
    try:
        rows = packing.pack(load(spark, sf, "documents"), p).collect()
    finally:
        packing.SHARD_ROWS = old
    words = {r.doc_id: len((r.text or "").encode().split()) for r in load(spark, sf, "documents").collect()}
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        assert r.n_tokens <= r.bucket <= 512 and r.start == r.piece * 512
    assert {d: sum(r.n_tokens for r in v) for d, v in by_doc.items()} == words
    per = collections.defaultdict(list)
    for r in rows:
        per[r.bucket, r.batch].append(r.slot)
    for (bucket, batch), slots in per.items():
        fits = max(1, 4096 // bucket)
        last = max(b for k, b in per if k == bucket)
        assert sorted(slots) == list(range(len(slots))) and (len(slots) == fits or batch == last)
    assert packing.pack(none).count() == 0
    got = collections.Counter(str(r.doc_id) for r in packing.pack(odd).collect())
    assert got["9"] == 3 and got["None"] == 2 and got["7"] == 10
