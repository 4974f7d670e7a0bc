"""The bucketed store: upserts, races, tombstones and compaction against plain dictionaries."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from tagbill.operators.store import Store, Update


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, values):
    return spark.createDataFrame(values, "k long, name string, v int")


def test_upserts_deletes_and_compaction_follow_a_dictionary(spark, store):
    rng = random.Random(3)
    want = {k: (k, f"n{k}", 0) for k in [None, *range(40)]}
    store.replace_all({"t": (frame(spark, list(want.values())), ["k"])}, buckets=4)
    for step in range(5):
        fresh = [(k, rng.choice(["a", None]), step) for k in rng.sample(range(60), 5)]
        store.update({"t": Update(frame(spark, fresh))})
        want |= {r[0]: r for r in fresh}
        gone = rng.sample([*range(60), None], 4)
        store.delete(["t"], spark.createDataFrame([(k,) for k in gone], "k long"))
        want = {k: r for k, r in want.items() if k not in gone}
        assert rows(store.read("t")) == sorted(want.values(), key=str) and store.count("t") == len(want)
        if step == 2:
            store.compact("t")
            assert not store.manifest()["t"]["tombstones"]
            assert rows(store.read("t")) == sorted(want.values(), key=str) and store.count("t") == len(want)


def test_an_upsert_touches_its_buckets_only(spark, store):
    store.replace_all({"t": (frame(spark, [(k, "old", 0) for k in range(200)]), ["k"])}, buckets=16)
    before = store.manifest()["t"]["parts"]
    store.update({"t": Update(frame(spark, [(5, "new", 1), (1005, "new", 1)]))})
    after = store.manifest()["t"]["parts"]
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 2 and len(before) == 16
    assert rows(store.read("t").filter("v = 1")) == [(1005, "new", 1), (5, "new", 1)] and store.count("t") == 201
    assert rows(store.read("t", 0)) == sorted(((k, "old", 0) for k in range(200)), key=str)     # a reader of the older commit


def test_deletion_rewrites_nothing(spark, store):
    store.replace_all({n: (frame(spark, [(k, n, 0) for k in range(20)]), ["k"]) for n in ("parent", "child")}, buckets=4)
    before = {n: e["parts"] for n, e in store.manifest().items()}
    store.delete(["parent", "child"], spark.createDataFrame([(3,), (3,), (99,)], "k long"))
    assert {n: e["parts"] for n, e in store.manifest().items()} == before
    assert all(store.count(n) == 19 and store.read(n).filter("k = 3").isEmpty() for n in before)
    store.update({"child": Update(frame(spark, [(3, "again", 1)]))})           # written after the deletion, so it stays
    assert rows(store.read("child").filter("k = 3")) == [(3, "again", 1)] and store.count("parent") == 19


def test_two_writers_at_once_both_land(spark, store):
    store.replace_all({"t": (frame(spark, [(k, "old", 0) for k in range(50)]), ["k"])}, buckets=4)
    errors = []

    def write(who):
        try:
            for i in range(3):
                store.update({"t": Update(frame(spark, [(k, f"w{who}", i) for k in range(who, 50, 3)]))})
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and store.version() == 9
    assert rows(store.read("t")) == sorted(((k, f"w{k % 3}", 2) for k in range(50)), key=str)


def test_a_lost_race_reads_again(spark, store):
    """Another writer publishes between the reading and the publishing of an update that adds up."""
    store.replace_all({"t": (frame(spark, [(1, "sum", 10)]), ["k"])}, buckets=2)
    other = Store(spark, store.root)
    calls = []

    def add(current, fresh):
        if not calls:
            calls.append(1)
            other.update({"t": Update(frame(spark, [(1, "sum", 100)]))})
        return current.alias("c").join(fresh.alias("f"), F.col("c.k") == F.col("f.k")).select(
            "c.k", "c.name", (F.col("c.v") + F.col("f.v")).alias("v"))

    store.update({"t": Update(frame(spark, [(1, "sum", 5)]), add)})
    assert rows(store.read("t")) == [(1, "sum", 105)]


def test_loads_of_several_tables_show_at_once(spark, store):
    for load in range(3):
        store.replace_all({n: (frame(spark, [(load, n, load)] * (load + 1)), ["k"]) for n in ("a", "b", "c", "d")}, buckets=2)
        assert {tuple(r)[0] for n in "abcd" for r in store.read(n).collect()} == {load}
        assert [store.count(n) for n in "abcd"] == [load + 1] * 4
    assert rows(store.read("a", 0)) == [(0, "a", 0)]


def test_empty_stores_tables_and_appends(spark, store):
    assert store.version() == -1 and store.read("t") is None and store.count("t") == 0 and store.tables() == []
    store.create("t", frame(spark, []).schema, ["k"], 4)
    store.create("t", frame(spark, []).schema, ["k"], 9)
    assert store.read("t").isEmpty() and store.count("t") == 0 and store.manifest()["t"]["buckets"] == 4
    store.append("t", spark.createDataFrame([("x", 1)], "NAME string, extra int"))
    store.append("t", frame(spark, [(1, "y", 2), (1, "y", 2)]))
    assert rows(store.read("t")) == [(1, "y", 2), (1, "y", 2), (None, "x", None)] and store.count("t") == 3
    store.update({"t": Update(frame(spark, []), keys=spark.createDataFrame([(1,)], "k long"))})
    assert rows(store.read("t")) == [(None, "x", None)]
    store.compact("t")
    store.replace_all({"t": (frame(spark, []), ["k"])})
    assert store.count("t") == 0 and store.read("t").isEmpty()
