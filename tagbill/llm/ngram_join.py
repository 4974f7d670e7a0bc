"""N-gram Jaccard join by a count-vector R-tree: groups of documents whose shingle sets agree.

A document's tokens are its distinct word shingles, as 64-bit hashes. Documents link when
intersection over union reaches ``percent`` / 100; a group is what links reach. Documents
of equal sets form a class and are searched once.

Points. Tokens are hashed into ``GROUPS`` groups; a class is the point of its group counts.
The overlap of two sets is at most the sum of the smaller counts of each group, and of a set
with any point in a box at most what the box's corner nearest to it allows. An R-tree of
such boxes finds, for each point, the points whose bound reaches the threshold; surviving
pairs are verified on their sets.

Distribution. With sizes m and n a link leaves at most (m + n)(1 - 2t) tokens unshared,
t = percent / (100 + percent). So if a range of sizes up to U is cut into more than
2U(1 - 2t) blocks of tokens (by another hash), two linked sets agree in all groups of a block
at least: they meet under that block's key. Keys that only one class has go at once. Under
the others there may be very many points, all alike, and no task takes them whole: first, in
a few rounds, members of crowded keys are verified against one leader each, and components of the
links found tell which keys hold one component only (they are done: a further link would
join what is joined). Keys that still hold several are searched by R-trees, in cells of
bounded size (pairs of blocks of a key's points), skipping boxes of the point's own component.
A pair of a dense group meets under very many keys. So first come sweeps in which a cell tells
a spanning forest of its candidates only, the first ones in an order that all cells share; what links
becomes one component. Only then every candidate is told that is left between different
components, but for those already verified.

Defined results. Words are split at ASCII white space after lower-casing A-Z; a text with
fewer words than a shingle has one token, the whole sequence. Null text, or no word: no
token, linked with nothing, the document's id names its group. Rows without doc_id have the
id of their group, but never name it (a group without any id has a null one). Repeated rows
come back as often as they came in. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagbill.llm.common import cut, prepare
from tagbill.llm.divergence import stretches
from tagbill.llm.simhash import components

#: Coordinates of a point.
GROUPS = 256
#: Children of a node of the tree.
FAN = 16
#: Points of one block of a cell; a cell has two blocks at most.
BLOCK = 2048
#: Keys of more members than this are crowded; rounds of verifying their members against a leader before trees are built.
CROWD = BLOCK
ROUNDS = 3
#: Sweeps of the cells that tell a forest of their candidates, before all that are left are told.
SWEEPS = 1
#: Up to so many points are compared each with each; more get a tree.
FEW = 2 * FAN
#: Bits of the filter that picks the documents whose sets are needed.
FILTER_BITS = 1 << 26

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    x = (x ^ (x >> np.uint64(29))) * _ODD[4]
    return x ^ (x >> np.uint64(32))


# ---- token sets -----------------------------------------------------------

def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))]


def shingle_sets(texts: list[bytes], width: int = 3) -> list[np.ndarray]:
    """The distinct hashes of each text's shingles, in order."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    inside = ~_SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]             # the last byte is never inside
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    kind, size = (pa.binary(), np.int32) if offsets[-1] < 2**31 - 1 else (pa.large_binary(), np.int64)
    words = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets.astype(size)), pa.py_buffer(data[inside])])
    coded = words.dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w, 42) for w in coded.dictionary.to_pylist()], np.uint64)
    word = known[np.asarray(coded.indices)] if len(known) else np.zeros(0, np.uint64)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(starts, begins)          # of each text, its first word
    joined = np.zeros(max(0, len(word) - width + 1), np.uint64)
    for i in range(width):                           # a polynomial in an odd number: order counts
        joined = joined * _ODD[0] + mix(word[i:i + len(joined)] + _ODD[1])
    joined = mix(joined)
    found = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            found.append(_distinct(joined[a:b - width + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)     # shorter sequences: apart from all shingles by their length
            for i in range(a, b):
                whole = whole * _ODD[2] + mix(word[i:i + 1] + _ODD[1])
            found.append(mix(whole))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def linked(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Tokens that two sets share; both in order."""
    a, b = (a, b) if len(a) < len(b) else (b, a)
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


# ---- block keys -----------------------------------------------------------

def size_range(n: int, percent: int) -> list[tuple[int, int]]:
    """(number, largest size) of the ranges that a set of n tokens is searched in: any linked set shares one.

    Ranges overlap: range r goes from its lower end up to a size that its smallest sets can't exceed twice over.
    """
    found, r, low = [], 0, 1
    while low <= n:
        nxt = max(low + 1, -(-low * 100 * 100 // (percent * percent)))      # next range begins here
        high = max(nxt - 1, (nxt - 1) * 100 // percent)                     # largest partner of a set that begins in here
        if n <= high:
            found.append((r, high))
        r, low = r + 1, nxt
    return found


def blocks_of(high: int, percent: int) -> int:
    """Blocks such that two linked sets of at most ``high`` tokens agree in one of them."""
    return 2 * high * (100 - percent) // (100 + percent) + 1


def block_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """One key for each range and block: a hash of the block's tokens, of the block and the range."""
    keys = []
    for r, high in size_range(len(tokens), percent):
        k = blocks_of(high, percent)
        block = (tokens % np.uint64(k)).astype(np.int64)
        sums = np.zeros(k, np.uint64)
        order = np.argsort(block, kind="stable")
        block = block[order]
        first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        sums[block[first]] = np.add.reduceat(mix(tokens[order] + _ODD[2]), first)
        keys.append(mix(sums + np.arange(k, dtype=np.uint64) * _ODD[0] + np.uint64(r * int(_ODD[1]) % 2**64)))
    return np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)


def point(tokens: np.ndarray) -> np.ndarray:
    return np.bincount((mix(tokens) >> np.uint64(32)).astype(np.int64) % GROUPS, minlength=GROUPS)


def packed(at: np.ndarray) -> bytes:
    """A point in the narrowest unsigned integers that hold it; their width shows in the length."""
    most = int(at.max()) if len(at) else 0
    return at.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def unpacked(data) -> np.ndarray:
    """The point, in 32-bit integers."""
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(data) // GROUPS]).astype(np.int32)


# ---- the tree -------------------------------------------------------------

def reach(q: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> np.ndarray:
    """For each box whether a point in it may link with ``q``.

    A point b links only if (100 + percent) * sum(min(q, b)) >= percent * (sum(q) + sum(b)); each
    coordinate of b does most for that where it is nearest to q's.
    """
    near = np.clip(q, low, high)
    whole = lambda x: x.sum(axis=-1, dtype=np.int64)
    return (100 + percent) * whole(np.minimum(q, near)) - percent * whole(near) >= percent * whole(q)


class Tree:
    """A packed R-tree of points, each of a component."""

    def __init__(self, points: np.ndarray, component: np.ndarray, percent: int) -> None:
        self.percent = percent
        # sort-tile: slabs by size, within a slab by the two coordinates that vary most
        size = points.sum(axis=1, dtype=np.int64)
        slab = np.argsort(np.argsort(size, kind="stable"), kind="stable") // max(FAN, int(len(points) ** 0.5))
        wide = np.argsort(points.var(axis=0))[-2:]
        self.order = np.lexsort((points[:, wide[0]], points[:, wide[1]], slab))
        low = high = points[self.order]
        one = component[self.order]
        self.levels = [(low, high, one)]             # from the points up; one: the component of all, or -1
        while len(low) > FAN:
            at = np.arange(0, len(low), FAN)
            least, most = np.minimum.reduceat(one, at), np.maximum.reduceat(one, at)
            low, high, one = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.where(least == most, least, -1)
            self.levels.append((low, high, one))

    def search(self, q: np.ndarray, component: int) -> np.ndarray:
        """Places of the points of other components whose bound reaches the threshold."""
        at = np.arange(len(self.levels[-1][0]))
        for i in range(len(self.levels) - 1, -1, -1):
            low, high, one = self.levels[i]
            at = at[one[at] != component]
            at = at[reach(q, low[at], high[at], self.percent)]
            if i:
                at = (at[:, None] * FAN + np.arange(FAN)).ravel()
                at = at[at < len(self.levels[i - 1][0])]
        return self.order[at]


def candidates(points: np.ndarray, component: np.ndarray, percent: int, forest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places whose bound reaches the threshold and whose components differ, each pair once.

    With ``forest``, only the first pair that leads from one tree of components to another: fewer than components.
    """
    tree_of = component.copy()
    a, b = [], []

    def told(i: int, near: np.ndarray) -> None:
        if forest and len(near):
            trees, first = np.unique(tree_of[near], return_index=True)
            near = near[np.sort(first[trees != tree_of[i]])]
            tree_of[np.isin(tree_of, tree_of[near])] = tree_of[i]
        a.append(near)
        b.append(np.full(len(near), i))

    if len(points) <= FEW:
        size = points.sum(axis=1, dtype=np.int64)
        both = np.array([np.minimum(q, points).sum(axis=1, dtype=np.int64) for q in points])
        near = (100 + percent) * both >= percent * (size[:, None] + size)
        near = np.triu(near & (component[:, None] != component), 1)
        if not forest:
            return np.nonzero(near)
        for i in np.flatnonzero(near.any(axis=0)).tolist():
            told(i, np.flatnonzero(near[:, i]))
    else:
        tree = Tree(points, component, percent)
        for i, q in enumerate(points):
            near = tree.search(q, int(component[i]))
            told(i, np.sort(near[near < i]))
    none = [np.zeros(0, np.int64)]
    return np.concatenate(a or none), np.concatenate(b or none)


# ---- the join -------------------------------------------------------------

def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
                       F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("print"))


def described(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, print, n, class, keys) of every row; ``class`` is a digest of the set, null without tokens."""
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64()), ("n", pa.int64()), ("class", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, (ids, prints) in stretches(it):
            sets = shingle_sets(texts, width)
            for at in range(0, len(sets), 1024):
                some = sets[at:at + 1024]
                keys = [block_keys(s, percent) for s in some]
                offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[at:at + 1024], pa.int64()), pa.array(prints[at:at + 1024], pa.int64()), pa.array([len(s) for s in some], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in some], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys), pa.int64()))], schema=schema)

    return _documents(docs).mapInArrow(run, "doc_id long, print long, n long, class binary, keys array<long>")


def _shared_keys(keyed: DataFrame) -> DataFrame:
    """(key, id) of the keys that two classes or more have."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, bool] | None = None     # the row before: key, id, whether it went out
        for b in it:
            if not b.num_rows:
                continue
            key, id_ = np.asarray(b.column(0)), np.asarray(b.column(1))
            same = key[1:] == key[:-1]
            before = last is not None and last[0] == key[0]
            out = np.concatenate(([before], same)) | np.concatenate((same, [False]))
            head = [np.array([x]) for x in last[:2]] if before and not last[2] else [np.zeros(0, np.int64)] * 2
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((h, c[out]))) for h, c in zip(head, (key, id_))], schema=schema)
            last = (int(key[-1]), int(id_[-1]), bool(out[-1]))

    return keyed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "key long, id long")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, tokens, point) of the ``wanted`` classes (id, doc_id, print), from one document of each."""
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64()), ("tokens", pa.binary()), ("point", pa.binary())])
    words = (wanted.select(F.shiftright(F.pmod("print", F.lit(FILTER_BITS)), 6).alias("word"),
                           F.expr(f"shiftleft(1L, cast(pmod(print, {FILTER_BITS}) % 64 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
    filled = np.zeros(FILTER_BITS >> 6, np.int64)     # of one size, whatever the number of classes
    filled[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def picked() -> Iterator[pa.RecordBatch]:
            for b in it:
                spot = np.asarray(b.column(2)) % FILTER_BITS
                yield b.filter(pa.array((shared.value[spot >> 6] >> (spot & 63)) & 1 == 1))

        for texts, (ids, prints) in stretches(picked()):
            sets = shingle_sets(texts, width)
            for at in range(0, len(sets), 256):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at:at + 256], pa.int64()), pa.array(prints[at:at + 256], pa.int64()),
                                                  pa.array([s.tobytes() for s in sets[at:at + 256]], pa.binary()),
                                                  pa.array([packed(point(s)) for s in sets[at:at + 256]], pa.binary())], schema=schema)

    found = _documents(docs).mapInArrow(run, "doc_id long, print long, tokens binary, point binary")
    want = wanted.select("id", F.col("doc_id").alias("of"), F.col("print").alias("mark"))
    return (found.join(want, found["doc_id"].eqNullSafe(want["of"]) & (found["print"] == want["mark"]))
            .select("id", "tokens", "point").dropDuplicates(["id"]))


def _tested(pairs: DataFrame, known: DataFrame, column: str, test) -> DataFrame:
    """The pairs (a, b) for which ``test`` holds of both ids' ``column`` (binary)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            hits = [test(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(hits, pa.bool_()))

    one, other = (known.select(F.col("id").alias(x), F.col(column).alias(f"{column}_{x}")) for x in "ab")
    return (pairs.join(one, "a").join(other, "b").select("a", "b", f"{column}_a", f"{column}_b")
            .mapInArrow(run, "a long, b long"))


def _bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose points may link."""
    def test(x, y) -> bool:
        x, y = unpacked(x), unpacked(y)
        return linked(int(x.sum()), int(y.sum()), int(np.minimum(x, y).sum()), percent)

    return _tested(pairs, sets, "point", test)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets link."""
    def test(x, y) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        return linked(len(x), len(y), overlap(x, y), percent)

    return _tested(pairs, sets, "tokens", test)


def _searched(rows: DataFrame, sets: DataFrame, percent: int, block: int, sweep: int | None = None) -> DataFrame:
    """(a, b): pairs of different components under one key whose bound reaches the threshold; by R-trees.

    With ``sweep``, a cell tells a forest of its components only, by an order of the ids that the sweep's number picks.
    """
    # a key of many points: its rows go to every cell (i, j) of block pairs that holds their block
    sizes = (rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block)
             .select("key", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks")))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                        lambda o: F.least(mine, o) * F.col("blocks") + F.greatest(mine, o))
    dealt = (rows.join(sizes, "key", "left")
             .select("key", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0)))
                                      .otherwise(F.array_distinct(every))).alias("cell"), "id", "comp"))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def pairs(cell: pa.Table) -> pa.RecordBatch:
            id_, comp = (cell[c].to_numpy() for c in ("id", "comp"))
            points = np.stack([unpacked(x.as_buffer()) for x in cell["point"]])
            if sweep is not None:
                order = np.argsort(mix(id_.astype(np.uint64) + _ODD[sweep % len(_ODD)]))
                id_, comp, points = id_[order], comp[order], points[order]
            a, b = candidates(points, comp, percent, forest=sweep is not None)
            a, b = id_[a], id_[b]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=out)

        for batch in it:
            t = pa.Table.from_batches([batch])
            key, cell = t["key"].to_numpy(), t["cell"].to_numpy()
            first = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1, [len(key)]))
            for s, e in zip(first[:-1], first[1:]):
                if held and (held[0]["key"][0].as_py(), held[0]["cell"][0].as_py()) != (key[s], cell[s]):
                    yield pairs(pa.concat_tables(held))
                    held = []
                if e > s:
                    held.append(t.slice(s, e - s))
        if held:
            yield pairs(pa.concat_tables(held))

    return (dealt.join(sets.select("id", "point"), "id").select("key", "cell", "id", "comp", "point")
            .repartition("key", "cell").sortWithinPartitions("key", "cell", "id")
            .mapInArrow(search, "a long, b long").distinct())


def join(docs: DataFrame, width: int = 3, percent: int = 90, block: int = BLOCK, rounds: int = ROUNDS,
         crowd: int = CROWD, sweeps: int = SWEEPS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``; see the module's text."""
    prepare(docs.sparkSession)
    rows = cut(described(docs, width, percent))
    classes = cut(rows.filter(F.col("class").isNotNull()).groupBy("class")
                  .agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "print")).alias("of"), F.first("keys").alias("keys"))
                  .withColumn("id", F.monotonically_increasing_id()))
    keys = cut(_shared_keys(classes.select(F.explode("keys").alias("key"), "id")))
    wanted = classes.join(keys.select("id").distinct(), "id", "left_semi").select("id", "of.doc_id", "of.print")
    sets = cut(_sets(docs, cut(wanted), width))

    links = docs.sparkSession.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    comp = cut(links.select(F.col("a").alias("id"), F.col("b").alias("root")))

    def joined(more: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All links so far and, of every id that they lead to a smaller one, the smallest."""
        both = cut(links.union(more))
        return both, cut(components(both).select(F.col("fp").alias("id"), "root"))

    def rooted(rows: DataFrame, *names: str) -> DataFrame:
        """``rows`` with ``root_<name>``, the component of each named id."""
        for name in names:
            of = comp.select(F.col("id").alias(name), F.col("root").alias(f"root_{name}"))
            rows = rows.join(of, name, "left").withColumn(f"root_{name}", F.coalesce(f"root_{name}", name))
        return rows

    crowded = cut(keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("key"), "key"))
    for i in range(rounds):
        # a leader for each key of several components, another one in every round
        at = rooted(crowded, "id")
        order = F.struct(F.xxhash64(F.lit(i), "id"), F.col("id"), F.col("root_id"))
        mixed = (at.groupBy("key").agg(F.min("root_id").alias("low"), F.max("root_id").alias("high"), F.min(order).alias("lead"))
                 .filter(F.col("low") < F.col("high")).select("key", "lead"))
        at = cut(at.join(mixed, "key").select("key", "id", "root_id", F.col("lead.id").alias("leader"), F.col("lead.root_id").alias("leads")))
        if at.isEmpty():
            break
        pairs = (at.filter(F.col("root_id") != F.col("leads"))
                 .select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct())
        links, comp = joined(_verified(_bounded(pairs, sets, percent), sets, percent))
        crowded = at.select("key", "id")
    tried = None
    for sweep in [*range(sweeps), None]:
        at = rooted(keys, "id")
        mixed = (at.groupBy("key").agg(F.min("root_id").alias("low"), F.max("root_id").alias("high"))
                 .filter(F.col("low") < F.col("high")).select("key"))
        at = cut(at.join(mixed, "key").select("key", "id", F.col("root_id").alias("comp")))
        if at.isEmpty():
            break
        pairs = _searched(at, sets, percent, block, sweep)
        pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        links, comp = joined(_verified(pairs, sets, percent))
        tried = pairs if tried is None else tried.union(pairs)
        keys = at.select("key", "id")
    named = rooted(classes.select("class", "least", "id"), "id").withColumnRenamed("root_id", "root")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    groups = named.join(least, "root").select("class", "component")
    return (rows.join(groups, "class", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id")))


DUCKDB_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT row, doc_id, list_distinct(CASE WHEN len(w) BETWEEN 1 AND 2 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS shingles
  FROM d),
t AS (SELECT row, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
links AS (
  SELECT a.row AS x, b.row AS y FROM t a JOIN t b ON a.shingle = b.shingle AND a.row <> b.row
  GROUP BY a.row, b.row, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reached AS (
  SELECT row AS x, row AS y FROM s
  UNION
  SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x)
SELECT a.doc_id, len(a.shingles)::BIGINT AS n_shingles, min(b.doc_id) AS component_id
FROM s a JOIN reached r ON r.x = a.row JOIN s b ON b.row = r.y GROUP BY a.row, a.doc_id, a.shingles"""
