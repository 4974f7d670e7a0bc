"""SimHash near-duplicate groups by the generalised pigeonhole principle.

Fingerprints: 64 bits; a bit is 1 if it is set in over half of the XXH64 hashes
(UTF-8, seed 42) of a text's word shingles, repeats included. Two fingerprints
link at ``max_distance`` or fewer differing bits; a group is what links reach.

Search. The 64 bit positions are dealt into m parts so that correlated bits sit
together (their joint skew then spoils one part instead of several). With part
thresholds t_1..t_m that add up to ``max_distance - m + 1`` (each at least -1),
any pair within ``max_distance`` is within t_i in some part i: were it beyond
every t_i, the distances would add up to at least sum(t_i + 1) =
``max_distance + 1``. Thresholds are unequal: a dynamic program picks them, and
the number of parts, by the estimated cost of probes plus candidates, from bit
statistics of all fingerprints. A part with threshold -1 is skipped; threshold t
is probed by flipping up to t of the part's bits, from one side of a pair only.
Candidates that meet under one (part, key) are verified by their bit distance
inside the task, which emits links that span them (at most one a row) and not
all pairs. Keys with very many fingerprints are dealt out as pairs of blocks.

Defined results. Null text: empty. No word: fingerprint zero, linked like any
other. Fewer words than a shingle: one shingle of all words. Repeated rows come
back as often as they came in. A row without doc_id gets a fingerprint and the
group's id, but never names a group (a group without any id has a null one).
Empty table: no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagbill.llm.common import batches, cut, out, prepare

BITS = 64
#: Largest threshold of a part; more flips than two would cost more than more parts.
MOST_FLIPS = 2
#: Fingerprints of one (part, key) that a single task compares at once.
BLOCK = 4096


# ---- fingerprints ---------------------------------------------------------

def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text in UTF-8, as a signed 64-bit integer."""
    words = text.lower().split()          # of bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, seed)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1:].tolist())]
    n = len(hashes)
    counts = np.zeros(BITS, np.int64)
    every = np.array(hashes, dtype="<u8").view(np.uint8).reshape(n, 8)
    for at in range(0, n, 4096):          # a very long text must not unpack whole
        counts += np.unpackbits(every[at:at + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            yield out(schema, b.column(0), [fingerprint(t or b"", shingle, seed) for t in b.column(1).to_pylist()])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
            .mapInArrow(run, "doc_id long, fp long"))


# ---- parts and thresholds -------------------------------------------------

@dataclass(frozen=True)
class Plan:
    """Bit positions of each part, and its threshold (-1: not probed)."""
    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each two bits, how many have both set."""
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64())])
    row, col = np.triu_indices(BITS)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for b in batches(it, 65536):
            fp = np.asarray(b.column(0)).astype("<i8")
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += np.rint(bits.T @ bits).astype(np.int64)
            n += len(fp)
        if n:
            yield out(schema, [*row, -1], [*col, -1], [*both[row, col], n])

    got = fps.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((BITS, BITS)), 0     # at most 64 * 65 / 2 + 1 rows, whatever the input
    for r in got:
        if r.i < 0:
            n = r.n
        else:
            both[r.i, r.j] = both[r.j, r.i] = r.n
    return n, both


def _correlation(n: int, both: np.ndarray) -> np.ndarray:
    p = both.diagonal() / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))


def _grouped(corr: np.ndarray, m: int) -> tuple[tuple[int, ...], ...]:
    """Deal the bits into m parts of nearly equal size, correlated bits together."""
    left, parts = set(range(BITS)), []
    for k in range(m):
        size = (BITS * (k + 1)) // m - (BITS * k) // m
        rest = sorted(left)
        part = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        left.discard(part[0])
        while len(part) < size:
            nxt = max(sorted(left), key=lambda b: (corr[b, part].sum(), -b))
            part.append(nxt)
            left.discard(nxt)
        parts.append(tuple(sorted(part)))
    return tuple(parts)


def _close(part: tuple[int, ...], p: np.ndarray, most: int) -> list[float]:
    """Chance that two fingerprints differ in 0, at most 1, .. at most ``most`` bits of a part."""
    dist = np.zeros(most + 1)
    dist[0] = 1.0
    for b in part:
        q = 2 * p[b] * (1 - p[b])
        dist = dist * (1 - q) + np.concatenate(([0.0], dist[:-1])) * q
    return list(np.cumsum(dist))


def make_plan(n: int, both: np.ndarray, max_distance: int) -> Plan:
    """Parts and thresholds of the least estimated probes plus candidates."""
    p = both.diagonal() / max(n, 1)
    corr = _correlation(n, both)
    best: tuple[float, Plan] | None = None
    for m in range(1, max_distance + 2):
        parts = _grouped(corr, m)
        top = max_distance - m + 1 + (m - 1)          # one part may take what the others pass up
        cost = []
        for part in parts:
            near, c = _close(part, p, min(top, len(part))), {-1: 0.0}
            for t in range(min(top, MOST_FLIPS) + 1):
                probes = 1 + sum(math.comb(len(part), k) for k in range(1, t + 1)) / 2
                # a probe is sorted and shuffled; a candidate costs one comparison
                c[t] = n * probes + 0.05 * n * n / 2 * near[min(t, len(near) - 1)]
            cost.append(c)
        # dynamic program over parts: least cost for each sum of (t + 1) so far
        need = max_distance + 1
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for c in cost:
            nxt: dict[int, tuple[float, tuple[int, ...]]] = {}
            for total, (so_far, chosen) in table.items():
                for t, x in c.items():
                    s = total + t + 1
                    if s <= need and (s not in nxt or so_far + x < nxt[s][0]):
                        nxt[s] = (so_far + x, (*chosen, t))
            table = nxt
        # the thresholds + 1 must add up to max_distance + 1 for the guarantee
        if need in table and (best is None or table[need][0] < best[0]):
            best = (table[need][0], Plan(parts, table[need][1]))
    assert best is not None
    return best[1]


# ---- probing and verification --------------------------------------------

def _flips(fp: Column, part: tuple[int, ...], most: int) -> Column:
    """Array of bit masks of 1..most (at most 2) bits of a part, the lowest of them 0 in ``fp``."""
    bits = F.array(*[F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("long") for b in part])
    single = F.filter(bits, lambda x: fp.bitwiseAND(x) == 0)
    if most == 1:
        return single
    above = lambda x, i: F.transform(F.slice(bits, i + 2, F.lit(BITS)), lambda y: x.bitwiseOR(y))
    double = F.flatten(F.transform(bits, lambda x, i: F.when(fp.bitwiseAND(x) == 0, above(x, i))
                                   .otherwise(F.array().cast("array<bigint>"))))
    return F.concat(single, double)


def _keys(fp: Column, plan: Plan) -> Column:
    """Array of (part, key, probe): a fingerprint's own keys and its flipped ones.

    Of two fingerprints that differ in a set of bits, the one with 0 in the
    lowest of them probes; so each pair meets from one side.
    """
    found = []
    for i, (part, t) in enumerate(zip(plan.parts, plan.thresholds)):
        if t < 0:
            continue
        mask = sum(1 << b for b in part)
        key = fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))
        found.append(F.array(F.struct(F.lit(i).alias("part"), key.alias("key"), F.lit(False).alias("probe"))))
        if t:
            found.append(F.transform(_flips(fp, part, t), _flipped(i, key)))
    return F.concat(*found)


def _flipped(part: int, key: Column):
    return lambda x: F.struct(F.lit(part).alias("part"), key.bitwiseXOR(x).alias("key"), F.lit(True).alias("probe"))


def _spanning(fp: np.ndarray, probe: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among the rows of one (part, key) that connect whatever is in reach.

    Breadth-first from each unreached row: a row is compared with those not yet
    reached only, so a dense group costs little more than one comparison a row.
    A link between two probing rows is a link too (the distance is the whole one).
    """
    left = np.arange(len(fp))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[at]) <= most
            if near.any():
                hit = left[near]
                yield np.full(len(hit), fp[at]), fp[hit]
                queue.extend(hit.tolist())
                left = left[~near]


def _links_in_sorted(it: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among rows that agree on (part, key, cell); rows come sorted by these."""
    held: list[np.ndarray] = []

    def solve(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        change = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
        starts = np.concatenate(([0], change))
        sizes = np.diff(np.concatenate((starts, [len(rows)])))
        fp, probe = rows[:, 3].view(np.uint64), rows[:, 4]
        for size in (2, 3, 4, 5, 6, 7, 8):            # small groups: all pairs of a size at once
            at = starts[sizes == size]
            for a, b in itertools.combinations(range(size), 2):
                x, y = fp[at + a], fp[at + b]
                near = (np.bitwise_count(x ^ y) <= most) & (x != y)
                if near.any():
                    yield x[near], y[near]
        for s, n in zip(starts[sizes > 8], sizes[sizes > 8]):
            yield from _spanning(np.unique(fp[s:s + n]), probe[s:s + n], most)

    for b in it:
        rows = np.column_stack([np.asarray(b.column(i)).astype(np.int64) for i in range(5)])
        if not len(rows):
            continue
        if held and (rows[-1, :3] == held[0][0, :3]).all():
            held.append(rows)                          # one group goes on over whole batches
            continue
        rows = np.ascontiguousarray(np.concatenate([*held, rows])) if held else rows
        last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
        split = last[-1] + 1 if len(last) else 0
        if split:
            yield from solve(np.ascontiguousarray(rows[:split]))
        held = [rows[split:]]
    if held:
        yield from solve(np.ascontiguousarray(np.concatenate(held)))


def links(fps: DataFrame, max_distance: int = 4, block: int = BLOCK, plan: Plan | None = None) -> DataFrame:
    """(a, b) with a < b: links that connect all fingerprints within ``max_distance``.

    ``fps`` has distinct, non-null fingerprints in ``fp``. Not every pair within
    the distance is returned, but any two such are connected by returned links.
    """
    if plan is None:
        plan = make_plan(*bit_statistics(fps), max_distance)
    probes = (fps.select("fp", F.explode(_keys(F.col("fp"), plan)).alias("k"))
              .select("k.part", "k.key", "fp", "k.probe"))
    # Groups above the block size: their rows go to every cell (i, j) of block
    # pairs that holds their block, so that any two rows meet in one cell.
    sizes = (probes.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > block)
             .select(F.col("part").alias("hot_part"), F.col("key").alias("hot_key"),
                     F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks")))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                        lambda o: F.least(mine, o) * F.col("blocks") + F.greatest(mine, o))
    dealt = (probes.join(sizes, (F.col("part") == F.col("hot_part")) & (F.col("key") == F.col("hot_key")), "left")
             .select("part", "key", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0)))
                                              .otherwise(F.array_distinct(every))).alias("cell"), "fp", "probe"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y in _links_in_sorted(it, max_distance):
            x, y = x.view(np.int64), y.view(np.int64)
            yield out(schema, np.minimum(x, y), np.maximum(x, y))

    return (dealt.select("part", F.col("key"), "cell", "fp", F.col("probe").cast("int").alias("probe"))
            .repartition("part", "key", "cell").sortWithinPartitions("part", "key", "cell", "fp")
            .mapInArrow(run, "a long, b long").distinct())


# ---- components -----------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(fp, root): the smallest fingerprint reachable by the links, for all that have a smaller one.

    Alternating large-star and small-star steps: every round hangs each node's
    larger (smaller) neighbours on the smallest one; a fixed point is a star for
    each component. Rounds grow with the logarithm of the longest chain. A node's
    neighbours are never gathered in one row, only their minimum.
    """
    edges = cut(edges.filter(F.col("a") != F.col("b")).select("a", "b"))

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else \
            e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        joined = both.join(low, F.col("a") == F.col("u"))
        if large:
            moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")) \
                .union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return moved.filter(F.col("a") != F.col("b")).distinct()

    def sums(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    before = sums(edges)
    while True:
        edges = cut(star(star(edges, True), False))
        now = sums(edges)
        if now == before:
            break
        before = now
    return edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("fp"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_distance: int = 4, seed: int = 42,
                    block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``; see the module's text."""
    prepare(docs.sparkSession)
    rows = cut(fingerprints(docs, shingle, seed))
    ids = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(ids.select("fp"), max_distance, block))
    named = (ids.join(roots, "fp", "left")
             .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    group = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(group, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, max_distance: int = 4, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` whose doc_id names its group; rows without an id stay.

    Of rows that share the same doc_id the one with the smallest text stays.
    """
    found = near_duplicates(docs, shingle, max_distance, seed)
    names = (found.filter(F.col("doc_id") == F.col("component_id"))
             .select(F.col("doc_id").alias("kept_id")).distinct())
    kept = docs.join(names, docs["doc_id"] == names["kept_id"], "left_semi")
    if kept.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        place = "rank" + "_" * max(map(len, docs.columns))          # no name of the input's
        order = Window.partitionBy("doc_id").orderBy("text")
        kept = kept.withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).drop(place)
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()))
