"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

1. Examples: a bounded sample of the labelled training rows (``max_examples``).
2. Terms: all words and five-letter word beginnings of the examples. One pass over all
   texts takes document frequencies over all documents; weights are
   (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1). Terms whose presence among the examples
   depends on the label (chi-squared, Bonferroni over all terms tested) weigh ``told``
   times as much, so that the nearest examples are near for what the label is about;
   a text without any of them is still searched by all its terms.
3. Index: an inverted one over all terms, of blocks of 64 examples that share their
   heaviest frequent term. Postings of the rarer terms are added up first. The ``head``
   most frequent terms have their largest weight in each block: with it a block has an
   upper bound of its cosines. Blocks of the highest bounds are scored first; the k-th
   best cosine then leaves out every block whose bound is lower, so the k best are exact.
   Examples tied with the k-th (to nine places) all count, so no tie is broken by an id.
4. Votes are weighted by 1 / (distance + 0.05); an isotonic fit of leave-one-out votes
   on the examples makes them probabilities. Evidence: the ids of nearest examples.

Every text is read once: its terms and counts are written to the shared folder, and both
the document frequencies and the scores come from there.
The vocabulary and the index are bounded by the texts of ``max_examples`` examples and
are broadcast; all rows are scored where they are read, nothing about them is gathered.

Defined results. Null or empty text, or one without any term of an example: the share of toxic
examples among those without any term (of all, if there are none). No labels: 0.0
for every row. Repeated rows score alike; repeated or contradicting labels of a
doc_id count as its largest. A row without doc_id is scored and never an example.
Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagbill.llm.common import batches, bounded_sample, cut, out, prepare, texts, written

_WORD = re.compile(r"[^\W\d_]+")
PREFIX = 5
#: Texts scored at a time.
GROUP = 128


@dataclass(frozen=True)
class Params:
    #: Bound of the labelled sample that the examples come from.
    max_examples: int = 8192
    max_terms: int = 4096
    #: Chance that any term is taken though it doesn't depend on the label.
    alpha: float = 0.05
    neighbours: int = 25
    #: Weight of a label-dependent term beside that of any other.
    told: float = 4.0
    #: Most frequent terms, of which blocks have bounds.
    head: int = 512


def terms(text: str) -> Counter:
    """Counts of words and, marked by a final '*', of longer words' beginnings."""
    found = Counter(_WORD.findall(text.lower()))
    for w, n in list(found.items()):
        if len(w) > PREFIX:
            found[w[:PREFIX] + "*"] += n
    return found


# ---- terms that depend on the label ----------------------------------------

def select_terms(examples: DataFrame, p: Params) -> tuple[list[str], list[str]]:
    """All terms of the examples (text, y), and at most ``max_terms`` that depend on y, in order."""
    schema = pa.schema([("term", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            every = list(held[0].keys() | held[1].keys())
            b = out(schema, every, [held[1][t] for t in every], [held[0][t] for t in every])
            held[0].clear()
            held[1].clear()
            return b

        for b in batches(it):
            for t, y in zip(texts(b.column(0)), b.column(1).to_pylist()):
                held[y].update(terms(t).keys())
                if len(held[0]) + len(held[1]) > 200_000:
                    yield flush()
        yield flush()

    every = cut(examples.select("text", "y").mapInArrow(count, "term string, pos long, neg long")
                .groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    vocabulary = sorted(every.select("term").toArrow().column(0).to_pylist())     # bounded by the examples' texts
    sizes = {r.y: r.n for r in examples.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    counts = every.filter("pos + neg > 2")
    tested = counts.count()
    if not n1 or not n0 or not tested:
        return vocabulary, []
    least = NormalDist().inv_cdf(1 - p.alpha / (2 * tested)) ** 2
    a, b, n = F.col("pos").cast("double"), F.col("neg").cast("double"), float(n1 + n0)
    d = n0 - b
    c = n1 - a
    chi = n * (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d) * float(n1) * float(n0))
    picked = (counts.filter(F.col("pos") + F.col("neg") < n).withColumn("chi", chi).filter(F.col("chi") >= least)
              .orderBy(F.desc("chi"), "term").limit(p.max_terms).select("term").collect())
    return vocabulary, [r.term for r in picked]


class Places(dict):
    """Of each word seen: its place and that of its beginning in a vocabulary, each plus one (0: none), as one number."""
    #: Words remembered.
    MOST = 200_000

    def __init__(self, vocabulary: list[str]) -> None:
        super().__init__()
        self.place = {t: i + 1 for i, t in enumerate(vocabulary)}

    def __missing__(self, word: str) -> int:
        get = self.place.get
        both = get(word, 0) << 32 | (get(word[:PREFIX] + "*", 0) if len(word) > PREFIX else 0)
        if len(self) < self.MOST:
            self[word] = both
        return both


_LAST: list = [None, None]


def places_of(vocabulary: list[str] | None) -> Places:
    """The places of a worker, kept from task to task while the vocabulary is the same object; None drops them."""
    if _LAST[0] is not vocabulary:
        _LAST[:] = vocabulary, Places(vocabulary or [])
    return _LAST[1]


#: Characters of texts whose words are looked up at once.
STRETCH = 1 << 20


def found_terms(texts_: list[str], places: Places) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the places of the vocabulary's terms in it, in order, and their counts."""
    words, sizes, held = [], [], 0
    for text in texts_:
        some = _WORD.findall(text.lower())
        words += some
        sizes.append(len(some))
        held += len(text)
        if held >= STRETCH:
            yield from _counted(words, sizes, places)
            words, sizes, held = [], [], 0
    yield from _counted(words, sizes, places)


def _counted(words: list[str], sizes: list[int], places: Places) -> list[tuple[np.ndarray, np.ndarray]]:
    both = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
    ids = np.concatenate((both >> 32, both & 0xFFFFFFFF)) - 1
    size = max(1, len(places.place))
    key = np.tile(np.repeat(np.arange(len(sizes)), sizes), 2) * size + ids
    key = np.sort(key[ids >= 0])
    first = np.flatnonzero(np.diff(key, prepend=-1))
    n = np.diff(first, append=len(key)).astype(np.int32)
    text, ids = np.divmod(key[first], size)
    ids = ids.astype(np.int32)
    ends = np.searchsorted(text, np.arange(len(sizes) + 1)).tolist()
    return [(ids[a:b], n[a:b]) for a, b in zip(ends, ends[1:])]


def _packed(ids: np.ndarray, tfs: np.ndarray) -> bytes:
    return np.concatenate((np.diff(ids, prepend=np.int32(0)), tfs)).tobytes()


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(packed, np.int32)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


def term_vectors(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, found), written: the terms of the vocabulary in every text and their counts, packed."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("found", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = places_of(held.value)
        for b in batches(it):
            yield out(schema, b.column(0), [_packed(*x) for x in found_terms(texts(b.column(1)), at)])

    return written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, found binary"))


def frequencies(found: DataFrame, size: int) -> tuple[int, np.ndarray]:
    """The number of documents, and how many of them have each of ``size`` terms."""
    schema = pa.schema([("t", pa.int32()), ("n", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(size, np.int64)
        for b in batches(it):
            n += b.num_rows
            for packed in b.column(0).to_pylist():
                df[_unpacked(packed)[0]] += 1
        some = np.flatnonzero(df)
        yield out(schema, np.append(some, -1), np.append(df[some], n))

    # one row a term of the bounded vocabulary
    rows = found.select("found").mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size + 1)
    counts[rows.column(0).to_numpy()] = rows.column(1).to_numpy()           # the last one counts documents
    return int(counts[-1]), counts[:-1]


def vectors(examples: DataFrame, vocabulary: list[str]) -> list[tuple[int, int, list[int], list[int]]]:
    """(doc_id, y, term places, counts) of each of the bounded examples, once if repeated."""
    held = examples.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("ids", pa.binary()), ("tfs", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = places_of(held.value)
        for b in batches(it):
            found = list(found_terms(texts(b.column(2)), at))
            yield out(schema, b.column(0), b.column(1), *([np.array(x, np.int32).tobytes() for x in c] for c in zip(*found)))

    rows = (examples.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, ids binary, tfs binary")
            .distinct().toArrow())
    return [(d, y, np.frombuffer(i, np.int32), np.frombuffer(n, np.int32))
            for d, y, i, n in zip(*(c.to_pylist() for c in rows.columns))]


# ---- index -----------------------------------------------------------------

#: Cosines are equal if they agree to nine places; bounds are held against less than the k-th best by this.
MARGIN = 1e-8
#: Examples of one block.
BLOCK = 64


def clustered(rows: list[tuple], weights: np.ndarray, head: int) -> list[tuple]:
    """``rows`` (doc_id, label, term ids, counts) with those of the same heaviest frequent terms beside each other."""
    df = np.bincount(np.concatenate([r[2] for r in rows]), minlength=len(weights))
    frequent = np.zeros(len(weights), bool)
    frequent[np.argsort(-df, kind="stable")[:head]] = True

    def key(r: tuple) -> list[int]:
        ids = np.asarray(r[2])
        w = np.where(frequent[ids], _unit(r[2], r[3], weights), 0)
        return ids[np.argsort(-w, kind="stable")[:4]].tolist()

    return sorted(rows, key=key)


@dataclass
class Index:
    """Postings of unit vectors of examples, by example and by term."""
    weights: np.ndarray                     # weight of each term
    labels: np.ndarray
    ids: np.ndarray
    rows: np.ndarray                        # first entry of each example, and the end
    row_terms: np.ndarray
    row_counts: np.ndarray
    dense: np.ndarray                       # block x head term x example
    tops: np.ndarray                        # head term x block: the largest weight
    column: np.ndarray                      # place of a term among the head terms, or -1
    starts: np.ndarray                      # first posting of each term, and the end
    post: np.ndarray
    post_weights: np.ndarray

    @staticmethod
    def build(rows: list[tuple[int, int, list[int], list[int]]], idf: np.ndarray, head: int) -> Index:
        """``rows``: (doc_id, label, term ids, counts), none without terms; they keep their places."""
        terms_ = np.concatenate([np.asarray(r[2], np.int32) for r in rows])
        weights = np.concatenate([_unit(r[2], r[3], idf) for r in rows])
        sizes = [len(r[2]) for r in rows]
        example = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
        df = np.bincount(terms_, minlength=len(idf))
        most = np.argsort(-df, kind="stable")[:head]
        column = np.full(len(idf), -1, np.int64)
        column[most] = np.arange(len(most))
        dense = np.zeros((-(-len(rows) // BLOCK), len(most), BLOCK))
        at_head = column[terms_] >= 0
        dense[example[at_head] // BLOCK, column[terms_[at_head]], example[at_head] % BLOCK] = weights[at_head]
        tail = np.flatnonzero(~at_head)
        tail = tail[np.argsort(terms_[tail], kind="stable")]
        return Index(idf, np.array([r[1] for r in rows], np.int64), np.array([r[0] for r in rows], np.int64),
                     np.concatenate(([0], np.cumsum(sizes))), terms_,
                     np.concatenate([np.asarray(r[3], np.int32) for r in rows]), dense,
                     np.ascontiguousarray(dense.max(axis=2).T), column,
                     np.searchsorted(terms_[tail], np.arange(len(idf) + 1)), example[tail].astype(np.int64), weights[tail])

    def nearest(self, ids: list[int], tfs: list[int], k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples with the k largest cosines above 0, all ties of the k-th, and their cosines.

        ``but``: the place of an example to leave out.
        """
        return self.nearest_many([(ids, tfs)], k, [but])[0]

    def nearest_many(self, queries: list[tuple[list[int], list[int]]], k: int,
                     but: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of each query; none without terms."""
        units = [(np.asarray(ids, np.int64), _unit(ids, tfs, self.weights)) for ids, tfs in queries]
        heads = np.zeros((len(units), len(self.tops)))
        n, blocks = len(self.ids), len(self.dense)
        rough = np.zeros((len(units), blocks * BLOCK))
        for j, (ids, q) in enumerate(units):
            c = self.column[ids]
            heads[j, c[c >= 0]] = q[c >= 0]
            a, b = self.starts[ids[c < 0]], self.starts[ids[c < 0] + 1]
            if len(a):
                size = b - a
                at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
                rough[j, :n] = np.bincount(self.post[at], self.post_weights[at] * np.repeat(q[c < 0], size), n)
            if but[j] >= 0:
                rough[j, but[j]] = -9
        rough[:, n:] = -9
        by_block = rough.reshape(len(units), blocks, BLOCK)
        bound = heads @ self.tops + by_block.max(axis=2)
        scored = np.zeros(bound.shape, bool)

        def add_heads(wanted: np.ndarray) -> None:
            for i in np.flatnonzero(wanted.any(axis=0)).tolist():
                j = np.flatnonzero(wanted[:, i])
                by_block[j, i] += heads[j] @ self.dense[i]
            scored[wanted] = True

        some = min(blocks, -(-k // BLOCK) + 5)               # enough for a k-th best
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, np.argpartition(-bound, some - 1, axis=1)[:, :some], True, axis=1)
        add_heads(first)
        if some < blocks:
            seen = by_block[first].reshape(len(units), -1)
            least = np.partition(seen, seen.shape[1] - k, axis=1)[:, seen.shape[1] - k]
            add_heads((bound >= np.where(least > MARGIN, least - MARGIN, -10)[:, None]) & ~first)
        found = []
        for j in range(len(units)):
            at = np.flatnonzero(scored[j])
            s = np.round(by_block[j, at].ravel(), 9)
            e = np.flatnonzero(s >= max(np.partition(s, len(s) - k)[len(s) - k], 1e-9)) if len(s) > k else np.flatnonzero(s > 0)
            e, exact = at[e // BLOCK] * BLOCK + e % BLOCK, s[e]
            order = np.lexsort((self.ids[e], -exact))
            found.append((e[order], exact[order]))
        return found

    def vote(self, e: np.ndarray, s: np.ndarray) -> float:
        w = 1.0 / (1.05 - np.minimum(s, 1.0))
        return float((w * self.labels[e]).sum() / w.sum())


class Examples:
    """What an ``Index`` is built from, packed: each worker builds it for itself, the driver never does."""

    def __init__(self, rows: list[tuple], weights: np.ndarray, head: int) -> None:
        self.weights, self.head = weights, head
        self.ids, self.labels = [r[0] for r in rows], [r[1] for r in rows]
        self.starts = np.concatenate(([0], np.cumsum([len(r[2]) for r in rows])))
        self.terms, self.counts = (zlib.compress(np.concatenate([r[i] for r in rows]).astype(np.int32).tobytes(), 1) for i in (2, 3))

    def rows(self) -> list[tuple]:
        terms_, counts = (np.frombuffer(zlib.decompress(x), np.int32) for x in (self.terms, self.counts))
        return [(i, y, terms_[a:b], counts[a:b])
                for i, y, a, b in zip(self.ids, self.labels, self.starts[:-1], self.starts[1:])]

    @cached_property
    def index(self) -> Index:
        return Index.build(self.rows(), self.weights, self.head)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "index"}


def _unit(ids: list[int], tfs: list[int], weights: np.ndarray) -> np.ndarray:
    w = (1 + np.log(np.asarray(tfs, float))) * weights[np.asarray(ids, np.int64)]
    return w / math.sqrt(float(w @ w))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (x, value) of the non-decreasing least-squares fit, by pooling."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []                      # [sum, weight, first x]
    xs, inverse = np.unique(x[order], return_inverse=True)
    sums, sizes = np.bincount(inverse, y[order], len(xs)), np.bincount(inverse, minlength=len(xs))
    for v, total, n in zip(xs, sums, sizes):
        pools.append([float(total), float(n), float(v)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            total2, n2, _ = pools.pop()
            pools[-1][0] += total2
            pools[-1][1] += n2
    return np.array([p[2] for p in pools]), np.array([p[0] / p[1] for p in pools])


@dataclass
class Model:
    vocabulary: list[str]
    told: set[int]                                       # places of the label-dependent terms
    examples: Examples | None
    steps: tuple[np.ndarray, np.ndarray]
    without: float                                       # score of a text without any term
    neighbours: int

    def score(self, found: list[tuple[list[int], list[int]]]) -> list[tuple[float, list[int]]]:
        """(score, nearest examples) of each text's terms and counts."""
        done = [(self.without, [])] * len(found)
        asked = [j for j, (ids, _) in enumerate(found) if len(ids)] if self.examples else []
        x, v = self.steps
        for i in range(0, len(asked), GROUP):
            group = asked[i:i + GROUP]
            index = self.examples.index
            near = index.nearest_many([found[j] for j in group], self.neighbours, [-1] * len(group))
            for j, (e, s) in zip(group, near):
                if len(e):
                    at = max(int(np.searchsorted(x, index.vote(e, s), side="right")) - 1, 0)
                    done[j] = float(v[at]), index.ids[e[:5]].tolist()
        return done


def votes(spark: SparkSession, examples: Examples, neighbours: int) -> tuple[np.ndarray, np.ndarray]:
    """Leave-one-out votes on the bounded examples, and their labels, in order; none of those without a neighbour."""
    held = spark.sparkContext.broadcast(examples)
    schema = pa.schema([("place", pa.int64()), ("vote", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places_of(None)
        # not kept for other tasks, so that a worker never holds this index and that of the scores
        rows = held.value.rows()
        ix = Index.build(rows, held.value.weights, held.value.head)
        for b in batches(it, GROUP):
            at = b.column(0).to_pylist()
            near = ix.nearest_many([rows[i][2:] for i in at], neighbours, at)
            done = [(i, ix.vote(e, s)) for i, (e, s) in zip(at, near) if len(e)]
            yield out(schema, *zip(*done)) if done else out(schema, [], [])

    n = len(examples.ids)
    # one row an example; sorted here, for a sort in Spark would work the votes out twice
    found = (spark.range(0, n, 1, -(-n // (8 * GROUP))).mapInArrow(run, "place long, vote double")
             .toArrow().sort_by("place"))
    return found.column(1).to_numpy(), np.array(examples.labels, float)[found.column(0).to_numpy()]


def fit(docs: DataFrame, labelled: DataFrame, p: Params = Params()) -> tuple[Model, DataFrame]:
    """The model, and the ``term_vectors`` of all rows; ``labelled``: (doc_id, y) training rows."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = cut(bounded_sample(labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "y"),
                                "doc_id", p.max_examples, 11))
    # bounded by max_examples rows of two numbers
    wanted = F.broadcast(sample.withColumnRenamed("doc_id", "example"))
    examples = cut(docs.join(wanted, F.col("doc_id") == F.col("example")).select("doc_id", "text", "y"))
    vocabulary, told = select_terms(examples, p)
    found = term_vectors(docs, vocabulary)
    n, df = frequencies(found, len(vocabulary))
    idf = np.log((1 + n) / (1 + df)) + 1
    more = [bisect_left(vocabulary, t) for t in told]
    idf[more] *= p.told
    rows = sorted(vectors(examples, vocabulary), key=lambda r: (r[0], r[1], r[2].tobytes(), r[3].tobytes()))
    some, none = [r for r in rows if len(r[2])], [r for r in rows if not len(r[2])]
    base = sum(r[1] for r in rows) / len(rows) if rows else 0.0
    without = sum(r[1] for r in none) / len(none) if none else base
    if not some:
        return Model(vocabulary, set(more), None, (np.zeros(1), np.zeros(1)), without, p.neighbours), found
    kept = Examples(clustered(some, idf, p.head), idf, p.head)
    del rows, some, none
    x, y = votes(docs.sparkSession, kept, p.neighbours)
    steps = isotonic(x, y) if len(x) else (np.zeros(1), np.array([base]))
    pa.default_memory_pool().release_unused()
    return Model(vocabulary, set(more), kept, steps, without, p.neighbours), found


def score(vectors_: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, evidence, terms) for every row of ``term_vectors``; ``terms``: its label-dependent ones."""
    held = vectors_.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("evidence", pa.list_(pa.int64())),
                        ("terms", pa.list_(pa.string()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places_of(None)
        m = held.value
        told = np.zeros(len(m.vocabulary), bool)
        told[list(m.told)] = True
        for b in batches(it):
            found = [_unpacked(x) for x in b.column(1).to_pylist()]
            done = m.score(found)
            yield out(schema, b.column(0), [x for x, _ in done], [near for _, near in done],
                      [[m.vocabulary[i] for i in ids[told[ids]]] for ids, _ in found])

    return (vectors_.select("doc_id", "found")
            .mapInArrow(run, "doc_id long, score double, evidence array<long>, terms array<string>"))


def training_rows(labels: DataFrame, column: str, held_out: Column) -> DataFrame:
    """(doc_id, y): one row a labelled document that isn't held out."""
    return (labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out)
            .groupBy("doc_id").agg(F.max(column).cast("int").alias("y")))


def keep(docs: DataFrame, labels: DataFrame, held_out: Column, p: Params = Params(), most: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``most``, all columns unchanged."""
    model, _ = fit(docs, training_rows(labels, "toxic", held_out), p)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        places = places_of(m.vocabulary)
        for b in batches(it):
            low = [x < most for x, _ in m.score(list(found_terms(texts(b.column(at)), places)))]
            yield b.filter(pa.array(low, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, p: Params = Params()) -> DataFrame:
    """Score every row of ``docs``; learn from ``labels.toxic`` where not ``held_out``."""
    model, vectors_ = fit(docs, training_rows(labels, "toxic", held_out), p)
    return score(vectors_, model)
