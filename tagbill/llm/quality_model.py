"""Quality classifier: random Fourier features over document statistics.

Statistics of a text (lengths, character classes, word and line repetition) come from
one pass and are standardised by mean and deviation over all documents. Random Fourier
features approximate a Gaussian kernel over them; ridge regression on the features has
a closed form, whose normal equations are sums over rows: each task adds up its own
part and the parts are added by cell. Isotonic regression of the training labels on
the fitted values, by score bins, makes the output a probability.

The training rows are a bounded sample of the labelled ones (``max_examples``); the
equations have (features + 1)^2 cells whatever the input.

Defined results. Null or empty text: all statistics 0, scored like any other. No
labelled training row: 0.5 for every row; labels of one kind only: that kind's share.
Repeated rows score alike; repeated or contradicting labels of a doc_id count as its
largest. A row without doc_id is scored and never trained on. Empty table: no rows.
Other columns are ignored.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagbill.llm.common import batches, bounded_sample, cut, out, prepare, texts

NAMES = ("chars", "words", "word_length", "distinct_words", "adjacent_repeats", "upper", "digits", "exclamations",
         "symbols", "bars", "punctuation", "spaces", "other", "lines", "duplicate_lines")


@dataclass(frozen=True)
class Params:
    #: Bound of the labelled sample that the classifier is fitted on.
    max_examples: int = 50_000
    features: int = 256
    #: Width of the Gaussian kernel, in deviations.
    width: float = 3.0
    ridge: float = 1e-3
    bins: int = 512
    seed: int = 5


def _classes() -> np.ndarray:
    """Class of each code point below 0x3000: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 '!', 6 symbol, 7 '|', 8 punctuation."""
    table = np.zeros(0x3000, np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        table[c] = (7 if ch == "|" else 5 if ch == "!" else 6 if ch in "#*$%&<>" else 4 if ch.isspace() else
                    3 if ch.isdigit() else 2 if ch.isupper() else 1 if ch.isalpha() else 8 if 32 < c < 127 else 0)
    return table


_CLASS = _classes()


def statistics(text: str) -> list[float]:
    """The values of ``NAMES`` for one text."""
    if not text:
        return [0.0] * len(NAMES)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    kinds = np.bincount(_CLASS[np.minimum(code, len(_CLASS) - 1)], minlength=9) / n
    words = text.split()
    w = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    same = sum(map(operator.eq, words, words[1:]))
    return [np.log1p(n), np.log1p(w), np.log1p(n / (w + 1)), np.log1p(len(set(words))) / np.log1p(w) if w else 0.0,
            same / w if w else 0.0, kinds[2], kinds[3], kinds[5], kinds[6], kinds[7], kinds[8], kinds[4], kinds[0],
            np.log1p(w / (len(lines) + 1)), 1 - len(set(lines)) / len(lines) if lines else 0.0]


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for every row, x the statistics."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            yield out(schema, b.column(0), [statistics(t) for t in texts(b.column(1))])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, x array<double>"))


@dataclass
class Model:
    mean: np.ndarray
    deviation: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    beta: np.ndarray
    low: float
    high: float
    calibrated: np.ndarray                 # probability of each bin of fitted values

    def phi(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        f = np.sqrt(2 / len(self.shift)) * np.cos(z @ self.turn + self.shift)
        return np.column_stack([f, np.ones(len(x))])

    def bins(self, x: np.ndarray) -> np.ndarray:
        at = (self.phi(x) @ self.beta - self.low) / (self.high - self.low) * len(self.calibrated)
        return np.clip(at.astype(np.int64), 0, len(self.calibrated) - 1)


def _rows(b: pa.RecordBatch, column: int) -> np.ndarray:
    return np.asarray(b.column(column).flatten()).reshape(b.num_rows, len(NAMES))


def pooled(good: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Non-decreasing least-squares fit to the shares good / all of ordered bins; empty bins follow the one before."""
    pools: list[list[float]] = []                          # good, all, bins
    for g, n in zip(good, all_):
        pools.append([float(g), float(n), 1])
        while len(pools) > 1 and (pools[-1][1] == 0 or pools[-2][1] == 0
                                  or pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]):
            g2, n2, k2 = pools.pop()
            pools[-1] = [pools[-1][0] + g2, pools[-1][1] + n2, pools[-1][2] + k2]
    return np.concatenate([np.full(int(k), g / n if n else 0.5) for g, n, k in pools])


def fit(x: DataFrame, labelled: DataFrame, p: Params = Params()) -> Model | float:
    """The model, or a constant score; ``x`` from ``measured``, ``labelled``: (doc_id, y) training rows."""
    each = x.select([F.get("x", F.lit(i)).alias(n) for i, n in enumerate(NAMES)])
    moments = each.agg(*[f(n).alias(f"{n} {f.__name__}") for n in NAMES for f in (F.avg, F.stddev_pop)]).first()
    sample = cut(x.join(bounded_sample(labelled.select(F.col("doc_id").alias("known"), "y"), "known", p.max_examples, 13),
                        F.col("doc_id") == F.col("known")).select("x", F.col("y").cast("double").alias("y")))
    n, good = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not n or good in (0, n):
        return good / n if n else 0.5
    mean = np.array([moments[f"{c} avg"] for c in NAMES])
    deviation = np.maximum(np.array([moments[f"{c} stddev_pop"] for c in NAMES]), 1e-6)
    rng = np.random.Generator(np.random.PCG64(p.seed))
    model = Model(mean, deviation, rng.normal(0, 1 / p.width, (len(NAMES), p.features)),
                  rng.uniform(0, 2 * np.pi, p.features), np.zeros(p.features + 1), -0.5, 1.5, np.zeros(p.bins))
    size = p.features + 1
    row, col = np.triu_indices(size)
    cells = pa.schema([("cell", pa.int32()), ("v", pa.float64())])

    def equations(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, c, any_ = np.zeros((size, size)), np.zeros(size), False
        for b in batches(it, 8192):
            f = model.phi(_rows(b, 0))
            a += f.T @ f
            c += f.T @ np.asarray(b.column(1))
            any_ = True
        if any_:
            yield out(cells, np.arange(len(row) + size), np.concatenate([a[row, col], c]))

    # The sample is bounded, and so are its tasks: each sends one row a cell.
    few = sample.coalesce(8)
    sums = np.zeros(len(row) + size)
    for r in few.mapInArrow(equations, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        sums[r.cell] = r.v
    a = np.zeros((size, size))
    a[row, col] = sums[:len(row)]
    a = a + np.triu(a, 1).T
    model.beta = np.linalg.solve(a + p.ridge * n * np.eye(size) / size, sums[len(row):])
    tally = pa.schema([("bin", pa.int64()), ("n", pa.int64()), ("good", pa.float64())])

    def binned(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 8192):
            at = model.bins(_rows(b, 0))
            yield out(tally, np.arange(p.bins), np.bincount(at, minlength=p.bins),
                      np.bincount(at, np.asarray(b.column(1)), p.bins))

    good_in, all_in = np.zeros(p.bins), np.zeros(p.bins)
    for r in (few.mapInArrow(binned, "bin long, n long, good double").groupBy("bin")
              .agg(F.sum("n").alias("n"), F.sum("good").alias("good")).collect()):
        good_in[r.bin], all_in[r.bin] = r.good, r.n
    model.calibrated = pooled(good_in, all_in)
    return model


def score(x: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, score) for every row of statistics."""
    if isinstance(model, float):
        return x.select("doc_id", F.lit(model).alias("score"))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    held = x.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches(it, 8192):
            yield out(schema, b.column(0), m.calibrated[m.bins(_rows(b, 1))])

    return x.mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, held_out: Column, p: Params = Params()) -> DataFrame:
    """Score every row of ``docs``; learn from ``labels.quality`` where not ``held_out``."""
    prepare(docs.sparkSession)
    x = cut(measured(docs))
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out)
             .groupBy("doc_id").agg(F.max("quality").cast("int").alias("y")))
    return score(x, fit(x, known, p))
