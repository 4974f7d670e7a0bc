"""Secret scans: known shapes, and a randomness test battery for what has no shape.

Known shapes are assignments of passwords, tokens and keys, access keys and long hex
runs. Beside them every run of 16 or more key characters outside these spans is
tested ('=' ends a run, so a value after ``NAME=`` is one of its own; a run that mixes
base64 and base64url is tested in its parts between separators) if its characters look like an encoding (decimal, hex, base32, base36, base64,
base64url: letters alone are no encoding) and if it carries at least 64 bits:
chi-squared uniformity over the encoding's alphabet, a runs test about the middle of
the alphabet and a lag-1 serial correlation, combined by Fisher's method. The p-value
is uniform for a random key and near 0 for text.

False discoveries, by length: all documents' p-values are counted by encoding, length
class and bin. In each such stratum the flat part of the histogram (p > 1/2) estimates
how many strings are random; the cut is the smallest p-value at which at most
``fdr`` of the strings above it are estimated not to be. A stratum of under
``least_tested`` strings uses its encoding's histogram, or all; if these are no
larger, the cut is 0.01. The counts have a fixed number of cells, whatever the input.

Defined results. Null or empty text: no spans, digest of the empty string. Spans are
in code points, end exclusive; ties in start go by kind in the order of ``KINDS``.
Repeated rows are scanned alike (each counts in the histograms). A null doc_id stays
null. Empty table: no rows. ``scan`` returns only its own columns; ``mask`` returns
the input's columns with its spans replaced in ``text``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagbill.llm.common import batches, cut, out, prepare, texts

KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Key characters; an '=' ends a run, and two at most pad it.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}|[A-Za-z0-9+/_-]{15}(?==(?![A-Za-z0-9+/_=-]))"
                  r"|[A-Za-z0-9+/_-]{14}(?===(?![A-Za-z0-9+/_=-])))")
_PARTS = (re.compile("[^/+]+"), re.compile("[^_-]+"))

# Alphabets, in the order of their digits.
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {
    "decimal": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_PLACE = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}
#: Upper ends of the length classes.
LENGTHS = (19, 23, 31, 39, 63, 127, 255)
BINS = 200
LEAST_BITS = 64


@dataclass(frozen=True)
class Params:
    #: Largest estimated share of non-random strings among those flagged.
    fdr: float = 0.05
    least_tested: int = 50


def encoding(run: str) -> str | None:
    """The smallest alphabet a run fits, if its mix of characters tells of an encoding."""
    low, up, digit = (any(a <= c <= b for c in run) for a, b in (("a", "z"), ("A", "Z"), ("0", "9")))
    if not digit:
        return None
    if not low and not up:
        return "decimal" if run.isdigit() else None
    for name, wants in (("hex", low), ("base32", up and not low), ("base36", low and not up),
                        ("base64", low and up), ("base64url", low and up)):
        if wants and all(c in _PLACE[name] for c in run):
            return name
    return None


def parts(run: str) -> list[tuple[int, str]]:
    """(start, text): the run, or if it mixes base64 and base64url, its parts between separators.

    A mixed run is split at the separators of one of the two, whichever leaves the longer key.
    """
    if not (("/" in run or "+" in run) and ("-" in run or "_" in run)):
        return [(0, run)]
    splits = [[(m.start(), m.group()) for m in c.finditer(run) if len(m.group()) >= 16 and encoding(m.group())]
              for c in _PARTS]
    return max(splits, key=lambda s: max((len(t) for _, t in s), default=0))


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(run: str, name: str) -> float:
    """Fisher's p-value of the three tests against 'independent uniform characters'."""
    k = len(ALPHABETS[name])
    x = np.fromiter((_PLACE[name][c] for c in run), np.float64, len(run))
    n = len(x)
    bins = max(2, min(k, n // 5))
    expected = np.bincount(np.arange(k) * bins // k, minlength=bins) * (n / k)
    seen = np.bincount(x.astype(int) * bins // k, minlength=bins)
    chi, free = float(((seen - expected) ** 2 / expected).sum()), bins - 1
    cube = (chi / free) ** (1 / 3)                        # Wilson and Hilferty
    uniform = 0.5 * math.erfc((cube - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)) / math.sqrt(2))
    high = x >= k / 2
    n1 = int(high.sum())
    n0 = n - n1
    if n1 and n0:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * n1 * n0 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        by_runs = _normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        by_runs = 2.0 ** (1 - n)
    d = x - x.mean()
    power = float(d @ d)
    serial = _normal_tail((float(d[1:] @ d[:-1]) / power + 1 / n) * math.sqrt(n)) if power > 0 else 0.0
    half = -sum(math.log(max(p, 1e-300)) for p in (uniform, by_runs, serial))
    return math.exp(-half) * (1 + half + half * half / 2)      # chi-squared with 6 degrees


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str, int, float]]]:
    """(base spans as (start, kind, end), tested runs as (start, end, encoding, length class, p))."""
    base = []
    if ":" in text or "=" in text:
        base += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base.sort()
    tested = []
    for m in _RUN.finditer(text):
        for start, run in parts(m.group()):
            name = encoding(run)
            a, b = m.start() + start, m.start() + start + len(run)
            if name is None or len(run) * math.log2(len(ALPHABETS[name])) < LEAST_BITS:
                continue
            if any(s < b and a < e for s, _, e in base):
                continue
            size = int(np.searchsorted(LENGTHS, len(run)))
            tested.append((a, b, name, size, battery(run, name)))
    return base, tested


_FOUND = ("doc_id long, base array<struct<start:int,kind:int,end:int>>, "
          "tested array<struct<start:int,end:int,encoding:string,size:int,p:double>>")
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()),
    ("base", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))),
    ("tested", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()),
                                   ("size", pa.int32()), ("p", pa.float64())])))])


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, base, tested) for every row, in one pass over the texts."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            found = [find(t) for t in texts(b.column(1))]
            yield out(_SCHEMA, b.column(0),
                      [[dict(zip(("start", "kind", "end"), s)) for s in x] for x, _ in found],
                      [[dict(zip(("start", "end", "encoding", "size", "p"), s)) for s in x] for _, x in found])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, _FOUND))


def cuts(found: DataFrame, p: Params = Params()) -> dict[tuple[str, int], float]:
    """The smallest p-value flagged, for each encoding and length class, from all documents."""
    t = found.select(F.explode("tested").alias("t")).select("t.*")
    rows = (t.groupBy("encoding", "size", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).alias("bin"))
            .agg(F.count("*").alias("n")).collect())          # at most 6 * 8 * 200 rows
    every = np.zeros(BINS)
    by: dict[str, np.ndarray] = {}
    strata: dict[tuple[str, int], np.ndarray] = {}
    for r in rows:
        for h in (every, by.setdefault(r.encoding, np.zeros(BINS)),
                  strata.setdefault((r.encoding, r.size), np.zeros(BINS))):
            h[r.bin] += r.n
    return {k: _cut(next((h for h in (v, by[k[0]], every) if h.sum() >= p.least_tested), None), p.fdr)
            for k, v in strata.items()}


def _cut(histogram: np.ndarray | None, fdr: float) -> float:
    if histogram is None:
        return 0.01
    above = np.cumsum(histogram[::-1])[::-1]                  # strings at or above each bin
    random = 2 * histogram[BINS // 2:].sum() * (1 - np.arange(BINS) / BINS)
    ok = np.flatnonzero((above > 0) & (random >= (1 - fdr) * above))
    return float(ok[0] / BINS) if len(ok) else 2.0


def _cut_of(c: Column, table: dict[tuple[str, int], float]) -> Column:
    """The cut of a tested run's stratum, as an expression over the bounded table."""
    if not table:
        return F.lit(2.0)
    pairs = [x for (name, size), v in sorted(table.items()) for x in (F.lit(f"{name} {size}"), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.concat_ws(" ", c["encoding"], c["size"])), F.lit(2.0))


def scan(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, base, added) for every row: arrays of (start, kind, end), in order."""
    prepare(docs.sparkSession)
    found = cut(candidates(docs))
    table = cuts(found, p)
    flagged = F.filter("tested", lambda c: c["p"] >= _cut_of(c, table))
    added = F.transform(flagged, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return found.select("doc_id", "base", added.alias("added"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, by start and then kind, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def mask(docs: DataFrame, p: Params = Params(), placeholder: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced, and ``n_chars`` kept true."""
    prepare(docs.sparkSession)
    table = cuts(cut(candidates(docs)), p)
    names = docs.columns

    def clean(text: str) -> str:
        base, tested = find(text)
        spans = sorted([(s, e) for s, _, e in base]
                       + [(s, e) for s, e, name, size, q in tested if q >= table.get((name, size), 2.0)])
        parts, at = [], 0
        for s, e in spans:
            if s >= at:
                parts += [text[at:s], placeholder]
            at = max(at, e)
        return "".join([*parts, text[at:]]) if spans else text

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            at = names.index("text")
            new = [None if t is None else clean(t) for t in b.column(at).to_pylist()]
            b = b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
            if "n_chars" in names:
                at = names.index("n_chars")
                b = b.set_column(at, b.schema.field(at), pa.array([None if t is None else len(t) for t in new],
                                                                  b.schema.field(at).type))
            yield b

    return docs.mapInArrow(run, docs.schema)
