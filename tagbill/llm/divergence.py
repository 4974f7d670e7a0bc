"""Source divergence audit: how the sources of a language differ in their use of words.

Terms are found by iceberg prefix refinement. A term is read as its bytes and a final
zero byte. Level by level, a pass over the texts counts for each language in how many
documents a prefix of that many bytes occurs; a prefix below the threshold goes, with all
terms that begin with it (none of them can be in more documents than their prefix), and
only the others are extended at the next level. A prefix that ends with the zero byte is a
complete term, and its count is exact; refinement ends when no longer prefix is left, which
a text of any length allows, as levels grow by half. A document is counted by one task, so
counts add up, and each task sums its own before the shuffle. What is left after a level
reaches the next one as a bitmap of ``FILTER_BITS`` bits by hash, a size that doesn't depend
on the input: a prefix that passes by a clash is counted once more and then decided by its
own count.

One more pass counts the kept terms for each (lang, source) group; rows travel as one row
for each language, term and stretch of a task, and are merged in order of the term. With
``n`` occurrences of a term in a group and N of all kept terms, p = 1 + floor(10^9 (n + 2) /
(N + 2 V)), V being the kept terms of the language, and q the same for the whole language. The
divergence of two shares is floor((p - q)^2 / (p + q)). All arithmetic is in integers.

Defined results. Null text, lang and source are ''. Every row is a document of its own,
repeated rows as well. Every group that occurs has its rows; a language of one source has
no pairs; without kept terms every pair has the value 0. Ties of values go by the item's
UTF-8 bytes. Empty table: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagbill.llm.common import cut, prepare

#: Bytes of the prefixes of each level; beyond the last, each level is half as long again.
LEVELS = (6, 11, 18)
FILTER_BITS = 1 << 26
#: Bytes of text that a task reads at once.
STRETCH = 12 << 20
#: Prefix counts that a task holds before it sends them on.
HELD = 1 << 20
#: A table of groups up to this many bytes is broadcast to the texts; a larger one is joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: Kept terms that one task compares over all sources of a language.
SLICE = 1 << 14

#: Bytes of terms, A-Z lowered; 0 ends a term.
_TERM = np.zeros(256, np.uint8)
_TERM[0x80:] = np.arange(0x80, 0x100)
_TERM[0x61:0x7B] = np.arange(0x61, 0x7B)
_TERM[0x41:0x5B] = np.arange(0x61, 0x7B)


# ---- terms of a stretch of documents --------------------------------------

class Stretch:
    """The terms of some documents: for each token its document and its place in ``terms``.

    Terms that have ``last`` bytes or fewer, the zero byte included, are left out before anything is built from them.
    """

    def __init__(self, texts: list[bytes], last: int = 0) -> None:
        data = _TERM[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        inside = data != 0
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate(([0], edge))
        starts, ends = edge[::2], edge[1::2]         # the last byte is never inside
        sizes = ends - starts + 1                    # the zero byte behind each term goes along
        if last:
            longer = sizes > last
            starts, sizes = starts[longer], sizes[longer]
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        # documents have many terms each: their borders are looked up, not the terms
        self.doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, begins)))
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        if last:
            values = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
        else:
            inside[ends] = True
            values = data[inside]
        kind, width = (pa.binary(), np.int32) if len(values) < 2**31 - 1 else (pa.large_binary(), np.int64)
        tokens = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(values)])
        coded = tokens.dictionary_encode()
        self.term, self.terms = np.asarray(coded.indices).astype(np.int64), coded.dictionary


def stretches(it: Iterator[pa.RecordBatch], size: int = STRETCH) -> Iterator[tuple[list[bytes], list[list]]]:
    """Texts of about ``size`` bytes, with the batches' other columns."""
    texts, others, held = [], None, 0
    for batch in it:
        first, *rest = [c.to_pylist() for c in batch.columns]
        others = [[] for _ in rest] if others is None else others
        texts += first
        for have, more in zip(others, rest):
            have += more
        held += sum(map(len, first))
        if held >= size:
            yield texts, others
            texts, others, held = [], None, 0
    if texts:
        yield texts, others


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values in order, each once, and how often each occurs (by a sort; ``np.unique`` hashes, far slower here)."""
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.concatenate((first, [len(values)])))


def _numbered(values: list[str]) -> tuple[np.ndarray, list[str]]:
    coded = pa.array(values, pa.string()).dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()


# ---- the bitmap of what is left ------------------------------------------

def _spot(lang: str, prefix: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + b"\0" + prefix) % FILTER_BITS


def left_over(found: DataFrame) -> np.ndarray:
    """Bitmap of (lang, prefix) rows: ``FILTER_BITS`` bits, whatever the number of rows."""
    schema = pa.schema([("word", pa.int32()), ("bits", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            spots = np.array([_spot(x, p) for x, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], np.int64)
            if len(spots):
                bits = (np.uint64(1) << (spots & 63).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((spots >> 6).astype(np.int32)), pa.array(bits)], schema=schema)

    words = (found.select("lang", "prefix").mapInArrow(run, "word int, bits long")
             .groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow())
    filled = np.zeros(FILTER_BITS >> 6, np.int64)
    filled[words["word"].to_numpy()] = words["bits"].to_numpy()
    return filled


def _passes(filled: np.ndarray, langs: list[str], lang: np.ndarray, prefixes: pa.Array, prefix: np.ndarray) -> np.ndarray:
    """For each (lang, prefix), given by their places, whether the bitmap has it; each distinct pair is looked up once."""
    pair, names = lang * len(prefixes) + prefix, prefixes.to_pylist()
    if len(langs) * len(prefixes) <= max(1 << 22, 4 * len(pair)):
        seen = np.zeros(len(langs) * len(prefixes), bool)
        seen[pair] = True
        distinct = np.flatnonzero(seen)
        place = None
    else:
        distinct, _ = _distinct(pair)
        place = np.searchsorted(distinct, pair)
    heads = [x.encode() + b"\0" for x in langs]
    digest = xxhash.xxh64_intdigest
    spots = np.array([digest(heads[x] + names[p]) % FILTER_BITS
                      for x, p in zip((distinct // len(names)).tolist(), (distinct % len(names)).tolist())], np.int64)
    found = (filled[spots >> 6] >> (spots & 63)) & 1 == 1
    if place is not None:
        return found[place]
    seen[distinct] = found
    return seen[pair]


def _prefixes(terms: pa.Array, size: int) -> tuple[np.ndarray, pa.Array]:
    coded = pc.binary_slice(terms, 0, size).dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary


# ---- refinement -----------------------------------------------------------

def _counted(rows: list[pa.Table]) -> list[pa.Table]:
    return [pa.concat_tables(rows).group_by(["lang", "prefix"]).aggregate([("n", "sum")]).rename_columns(["lang", "prefix", "n"])]


def prefix_counts(docs: DataFrame, size: int, last: int, filled: np.ndarray | None) -> DataFrame:
    """(lang, prefix, n): documents of each prefix of ``size`` bytes whose first ``last`` bytes are left.

    Terms that were complete within ``last`` bytes are decided and take no part.
    """
    schema = pa.schema([("lang", pa.string()), ("prefix", pa.binary()), ("n", pa.int64())])
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for texts, (names,) in stretches(it):
            s = Stretch(texts, last)
            if not len(s.terms):
                continue
            lang, langs = _numbered(names)
            doc, term = s.doc, s.term
            if last:
                of, prefixes = _prefixes(s.terms, last)
                alive = _passes(shared.value, langs, lang[doc], prefixes, of[term])
                doc, term = doc[alive], term[alive]
            of, prefixes = _prefixes(s.terms, size)
            pairs, _ = _distinct(doc * len(prefixes) + of[term])
            pair, n = _distinct(lang[pairs // len(prefixes)] * len(prefixes) + pairs % len(prefixes))
            held.append(pa.table([pa.array(langs, pa.string()).take(pa.array(pair // len(prefixes))),
                                  prefixes.take(pa.array(pair % len(prefixes))).cast(pa.binary()), pa.array(n, pa.int64())], schema=schema))
            if sum(t.num_rows for t in held) > HELD:
                held = _counted(held)
                if held[0].num_rows > HELD // 2:
                    yield from held[0].to_batches()
                    held = []
        if held:
            yield from _counted(held)[0].to_batches()

    return (docs.select("text", "lang").mapInArrow(run, "lang string, prefix binary, n long")
            .groupBy("lang", "prefix").agg(F.sum("n").alias("n")))


def next_level(size: int, levels: tuple[int, ...]) -> int:
    return next((k for k in levels if k > size), size + size // 2 + 1)


def kept_terms(docs: DataFrame, least: int = 10, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(lang, prefix, n): the complete terms in at least ``least`` documents of their language."""
    found: list[DataFrame] = []
    filled, last = None, 0
    complete = F.substring("prefix", -1, 1) == F.lit(b"\0")
    while True:
        size = next_level(last, levels)
        level = cut(prefix_counts(docs, size, last, filled).filter(F.col("n") >= least))
        found.append(level.filter(complete))
        longer = level.filter(~complete)
        if longer.isEmpty():
            break
        filled, last = left_over(longer), size
    kept = found[0]
    for more in found[1:]:
        kept = kept.unionByName(more)
    return kept


# ---- counts of the kept terms --------------------------------------------

_COUNTS = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("groups", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
_COUNTS_DDL = "lang string, term binary, groups array<long>, counts array<long>"


def _listed(run: np.ndarray, group: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """First place of each run, and its groups and counts as lists; rows are in order of run and group."""
    first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))) if len(run) else np.zeros(0, np.int64)
    offsets = pa.array(np.concatenate((first, [len(run)])).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (group, n)]
    return first, *lists


def _stretch_counts(docs: DataFrame, filled: np.ndarray) -> DataFrame:
    """One row for each stretch, language and term that the bitmap has: its counts in each group."""
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, (names, groups) in stretches(it):
            s = Stretch(texts)
            if not len(s.terms):
                continue
            lang, langs = _numbered(names)
            alive = _passes(shared.value, langs, lang[s.doc], s.terms, s.term)
            doc, term = s.doc[alive], s.term[alive]
            ids, group = np.unique(np.array(groups, np.int64), return_inverse=True)
            key, n = _distinct((lang[doc] * len(s.terms) + term) * len(ids) + group[doc])
            first, gs, ns = _listed(key // len(ids), ids[key % len(ids)], n)
            pair = (key // len(ids))[first]
            rows = pa.table([pa.array(langs, pa.string()).take(pa.array(pair // len(s.terms))),
                             s.terms.take(pa.array(pair % len(s.terms))).cast(pa.binary()), gs, ns], schema=_COUNTS)
            yield from rows.to_batches(max_chunksize=1 << 14)

    return docs.select("text", "lang", "group").mapInArrow(run, _COUNTS_DDL)


def _merged(rows: pa.Table) -> pa.Table:
    """One row a (lang, term) of rows that come in order of these."""
    rows = rows.combine_chunks()
    lang, term = (np.asarray(c.combine_chunks().dictionary_encode().indices) for c in (rows["lang"], rows["term"]))
    change = np.concatenate(([True], (lang[1:] != lang[:-1]) | (term[1:] != term[:-1])))
    groups, counts = rows["groups"].combine_chunks(), rows["counts"].combine_chunks()
    run = np.repeat(np.cumsum(change) - 1, np.asarray(pc.list_value_length(groups)))
    group, n = np.asarray(groups.flatten()), np.asarray(counts.flatten())
    order = np.lexsort((group, run))
    run, group, n = run[order], group[order], n[order]
    same = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | (group[1:] != group[:-1]))))
    _, gs, ns = _listed(run[same], group[same], np.add.reduceat(n, same))
    heads = pa.array(np.flatnonzero(change))
    return pa.table([rows["lang"].take(heads), rows["term"].take(heads), gs, ns], schema=_COUNTS)


def _merge_in_order(it: Iterator[pa.RecordBatch], most: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in it:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]).cast(_COUNTS))
        n += batch.num_rows
        if n >= most:                                # the last term may go on, so it stays, as one row
            rows = _merged(pa.concat_tables(held))
            yield from rows.slice(0, rows.num_rows - 1).combine_chunks().to_batches()
            held, n = [rows.slice(rows.num_rows - 1)], 1
    if held:
        yield from _merged(pa.concat_tables(held)).to_batches()


def term_counts(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, term, groups, counts) for every kept term; ``docs`` has text, lang and group, ``kept`` lang and prefix."""
    rows = (_stretch_counts(docs, left_over(kept)).repartition("lang", "term").sortWithinPartitions("lang", "term")
            .mapInArrow(_merge_in_order, _COUNTS_DDL))
    whole = kept.select(F.col("lang").alias("of"), F.col("prefix").alias("whole"))
    # the bitmap lets other terms through: the exact list decides
    return rows.join(whole, (F.col("lang") == F.col("of")) & (F.col("term") == F.col("whole")), "left_semi")


# ---- shares and divergence ------------------------------------------------

#: 10^9 in two factors, so that products stay in 64 bits.
_SCALE = (32_000, 31_250)


def scaled(n: np.ndarray, total: int) -> np.ndarray:
    """floor(10^9 n / total), exactly, for 0 <= n <= total."""
    if total > (2**63 - 1) // _SCALE[0]:
        return np.array([_SCALE[0] * _SCALE[1] * int(x) // total for x in n.ravel()], np.int64).reshape(n.shape)
    whole, rest = np.divmod(n * _SCALE[0], total)
    return whole * _SCALE[1] + rest * _SCALE[1] // total


def _share(n: Column, total: Column) -> Column:
    return F.lit(1) + F.call_function("div", (n + 2).cast("decimal(38,0)") * F.lit(1_000_000_000), total.cast("decimal(38,0)"))


def _pair_sums(slice_: pa.Table, groups: pa.Table) -> pa.Table:
    """Summed divergence of every two groups of a language over one slice of its terms."""
    groups = groups.sort_by("group")
    ids, totals = groups["group"].to_numpy(), groups["total"].to_numpy()
    counts = slice_["counts"].combine_chunks()
    place = np.searchsorted(ids, np.asarray(slice_["groups"].combine_chunks().flatten()))
    row = np.repeat(np.arange(slice_.num_rows), np.asarray(pc.list_value_length(counts)))
    n = np.zeros((len(ids), slice_.num_rows), np.int64)
    n[place, row] = np.asarray(counts.flatten())
    p = np.stack([1 + scaled(x + 2, int(total)) for x, total in zip(n, totals)])
    sums = np.zeros((len(ids), len(ids)), np.int64)
    for a in range(len(ids)):
        step = max(1, (1 << 20) // max(1, slice_.num_rows))
        for b in range(a + 1, len(ids), step):
            apart, both = p[a] - p[b:b + step], p[a] + p[b:b + step]
            sums[a, b:b + step] = (apart * apart // both).sum(axis=1)
    a, b = np.triu_indices(len(ids), 1)
    return pa.table({"group": np.concatenate((ids[a], ids[b])), "other": np.concatenate((ids[b], ids[a])),
                     "value": np.concatenate((sums[a, b], sums[a, b]))})


def audit(docs: DataFrame, least: int = 10, top_terms: int = 10, levels: tuple[int, ...] = LEVELS,
          slice_terms: int = SLICE) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source of the language, part ``term``
    the terms that a source uses more than its language does, the ``top_terms`` first of each."""
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(clean("text").cast("binary").alias("text"), clean("lang").alias("lang"), clean("source").alias("source"))
    groups = cut(rows.select("lang", "source").distinct().withColumn("group", F.monotonically_increasing_id()))
    size = groups.agg(F.sum(F.octet_length("lang") + F.octet_length("source") + F.lit(48))).first()[0] or 0
    near = F.broadcast if size <= BROADCAST_BYTES else lambda df: df

    kept = cut(kept_terms(rows.select("text", "lang"), least, levels))
    named = rows.join(near(groups), ["lang", "source"]).select("text", "lang", "group")
    terms = cut(term_counts(named, kept))
    kinds = kept.groupBy("lang").agg(F.count("*").alias("kinds"))
    used = (terms.select(F.explode(F.arrays_zip("groups", "counts")).alias("x"))
            .groupBy(F.col("x.groups").alias("group")).agg(F.sum("x.counts").alias("used")))
    totals = cut(groups.join(used, "group", "left").join(kinds, "lang", "left").select(
        "lang", "source", "group", F.coalesce("kinds", F.lit(0)).alias("kinds"),
        (F.coalesce("used", F.lit(0)) + 2 * F.coalesce("kinds", F.lit(0))).alias("total")))

    # every language has slices of about slice_terms kept terms, one at least
    slices = F.greatest(F.lit(1), F.ceil(F.col("kinds") / F.lit(slice_terms))).cast("int")
    each = totals.select("lang", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), "group", "total")
    width = totals.groupBy("lang").agg(F.max(slices).alias("slices"))
    dealt = terms.join(width, "lang").select("lang", F.pmod(F.xxhash64("term"), "slices").cast("int").alias("slice"), "groups", "counts")
    pairs = (dealt.groupBy("lang", "slice").cogroup(each.groupBy("lang", "slice"))
             .applyInArrow(lambda a, b: _pair_sums(a, b), "group long, other long, value long")
             .groupBy("group", "other").agg(F.sum("value").alias("value")))
    names = totals.select(F.col("group").alias("other"), F.col("source").alias("item"))
    pairs = (pairs.join(near(names), "other").join(near(totals), "group")
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value"))

    whole = totals.groupBy("lang").agg((F.sum("total") - F.sum(2 * F.col("kinds")) + 2 * F.max("kinds")).alias("whole"))
    every = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    spread = (terms.join(near(whole), "lang")
              .select(F.col("term"), _share(every, F.col("whole")).alias("q"), F.explode(F.arrays_zip("groups", "counts")).alias("x"))
              .select("term", "q", F.col("x.groups").alias("group"), F.col("x.counts").alias("n"))
              .join(near(totals), "group").withColumn("p", _share(F.col("n"), F.col("total"))).filter(F.col("p") > F.col("q")))
    apart = F.col("p") - F.col("q")
    text = F.expr("substring(term, 1, octet_length(term) - 1)").cast("string")
    more = spread.select("lang", "source", F.lit("term").alias("part"), text.alias("item"),
                         F.call_function("div", apart * apart, F.col("p") + F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    return (pairs.withColumn("rank", rank)
            .unionByName(more.withColumn("rank", rank).filter(F.col("rank") <= top_terms)))


DUCKDB_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
w AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(used, 0) AS used, sum(coalesce(used, 0)) OVER (PARTITION BY lang) AS whole
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS used FROM c GROUP BY ALL) USING (lang, source)),
full_counts AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY lang, term) AS every, v, used, whole
  FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
shares AS (
  SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 2) // (used + 2 * v) AS p,
    1 + 1000000000::HUGEINT * (every + 2) // (whole + 2 * v) AS q
  FROM full_counts),
pairs AS (
  SELECT a.lang, a.source, b.source AS item,
    (SELECT coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) FROM shares x JOIN shares y ON x.term = y.term
     WHERE x.lang = a.lang AND y.lang = a.lang AND x.source = a.source AND y.source = b.source)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value,
  (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
(SELECT lang, source, 'term', item, value,
  (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms
 QUALIFY rank <= 10)"""
