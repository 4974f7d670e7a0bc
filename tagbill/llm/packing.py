"""Packing into optimal length buckets and token-budget batches.

Documents longer than ``max_length`` become pieces of at most that length, so the
global histogram of lengths, rounded up to ``multiple``, has a fixed number of cells.
Over it a dynamic program chooses at most ``buckets`` padded lengths that make the
total padding smallest (exactly, among lengths that are multiples of ``multiple``).
A batch of a bucket holds as many sequences as the token budget allows at that padded
length; sequences are numbered across the whole bucket, so only its last batch is
short. Numbering is distributed: a bucket is dealt into shards by a row hash, ranks
within a shard are offset by the sizes of the shards before it.

Lengths are words by default (``[^\\x20\\x09-\\x0D]+``); pass an expression of a token
count to pack by tokens.

Defined results. Null or empty text: one piece of length 0 in the smallest bucket.
Ties in length go by doc_id, then in the order read. Repeated rows are packed as often
as they came in; a null doc_id is packed and stays null. Empty table: no rows. Other
columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagbill.llm.common import cut, prepare

SHARD_ROWS = 100_000


@dataclass(frozen=True)
class Params:
    max_length: int = 4096
    multiple: int = 8
    buckets: int = 16
    budget: int = 65536


def word_count(text: Column) -> Column:
    parts = F.split(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+")
    return F.size(F.array_remove(parts, "")).cast("long")


def optimal_buckets(lengths: list[int], counts: list[int], k: int) -> list[int]:
    """At most k of the sorted ``lengths`` to pad to, the largest among them, of least padding."""
    if not lengths:
        return []
    q = np.asarray(lengths, np.int64)
    upto = np.concatenate(([0], np.cumsum(np.asarray(counts, np.int64))))
    n = len(q)
    # best[j]: least padded total of the j shortest lengths; a bucket over i..j-1 pads all to q[j-1]
    best = np.concatenate(([0], q * upto[1:]))
    came = [np.zeros(n + 1, np.int64)]
    for _ in range(min(k, n) - 1):
        nxt, origin = best.copy(), np.arange(n + 1) * 0 - 1
        for j in range(1, n + 1):
            total = best[:j] + q[j - 1] * (upto[j] - upto[:j])
            i = int(total.argmin())
            if total[i] < best[j]:
                nxt[j], origin[j] = total[i], i
        came.append(origin)
        best = nxt
    found, j, level = [], n, len(came) - 1
    while j > 0:
        while level > 0 and came[level][j] < 0:
            level -= 1
        found.append(int(q[j - 1]))
        j = int(came[level][j])
        level = max(level - 1, 0)
    return found[::-1]


def pack(docs: DataFrame, p: Params = Params(), length: Column | None = None) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bucket, batch, slot): one row a piece.

    ``bucket`` is the padded length; ``batch`` counts from 0 in each bucket.
    """
    prepare(docs.sparkSession)
    length = word_count(F.col("text")) if length is None else length
    whole = docs.select("doc_id", F.greatest(length, F.lit(0)).alias("n"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0).cast("long")),
                        F.lit(p.max_length).cast("long"))
    pieces = cut(whole.select("doc_id", "n", F.posexplode(starts).alias("piece", "start"))
                 .select("doc_id", "piece", "start",
                         F.least(F.col("n") - F.col("start"), F.lit(p.max_length)).alias("n_tokens"),
                         F.monotonically_increasing_id().alias("row")))
    padded = F.ceil(F.greatest("n_tokens", F.lit(1)) / F.lit(p.multiple)) * p.multiple
    seen = sorted((int(r.q), r.n) for r in pieces.groupBy(padded.alias("q")).agg(F.count("*").alias("n")).collect())
    bounds = optimal_buckets([q for q, _ in seen], [n for _, n in seen], p.buckets) or [p.multiple]
    rows = [sum(n for q, n in seen if lo < q <= hi) for lo, hi in zip([0, *bounds], bounds)]

    def by_bound(values: list[int]) -> Column:
        pick = F.lit(values[-1])
        for b, v in reversed(list(zip(bounds[:-1], values[:-1]))):
            pick = F.when(F.col("n_tokens") <= b, F.lit(v)).otherwise(pick)
        return pick

    shards = by_bound([max(1, -(-n // SHARD_ROWS)) for n in rows])
    dealt = pieces.select("*", by_bound(bounds).cast("int").alias("bucket"),
                          F.pmod(F.xxhash64("row"), shards).cast("int").alias("shard"))
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
               .select(F.col("bucket").alias("b"), F.col("shard").alias("s"),
                       F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    ranks = Window.partitionBy("bucket", "shard").orderBy(F.desc("n_tokens"), "doc_id", "row")
    numbered = (dealt.withColumn("rank", F.row_number().over(ranks))
                .join(offsets, (F.col("bucket") == F.col("b")) & (F.col("shard") == F.col("s")))
                .withColumn("place", F.col("offset") + F.col("rank") - 1))
    fits = F.greatest(F.floor(F.lit(p.budget) / F.col("bucket")), F.lit(1)).cast("long")
    return numbered.select("doc_id", "piece", "start", "n_tokens", "bucket",
                           F.floor(F.col("place") / fits).cast("long").alias("batch"),
                           (F.col("place") % fits).cast("int").alias("slot"))
