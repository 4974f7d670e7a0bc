"""Exact top-k by exhaustive term-at-a-time accumulation.

A vector is a sparse row of integer weights, a component a term. Queries and candidates
are dealt into shards of bounded size, a cell being one shard of each; every cell holds
its candidates as postings by term (which candidates have it, with what weight). Terms
are taken one at a time: the query rows that have the term scatter its weighted postings
into dense arrays of scores. A partition selection takes each query's k best of the
cell, and the few rows of all cells are merged by rank.

The number of cells grows with candidates times queries, as an exhaustive search must;
each cell's memory is bounded by the shard sizes.

Defined results. A row takes no part if its id or vector is null or if a component is
null or not finite. Missing components of a shorter vector are 0. Equal rows count
once; rows that share an id but not a vector are candidates of their own, never of
that id's query, whose best scores they share. Ties go to the smaller id. With no more
than k candidates all are returned. Products are taken in 64-bit integers. Empty
table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagbill.llm.common import cut, out, prepare

CANDIDATES = 8192
QUERIES = 2048
#: Queries that accumulate side by side in one dense array of scores.
ROWS = 64


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, or null if any is null or not finite."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(embedding.isNotNull() & ~F.coalesce(bad, F.lit(False)),
                  F.transform(x, lambda v: F.floor(v * F.lit(scale)).cast("long")))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of integers; missing components of shorter rows are 0."""
    rows = column.combine_chunks()
    offsets = np.asarray(rows.offsets).astype(np.int64)
    offsets, values = offsets - offsets[0], np.asarray(rows.flatten()).astype(np.int64)
    sizes = np.diff(offsets)
    width = int(sizes.max()) if len(sizes) else 0
    if len(values) == width * len(sizes):
        return values.reshape(len(sizes), width)
    full = np.zeros((len(sizes), width), np.int64)
    full[np.arange(width)[None, :] < sizes[:, None]] = values
    return full


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of some query rows with all candidates, term at a time."""
    scores = np.zeros((len(queries), len(candidates)), np.int64)
    for t in range(min(queries.shape[1], candidates.shape[1])):
        posting = np.flatnonzero(candidates[:, t])
        having = np.flatnonzero(queries[:, t])
        if not len(posting) or not len(having):
            continue
        weighted = np.multiply.outer(queries[having, t], candidates[posting, t])
        if weighted.shape == scores.shape:
            scores += weighted
        else:
            scores[np.ix_(having, posting)] += weighted
    return scores


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one row of scores, ties to the smaller of the sorted ``ids``."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > kth)
        places = np.concatenate((above, np.flatnonzero(scores == kth)[:k - len(above)]))
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, candidates: int = CANDIDATES,
          queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score); ``vectors`` has vec_id and weights (array of long, null: no part)."""
    prepare(vectors.sparkSession)
    rows = cut(vectors.filter(F.col("vec_id").isNotNull() & F.col("weights").isNotNull())
               .select(F.col("vec_id").cast("long").alias("vec_id"), "weights", is_query.alias("asks")).distinct())
    n, asked = rows.agg(F.count("*"), F.coalesce(F.count_if("asks"), F.lit(0))).first()
    c_shards, q_shards = max(1, -(-n // candidates)), max(1, -(-asked // queries))
    deal = lambda seed, shards: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "weights"), F.lit(shards)).cast("int")
    every = lambda shards: F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    left = rows.select(deal(1, c_shards).alias("c"), every(q_shards).alias("q"), "vec_id", "weights")
    right = rows.filter("asks").select(deal(2, q_shards).alias("q"), every(c_shards).alias("c"), "vec_id", "weights")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def cell(cands: pa.Table, asks: pa.Table) -> pa.Table:
        found = []
        if cands.num_rows and asks.num_rows:
            cands = cands.sort_by("vec_id")
            ids, x = cands["vec_id"].to_numpy(), _matrix(cands["weights"])
            qids, y = asks["vec_id"].to_numpy(), _matrix(asks["weights"])
            for at in range(0, len(qids), ROWS):
                for q, scores in zip(qids[at:at + ROWS], accumulate(y[at:at + ROWS], x)):
                    other = np.flatnonzero(ids != q)
                    best = other[select(scores[other], ids[other], k)]
                    found.append((np.full(len(best), q), ids[best], scores[best]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else ([], [], [])
        return pa.Table.from_batches([out(schema, *columns)])

    best = (left.groupBy("c", "q").cogroup(right.groupBy("c", "q"))
            .applyInArrow(cell, "query_id long, vec_id long, score long").distinct())
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


DUCKDB_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5"""
