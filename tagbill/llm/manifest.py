"""Merkle manifest of a dataset: every row's proof by incremental witnesses.

Rows are leaves; each source's leaves, in order, form a tree of runs of ``arity``
consecutive nodes (the last run may be shorter, even one node), and the sources' roots
in order form a tree of the same kind on top. H is the lowercase hex SHA-256 of its
inputs joined, digests as their hex text.

Witnesses. Nodes are appended one after another (``Appender``). A node that joins a run
gets a partial witness, its elder siblings, which all leaves below it share; every later
sibling that completes extends the partial witnesses of the open run; a full run becomes
a node and is appended one level up. Spark appends in aligned blocks of ``arity`` to the
power ``levels`` nodes: blocks are independent, one block is never more than that many
rows, and the block roots are appended in the same way, round after round, until each
source has one root; then the sources' roots likewise. On the way down every block's
leaves take the block's own witness behind theirs. No source passes whole through a task:
places within a source come from a range partitioning and counts per partition.

Defined results. A null value is ``-`` in a leaf. Leaves go by (source, doc_id, leaf),
nulls first; rows that repeat are leaves of their own and, being equal, may change places.
The null source is a source. Empty table: no rows. Other columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagbill.llm.common import cut, prepare

ARITY = 16
#: Levels of one aligned block: it holds ``ARITY ** LEVELS`` nodes.
LEVELS = 2

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
WITNESS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
WITNESS_DDL = "array<struct<left string, right string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """H of the values: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = [v.cast("string") for v in values]
    part = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
            for t in text]
    return F.sha2(F.concat(*part).cast("binary"), 256)


def proof_text(witness: Column) -> Column:
    """All siblings of a witness, level by level, left to right."""
    return F.array_join(F.transform(witness, lambda w: F.concat(w["left"], w["right"])), "")


def fold(start: Column, witness: Column) -> Column:
    """The root that a leaf and its witness give."""
    return F.aggregate(witness, start, lambda node, w: F.sha2(F.concat(w["left"], node, w["right"]).cast("binary"), 256))


# ---- appending ------------------------------------------------------------

class Partial:
    """A witness of one level: elder siblings, and younger ones as they complete."""
    __slots__ = ("left", "right")

    def __init__(self, left: str) -> None:
        self.left, self.right = left, []

    def value(self) -> dict[str, str]:
        return {"left": self.left, "right": "".join(self.right)}


class Appender:
    """Appends nodes to ``levels`` levels of runs and keeps every node's partial witness."""

    def __init__(self, levels: int, arity: int = ARITY) -> None:
        self.levels, self.arity = levels, arity
        self.witness: list[list[Partial]] = []       # of every node appended, from the lowest level up
        #: Of each level the open run: its nodes' digests, their partial witnesses, and its first leaf.
        self.open: list[tuple[list[str], list[Partial], int]] = [([], [], 0) for _ in range(levels)]
        self.top: list[str] = []

    def append(self, node: str) -> None:
        at = len(self.witness)
        self.witness.append([])
        self._join(0, node, at, at + 1)

    def _join(self, level: int, node: str, first: int, end: int) -> None:
        if level == self.levels:
            self.top.append(node)
            return
        nodes, partial, start = self.open[level]
        if not nodes:
            self.open[level] = (nodes, partial, start := first)
        for elder in partial:
            elder.right.append(node)
        mine = Partial("".join(nodes))
        nodes.append(node)
        partial.append(mine)
        for below in range(first, end):
            self.witness[below].append(mine)
        if len(nodes) == self.arity:
            self._complete(level, end)

    def _complete(self, level: int, end: int) -> None:
        nodes, _, start = self.open[level]
        self.open[level] = ([], [], 0)
        self._join(level + 1, digest("".join(nodes)), start, end)

    def close(self) -> None:
        """Complete the shorter runs at the end."""
        for level in range(self.levels):
            if self.open[level][0]:
                self._complete(level, len(self.witness))


def levels_of(n: int, most: int, arity: int = ARITY) -> int:
    """Levels above n nodes until one is left, at most ``most``."""
    found = 0
    while n > 1 and found < most:
        n, found = -(-n // arity), found + 1
    return found


# ---- places ---------------------------------------------------------------

def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (from 0 within ``tree``, by ``order``) and ``n`` (rows of the tree)."""
    keys = ["tree", *order, "salt"]
    # equal rows may change places, so a salt lets many of them lie in several ranges
    dealt = cut(rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*keys)
                .sortWithinPartitions(*keys).drop("salt")
                .withColumn("range", F.spark_partition_id())
                .withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    runs = dealt.groupBy("tree", "range").agg(F.count("*").alias("here"), F.min("row").alias("first"))
    before = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("tree", "range", "first", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"),
                       F.sum("here").over(Window.partitionBy("tree")).alias("n"))
    return (dealt.join(runs, ["tree", "range"]).withColumn("pos", F.col("before") + F.col("row") - F.col("first"))
            .drop("range", "row", "first", "before"))


# ---- rounds ---------------------------------------------------------------

def _blocks(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / F.lit(size)).cast("long"))


def _climb(nodes: DataFrame, levels: int, arity: int) -> DataFrame:
    """(tree, pos, n, digest): the root of every aligned block as a node of the next round."""
    size = arity ** levels
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, n = None, None, 0         # the open block, its key, the leaves of its tree

        def root() -> pa.RecordBatch:
            held.close()
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(
                (*at, -(-n // size), held.top[0]), schema)], schema=schema)

        for batch in it:
            columns = [c.to_pylist() for c in batch.columns]
            for tree, block, count, node in zip(*columns):
                if at != (tree, block):
                    if held:
                        yield root()
                    held, at, n = Appender(levels_of(count, levels, arity), arity), (tree, block), count
                held.append(node)
        if held:
            yield root()

    return (_blocks(nodes, size).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
            .select("tree", "block", "n", "digest").mapInArrow(run, "tree string, pos long, n long, digest string"))


def _descend(nodes: DataFrame, above: DataFrame, levels: int, arity: int) -> DataFrame:
    """``nodes`` with their witnesses up to the root; ``above`` has (tree, pos, witness, subroot, root) of the blocks."""
    size = arity ** levels
    kept = [f for f in nodes.schema.fields]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def block(below: pa.Table, upper: pa.Table) -> pa.Table:
        below = below.sort_by("pos").drop_columns(["block"])
        appender = Appender(levels_of(below["n"][0].as_py(), levels, arity), arity)
        for node in below["digest"].to_pylist():
            appender.append(node)
        appender.close()
        rest = upper["witness"][0].as_py()
        witness = [[p.value() for p in mine] + rest for mine in appender.witness]
        same = lambda name: pa.array([upper[name][0].as_py()] * below.num_rows, pa.string())
        return (below.append_column("witness", pa.array(witness, WITNESS))
                .append_column("subroot", same("subroot")).append_column("root", same("root")))

    blocked = _blocks(nodes, size)
    upper = above.withColumnRenamed("pos", "block").select("tree", "block", "witness", "subroot", "root")
    return (blocked.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block"))
            .applyInArrow(block, f"{ddl}, witness {WITNESS_DDL}, subroot string, root string"))


def _rounds(nodes: DataFrame, levels: int, arity: int) -> list[DataFrame]:
    """The nodes of every round, from ``nodes`` to one root for each tree."""
    most = nodes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    found = [nodes]
    while most > 1:
        found.append(cut(_climb(found[-1], levels, arity)))
        most = -(-most // arity ** levels)
    return found


def manifest(leaves: DataFrame, levels: int = LEVELS, arity: int = ARITY) -> DataFrame:
    """Every leaf with its place and proof.

    ``leaves`` has source (string), key (what orders a source's leaves), digest, and any further columns but
    tree, pos, n, block, range, row, first, before, here, salt, witness, subroot and root. Added: pos and n (place
    in the source, its leaves), witness (``left`` and ``right`` siblings of each level up to the root), subroot, root.
    """
    prepare(leaves.sparkSession)
    # one key for a source, the null one first
    tree = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    base = cut(placed(cut(leaves.withColumn("tree", tree)), ["key", "digest"]))
    below = _rounds(base, levels, arity)
    subroots = below[-1].select("tree", "digest")
    sources = cut(placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"]))
    over = _rounds(sources, levels, arity)
    none = F.array().cast(WITNESS_DDL)
    known = over[-1].select("tree", "pos", none.alias("witness"), F.lit(None).cast("string").alias("subroot"),
                            F.col("digest").alias("root"))
    for nodes in reversed(over[:-1]):
        known = _descend(nodes, known, levels, arity)
    if len(over) == 1:                                   # one source, or none: its subroot is the root
        known = sources.withColumns({"witness": none, "root": F.col("digest")})
    known = cut(known.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "witness",
                             F.col("digest").alias("subroot"), "root"))
    if len(below) == 1:                                  # no source has more than one leaf
        return base.join(known.drop("pos"), "tree").drop("tree")
    for i, nodes in enumerate(reversed(below[:-1])):
        known = _descend(nodes, known, levels, arity)
        if i < len(below) - 2:
            known = cut(known)
    return known.drop("tree")


DUCKDB_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
        lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN sha256(head || coalesce(strlen(text) || ':'
      || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered
  FROM d),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s
  FROM leaves),
up AS (
  SELECT 0 AS level, s, pos, n, leaf AS node FROM numbered
  UNION ALL
  SELECT level + 1, s, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos))
  FROM up WHERE n > 1 GROUP BY level, s, pos // 16, n),
subroots AS (SELECT s AS pos, count(*) OVER () AS n, node FROM up WHERE n = 1),
above AS (
  SELECT 0 AS level, pos, n, node FROM subroots
  UNION ALL
  SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos))
  FROM above WHERE n > 1 GROUP BY level, pos // 16, n),
-- runs of each level of each tree (the tree of sources is s = -1, its levels count from 100)
runs AS (
  SELECT level, s, pos // 16 AS run, string_agg(node, '' ORDER BY pos) AS nodes FROM up WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT level + 100, -1, pos // 16, string_agg(node, '' ORDER BY pos) FROM above WHERE n > 1 GROUP BY ALL),
steps AS (
  SELECT l.s, l.pos AS place, r.level, substr(r.nodes, 1, 64 * k) AS before, substr(r.nodes, 64 * k + 65) AS after,
    row_number() OVER (PARTITION BY l.s, l.pos ORDER BY r.level) AS step
  FROM (SELECT numbered.s, pos, level, CASE WHEN level < 100 THEN numbered.s ELSE -1 END AS tree,
          CASE WHEN level < 100 THEN pos // (16::BIGINT ** level)::BIGINT
               ELSE numbered.s // (16::BIGINT ** (level - 100))::BIGINT END AS node
        FROM numbered, (SELECT DISTINCT level FROM runs)) l
  JOIN runs r ON r.level = l.level AND r.s = l.tree AND r.run = l.node // 16, LATERAL (SELECT l.node % 16 AS k)),
folded AS (
  SELECT s, pos AS place, 0::BIGINT AS step, coalesce(tampered, leaf) AS node FROM numbered
  UNION ALL
  SELECT f.s, f.place, f.step + 1, sha256(t.before || f.node || t.after)
  FROM folded f JOIN steps t ON t.s = f.s AND t.place = f.place AND t.step = f.step + 1),
ends AS (SELECT s, place, arg_max(node, step) AS folded_root FROM folded GROUP BY s, place),
proofs AS (SELECT s, place, sha256(string_agg(before || after, '' ORDER BY step)) AS proof FROM steps GROUP BY s, place)
SELECT doc_id, leaf, b.node AS subroot, o.node AS root, coalesce(p.proof, sha256('')) AS proof_sha256, folded_root,
  folded_root = o.node AS verified
FROM numbered l JOIN subroots b ON b.pos = l.s JOIN (SELECT node FROM above WHERE n = 1) o ON true
JOIN ends e ON e.s = l.s AND e.place = l.pos LEFT JOIN proofs p ON p.s = l.s AND p.place = l.pos"""
