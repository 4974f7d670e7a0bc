"""J1 ``v_repack_chain``: backward repack lineage of every shipped tag.

The reference enumerates every simple path with a recursive CTE and then keeps
the shallowest row per (shipped_tag, tagid). A shortest walk never repeats a
tag, so shortest distances give the same keys and depths. They are taken
between *runs*: run r leads to the runs that produced a tag it consumes, and a
tag lies one step below the nearest run that consumes it. All tags of a run
share its distances, which are worked out once per run.

Distances double. Let D hold all distances up to h. A shortest path of length
h+1 .. 2h passes a run at distance exactly h, and what follows it is itself a
shortest path of at most h, so ``D[exactly h] joined with D`` gives every
distance up to 2h. Cycles need no contraction: a longer way round loses the
minimum. A lineage of depth d takes log2(d) rounds of one join and one
aggregate, each written as Parquet to the checkpoint folder.

What remains is attached in two joins: the tags that each reached run consumes
(the shallowest, then the smallest quantity), and the shipped tags of each run.
A tag's own columns are joined to the consumptions, which are few, before they meet the
distances. A tag that one run alone consumes is reached from another run in one
way only and needs no minimum; only tags of several consumers are aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.products import billable_product
from ..session import cut_lineage, staged
from .status import first_per_key

CHAIN_COLUMNS = ["shipped_tag", "tagid", "icrunidx", "fcreasonidx", "productname", "uom", "qty",
                 "depth"]
# Deterministic choice among a tag's produced rows (the reference leaves it open);
# among equally shallow consumptions the smallest quantity wins.
CHAIN_TIEBREAK = ["icrunidx", "fcreasonidx", "productname", "uom"]
# What a tag's chosen produced row says of it.
TAG_COLUMNS = [*CHAIN_TIEBREAK, "billable"]


def produced_tags(outputs: DataFrame) -> DataFrame:
    return outputs.filter(F.col("tagid").isNotNull()).select(
        F.col("tagid").cast("long").alias("tagid"), "icrunidx", "fcreasonidx", "productname", "uom")


def consumptions(inputs: DataFrame) -> DataFrame:
    """(run, tagid, qty): what each run consumed."""
    return inputs.filter(F.col("tagid").isNotNull() & F.col("icrunidx").isNotNull()).select(
        F.col("icrunidx").alias("run"), F.col("tagid").cast("long").alias("tagid"),
        F.col("qnt").alias("qty"))


def run_graph(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """(run, above): ``above`` produced a tag that ``run`` consumed; one row per pair."""
    made = produced_tags(outputs).filter(F.col("icrunidx").isNotNull()).select(
        "tagid", F.col("icrunidx").alias("above"))
    return (consumptions(inputs).select("run", "tagid").join(made, "tagid")
            .filter(F.col("run") != F.col("above")).select("run", "above").distinct())


def run_distances(graph: DataFrame) -> DataFrame:
    """(run, above, hops): the shortest distance of every run to every other run it leads to."""
    known = staged(graph.withColumn("hops", F.lit(1)))
    reach = 1
    while not known.filter(F.col("hops") == reach).isEmpty():
        far = known.filter(F.col("hops") == reach).select("run", F.col("above").alias("via"))
        rest = known.select(F.col("run").alias("via"), "above", (F.col("hops") + reach).alias("hops"))
        step = far.join(rest, "via").filter(F.col("run") != F.col("above")).select("run", "above", "hops")
        known = staged(known.union(step).groupBy("run", "above").agg(F.min("hops").alias("hops")))
        reach *= 2
    return known


def distances_from(start: DataFrame, outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """(run, above, hops) from the few runs of ``start`` (column ``run``), hop by hop.

    Reads only what the frontier touches; used where one tag's lineage is asked for.
    """
    used = consumptions(inputs).select(F.col("run").alias("via"), "tagid")
    made = produced_tags(outputs).filter(F.col("icrunidx").isNotNull()).select(
        "tagid", F.col("icrunidx").alias("above"))
    found = frontier = cut_lineage(start.select("run", F.col("run").alias("above"), F.lit(0).alias("hops")))
    while not frontier.isEmpty():
        step = (frontier.select("run", F.col("above").alias("via"), (F.col("hops") + 1).alias("hops"))
                .join(used, "via").join(made, "tagid").select("run", "above", "hops").distinct())
        frontier = cut_lineage(step.join(found.select("run", "above"), ["run", "above"], "left_anti"))
        found = found.union(frontier)
    return found.filter(F.col("hops") > 0)


def consumed_tags(inputs: DataFrame, rows: DataFrame) -> DataFrame:
    """(above, tagid, qty, users, the columns of ``rows``): each run's consumed tags that were produced.

    ``qty`` is the smallest quantity that the run consumed, ``users`` the number of runs that consumed the tag.
    """
    smallest = F.min(F.struct(F.col("qty").isNull().alias("_no"), "qty"))
    used = consumptions(inputs).groupBy("tagid", F.col("run").alias("above")).agg(smallest.alias("_b"))
    used = used.select("tagid", "above", F.col("_b.qty").alias("qty"))
    users = used.groupBy("tagid").agg(F.count(F.lit(1)).alias("users"))
    return used.join(rows.join(users, "tagid"), "tagid")


def run_lineage(distances: DataFrame, runs: DataFrame, consumed: DataFrame) -> DataFrame:
    """(run, tagid, depth, qty, the tag's columns): every tag below a run of ``runs``, at its shallowest depth."""
    own = runs.select("run", F.col("run").alias("above"), F.lit(0).alias("hops"))
    reached = own.unionByName(distances).withColumn("depth", F.col("hops") + 1).drop("hops")
    columns = ["run", "tagid", "depth", "qty", *TAG_COLUMNS]
    lone = reached.join(consumed.filter(F.col("users") == 1), "above").select(*columns)
    best = F.min(F.struct("depth", F.col("qty").isNull().alias("_no"), "qty", *TAG_COLUMNS))
    shared = (reached.join(consumed.filter(F.col("users") > 1), "above").groupBy("run", "tagid")
              .agg(best.alias("_b")).select("run", "tagid", "_b.*").select(*columns))
    return lone.unionByName(shared)


def repack_chain(shipped: DataFrame, outputs: DataFrame, inputs: DataFrame,
                 shipped_tag: int | None = None) -> DataFrame:
    """All chain nodes, one per (shipped_tag, tagid) at its shallowest depth.

    ``shipped_tag`` restricts the *seed* (C5): the walk then touches only that
    tag's ancestry instead of filtering the full result.
    """
    seed = shipped.select(F.col("tagid").alias("shipped_tag"), F.col("shipped_qty").alias("qty"))
    if shipped_tag is not None:
        seed = seed.filter(F.col("shipped_tag") == F.lit(shipped_tag))
    seed = staged(seed)
    made = produced_tags(outputs)
    rows = first_per_key(made, ["tagid"], CHAIN_TIEBREAK).withColumn(
        "billable", F.col("fcreasonidx").isin(39, 41) & billable_product(F.col("productname")))
    columns = [*CHAIN_COLUMNS, "billable"]
    roots = (seed.join(rows, seed["shipped_tag"] == rows["tagid"])
             .withColumn("depth", F.lit(0)).select(*columns))

    of_run = staged(seed.select("shipped_tag").join(
        made.select(F.col("tagid").alias("shipped_tag"), F.col("icrunidx").alias("run")), "shipped_tag")
        .filter(F.col("run").isNotNull()).distinct())
    runs = of_run.select("run").distinct()
    distances = run_distances(run_graph(outputs, inputs)) if shipped_tag is None else \
        distances_from(runs, outputs, inputs)
    below = run_lineage(distances, runs, staged(consumed_tags(inputs, rows)))

    # a tag of one run takes that run's lineage as it is; one of several the shallowest of theirs
    n_runs = of_run.groupBy("shipped_tag").agg(F.min("run").alias("run"), F.count(F.lit(1)).alias("_n"))
    single = n_runs.filter(F.col("_n") == 1).select("shipped_tag", "run")
    several = of_run.join(n_runs.filter(F.col("_n") > 1).select("shipped_tag"), "shipped_tag")
    attached = single.join(below, "run").select(*columns)
    best = F.min(F.struct("depth", F.col("qty").isNull().alias("_no"), "qty", *TAG_COLUMNS))
    merged = (several.join(below, "run").groupBy("shipped_tag", "tagid").agg(best.alias("_b"))
              .select("shipped_tag", "tagid", "_b.*").select(*columns))
    return roots.unionByName(attached.unionByName(merged).filter(F.col("tagid") != F.col("shipped_tag")))


def billable_chain(chain: DataFrame) -> DataFrame:
    """Billable nodes across all shipped tags."""
    return (chain.filter(F.col("billable"))
            .select("shipped_tag", "tagid", "icrunidx", "fcreasonidx", "productname", "qty", "depth")
            .orderBy("shipped_tag", "depth"))


def billable_chain_stats(chain: DataFrame) -> DataFrame:
    """Billable nodes, distinct shipped tags, shipped tags with more than one node."""
    per_tag = (chain.filter(F.col("billable")).groupBy("shipped_tag")
               .agg(F.count(F.lit(1)).alias("n")))
    return per_tag.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("nodes"),
                       F.count(F.lit(1)).alias("shipped_tags"),
                       F.count_if(F.col("n") > 1).alias("multi_step"))
