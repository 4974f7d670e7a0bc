"""ST4: stored views kept up to date from one snapshot to the next.

A store holds the shipped tags (A1), each tag's contributions to the weekly bill, the weekly
bill itself (A14), and a digest of everything that the inputs say about a tag. A refresh
aggregates the new snapshot's digests (partial sums, one row a tag), compares them with the
stored ones, and works out only the tags that differ: their rows of every input, their
status, charges and storage. The old contributions of those tags are taken out of their
weeks and the new ones added, in exact decimals, so only touched weeks and the buckets of
touched tags are rewritten; all of it is one commit.

Entered costs (labor, materials) have no tag: their weekly sums are compared with those in
the stored weeks. Rates and the classification are dimensions of every tag; after a change
of them ``build`` is called again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import guarded_iso
from ..schemas import MONEY_SUM
from ..session import cut_lineage
from . import charges, shipped, status, storage
from .rollups import SUMMARY_COLUMNS
from .store import Store, Update

TABLES = {"tag_digests": ["tagid"], "shipped": ["tagid"], "tag_amounts": ["tagid"], "week_amounts": ["billing_week"]}
STREAMS = ("service", "storage", "labor", "materials")


def tag_inputs(raw: DataFrame, outputs: DataFrame, inputs: DataFrame, billing_lines: DataFrame) -> dict[str, DataFrame]:
    """The inputs that are keyed by tag, under one key name."""
    return {"raw": raw.withColumn("_tag", F.col("pallet").cast("long")),
            **{n: df.withColumn("_tag", F.col("tagid").cast("long"))
               for n, df in (("outputs", outputs), ("inputs", inputs), ("billing_lines", billing_lines))}}


def digests(tables: dict[str, DataFrame]) -> DataFrame:
    """(tagid, digest, lines): an order-independent digest of all rows of a tag, in whichever table."""
    rows = None
    for name, df in sorted(tables.items()):
        cols = sorted(c for c in df.columns if c != "_tag")
        one = df.filter(F.col("_tag").isNotNull()).select(
            F.col("_tag").alias("tagid"), F.xxhash64(F.lit(name), *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in cols])
            .alias("h"))
        rows = one if rows is None else rows.unionByName(one)
    # the exact sum of the hashes, by their upper and lower 32 bits: sums of longs are cheaper than of decimals
    sums = rows.groupBy("tagid").agg(F.sum(F.shiftright("h", 32)).alias("_hi"), F.sum(F.col("h").bitwiseAND(0xFFFFFFFF)).alias("_lo"),
                                     F.count(F.lit(1)).alias("lines"))
    whole = F.col("_hi").cast("decimal(38,0)") * F.lit(2**32).cast("decimal(11,0)") + F.col("_lo")
    return sums.select("tagid", whole.cast("decimal(38,0)").alias("digest"), "lines")


def changed_tags(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tags whose digest is new, gone or different."""
    o = old.select("tagid", F.struct("digest", "lines").alias("_old"))
    n = new.select("tagid", F.struct("digest", "lines").alias("_new"))
    return o.join(n, "tagid", "full").filter(~F.col("_old").eqNullSafe(F.col("_new"))).select("tagid")


def tag_views(tables: dict[str, DataFrame], classification: DataFrame, packing_rates: DataFrame,
              storage_rates: DataFrame, store: Store | None = None) -> tuple[DataFrame, DataFrame]:
    """The shipped tags (staged in ``store``, if given), and (tagid, stream, billing_week, amount) of every unbilled charge."""
    t = {n: df.drop("_tag") for n, df in tables.items()}
    sh = shipped.shipped(t["raw"])
    sh = sh if store is None else store.staged(sh)
    rated = charges.charges(status.status_with_ship(t["outputs"], t["inputs"], sh, t["billing_lines"]),
                            classification, packing_rates)
    cold = storage.storage_charges(sh, classification, storage_rates, t["billing_lines"])
    amounts = None
    for stream, df in (("service", rated), ("storage", cold)):
        one = df.filter(~F.col("billed")).select("tagid", F.lit(stream).alias("stream"), "billing_week", "amount")
        amounts = one if amounts is None else amounts.unionByName(one)
    return sh, amounts


def _weekly(amounts: DataFrame, sign: int = 1) -> DataFrame:
    """(billing_week, <stream>, <stream>_lines) sums of contributions; weeks without a date count lines only."""
    at = lambda s: F.col("stream") == s
    return amounts.groupBy("billing_week").agg(
        *[(sign * F.coalesce(F.sum(F.when(at(s), F.col("amount"))), F.lit(0))).cast(MONEY_SUM).alias(s) for s in STREAMS],
        *[(sign * F.count_if(at(s))).cast("long").alias(f"{s}_lines") for s in STREAMS])


def entered_amounts(labor: DataFrame, materials: DataFrame) -> DataFrame:
    """The contributions that have no tag."""
    def of(df: DataFrame, amount: str, stream: str) -> DataFrame:
        return (df.filter(F.col("week_end").rlike(r"^\d{4}-\d{2}-\d{2}$"))
                .select(F.lit(stream).alias("stream"), guarded_iso("week_end").alias("billing_week"), F.col(amount).alias("amount")))
    return of(labor, "labor_charge", "labor").unionByName(of(materials, "materials_charge", "materials"))


def _added(current: DataFrame, delta: DataFrame) -> DataFrame:
    """Stored weeks plus a delta; a week without any line goes."""
    cols = [*STREAMS, *[f"{s}_lines" for s in STREAMS]]
    u = current.select("billing_week", *cols).unionByName(delta.select("billing_week", *cols))
    kinds = {f.name: f.dataType for f in current.schema.fields}
    out = u.groupBy("billing_week").agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in cols])
    return out.filter(sum((F.col(f"{s}_lines") for s in STREAMS), F.lit(0)) > 0)


def build(store: Store, tables: dict[str, DataFrame], dims: dict[str, DataFrame], labor: DataFrame, materials: DataFrame,
          buckets: int = 32) -> int:
    """Write all stored views from a whole snapshot."""
    sh, amounts = tag_views(tables, store=store, **dims)
    amounts = store.staged(amounts)
    weeks = _weekly(amounts.drop("tagid").unionByName(entered_amounts(labor, materials)))
    return store.replace_all({"tag_digests": (digests(tables), ["tagid"]), "shipped": (sh, ["tagid"]),
                              "tag_amounts": (amounts, ["tagid"]), "week_amounts": (weeks, ["billing_week"])}, buckets)


def refresh(store: Store, tables: dict[str, DataFrame], dims: dict[str, DataFrame], labor: DataFrame,
            materials: DataFrame) -> dict[str, int]:
    """Bring the stored views to the state of a new snapshot; counts of what was touched.

    ``{"tags", "weeks", "version"}``; a snapshot that says the same leaves the store as it is.
    """
    version = store.version()
    now = store.staged(digests(tables))
    changed = cut_lineage(changed_tags(store.read("tag_digests", version), now))
    stored = store.read("week_amounts", version)
    costs = _weekly(entered_amounts(labor, materials))
    before = stored.select("billing_week", *[(F.lit(0) if s in ("service", "storage") else -F.col(s)).cast(MONEY_SUM).alias(s) for s in STREAMS],
                           *[(F.lit(0) if s in ("service", "storage") else -F.col(f"{s}_lines")).cast("long").alias(f"{s}_lines")
                             for s in STREAMS])
    mine = {n: df.join(changed.withColumnRenamed("tagid", "_tag"), "_tag", "left_semi") for n, df in tables.items()}
    sh, amounts = tag_views(mine, store=store, **dims)
    amounts = store.staged(amounts)
    old = store.read("tag_amounts", version).join(changed, "tagid", "left_semi")
    cols = ["billing_week", *STREAMS, *[f"{s}_lines" for s in STREAMS]]
    moved = None
    for part in (_weekly(amounts), _weekly(old, -1), costs, before):
        moved = part.select(*cols) if moved is None else moved.unionByName(part.select(*cols))
    delta = cut_lineage(moved.groupBy("billing_week").agg(*[F.sum(c).alias(c) for c in cols[1:]])
                        .filter(sum((F.when(F.col(c) != 0, 1).otherwise(0) for c in cols[1:]), F.lit(0)) > 0))
    counts = {"tags": changed.count(), "weeks": delta.count()}
    updates = {}
    if counts["tags"]:
        updates = {"tag_digests": Update(now.join(changed, "tagid", "left_semi"), keys=changed),
                   "shipped": Update(sh, keys=changed, is_staged=True),
                   "tag_amounts": Update(amounts, keys=changed, is_staged=True)}
    if counts["weeks"]:
        updates["week_amounts"] = Update(delta, _added)
    return counts | {"version": store.update(updates) if updates else version}


def bill_summary(store: Store) -> DataFrame:
    """A14 off the stored weeks."""
    w = store.read("week_amounts")
    dated = lambda s: F.when(F.col("billing_week").isNotNull(), F.col(s)).otherwise(F.lit(0)).cast(MONEY_SUM)
    out = w.select("billing_week", *[dated(s).alias(f"{s}_amount") for s in STREAMS])
    total = F.col("service_amount") + F.col("storage_amount") + F.col("labor_amount") + F.col("materials_amount")
    return out.withColumn("total_amount", total.cast(MONEY_SUM)).select(*SUMMARY_COLUMNS).orderBy(F.col("billing_week").asc_nulls_last())
