"""Run detail (time and materials per repack run): S9, S10, C7, C8, A19, K8-K11, J16, P15, P19.

A submission is one nested row (parent fields + four child arrays). Line
totals and the run rollups are computed *inside the row* with array
higher-order functions, so saving runs needs no shuffle at all; only the
upsert against the stored tables joins on ``run_no``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import billing_week
from ..schemas import MONEY, QTY, RATE, RUN_PARENT_FIELDS
from .state import one_per_key
from .store import Store, Update

OVERHEAD_DEFAULT = "0.20"  # fixed value: overhead rate when none is given
ACC = T.DecimalType(38, 4)

# The reference lists seeded into the run-detail form.
REF_POSITIONS = [("Input Set-on", 1), ("Grader", 2), ("Packers", 3), ("Machine Operator", 4),
                 ("Palletizers", 5), ("Forklift Driver", 6), ("Tally", 7), ("QC", 8),
                 ("Clean Up", 9), ("Supervisor", 10)]
REF_MATERIALS = [("CHEP", "pallet", "15.00", "pallet", 1),
                 ("Heat Treated", "pallet", "15.00", "pallet", 2),
                 ("Bag Masters", "pallet", "2.14", "pallet", 3),
                 ("6.5 Generic Euro", "pallet", "2.05", "pallet", 4),
                 ('84"', "corner_board", "1.20", "unit", 5),
                 ("Pallet Cover", "corner_board", "4.00", "unit", 6),
                 ('Tri Walls 36"', "corner_board", "23.28", "unit", 7),
                 ("40lb Bottoms", "other", "0.75", "unit", 8),
                 ("40lb Tops", "other", "0.77", "unit", 9)]
REF_DEFECTS = [("Scarring", 1), ("Scale", 2), ("Bruising", 3), ("Soft", 4), ("Stem Pulls", 5),
               ("Decay", 6), ("Sooty Mold", 7)]

PARENT_INPUT = [f.name for f in RUN_PARENT_FIELDS]
COMPUTED = ["total_labor", "overhead", "new_materials", "total"]
PARENT_COLUMNS = PARENT_INPUT + COMPUTED
# The child tables and their columns.
CHILDREN = {
    "labor": ["seq", "position", "num_workers", "reg_hours", "ot_hours", "total_hours", "reg_pay",
              "ot_pay", "total_pay"],
    "io": ["seq", "io", "boxes", "label", "pack_style", "size"],
    "material": ["seq", "category", "material", "quantity", "price_per_unit", "total"],
    "defect": ["seq", "defect_type", "value"],
}
DEFAULTS = {"company": "HARBOR PACKING", "status": "draft"}  # fixed values: column defaults


def ref_positions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REF_POSITIONS, "name string, seq int")


def ref_defects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REF_DEFECTS, "name string, seq int")


def ref_materials(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(n, c, p, u, s) for n, c, p, u, s in REF_MATERIALS],
        "name string, category string, default_price string, unit_label string, seq int",
    ).withColumn("default_price", F.col("default_price").cast(RATE))


def normalize(sub: DataFrame) -> DataFrame:
    """S9 + C7: resolve the ``materials`` alias and price each material line.

    The alias applies when ``material`` is missing or empty. A line total is
    ``HALF_UP(quantity × price, 2)`` when both are given, else the submitted total.
    """
    mat = F.when(F.size(F.coalesce("material", F.array())) > 0, F.col("material")) \
        .when(F.size(F.coalesce("materials", F.array())) > 0, F.col("materials"))
    priced = F.transform(mat, lambda m: m.withField(
        "total", F.when(m["quantity"].isNotNull() & m["price_per_unit"].isNotNull(),
                        F.round(m["quantity"] * m["price_per_unit"], 2))
        .otherwise(m["total"]).cast(MONEY)))
    return sub.withColumn("material", priced).drop("materials")


def with_rollups(sub: DataFrame) -> DataFrame:
    """A19 + C8: labor, overhead, materials and total per run, HALF_UP to cents.

    Overhead uses the unrounded labor sum; the total is rounded once from the
    unrounded parts (so it can differ by a cent from the sum of shown parts).
    """
    labor = F.aggregate("labor", F.lit(0).cast(ACC),
                        lambda acc, x: (acc + F.coalesce(x["total_pay"], F.lit(0))).cast(ACC))
    mats = F.aggregate("material", F.lit(0).cast(ACC),
                       lambda acc, x: (acc + F.coalesce(x["total"], F.lit(0))).cast(ACC))
    rate = F.coalesce(F.col("overhead_rate"), F.lit(OVERHEAD_DEFAULT).cast(RATE))
    return (sub.withColumn("_lab", F.coalesce(labor, F.lit(0).cast(ACC)))
            .withColumn("_mat", F.coalesce(mats, F.lit(0).cast(ACC)))
            .withColumn("overhead_rate", rate.cast(RATE))
            .withColumn("total_labor", F.round("_lab", 2).cast(MONEY))
            .withColumn("overhead", F.round(F.col("_lab") * F.col("overhead_rate"), 2).cast(MONEY))
            .withColumn("new_materials", F.round("_mat", 2).cast(MONEY))
            .withColumn("total", F.round(F.col("_lab") + F.col("_lab") * F.col("overhead_rate")
                                         + F.col("_mat"), 2).cast(MONEY))
            .drop("_lab", "_mat"))


def prepare(sub: DataFrame) -> DataFrame:
    return with_rollups(normalize(sub))


def parent_rows(prepared: DataFrame) -> DataFrame:
    return prepared.select(*PARENT_COLUMNS)


def child_rows(prepared: DataFrame, key: str) -> DataFrame:
    """K9: one row per child line; ``seq`` defaults to the line's array position."""
    cols = CHILDREN[key]
    ex = prepared.select("run_no", F.posexplode(key).alias("_pos", "_c"))
    return ex.select("run_no", *[
        (F.coalesce(F.col("_c.seq"), F.col("_pos")).cast("int") if c == "seq" else F.col(f"_c.{c}"))
        .alias(c) for c in cols])


def upsert_parents(current: DataFrame, prepared: DataFrame, present: list[str] | str, stamp: Column | None = None) -> DataFrame:
    """K8: rows of a save overwrite only the columns the payload carried.

    ``present`` lists the payload's parent columns, for the whole batch or, as the
    name of an array column of ``prepared``, for each document by itself. The
    computed rollups are always written. New runs get the column defaults for
    absent columns. With ``stamp``, written rows get it as their ``updated_at`` and
    the others keep the one that ``current`` has; rows without a run number have none.
    """
    always = set(COMPUTED) | {"overhead_rate", "run_no"}
    own = [F.col(present).alias("_present")] if isinstance(present, str) else []
    new = one_per_key(prepared.select(*PARENT_COLUMNS, *own), "run_no").select(
        *[F.col(c).alias(f"_n_{c}") for c in PARENT_COLUMNS], *["_present" for _ in own], F.lit(True).alias("_written"))
    stored = PARENT_COLUMNS if stamp is None else [*PARENT_COLUMNS, "updated_at"]
    old = current.select(*[F.col(c).alias(f"_o_{c}") for c in stored]).withColumn("_exists", F.lit(True))
    # one join finds the runs that are new, changed and left alone
    j = new.join(old, new["_n_run_no"] == old["_o_run_no"], "full")
    written = F.coalesce("_written", F.lit(False))
    cols = []
    for c in PARENT_COLUMNS:
        if c == "run_no":
            cols.append(F.coalesce("_n_run_no", "_o_run_no").alias("run_no"))
        elif c in always:
            cols.append(F.when(written, F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c))
        else:
            default = F.lit(DEFAULTS.get(c))
            sent = F.array_contains("_present", c) if own else F.lit(c in present)
            cols.append(F.when(written & sent, F.col(f"_n_{c}"))
                        .when(F.col("_exists"), F.col(f"_o_{c}"))
                        .otherwise(default.cast(current.schema[c].dataType)).alias(c))
    if stamp is not None:
        cols.append(F.when(F.coalesce("_n_run_no", "_o_run_no").isNotNull(),
                           F.when(written, stamp).otherwise(F.col("_o_updated_at"))).alias("updated_at"))
    return j.select(*cols)


def replace_children(current: DataFrame, prepared: DataFrame, key: str) -> DataFrame:
    """K9: a saved run's child lines are replaced wholesale (absent array → emptied)."""
    kept = current.join(prepared.select("run_no"), "run_no", "left_anti")
    return kept.unionByName(child_rows(prepared, key))


def save_runs(store: Store, prepared: DataFrame, now: str, present: list[str] | str | None = None, kinds=tuple(CHILDREN),
              buckets: int = 32) -> int:
    """K8 + K9: save a batch of documents into the stored run and child tables, in one commit.

    ``present`` as in ``upsert_parents`` (all columns by default). Saved rows get ``now`` as their
    ``updated_at``; a saved run's child lines of every kind are replaced.
    """
    stamp = F.lit(now).cast("timestamp")
    if "run" not in store.manifest():
        store.create("run", parent_rows(prepared).withColumn("updated_at", stamp).schema, ["run_no"], buckets)
    for kind in kinds:
        if f"run_{kind}" not in store.manifest():
            store.create(f"run_{kind}", child_rows(prepared, kind).schema, ["run_no"], buckets)
    names = PARENT_INPUT if present is None else present

    prepared = store.staged(prepared.select(*PARENT_COLUMNS, *kinds, *([names] if isinstance(names, str) else [])))
    updates = {"run": Update(prepared, lambda current, fresh: upsert_parents(current, fresh, names, stamp), is_staged=True)}
    for kind in kinds:
        updates[f"run_{kind}"] = Update(child_rows(prepared, kind), keys=prepared.select("run_no"), is_staged=True)
    return store.update(updates)


def delete_runs(table: DataFrame, run_nos: DataFrame) -> DataFrame:
    """Cascade delete — apply to the parent and to every child table."""
    return table.join(run_nos.select("run_no"), "run_no", "left_anti")


def upsert_material_prices(current: DataFrame, prices: DataFrame) -> DataFrame:
    """Price always replaced; category / unit / seq keep the stored value when absent."""
    n = prices.select(F.col("name").alias("_n"), F.col("category").alias("_c"),
                      F.col("default_price").cast(RATE).alias("_p"),
                      F.col("unit_label").alias("_u"), F.col("seq").cast("int").alias("_s"))
    j = current.join(n, current["name"] == n["_n"], "full")
    return j.select(F.coalesce("_n", "name").alias("name"),
                    F.coalesce("_c", "category").alias("category"),
                    F.when(F.col("_n").isNotNull(), F.col("_p")).otherwise(F.col("default_price"))
                    .alias("default_price"),
                    F.coalesce("_u", "unit_label").alias("unit_label"),
                    F.coalesce("_s", "seq").alias("seq"))


def run_list(parents: DataFrame, week: str | None = None, status: str | None = None,
             start: str | None = None, end: str | None = None) -> DataFrame:
    """Filtered run list, ``run_date DESC NULLS LAST, run_no DESC``."""
    df = parents
    if status:
        df = df.filter(F.col("status") == status)
    if start and end:
        df = df.filter(F.col("run_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if week:
        df = df.filter(billing_week("run_date") == F.lit(week).cast("date"))
    return (df.select("run_no", "run_date", "repack", "commodity", "varieties", "restyle",
                      "total_labor", "overhead", "new_materials", "total", "status")
            .orderBy(F.col("run_date").desc_nulls_last(), F.col("run_no").desc()))


def run_detail_charges(parents: DataFrame) -> DataFrame:
    """P19 ``v_run_detail_charges``: dated runs with their billing week."""
    return parents.filter(F.col("run_date").isNotNull()).select(
        "run_no", "run_date", billing_week("run_date").alias("billing_week"), "repack",
        "commodity", "varieties", "restyle", "total_labor", "overhead", "new_materials", "total",
        "status")


def run_nested(parents: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Each run with its child lines as arrays ordered by seq (a run's lines are few)."""
    out = parents
    for key, df in children.items():
        cols = CHILDREN[key]
        g = df.groupBy("run_no").agg(
            F.sort_array(F.collect_list(F.struct(*cols))).alias(key))
        out = out.join(g, "run_no", "left")
    return out


def nested_documents(prepared: DataFrame) -> DataFrame:
    """J16 for documents that still hold their lines: ``run_nested`` within the row, without a shuffle."""
    def lines(key: str):
        of = lambda x, i: F.struct(*[
            (F.coalesce(x["seq"], i).cast("int") if c == "seq" else x[c]).alias(c) for c in CHILDREN[key]])
        return F.when(F.size(key) > 0, F.sort_array(F.transform(key, of))).alias(key)
    return prepared.select(*PARENT_COLUMNS, *[lines(key) for key in CHILDREN])


#: What a line of each kind is about, and its amount.
LINE_DIGEST = {"labor": ("position", "total_pay"), "io": ("io", "boxes"),
               "material": ("material", "total"), "defect": ("defect_type", "value")}


def nested_lines(nested: DataFrame) -> DataFrame:
    """One row per line of a nested run, with its place (from 0) among the run's lines of that kind."""
    def of(kind: str, item: str, amount: str):
        return F.transform(F.coalesce(F.col(kind), F.array()), lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("place"), x["seq"].alias("seq"), x[item].alias("item"),
            x[amount].cast(QTY).alias("amount")))
    lines = F.concat(*[of(kind, *names) for kind, names in LINE_DIGEST.items()])
    return (nested.select("run_no", F.col("total").alias("run_total"), F.explode(lines).alias("line"))
            .select("run_no", "run_total", "line.*"))
