"""State tables without a transactional format (K1, K2).

A snapshot is a directory of versions ``<root>/v=<n>``; a writer always writes a
*new* version and readers take the highest one, so nothing is ever overwritten
while it is being read and a failed write leaves the previous version intact.
Upserts elsewhere in the package are expressed as ``old anti new ∪ new`` and
written here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def align_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """K2: keep the target's columns in its order; missing ones become typed NULLs."""
    have = {c.lower(): c for c in df.columns}
    cols = []
    for f in schema.fields:
        src = have.get(f.name.lower())
        col = F.col(f"`{src}`") if src is not None else F.lit(None)
        cols.append(col.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def one_per_key(fresh: DataFrame, *keys: str) -> DataFrame:
    """One row per key of an upsert's payload: the greatest by all other columns in order.

    Payload rows carry no time of their own, so the choice is by value, the same on every run.
    """
    others = [F.col(c).desc_nulls_last() for c in fresh.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(*(others or [F.lit(1)]))
    return fresh.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def numbered_folders(spark: SparkSession, root: str, prefix: str = "v=", completed: bool = True) -> list[int]:
    """Numbers n of the folders ``<root>/<prefix><n>``, in order; with _SUCCESS only if ``completed``."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return []
    out = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        n = name[len(prefix):]
        if name.startswith(prefix) and n.isdigit() and (not completed or fs.exists(
                jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))):
            out.append(int(n))
    return sorted(out)


def _versions(spark: SparkSession, root: str, completed: bool = True) -> list[int]:
    return numbered_folders(spark, root, completed=completed)


def read_snapshot(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame | None:
    vs = _versions(spark, root)
    if not vs:
        return None
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(f"{root}/v={vs[-1]}")


def write_snapshot(df: DataFrame, root: str, partition_by: list[str] | None = None) -> str:
    """K1: write ``df`` as the next version of the snapshot at ``root``."""
    vs = _versions(df.sparkSession, root, completed=False)   # never reuse an abandoned folder
    target = f"{root}/v={(vs[-1] + 1) if vs else 0}"
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(target)
    return target


def append_aligned(spark: SparkSession, root: str, rows: DataFrame, schema: T.StructType) -> DataFrame:
    """K2: append aligned rows as a new batch folder; earlier batches are never rewritten."""
    batches = _versions(spark, root.rstrip("/") + "/_batches", completed=False)
    n = (batches[-1] + 1) if batches else 0
    align_to(rows, schema).write.mode("errorifexists").parquet(f"{root}/_batches/v={n}")
    # only completed batches (with _SUCCESS) are read; a failed writer's folder is ignored
    done = _versions(spark, root.rstrip("/") + "/_batches")
    return spark.read.schema(schema).parquet(*[f"{root}/_batches/v={v}" for v in done])


def upsert_supplied(current: DataFrame, fresh: DataFrame, key: str, supplied: list[str],
                    schema: T.StructType, touched: str | None = "updated_at") -> DataFrame:
    """Upsert on ``key`` writing only the ``supplied`` columns (K8/K12 shape).

    Existing rows keep every column the payload did not carry; new rows get NULL
    there. ``touched`` (if given) is set to now on every written row, and a
    ``created_at`` column, when present, is set only for new rows.
    """
    cols = [f.name for f in schema.fields]
    fresh = one_per_key(fresh, key)
    new = fresh.select(*[F.col(c).alias(f"_n_{c}") for c in [key] + [s for s in supplied if s != key]])
    old = current.select(*[F.col(c).alias(f"_o_{c}") for c in cols]).withColumn("_exists", F.lit(True))
    j = new.join(old, new[f"_n_{key}"] == old[f"_o_{key}"], "left")
    out = []
    for f in schema.fields:
        c = f.name
        if c == key:
            v = F.col(f"_n_{key}")
        elif c in supplied:
            v = F.col(f"_n_{c}")
        elif c == touched:
            v = F.current_timestamp()
        elif c == "created_at":
            v = F.when(F.col("_exists"), F.col("_o_created_at")).otherwise(F.current_timestamp())
        else:
            v = F.when(F.col("_exists"), F.col(f"_o_{c}"))
        out.append(v.cast(f.dataType).alias(c))
    kept = current.join(fresh.select(key), key, "left_anti").select(*cols)
    return kept.unionByName(j.select(*out))
