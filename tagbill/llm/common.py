"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to a Python worker; texts may be very long.
BATCH_ROWS = 512

#: ASCII white space that separates words in every contract here.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches and make sure a shared checkpoint folder is set.

    The folder is read from ``spark.checkpoint.dir``. Only a single-JVM session
    (tests, bench) without the setting gets a folder of its own; a cluster
    session without it is an error.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if sc.master.startswith("local"):       # workers of one machine find the package where the driver has it
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        sc.environment["PYTHONPATH"] = root
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        folder = tempfile.mkdtemp(prefix="llm-checkpoint-")
    sc.setCheckpointDir(folder)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back, so that its size is known to later joins."""
    spark = df.sparkSession
    prepare(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id's text leaves ``remainder``; a null id counts as ''."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % F.lit(modulus)) == F.lit(remainder)


def bounded_sample(rows: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """About ``most`` rows at the most, picked by a hash of ``key`` alike on every run.

    Without a sort: the share kept is ``most`` over the number of rows, so the
    expected size never exceeds the bound.
    """
    n = rows.count()
    if n <= most:
        return rows
    share = int(most / n * 1_000_000)
    return rows.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < share)


def batches(it: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Non-empty record batches of at most ``rows`` rows."""
    for batch in it:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts(column: pa.Array) -> list[str]:
    """The texts of a column; a null text reads as the empty one."""
    return [t or "" for t in column.to_pylist()]


def out(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
