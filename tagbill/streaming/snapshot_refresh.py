"""ST4: incremental snapshot refresh of the three repack tables from an inbox of reports.

A report is a file of the inbox, or a folder in it with the report's part files. A file
stream with ``Trigger.availableNow`` notices what has landed since the last run; each
report noticed, the oldest first, is read whole and by header name (a missing column is
an error), split (P1), and each part becomes the next snapshot version (K1), numbered by
the same allocator as every other writer. What a batch has written is noted
under the stream's checkpoint, so a replayed batch that had finished writes nothing, and
one that had not writes newer versions; no version is ever overwritten.
"""

from __future__ import annotations

import os

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import numbered_folders, write_snapshot
from ..sources import reports
from ..sources.reports import REPACK_HEADER


# the columns of Spark's binary file source; the content is never read
FILES = "path string, modificationTime timestamp, length long, content binary"


def _below(inbox: str) -> str:
    """The folder of an inbox that may be given as a pattern, up to its first wildcard."""
    return inbox.split("*", 1)[0].rstrip("/")


def _report_of(inbox: str) -> Column:
    """The first path step below the inbox: the report's file or folder."""
    rest = F.split_part(F.col("path"), F.lit(f"/{os.path.basename(inbox)}/"), F.lit(-1))
    return F.split_part(rest, F.lit("/"), F.lit(1))


def refresh_repack_snapshots(spark: SparkSession, inbox: str, root: str, checkpoint: str) -> None:
    wanted = {c.strip().lower() for c in REPACK_HEADER}
    noted = f"{checkpoint}/written"

    def process(batch: DataFrame, epoch: int) -> None:
        if epoch in numbered_folders(spark, noted, "batch="):
            return
        # one row a report that has landed, the oldest first
        landed = (batch.groupBy(_report_of(_below(inbox)).alias("report")).agg(F.max("modificationTime").alias("at"))
                  .orderBy("at", "report").collect())
        written = [("", "")]
        for r in landed:
            report = reports.read_report_csv(spark, f"{_below(inbox)}/{r.report}").persist(StorageLevel.MEMORY_AND_DISK)
            try:
                if missing := wanted - set(report.columns):
                    raise ValueError(f"report {r.report} lacks {sorted(missing)}")
                written += [(name, write_snapshot(part, f"{root}/repack_{name}"))
                            for name, part in reports.split_repacks(report).items()]
            finally:
                report.unpersist()
        spark.createDataFrame(written, "name string, version string").write.mode("overwrite").parquet(f"{noted}/batch={epoch}")

    q = (spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
         .load(inbox).select("path", "modificationTime")
         .writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
