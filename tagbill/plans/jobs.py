"""Batch jobs around the views: ingest report files as snapshots (S1-S3, P1, K1, ST4)
and publish computed views as snapshots (K1), partitioned for pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.state import read_snapshot, write_snapshot
from ..sources import reports
from .billing import Billing

# views whose rows carry a billing week are written partitioned by it, so a
# week's bill reads only that week's folder
WEEK_PARTITIONED = {"charges", "bill_lines", "storage_charges", "bill_summary"}


def ingest_reports(spark: SparkSession, repack_csv: str, shipping_csv: str, root: str,
                   shipping_encoding: str = reports.SHIPPING_ENCODING) -> dict[str, str]:
    """Load both reports and replace the four snapshot tables (each a new version).

    The repack report is read once and persisted while its three splits are
    written; the shipping report's numeric columns are coerced on the way in.
    """
    from pyspark import StorageLevel
    rep = reports.read_report_csv(spark, repack_csv).persist(StorageLevel.MEMORY_AND_DISK)
    out = {}
    try:
        for name, df in reports.split_repacks(rep).items():
            out[f"repack_{name}"] = write_snapshot(df, f"{root}/repack_{name}")
    finally:
        rep.unpersist()
    ship = reports.coerce_shipping(reports.read_report_csv(spark, shipping_csv, shipping_encoding))
    out["shipping_raw"] = write_snapshot(ship, f"{root}/shipping_raw")
    return out


def publish_views(billing: Billing, root: str, names: list[str]) -> dict[str, str]:
    """Write the named views of ``billing`` as new snapshot versions under ``root``."""
    out = {}
    for name in names:
        df: DataFrame = getattr(billing, name)
        part = ["billing_week"] if name in WEEK_PARTITIONED else None
        out[name] = write_snapshot(df, f"{root}/{name}", partition_by=part)
    return out


def read_view(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    return read_snapshot(spark, f"{root}/{name}")
