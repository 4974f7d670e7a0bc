"""A1 ``v_shipped``: one row per shipped pallet tag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import guarded_mdy
from ..schemas import QTY


def ship_detail(shipping_raw: DataFrame) -> DataFrame:
    """Real ship lines only (pallet present, record type 5, transaction type 1)."""
    return shipping_raw.filter(F.col("pallet").isNotNull() & (F.col("recordtype") == 5)
                               & (F.col("trxtype") == 1))


def shipped(shipping_raw: DataFrame) -> DataFrame:
    """Per-tag quantity and first sono/customer/dates/product of its ship lines.

    A partial hash aggregate runs before the shuffle, so a pallet with very
    many lines is pre-summed per input split and cannot skew the final stage.
    Quantities are fixed-point before the sum (order-independent).
    """
    return (ship_detail(shipping_raw)
            .groupBy(F.col("pallet").cast("long").alias("tagid"))
            .agg(F.sum(F.col("icqnt").cast(QTY)).cast(QTY).alias("shipped_qty"),
                 F.min("sono").alias("sono"),
                 F.min("lastconame").alias("lastconame"),
                 F.min(guarded_mdy("shipdatetime")).alias("ship_date"),
                 F.min(guarded_mdy("recvdate")).alias("recv_date"),
                 F.min("productdescr").alias("productname")))
