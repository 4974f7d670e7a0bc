"""Presentation formats (F24) and fills (F25): applied only at the export edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def money_text(c) -> Column:
    """``1,234.50``: thousands separators, two decimals."""
    return F.format_number(F.col(c) if isinstance(c, str) else c, 2)


def qty_text(c) -> Column:
    """Whole quantities print as integers; others without trailing zeros."""
    c = F.col(c) if isinstance(c, str) else c
    whole = c == F.floor(c)
    trimmed = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,10)").cast("string"), "0+$", ""),
                               r"\.$", "")
    return F.when(whole, F.floor(c).cast("long").cast("string")).otherwise(trimmed)


def as_text(df: DataFrame) -> DataFrame:
    """every column as text, dates as ``yyyy-MM-dd``, missing values as the empty text."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def zero_filled(df: DataFrame) -> DataFrame:
    """missing numbers as 0, other columns as they are."""
    numeric = {n for n, t in df.dtypes if t.startswith("decimal") or t in ("int", "bigint", "double", "float")}
    return df.select(*[F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)).alias(c) if c in numeric
                       else F.col(c) for c in df.columns])
