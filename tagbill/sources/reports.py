"""Snapshot report files: CSV scans (S1-S3), the repack split (P1) and CSV exports.

Reports are read with every column as text and header names normalised
(``strip().lower()``); typing happens afterwards with ``try_cast`` so junk
footer rows become NULLs instead of failing the read (ANSI mode is on).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import QTY

BILL_EXPORT_COLUMNS = ["tagid", "productname", "transaction_type", "ship_date", "billing_week",
                       "commodity", "style", "bagtype", "rate", "shipped_qty", "amount"]
REPACK_HEADER = [" RecType", "OutputFlag ", "ICRunIdx", "TagID", "FCReasonIdx", "ProductName", "Qnt",
                 "UOM", "RunDate"]
SHIPPING_ENCODING = "windows-1252"  # fixed value: the shipping report's code page


def read_report_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Header CSV, all columns text, names ``strip().lower()``.

    Quoted values may hold doubled quotes, commas and line feeds. ``windows-1252``
    is read as ISO-8859-1, from which it differs in 0x80-0x9F only; those are mapped.
    """
    r = (spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE")
         .option("escape", '"').option("multiLine", True))
    western = (encoding or "").lower() in ("windows-1252", "cp1252")
    if encoding:
        r = r.option("encoding", "ISO-8859-1" if western else encoding)
    df = r.csv(path)
    if western:
        raw = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]   # five are undefined
        here, there = "".join(map(chr, raw)), bytes(raw).decode("cp1252")
        df = df.select(*[F.translate(F.col(f"`{c}`"), here, there).alias(c.translate(str.maketrans(here, there)))
                         for c in df.columns])
    return df.toDF(*[c.strip().lower() for c in df.columns])


def to_number(c: str) -> Column:
    """S3: text → double; junk and the text ``nan`` → NULL."""
    d = F.expr(f"try_cast(`{c}` AS DOUBLE)")
    return F.when(F.isnan(d), F.lit(None)).otherwise(d)


def coerce_shipping(df: DataFrame) -> DataFrame:
    """S3 + typing: numeric columns of the shipping report, present ones only."""
    out = df
    for c in ("recordtype", "trxtype", "icqnt", "pallet"):
        if c in out.columns:
            out = out.withColumn(c, to_number(c))
    casts = {"pallet": "long", "recordtype": "int", "trxtype": "int"}
    for c, t in casts.items():
        if c in out.columns:
            out = out.withColumn(c, F.col(c).cast(t))
    if "icqnt" in out.columns:
        out = out.withColumn("icqnt", F.col("icqnt").cast(QTY))
    return out


def split_repacks(report: DataFrame) -> dict[str, DataFrame]:
    """Rectype 1 with a product → lines; rectype 2 with a tag → inputs (N) / outputs (Y).

    Everything else (rectype 3, charge sub-lines) is dropped. One scan feeds all
    three filters; callers persist ``report`` when they write all three.
    """
    rt = to_number("rectype")
    typed = report.select(
        rt.cast("int").alias("rectype"), F.trim("outputflag").alias("outputflag"),
        to_number("icrunidx").cast("long").alias("icrunidx"),
        to_number("tagid").cast("long").alias("tagid"),
        to_number("fcreasonidx").cast("int").alias("fcreasonidx"),
        F.col("productname"), F.expr("try_cast(qnt AS DECIMAL(18,4))").alias("qnt"),
        F.col("uom"), F.try_to_date("rundate", "yyyy-MM-dd").alias("rundate"))
    lines = typed.filter((F.col("rectype") == 1) & F.col("productname").isNotNull())
    tags = typed.filter((F.col("rectype") == 2) & F.col("tagid").isNotNull())
    return {"lines": lines,
            "inputs": tags.filter(F.col("outputflag") == "N"),
            "outputs": tags.filter(F.col("outputflag") == "Y")}


def repack_report_rows(outputs: DataFrame, inputs: DataFrame, lines: DataFrame) -> DataFrame:
    """The repack report as the source system prints it: mixed-case padded headers,
    tags as float text, and one footer row per run (rectype 3)."""
    def tag_rows(df: DataFrame, flag: str) -> DataFrame:
        return df.select(F.lit("2"), F.lit(flag), F.col("icrunidx").cast("string"),
                         F.concat(F.col("tagid").cast("string"), F.lit(".0")),
                         F.col("fcreasonidx").cast("string"), "productname",
                         F.col("qnt").cast("string"), "uom", F.col("rundate").cast("string"))
    head = lines.select(F.lit("1"), F.lit(None).cast("string"), F.col("icrunidx").cast("string"),
                        F.lit(None).cast("string"), F.lit(None).cast("string"), "productname",
                        F.lit(None).cast("string"), F.lit(None).cast("string"),
                        F.lit(None).cast("string"))
    foot = lines.select(F.lit("3"), F.lit(None).cast("string"), F.col("icrunidx").cast("string"),
                        F.lit("TOTAL"), F.lit(None).cast("string"), F.lit("RUN TOTAL"),
                        F.lit("n/a"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    rows = head.union(tag_rows(inputs, "N")).union(tag_rows(outputs, "Y")).union(foot)
    return rows.toDF(*REPACK_HEADER)


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> str:
    """K15 (and K14 with ``quote_all``): header CSV; NULL is written as an empty field."""
    w = df.write.mode("errorifexists").option("header", True).option("escape", '"')
    if quote_all:
        w = w.option("quoteAll", True).option("nullValue", "").option("emptyValue", "")
    w.csv(path)
    return path


def bill_lines_export(lines: DataFrame) -> DataFrame:
    """The 11 exported bill-line columns as text (NULL → '')."""
    return lines.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                          for c in BILL_EXPORT_COLUMNS])


def read_labor_reply(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A labor reply sheet (icrunidx, productdescr, quantity, num_laborers,
    hours_per_laborer) as text; ``operators.labor.labor_rows`` types and prices it."""
    if fmt == "csv":
        return read_report_csv(spark, path)
    return spark.read.json(path)


def read_certificates(spark: SparkSession, path: str) -> DataFrame:
    """Certificate extraction records (nested debit rows) with a declared schema."""
    from ..schemas import CERT_EXTRACTION
    return spark.read.schema(CERT_EXTRACTION).json(path)


def read_run_submissions(spark: SparkSession, path: str) -> DataFrame:
    """Run-detail documents (parent fields + child arrays, ``materials`` alias kept)."""
    from ..schemas import RUN_SUBMISSION
    return spark.read.schema(RUN_SUBMISSION).json(path)


def seed_missing(current: DataFrame, seeds: DataFrame, key: str = "name") -> DataFrame:
    """Insert-if-absent — seed rows whose key is not stored yet are added."""
    return current.unionByName(seeds.join(current.select(key), key, "left_anti"))
