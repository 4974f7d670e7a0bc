"""Classification cache and rate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.products import classify_columns
from ..schemas import RATE
from .ranges import carry_forward
from .state import one_per_key
from .status import first_per_key
from .store import Store, Update

RATE_KEY = ["commtype", "commodity", "style", "bagtype"]

# Storage-sheet vocabulary (header phrases, commodity words in
# priority order, bag keywords in priority order).
HEADER_PHRASES = ["PACKING RATES", "COLD STORAGE RATES"]
SHEET_COMMODITIES = [("STEM", "STEMLEAF"), ("LEMON", "LEMON"), ("MANDARIN", "MANDARIN"),
                     ("BLOOD", "BLOOD"), ("ORANGE", "ORANGE"), ("CARAS", "ORANGE")]
SHEET_BAGS = ["GIRO", "NET", "POUCH", "COMBO", "CLAM"]


def product_names(outputs: DataFrame, inputs: DataFrame, lines: DataFrame) -> DataFrame:
    """Distinct non-blank product names across the three repack tables."""
    names = (outputs.select("productname").union(inputs.select("productname"))
             .union(lines.select("productname")))
    return names.filter(F.col("productname").isNotNull()
                        & (F.trim("productname") != "")).distinct()


def classification(names: DataFrame) -> DataFrame:
    """F14/F15 on distinct names: productname → type, commodity, style, needs_llm, bagtype."""
    return names.select("productname", *classify_columns("productname"))


def upsert_classification(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """K5: rows of ``fresh`` replace same-name rows of ``current``; others kept."""
    cols = ["productname", "type", "commodity", "style", "needs_llm", "bagtype"]
    fresh = one_per_key(fresh.select(*cols), "productname")
    kept = current.join(fresh.select("productname"), "productname", "left_anti")
    return kept.select(*cols).unionByName(fresh.select(*cols))


#: Name of the stored classification.
CLASSIFICATION = "product_classification"


def refresh_classification(store: Store, names: DataFrame, again: bool = False, buckets: int = 8) -> int:
    """K5: classify the names that the stored table does not have (all of them with ``again``) and upsert them.

    Returns the store's version; without a new name nothing is written.
    """
    if CLASSIFICATION not in store.manifest():
        store.create(CLASSIFICATION, classification(names.limit(0)).schema, ["productname"], buckets)
    if not again:
        names = names.join(store.read(CLASSIFICATION).select("productname"), "productname", "left_anti")
    if names.isEmpty():
        return store.version()
    return store.update({CLASSIFICATION: Update(classification(names), upsert_classification)})


def packing_rates(raw: DataFrame) -> DataFrame:
    """S5 + A13: blank-fill and trim the key text, one row per rate key.

    The lowest ``method`` wins (blank = standard before RPC); a stable second key
    (charge) makes the pick deterministic. The result is unique on the key,
    so broadcast joins against it never fan out.
    """
    text_cols = RATE_KEY + ["method"]
    norm = raw.select(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in text_cols],
                      F.col("charge").cast(RATE).alias("charge"))
    return first_per_key(norm, RATE_KEY, ["method", "charge"])


def sheet_group(a: Column) -> Column:
    """F16: a storage-sheet header → struct(commtype, commodity), else NULL."""
    up = F.upper(a)
    is_header = None
    for phrase in HEADER_PHRASES:
        cond = up.contains(phrase)
        is_header = cond if is_header is None else (is_header | cond)
    comm = None
    for word, value in SHEET_COMMODITIES:
        comm = F.when(up.contains(word), value) if comm is None else comm.when(up.contains(word), value)
    ctype = F.when(up.contains("ORGANIC"), "ORG").otherwise("COV")
    return F.when(is_header & comm.isNotNull(),
                  F.struct(ctype.alias("commtype"), comm.alias("commodity")))


def sheet_bagtype(a: Column) -> Column:
    """first bag keyword contained in the label, else BULK."""
    up = F.upper(a)
    expr = None
    for kw in SHEET_BAGS:
        expr = F.when(up.contains(kw), kw) if expr is None else expr.when(up.contains(kw), kw)
    return expr.otherwise("BULK")


def sheet_style(a: Column) -> Column:
    """``a/b#`` → a/bLB, TRI-WALL → TRIWALL, ``n#`` → nLB, else NULL."""
    up = F.upper(a)
    pair = r"(\d+)\s*/\s*(\d+)#"
    single = r"(\d+)#"
    return (F.when(up.rlike(pair), F.concat(F.regexp_extract(up, pair, 1), F.lit("/"),
                                            F.regexp_extract(up, pair, 2), F.lit("LB")))
            .when(up.contains("TRI-WALL") | up.contains("TRIWALL"), "TRIWALL")
            .when(up.rlike(single), F.concat(F.regexp_extract(up, single, 1), F.lit("LB"))))


def _num(c: str) -> Column:
    return F.expr(f"try_cast({c} AS DOUBLE)")


def storage_rates(sheet: DataFrame, ranged: bool = False) -> DataFrame:
    """S6 + W2 + F16-F19 + A13: the STORAGE tab rows → storage_rates.

    A header row sets (commtype, commodity) for the rows after it; the carry
    is a running ``last(ignorenulls)`` over the sheet's row order. Column d
    overrides c when numeric; b must be numeric; rows without a style drop.
    Duplicate keys keep the first row in sheet order. ``ranged`` carries the headers over ranges of rows, for
    sheets too long for one task.
    """
    w = (Window.partitionBy("sheet_id").orderBy("row_no")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    s = sheet.withColumn("_hdr", sheet_group(F.col("a")))
    s = carry_forward(s, ["sheet_id", "row_no"], "_hdr", "_grp", "sheet_id") if ranged else \
        s.withColumn("_grp", F.last("_hdr", ignorenulls=True).over(w))
    rate = F.coalesce(_num("d"), _num("c"))
    rows = s.filter(F.col("_hdr").isNull() & F.col("_grp").isNotNull() & F.col("a").isNotNull()
                    & rate.isNotNull() & _num("b").isNotNull() & sheet_style(F.col("a")).isNotNull())
    rows = rows.select(
        "sheet_id", "row_no",
        F.col("_grp.commtype").alias("commtype"), F.col("_grp.commodity").alias("commodity"),
        sheet_style(F.col("a")).alias("style"), sheet_bagtype(F.col("a")).alias("bagtype"),
        _num("b").cast(RATE).alias("ctns_per_pallet"),
        F.bround(rate, 4).cast(RATE).alias("rate"))
    return first_per_key(rows, RATE_KEY, ["sheet_id", "row_no"]).select(
        *RATE_KEY, "ctns_per_pallet", "rate")
