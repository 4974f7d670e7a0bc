"""Product-name classification as column expressions.

Classification is evaluated on the *distinct* product names only and joined
back, so the regexes run once per name, never once per pallet.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bag-size pattern and the commodity vocabulary (first match
# wins, in this order), as used by the rate tables.
BAG_SIZE = r"\d{1,2}/\d{1,2}(\.\d+)?LB"
COMMODITY_WORDS = [("STEM", "STEMLEAF"), ("LEMON", "LEMON"), ("MANDARIN", "MANDARIN"),
                   ("BLOOD", "BLOOD"), ("ORANGE", "ORANGE"), ("CARA", "ORANGE"),
                   ("NAVEL", "ORANGE")]
# Our own style rule (the reference delegates to an external parser): a bag
# size "a/bLB" first, then a single weight "nLB" or "n#".
STYLE_BAG = r"(\d{1,2}/\d{1,2}(?:\.\d+)?)\s?LB"
STYLE_WEIGHT = r"(\d+)\s?(?:LB|#)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bagtype(name) -> Column:
    """Rate-key pack form of a product name; NULL name → BULK."""
    u = F.upper(F.coalesce(_c(name), F.lit("")))
    is_bag = u.contains("BAG") | u.rlike(BAG_SIZE)
    bag_kind = (F.when(u.rlike(r"\bCOMBO\b"), "COMBO")
                .when(u.rlike(r"\bNET\b"), "NET")
                .when(u.contains("POUCH"), "POUCH")
                .otherwise("GIRO"))
    return F.when(is_bag, bag_kind).when(u.contains("CLAM"), "CLAM").otherwise("BULK")


def commtype(name) -> Column:
    u = F.upper(F.trim(_c(name)))
    return (F.when(u.startswith("ORGANIC ") | u.startswith("ORG "), "ORG")
            .when(u.startswith("CONVENTIONAL ") | u.startswith("COV "), "COV"))


def commodity(name) -> Column:
    u = F.upper(_c(name))
    expr = None
    for word, value in COMMODITY_WORDS:
        expr = (F.when(u.contains(word), value) if expr is None
                else expr.when(u.contains(word), value))
    return expr


def style(name) -> Column:
    u = F.upper(_c(name))
    bag = F.regexp_extract(u, STYLE_BAG, 1)
    weight = F.regexp_extract(u, STYLE_WEIGHT, 1)
    return (F.when(bag != "", F.concat(bag, F.lit("LB")))
            .when(weight != "", F.concat(weight, F.lit("LB"))))


def classify_columns(name_col: str = "productname") -> list[Column]:
    """(type, commodity, style, needs_llm, bagtype) for a product-name column."""
    t, c, s = commtype(name_col), commodity(name_col), style(name_col)
    return [t.alias("type"), c.alias("commodity"), s.alias("style"),
            (t.isNull() | c.isNull() | s.isNull()).alias("needs_llm"),
            bagtype(name_col).alias("bagtype")]


def billable_product(name) -> Column:
    """Carton predicate: not a setback or field bin (NULL name → NULL)."""
    return ~_c(name).rlike("(?i)SETBACK BIN|FIELD BIN")
