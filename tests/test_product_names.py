"""Product names and sheet labels with the answers worked out by hand, and properties of the rules."""

import random

from pyspark.sql import functions as F

from tagbill.functions.products import bagtype
from tagbill.operators.catalog import sheet_bagtype, sheet_style

NAMES = {
    "ORG LEMON 12/2LB": "GIRO", "COV ORANGE 10/3LB NET": "NET", "LEMON BAG COMBO": "COMBO", "MANDARIN POUCH BAGS": "POUCH",
    "LEMON 25LB": "BULK", "MANDARIN CLAMSHELL": "CLAM", "ORANGE 8/3 LB": "BULK", "lemon bag": "GIRO",
    "LEMON NETTED BAG": "GIRO", "LEMON NET CARTON": "BULK", "ORANGE COMBOS": "BULK", "CLAM BAG": "GIRO",
    "ORG 12/1.5LB": "GIRO", "": "BULK", None: "BULK",
}
LABELS = {
    "12/2# GIRO BAG": ("GIRO", "12/2LB"), "10 / 3# NET BAG": ("NET", "10/3LB"), "25# VF CARTON": ("BULK", "25LB"),
    "TRI-WALL BIN": ("BULK", "TRIWALL"), "TRIWALL": ("BULK", "TRIWALL"), "15/2# pouch bag": ("POUCH", "15/2LB"),
    "12# CLAM SHELL": ("CLAM", "12LB"), "EURO TRAY": ("BULK", None), "8/3 # COMBO": ("COMBO", None),
}


def test_names_by_hand(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string").select("n", bagtype("n").alias("b"))
    assert {r.n: r.b for r in df.collect()} == NAMES
    df = spark.createDataFrame([(n,) for n in LABELS], "n string")
    got = df.select("n", sheet_bagtype(F.col("n")).alias("b"), sheet_style(F.col("n")).alias("s")).collect()
    assert {r.n: (r.b, r.s) for r in got} == LABELS


def test_case_and_padding_do_not_matter(spark):
    rng = random.Random(3)
    words = ["ORG", "LEMON", "BAG", "NET", "12/2LB", "POUCH", "CLAM", "25LB", "COMBO"]
    names = [" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(200)]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(
        bagtype("n").alias("a"), bagtype(F.lower("n")).alias("b"), bagtype(F.concat(F.lit("  "), "n")).alias("c"), "n")
    for r in df.collect():
        assert r.a == r.b == r.c
        assert (r.a == "BULK") == (not any(w in r.n for w in ("BAG", "12/2LB", "CLAM")))
