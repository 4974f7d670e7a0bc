"""Driver tables (TPC-H-like star schema) → billing domain tables.

Every domain table is a pure DataFrame expression over the given parquet
tables, so its size grows with theirs and Catalyst prunes columns and pushes
filters into the parquet scans. The rules are fixed (see ``FIXTURES.md`` §2)
and mirrored one-for-one by the DuckDB adapter in ``plans/oracle_sql.py``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import billing_week
from ..schemas import MONEY, QTY, RATE

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")

# Fixed values of the fixture rules.
FORMS = ["12/2LB BAG", "10/3LB NET BAG", "25LB CARTON", "15/2LB POUCH BAG", "12LB CLAM",
         "8/3LB COMBO BAG", "Field Bin"]
COMMODITY_BY_TYPE = [("ECONOMY", "LEMON"), ("LARGE", "MANDARIN"), ("PROMO", "BLOOD"),
                     ("SMALL", "STEMLEAF")]          # anything else → ORANGE
INPUT_RUNDATE = "2024-01-01"
SELF_CONSUME_EVERY = 97                               # run r consumes 4r+1 when r % 97 = 0


def _pick(index: Column, values: list[str]) -> Column:
    expr = F.when(index == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:], start=1):
        expr = expr.when(index == i, F.lit(v))
    return expr


class Driver:
    """Lazy access to the driver's parquet tables in one ``sf`` folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]


class Domain:
    """The billing inputs, derived from the driver tables on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.driver = Driver(spark, sf_dir)

    # ------------------------------------------------------------------ helpers
    @cached_property
    def n_parts(self) -> Column:
        """Scalar subquery: number of parts (product catalogue size)."""
        return self.driver.table("part").select(F.count(F.lit(1))).scalar()

    @cached_property
    def part_attrs(self) -> DataFrame:
        p = self.driver.table("part")
        commodity = F.lit("ORANGE")
        for prefix, value in reversed(COMMODITY_BY_TYPE):
            commodity = F.when(F.col("p_type").startswith(prefix), F.lit(value)).otherwise(commodity)
        return p.select(
            "p_partkey", "p_retailprice",
            F.when(F.pmod("p_partkey", F.lit(3)) == 0, "ORG").otherwise("COV").alias("p_commtype"),
            commodity.alias("p_commodity"),
            F.pmod("p_size", F.lit(7)).alias("p_form"),
        )

    @cached_property
    def product(self) -> DataFrame:
        """(p_partkey, productname): e.g. ``ORG LEMON 12/2LB BAG``."""
        return self.part_attrs.select(
            "p_partkey",
            F.concat_ws(" ", "p_commtype", "p_commodity", _pick(F.col("p_form"), FORMS))
            .alias("productname"))

    def _product_of(self, df: DataFrame, key: str) -> DataFrame:
        """Attach the productname of part ``key % count(part)``."""
        prod = self.product.withColumnRenamed("p_partkey", "_pk")
        return (df.withColumn("_pk", F.pmod(F.col(key), self.n_parts))
                .join(prod, "_pk", "left").drop("_pk"))

    # ------------------------------------------------------- snapshot reports
    @cached_property
    def shipping_raw(self) -> DataFrame:
        """Shipping report after numeric coercion (S2/S3), one row per line item."""
        li = self.driver.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_returnflag", "l_shipdate")
        li = li.join(self.product.withColumnRenamed("p_partkey", "l_partkey"), "l_partkey", "left")
        ship_d = F.to_date("l_shipdate")
        return li.select(
            F.when(F.col("l_linenumber") == 7, F.lit(None).cast("long"))
             .otherwise(F.col("l_orderkey")).alias("pallet"),
            F.when(F.col("l_linenumber") <= 5, 5).otherwise(3).cast("int").alias("recordtype"),
            F.when(F.col("l_returnflag") == "N", 2).otherwise(1).cast("int").alias("trxtype"),
            F.col("l_quantity").cast(QTY).alias("icqnt"),
            F.pmod("l_orderkey", F.lit(997)).cast("string").alias("sono"),
            F.concat(F.lit("CUST"), F.col("l_suppkey").cast("string")).alias("lastconame"),
            F.when(F.pmod("l_partkey", F.lit(50)) == 0, F.lit("TOTAL"))
             .otherwise(F.concat(F.date_format(ship_d, "MM/dd/yyyy"), F.lit(" 06:00")))
             .alias("shipdatetime"),
            F.date_format(F.date_sub(ship_d, F.pmod("l_partkey", F.lit(21)).cast("int")),
                          "MM/dd/yyyy").alias("recvdate"),
            F.col("productname").alias("productdescr"),
        )

    @cached_property
    def repack_outputs(self) -> DataFrame:
        """Produced tags (rectype 2, outputflag Y): one per order, but for the orders of priority 2-HIGH.

        Those orders' tags are consumed and never produced, so that input-only tags exist.
        """
        o = self.driver.table("orders").select(
            "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
        o = o.filter(F.col("o_orderpriority") != "2-HIGH")
        reason = (F.when(F.col("o_orderstatus") == "F", 39)
                  .when(F.col("o_orderstatus") == "O", 41)
                  .when(F.col("o_orderstatus") == "P",
                        F.when(F.pmod("o_custkey", F.lit(2)) == 0, F.lit(None)).otherwise(12)))
        o = self._product_of(o, "o_orderkey")
        return o.select(
            F.col("o_orderkey").alias("tagid"),
            F.floor(F.col("o_orderkey") / 4).cast("long").alias("icrunidx"),
            reason.cast("int").alias("fcreasonidx"),
            "productname",
            F.col("o_totalprice").cast(QTY).alias("qnt"),
            F.lit("CS").alias("uom"),
            F.to_date("o_orderdate").alias("rundate"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        """Distinct run ids of the produced tags (read straight off ``orders``)."""
        return (self.driver.table("orders")
                .filter(F.col("o_orderpriority") != "2-HIGH")
                .select(F.floor(F.col("o_orderkey") / 4).cast("long").alias("icrunidx")).distinct())

    @cached_property
    def repack_inputs(self) -> DataFrame:
        """Consumed tags (outputflag N): run r consumes 2r, 2r+1 (and 4r+1 every 97th run)."""
        r = F.col("icrunidx")
        tags = F.when(F.pmod(r, F.lit(SELF_CONSUME_EVERY)) == 0,
                      F.array(2 * r, 2 * r + 1, 4 * r + 1)).otherwise(F.array(2 * r, 2 * r + 1))
        inp = self.runs.select("icrunidx", F.explode(tags).alias("tagid"))
        inp = self._product_of(inp, "tagid")
        return inp.select(
            "icrunidx", "tagid",
            F.when(F.pmod("tagid", F.lit(3)) == 0, 39).otherwise(41).cast("int").alias("fcreasonidx"),
            "productname",
            F.lit(10).cast(QTY).alias("qnt"),
            F.lit("CS").alias("uom"),
            F.lit(INPUT_RUNDATE).cast("date").alias("rundate"),
        )

    @cached_property
    def repack_lines(self) -> DataFrame:
        """Run header lines (rectype 1): one per run with the run's product."""
        lines = self._product_of(self.runs, "icrunidx")
        return lines.select("icrunidx", "productname")

    @cached_property
    def billing_lines(self) -> DataFrame:
        """Recorded billing lines: priority 1 → legacy (NULL type), 2 → PACKING, 3 → STORAGE."""
        o = self.driver.table("orders").select("o_orderkey", "o_orderpriority")
        ctype = (F.when(F.col("o_orderpriority").startswith("1"), F.lit("LEGACY"))
                 .when(F.col("o_orderpriority").startswith("2"), F.lit("PACKING"))
                 .when(F.col("o_orderpriority").startswith("3"), F.lit("STORAGE")))
        o = o.withColumn("_ct", ctype).filter(F.col("_ct").isNotNull())
        return o.select(
            F.col("o_orderkey").alias("tagid"),
            F.floor(F.col("o_orderkey") / 4).cast("long").alias("icrunidx"),
            F.lit(None).cast("string").alias("sono"),
            F.lit(None).cast("string").alias("productname"),
            F.lit(None).cast("string").alias("productdescr"),
            F.lit(None).cast("int").alias("fcreasonidx"),
            F.lit(None).cast(QTY).alias("shipped_qty"),
            F.lit(None).cast(QTY).alias("qnt"),
            F.lit(None).cast(MONEY).alias("billed_amount"),
            F.lit(None).cast("string").alias("ship_date"),
            F.lit(None).cast("string").alias("week_end"),
            F.when(F.col("_ct") != "LEGACY", F.col("_ct")).alias("charge_type"),
            F.lit("legacy").alias("source"),
        )

    # ------------------------------------------------------------ rate inputs
    @cached_property
    def packing_rates_raw(self) -> DataFrame:
        """Mirrored packing-rate table, one price row per pack form seen in ``part``.

        Gaps are left on purpose so that exact, GIRO-fallback and missing rates
        all occur; MANDARIN rows carry padded text and (LEMON, 12/2LB) has an
        extra ``RPC`` method row, both of which the load step must absorb.
        """
        pa = self.part_attrs
        g = pa.groupBy("p_commtype", "p_commodity", "p_form").agg(
            F.min("p_retailprice").alias("price"))
        ci = F.when(F.col("p_commtype") == "ORG", 0).otherwise(1)
        mi = (F.when(F.col("p_commodity") == "LEMON", 0).when(F.col("p_commodity") == "MANDARIN", 1)
              .when(F.col("p_commodity") == "BLOOD", 2).when(F.col("p_commodity") == "STEMLEAF", 3)
              .otherwise(4))
        k = F.col("p_form")
        style = _pick(k, ["12/2LB", "10/3LB", "25LB", "15/2LB", "12LB", "8/3LB", "FIELD BIN"])
        bag = _pick(k, ["GIRO", "NET", "BULK", "POUCH", "CLAM", "COMBO", "BULK"])
        g = g.select("*", ci.alias("ci"), mi.alias("mi"), style.alias("style"), bag.alias("bag"))
        # variant 0 = exact form, 1 = GIRO row of the same style, 2 = RPC method duplicate
        g = g.withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        keep = (F.when(F.col("variant") == 0, F.pmod(F.col("ci") + F.col("mi") + k, F.lit(4)) != 0)
                .when(F.col("variant") == 1, F.col("p_form").isin(1, 2, 3, 5)
                      & (F.pmod(F.col("ci") + 2 * F.col("mi") + k, F.lit(3)) != 0))
                .otherwise((F.col("mi") == 0) & (k == 0)))
        g = g.filter(keep & (k != 6))
        pad = F.col("mi") == 1
        charge = (F.col("price") / 100 - F.when(F.col("variant") == 1, 0.25).otherwise(0.0)
                  + F.when(F.col("variant") == 2, 1.0).otherwise(0.0))
        return g.select(
            F.col("p_commtype").alias("commtype"),
            F.col("p_commodity").alias("commodity"),
            F.when(pad, F.concat(F.lit(" "), F.col("style"), F.lit(" "))).otherwise(F.col("style"))
             .alias("style"),
            F.when(F.col("variant") == 1, F.lit("GIRO")).otherwise(F.col("bag")).alias("bagtype"),
            F.when(F.col("variant") == 2, F.lit("RPC")).otherwise(F.lit(None)).alias("method"),
            charge.cast(RATE).alias("charge"),
        )

    @cached_property
    def storage_sheet(self) -> DataFrame:
        """The STORAGE tab as rows ``(sheet_id, row_no, a, b, c, d)``.

        One header row per (commtype, commodity) group present in ``part``,
        followed by one row per pack form. Column c holds 60 / cartons per
        pallet, column d an override for oranges, one label per group has no
        style (dropped) and STEMLEAF's CLAM rate is a spreadsheet error.
        """
        pa = self.part_attrs
        groups = pa.select("p_commtype", "p_commodity").distinct()
        forms = pa.select("p_commtype", "p_commodity", "p_form").distinct()
        gi = (F.when(F.col("p_commtype") == "ORG", 0).otherwise(5)
              + F.when(F.col("p_commodity") == "LEMON", 0).when(F.col("p_commodity") == "MANDARIN", 1)
              .when(F.col("p_commodity") == "BLOOD", 2).when(F.col("p_commodity") == "STEMLEAF", 3)
              .otherwise(4))
        word = (F.when(F.col("p_commodity") == "STEMLEAF", "STEM LEAF")
                .when(F.col("p_commodity") == "ORANGE", "CARAS ORANGE")
                .otherwise(F.col("p_commodity")))
        header = groups.select(
            F.lit("STORAGE").alias("sheet_id"),
            (gi * 20).cast("int").alias("row_no"),
            F.concat(F.when(F.col("p_commtype") == "ORG", "ORGANIC ").otherwise(""), word,
                     F.when(F.col("p_commtype") == "ORG", F.lit(" COLD STORAGE RATES"))
                     .otherwise(F.lit(" PACKING RATES"))).alias("a"),
            F.lit(None).cast("string").alias("b"),
            F.lit("RATE").alias("c"),
            F.lit(None).cast("string").alias("d"))
        k = F.col("p_form")
        label = _pick(k, ["12/2# BAG", "10/3# NET BAG", "25# VF CARTON", "15/2# POUCH BAG",
                          "12# CLAM SHELL", "8/3 # COMBO", "TRI-WALL BIN"])
        label = F.when((k == 0) & (F.col("p_commtype") == "ORG"), F.lit("12/2# GIRO BAG")) \
                 .when((k == 2) & (F.col("p_commodity") == "LEMON"), F.lit("EURO TRAY")) \
                 .otherwise(label)
        ctns = _pick(k, ["80", "100", "60", "90", "120", "110", "1"])
        c = F.format_string("%.6f", F.lit(60.0) / ctns.cast("double"))
        c = F.when((k == 4) & (F.col("p_commodity") == "STEMLEAF"), F.lit("#DIV/0!")).otherwise(c)
        d = F.when(F.col("p_commodity") == "ORANGE", F.format_string("%.5f", F.lit(55.0) / ctns.cast("double")))
        body = forms.select(
            F.lit("STORAGE").alias("sheet_id"), (gi * 20 + k + 1).cast("int").alias("row_no"),
            label.alias("a"), ctns.alias("b"), c.alias("c"), d.alias("d"))
        return header.unionByName(body)

    # ------------------------------------------------------ ops-entered costs
    def _orders_of(self, priority: str) -> DataFrame:
        """The orders of one priority: each table of entered costs takes one of them whole."""
        return (self.driver.table("orders")
                .filter(F.col("o_orderpriority") == priority)
                .select("o_orderkey", "o_custkey", "o_orderdate"))

    @cached_property
    def labor_charges(self) -> DataFrame:
        o = self._orders_of("4-NOT SPECIFIED")
        nl = (F.pmod("o_custkey", F.lit(7)) + 1).cast(QTY)
        hr = ((F.pmod("o_custkey", F.lit(9)) + 1).cast(QTY) / 2).cast(QTY)
        rate = F.lit("18.75").cast(RATE)
        return o.select(
            F.floor(F.col("o_orderkey") / 4).cast("long").alias("icrunidx"),
            F.when(F.pmod("o_orderkey", F.lit(1000)) == 0, F.lit("bad"))
             .otherwise(F.date_format(billing_week(F.to_date("o_orderdate")), "yyyy-MM-dd"))
             .alias("week_end"),
            F.lit("REPACK").alias("productdescr"),
            (F.pmod("o_custkey", F.lit(40)) + 1).cast(QTY).alias("quantity"),
            nl.alias("num_laborers"), hr.alias("hours_per_laborer"), rate.alias("labor_rate"),
            F.bround(nl * hr * rate, 2).cast(MONEY).alias("labor_charge"),
        )

    @cached_property
    def repack_materials(self) -> DataFrame:
        o = self._orders_of("5-LOW")
        qty = (F.pmod("o_custkey", F.lit(5)) + 1).cast(QTY)
        cost = ((F.pmod("o_custkey", F.lit(13)) + 2).cast(RATE) / 4).cast(RATE)
        return o.select(
            F.floor(F.col("o_orderkey") / 4).cast("long").alias("icrunidx"),
            F.when(F.pmod("o_orderkey", F.lit(1400)) == 0, F.lit("2024-13-45"))
             .otherwise(F.date_format(billing_week(F.to_date("o_orderdate")), "yyyy-MM-dd"))
             .alias("week_end"),
            F.lit("REPACK").alias("productdescr"),
            (F.pmod("o_custkey", F.lit(40)) + 1).cast(QTY).alias("quantity"),
            F.lit("CHEP").alias("material_descr"), qty.alias("material_qty"),
            cost.alias("unit_cost"), F.round(qty * cost, 2).cast(MONEY).alias("materials_charge"),
        )

    # ------------------------------------------------------ run submissions
    @cached_property
    def run_submissions(self) -> DataFrame:
        """Time-and-materials documents: one per order, children from its line items.

        Labor lines pay the line's extended price; material lines price the line
        quantity at the part's retail price / 100 (no price on line 2, so the
        submitted total stands). Every 20th run sends its materials under the
        ``materials`` alias; every 70th has no run date; every 3rd customer leaves
        the overhead rate blank.
        """
        o = (self.driver.table("orders")
             .select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"))
        li = self.driver.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
        li = li.join(self.part_attrs.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"),
                     "l_partkey", "left")
        n = F.col("l_linenumber")
        labor = F.struct(
            F.when(n == 3, F.lit(None)).otherwise(n).cast("int").alias("seq"),
            _pick(n, ["", "Input Set-on", "Grader", "Packers", "Machine Operator", "Palletizers",
                      "Forklift Driver", "Tally"]).alias("position"),
            n.cast(QTY).alias("num_workers"), F.lit(8).cast(QTY).alias("reg_hours"),
            F.pmod(n, F.lit(3)).cast(QTY).alias("ot_hours"),
            (F.pmod(n, F.lit(3)) + 8).cast(QTY).alias("total_hours"),
            F.lit(None).cast(MONEY).alias("reg_pay"), F.lit(None).cast(MONEY).alias("ot_pay"),
            F.col("l_extendedprice").cast(MONEY).alias("total_pay"))
        price = F.when(n == 2, F.lit(None)).otherwise((F.col("p_retailprice") / 100).cast(RATE))
        material = F.struct(
            n.cast("int").alias("seq"),
            _pick(F.pmod(n, F.lit(3)), ["pallet", "corner_board", "other"]).alias("category"),
            _pick(F.pmod(n, F.lit(3)), ["CHEP", "Pallet Cover", "40lb Tops"]).alias("material"),
            F.col("l_quantity").cast(QTY).alias("quantity"), price.alias("price_per_unit"),
            F.col("l_extendedprice").cast(MONEY).alias("total"))
        io = F.struct(n.cast("int").alias("seq"),
                      F.when(F.pmod(n, F.lit(2)) == 0, "output").otherwise("input").alias("io"),
                      F.col("l_quantity").cast(QTY).alias("boxes"), F.lit("LBL").alias("label"),
                      F.lit("CTN").alias("pack_style"), F.lit("56").alias("size"))
        defect = F.struct(n.cast("int").alias("seq"), F.lit("Scarring").alias("defect_type"),
                          F.col("l_partkey").cast("string").alias("value"))
        # a document holds its own lines, as submitted: the arrays are bounded by one document
        kids = li.groupBy("l_orderkey").agg(
            F.sort_array(F.collect_list(F.struct(n.alias("k"), labor.alias("v")))).alias("_l"),
            F.sort_array(F.collect_list(F.struct(n.alias("k"), material.alias("v")))).alias("_m"),
            F.sort_array(F.collect_list(F.struct(n.alias("k"), io.alias("v")))).alias("_i"),
            F.sort_array(F.collect_list(F.when(n == 1, F.struct(n.alias("k"), defect.alias("v")))))
            .alias("_d"))
        j = o.join(kids, o["o_orderkey"] == kids["l_orderkey"], "left")
        vals = lambda c: F.transform(F.coalesce(F.col(c), F.array()), lambda x: x["v"])
        alias = F.pmod("o_orderkey", F.lit(20)) == 0
        mats = vals("_m")
        return j.select(
            F.col("o_orderkey").alias("run_no"),
            F.when(F.pmod("o_orderkey", F.lit(70)) == 0, F.lit(None).cast("date"))
             .otherwise(F.to_date("o_orderdate")).alias("run_date"),
            F.lit(None).cast("string").alias("run_type"), F.lit("CTN TO BAG").alias("note"),
            F.lit("HARBOR PACKING").alias("company"), F.lit("ORG ORANGE").alias("commodity"),
            F.lit("VALENCIA").alias("varieties"),
            _pick(F.pmod("o_custkey", F.lit(3)), ["REPACK-QUALITY", "PACK", "RESTYLE"]).alias("repack"),
            F.lit(None).cast("string").alias("restyle"), F.lit("0.85").cast(QTY).alias("pack_out_pct"),
            F.lit("06:00").alias("start_time"), F.lit("11:30").alias("start_lunch"),
            F.lit("12:00").alias("end_lunch"), F.lit("15:30").alias("finish_time"),
            F.lit(None).cast(QTY).alias("input_units"), F.lit(None).cast(QTY).alias("output_units"),
            F.when(F.pmod("o_custkey", F.lit(3)) == 0, F.lit(None).cast(RATE))
             .otherwise((F.lit(10) + F.pmod("o_custkey", F.lit(10))).cast(RATE) / 100).cast(RATE)
             .alias("overhead_rate"),
            F.when(F.col("o_orderstatus") == "F", "submitted").otherwise("draft").alias("status"),
            vals("_l").alias("labor"), vals("_i").alias("io"),
            # the alias is used when ``material`` is missing (NULL) or empty
            F.when(alias & (F.pmod("o_orderkey", F.lit(40)) == 0), F.filter(mats, lambda x: F.lit(False)))
             .when(alias, F.lit(None)).otherwise(mats).alias("material"),
            F.when(alias, mats).otherwise(F.lit(None)).alias("materials"),
            vals("_d").alias("defect"))

    # --------------------------------------------------- shipping charges
    @cached_property
    def shipping_charges_report(self) -> DataFrame:
        """Weekly shipping-charges report (S4 input): mixed-case headers plus extra columns.

        Every line of an order is a charge row (the first freight, the others pallet charges); every 13th
        part leaves the amount blank. ``week_folder`` names the report's week.
        """
        li = self.driver.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_tax", "l_shipdate")
        rate = (F.col("l_tax") * 100).cast(RATE)
        qty = F.col("l_quantity").cast(QTY)
        return li.select(
            F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("ShipDateTime"),
            F.col("l_orderkey").cast("string").alias("SONO"),
            F.when(F.col("l_linenumber") == 1, "FREIGHT").otherwise("PALLET CHARGE").alias("ChargeDescr"),
            qty.alias("Qnt"), rate.alias("Rate"),
            F.when(F.pmod("l_partkey", F.lit(13)) == 0, F.lit(None).cast(MONEY))
             .otherwise(F.round(qty * rate, 2).cast(MONEY)).alias("Amt"),
            F.lit("RDL").alias("Whse"),
            F.concat(F.lit("WE "), F.date_format(billing_week(F.to_date("l_shipdate")), "MM.dd.yyyy"))
            .alias("week_folder"))

    @cached_property
    def certificates(self) -> DataFrame:
        """Certificate extractions (S8): one per order, debit rows from its line items.

        Debit row numbers are, by line: an unrelated number, the certificate in
        lower case with spaces (amount missing), the exact number, then longer
        numbers that must not match. Order number 0 every 90th, missing every 150th.
        """
        o = self.driver.table("orders").select("o_orderkey", "o_orderdate")
        k = F.col("o_orderkey").cast("string")
        li = self.driver.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_shipdate")
        n = F.col("l_linenumber")
        lk = F.col("l_orderkey").cast("string")
        number = (F.when(n == 1, F.concat(F.lit("X-"), F.col("l_partkey").cast("string")))
                  .when(n == 2, F.concat(F.lit(" s c "), lk, F.lit(" ca")))
                  .when(n == 3, F.concat(F.lit("S-C-"), lk, F.lit("-CA")))
                  .otherwise(F.concat(F.lit("S-C-"), lk, F.lit("-CA-"), n.cast("string"))))
        row = F.struct(number.alias("certificate_number"),
                       F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
                       F.when(n == 2, F.lit(None).cast(MONEY))
                        .otherwise(F.col("l_extendedprice").cast(MONEY)).alias("debit_amount"))
        # array order = (line, part, ship date, price): line numbers repeat within an order
        rows = li.groupBy("l_orderkey").agg(
            F.sort_array(F.collect_list(F.struct(n.alias("k"), F.col("l_partkey").alias("k2"),
                                                 F.col("l_shipdate").alias("k3"),
                                                 F.col("l_extendedprice").alias("k4"), row.alias("v"))))
            .alias("_r"))
        j = o.join(rows, o["o_orderkey"] == rows["l_orderkey"], "left")
        return j.select(
            F.concat(F.lit("WE "), F.date_format(billing_week(F.to_date("o_orderdate")), "MM.dd.yyyy"))
            .alias("week_folder"),
            F.concat(F.lit("phyto_"), k, F.lit(".pdf")).alias("file"),
            F.concat(F.lit("S-C-"), k, F.lit("-CA")).alias("current_certificate_number"),
            F.lit(None).cast("string").alias("replaced_certificate_number"),
            F.when(F.pmod("o_orderkey", F.lit(150)) == 0, F.lit(None).cast("long"))
             .when(F.pmod("o_orderkey", F.lit(90)) == 0, F.lit(0).cast("long"))
             .otherwise(F.col("o_orderkey")).alias("order_number"),
            F.transform(F.coalesce("_r", F.array()), lambda x: x["v"]).alias("debit_rows"))
