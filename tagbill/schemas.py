"""Declared types of the domain tables (no schema inference anywhere)."""

from __future__ import annotations

from pyspark.sql import types as T

QTY = T.DecimalType(18, 4)      # carton / unit quantities
RATE = T.DecimalType(12, 4)     # per-unit rates
MONEY = T.DecimalType(18, 2)    # a rounded line amount
QTY_SUM = T.DecimalType(38, 4)  # totals of quantities across many lines
MONEY_SUM = T.DecimalType(38, 2)  # totals of money across many lines

REPACK_REPORT = T.StructType([
    T.StructField("rectype", T.StringType()), T.StructField("outputflag", T.StringType()),
    T.StructField("icrunidx", T.StringType()), T.StructField("tagid", T.StringType()),
    T.StructField("fcreasonidx", T.StringType()), T.StructField("productname", T.StringType()),
    T.StructField("qnt", T.StringType()), T.StructField("uom", T.StringType()),
    T.StructField("rundate", T.StringType()),
])

SHIPPING_RAW = T.StructType([
    T.StructField("pallet", T.LongType()), T.StructField("recordtype", T.IntegerType()),
    T.StructField("trxtype", T.IntegerType()), T.StructField("icqnt", QTY),
    T.StructField("sono", T.StringType()), T.StructField("lastconame", T.StringType()),
    T.StructField("shipdatetime", T.StringType()), T.StructField("recvdate", T.StringType()),
    T.StructField("productdescr", T.StringType()),
])

REPACK_TAGS = T.StructType([
    T.StructField("icrunidx", T.LongType()), T.StructField("tagid", T.LongType()),
    T.StructField("fcreasonidx", T.IntegerType()), T.StructField("productname", T.StringType()),
    T.StructField("qnt", QTY), T.StructField("uom", T.StringType()),
    T.StructField("rundate", T.DateType()),
])

BILLING_LINES = T.StructType([
    T.StructField("tagid", T.LongType()), T.StructField("icrunidx", T.LongType()),
    T.StructField("sono", T.StringType()), T.StructField("productname", T.StringType()),
    T.StructField("productdescr", T.StringType()), T.StructField("fcreasonidx", T.IntegerType()),
    T.StructField("shipped_qty", QTY), T.StructField("qnt", QTY),
    T.StructField("billed_amount", MONEY), T.StructField("ship_date", T.StringType()),
    T.StructField("week_end", T.StringType()), T.StructField("charge_type", T.StringType()),
    T.StructField("source", T.StringType()),
])

PACKING_RATES = T.StructType([
    T.StructField("commtype", T.StringType()), T.StructField("commodity", T.StringType()),
    T.StructField("style", T.StringType()), T.StructField("bagtype", T.StringType()),
    T.StructField("method", T.StringType()), T.StructField("charge", RATE),
])

STORAGE_RATES = T.StructType([
    T.StructField("commtype", T.StringType()), T.StructField("commodity", T.StringType()),
    T.StructField("style", T.StringType()), T.StructField("bagtype", T.StringType()),
    T.StructField("ctns_per_pallet", RATE), T.StructField("rate", RATE),
])

STORAGE_SHEET = T.StructType([
    T.StructField("sheet_id", T.StringType()), T.StructField("row_no", T.IntegerType()),
    T.StructField("a", T.StringType()), T.StructField("b", T.StringType()),
    T.StructField("c", T.StringType()), T.StructField("d", T.StringType()),
])

LABOR_CHARGES = T.StructType([
    T.StructField("icrunidx", T.LongType()), T.StructField("week_end", T.StringType()),
    T.StructField("productdescr", T.StringType()), T.StructField("quantity", QTY),
    T.StructField("num_laborers", QTY), T.StructField("hours_per_laborer", QTY),
    T.StructField("labor_rate", RATE), T.StructField("labor_charge", MONEY),
])

REPACK_MATERIALS = T.StructType([
    T.StructField("icrunidx", T.LongType()), T.StructField("week_end", T.StringType()),
    T.StructField("productdescr", T.StringType()), T.StructField("quantity", QTY),
    T.StructField("material_descr", T.StringType()), T.StructField("material_qty", QTY),
    T.StructField("unit_cost", RATE), T.StructField("materials_charge", MONEY),
])

LABOR_REQUESTS = T.StructType([
    T.StructField("week", T.StringType()), T.StructField("to_address", T.StringType()),
    T.StructField("run_count", T.IntegerType()), T.StructField("status", T.StringType()),
    T.StructField("sent_at", T.TimestampType()), T.StructField("received_at", T.TimestampType()),
])

LABOR_LINE = T.StructType([
    T.StructField("seq", T.IntegerType()), T.StructField("position", T.StringType()),
    T.StructField("num_workers", QTY), T.StructField("reg_hours", QTY),
    T.StructField("ot_hours", QTY), T.StructField("total_hours", QTY),
    T.StructField("reg_pay", MONEY), T.StructField("ot_pay", MONEY),
    T.StructField("total_pay", MONEY),
])
IO_LINE = T.StructType([
    T.StructField("seq", T.IntegerType()), T.StructField("io", T.StringType()),
    T.StructField("boxes", QTY), T.StructField("label", T.StringType()),
    T.StructField("pack_style", T.StringType()), T.StructField("size", T.StringType()),
])
MATERIAL_LINE = T.StructType([
    T.StructField("seq", T.IntegerType()), T.StructField("category", T.StringType()),
    T.StructField("material", T.StringType()), T.StructField("quantity", QTY),
    T.StructField("price_per_unit", RATE), T.StructField("total", MONEY),
])
DEFECT_LINE = T.StructType([
    T.StructField("seq", T.IntegerType()), T.StructField("defect_type", T.StringType()),
    T.StructField("value", T.StringType()),
])

RUN_PARENT_FIELDS = [
    T.StructField("run_no", T.LongType()), T.StructField("run_date", T.DateType()),
    T.StructField("run_type", T.StringType()), T.StructField("note", T.StringType()),
    T.StructField("company", T.StringType()), T.StructField("commodity", T.StringType()),
    T.StructField("varieties", T.StringType()), T.StructField("repack", T.StringType()),
    T.StructField("restyle", T.StringType()), T.StructField("pack_out_pct", QTY),
    T.StructField("start_time", T.StringType()), T.StructField("start_lunch", T.StringType()),
    T.StructField("end_lunch", T.StringType()), T.StructField("finish_time", T.StringType()),
    T.StructField("input_units", QTY), T.StructField("output_units", QTY),
    T.StructField("overhead_rate", RATE), T.StructField("status", T.StringType()),
]

RUN_SUBMISSION = T.StructType(RUN_PARENT_FIELDS + [
    T.StructField("labor", T.ArrayType(LABOR_LINE)),
    T.StructField("io", T.ArrayType(IO_LINE)),
    T.StructField("material", T.ArrayType(MATERIAL_LINE)),
    T.StructField("materials", T.ArrayType(MATERIAL_LINE)),
    T.StructField("defect", T.ArrayType(DEFECT_LINE)),
])

DEBIT_ROW = T.StructType([
    T.StructField("certificate_number", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("debit_amount", MONEY),
])

CERT_EXTRACTION = T.StructType([
    T.StructField("week_folder", T.StringType()), T.StructField("file", T.StringType()),
    T.StructField("current_certificate_number", T.StringType()),
    T.StructField("replaced_certificate_number", T.StringType()),
    T.StructField("order_number", T.LongType()),
    T.StructField("debit_rows", T.ArrayType(DEBIT_ROW)),
])

SHIPPING_CHARGES = T.StructType([
    T.StructField("shipdatetime", T.StringType()), T.StructField("sono", T.StringType()),
    T.StructField("chargedescr", T.StringType()), T.StructField("qnt", QTY),
    T.StructField("rate", RATE), T.StructField("amt", MONEY),
])

NOTIFICATION = T.StructType([
    T.StructField("message_id", T.StringType()), T.StructField("client_state", T.StringType()),
    T.StructField("subject", T.StringType()), T.StructField("received_at", T.TimestampType()),
    T.StructField("week_folder", T.StringType()),
])

REPLY_ROW = T.StructType([
    T.StructField("icrunidx", T.LongType()), T.StructField("productdescr", T.StringType()),
    T.StructField("quantity", QTY_SUM), T.StructField("num_laborers", T.StringType()),
    T.StructField("hours_per_laborer", T.StringType()), T.StructField("week_end", T.StringType()),
    T.StructField("sent_at", T.TimestampType()),
])

SHIPPING_RUNS = T.StructType([
    T.StructField("week_folder", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("report_path", T.StringType()), T.StructField("trimmed_path", T.StringType()),
    T.StructField("combined_path", T.StringType()), T.StructField("xlsx_path", T.StringType()),
    T.StructField("result", T.StringType()), T.StructField("needs_review", T.StringType()),
    T.StructField("total", MONEY_SUM), T.StructField("erp_result", T.StringType()),
    T.StructField("error", T.StringType()), T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()), T.StructField("posted_at", T.TimestampType()),
])
