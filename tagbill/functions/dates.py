"""Date column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text shapes the reports use.
MDY_PREFIX = r"^\d{2}/\d{2}/\d{4}"          # shipping report dates, "MM/DD/YYYY..."
ISO_DATE_FULL = r"^\d{4}-\d{2}-\d{2}$"      # week_end text on labor / material rows
WEEK_FOLDER = r"^WE (\d{2})\.(\d{2})\.(\d{4})$"  # shipping week folders, "WE mm.dd.yyyy"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def billing_week(d) -> Column:
    """Sunday on or after ``d`` (Spark's dayofweek: 1 = Sunday)."""
    d = _c(d)
    return F.date_add(d, F.pmod(F.lit(8) - F.dayofweek(d), F.lit(7)))


def guarded_mdy(s) -> Column:
    """``MM/DD/YYYY…`` text → date; other text, and impossible dates, → NULL."""
    s = _c(s)
    return F.when(s.rlike(MDY_PREFIX), F.try_to_date(F.substring(s, 1, 10), "MM/dd/yyyy"))


def guarded_iso(s) -> Column:
    """Whole-string ``YYYY-MM-DD`` → date, else NULL."""
    s = _c(s)
    return F.when(s.rlike(ISO_DATE_FULL), F.try_to_date(s, "yyyy-MM-dd"))


def week_folder_date(name) -> Column:
    """``WE mm.dd.yyyy`` → date; non-matching names and invalid dates → NULL."""
    name = _c(name)
    mm = F.regexp_extract(name, WEEK_FOLDER, 1)
    dd = F.regexp_extract(name, WEEK_FOLDER, 2)
    yyyy = F.regexp_extract(name, WEEK_FOLDER, 3)
    return F.when(name.rlike(WEEK_FOLDER),
                  F.try_to_date(F.concat_ws("-", yyyy, mm, dd), "yyyy-MM-dd"))


def week_folder_name(d) -> Column:
    """date → ``WE mm.dd.yyyy``."""
    return F.concat(F.lit("WE "), F.date_format(_c(d), "MM.dd.yyyy"))


def display_ship_date(s) -> Column:
    """Display form ``MM/dd/yyyy`` of a date-ish text; unparsable text kept, NULL → ''."""
    s = _c(s)
    parsed = F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")),
                        F.try_to_timestamp(s, F.lit("yyyy-MM-dd")),
                        F.try_to_timestamp(s, F.lit("MM/dd/yyyy HH:mm")),
                        F.try_to_timestamp(s, F.lit("MM/dd/yyyy")))
    return F.coalesce(F.date_format(parsed, "MM/dd/yyyy"), s, F.lit(""))
