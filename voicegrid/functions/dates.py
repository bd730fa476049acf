"""Review dates: parsing, months and Monday-ending weeks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The day-first date formats that occur in review exports, tried in this order.
DAY_FIRST = ("d/M/yyyy", "d/M/yy", "yyyy-MM-dd", "d-M-yyyy")
MONTH_FIRST = ("M/d/yyyy", "M/d/yy", "yyyy-MM-dd", "M-d-yyyy")


def parse_strict(text: Column) -> Column:
    """``dd/MM/yyyy`` or an error (sessions run with ANSI mode on)."""
    return F.to_date(text, "dd/MM/yyyy")


def parse_lenient(text: Column, formats: Sequence[str] = DAY_FIRST) -> Column:
    """First format that fits, else NULL."""
    return F.coalesce(*[F.try_to_date(text, f) for f in formats])


def month_start(date: Column) -> Column:
    return F.trunc(date, "MM")


def month_text(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def week_ending_monday(date: Column) -> Column:
    """The Monday that closes the Tuesday-to-Monday week of ``date``."""
    return F.next_day(F.date_sub(date, 1), "MON")
