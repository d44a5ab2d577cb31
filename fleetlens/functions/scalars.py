"""Small column helpers shared by the operators."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def pct(part: Column, whole: Column) -> Column:
    """``part`` as a percentage of ``whole``, one decimal.

    Divided as decimals, so x.x5 ties round half up and never depend on binary
    fractions; NULL when ``whole`` is zero.
    """
    return F.round(part * F.lit(Decimal("100.0")) / F.nullif(whole, F.lit(0)), 1).cast("double")


def gap_pct(caught_pct: Column) -> Column:
    """Share that slipped through; an unknown catch rate counts as nothing caught."""
    return F.lit(100.0) - F.coalesce(caught_pct, F.lit(0.0))


def is_fail(status: Column) -> Column:
    return F.upper(status) == "FAIL"


def month_of(date: Column) -> Column:
    """First day of the month as a zone-free timestamp."""
    return F.trunc(date, "month").cast("timestamp_ntz")


def wall_to_instant(wall: str) -> Column:
    """Zone-free time column as the instant it names in UTC, in any session zone."""
    return F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, "
                  f"TIMESTAMP_NTZ '1970-01-01 00:00:00', {wall}))")


def instant_to_wall(instant: str) -> Column:
    """Inverse of :func:`wall_to_instant`."""
    return F.expr(f"timestampadd(MICROSECOND, unix_micros({instant}), "
                  "TIMESTAMP_NTZ '1970-01-01 00:00:00')")


def not_blank(text: Column) -> Column:
    """Text that is more than white space; NULL is blank."""
    return F.coalesce(F.btrim(text, F.lit(" \t\n\r\f\v")) != "", F.lit(False))


def digits_to_bigint(identifier: Column) -> Column:
    """Numeric part of an id such as ``CC-1709``; NULL if it holds no digit."""
    return F.regexp_replace(identifier.cast("string"), "[^0-9]", "").try_cast("bigint")
