"""Dates: loan age and term (FN13), parts and checks (FN14), BI grains (FN15), coercion (VAL3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


def seasoning_months(report_date: Column, origination_year: Column) -> Column:
    """Months since July of the origination year, at least 1."""
    age = (F.year(report_date) - origination_year) * 12 + F.month(report_date) - 7
    return F.greatest(age, F.lit(1)).cast("int")


def remaining_term(legal_maturity: Column, seasoning: Column, floor: int = 0) -> Column:
    return F.greatest(legal_maturity - seasoning, F.lit(floor)).cast("int")


def maturity_date(origination_year: Column, legal_maturity: Column) -> Column:
    """The 28th of the month reached after the legal maturity."""
    year = origination_year + F.floor(legal_maturity / 12)
    return F.make_date(year.cast("int"), (F.pmod(legal_maturity, F.lit(12)) + 1).cast("int"), F.lit(28))


def first_business_day(year: Column, month: Column) -> Column:
    """First weekday of the month."""
    first = F.make_date(year, month, F.lit(1))
    day = F.dayofweek(first)  # 1 = Sunday, 7 = Saturday
    return F.date_add(first, F.when(day == 1, 1).when(day == 7, 2).otherwise(0))


def month_ends(start: Column, n: int) -> Column:
    """Array of ``n`` month ends, the first being that of ``start``."""
    first = F.trunc(start, "month")
    months = F.sequence(first, F.add_months(first, n - 1), F.expr("interval 1 month"))
    return F.transform(months, lambda d: F.last_day(d))


def is_iso_date(col: Column) -> Column:
    return col.cast("string").rlike(ISO_DATE)


def day_difference(end: Column, start: Column) -> Column:
    return F.datediff(end, start)


def coerce_date(text: Column) -> Column:
    """Date from ``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD``; null for anything else.

    The cast itself reads the three forms; the conditions keep out the others that it reads.
    """
    plain = ~F.contains(text, F.lit("T")) & ~F.contains(text, F.lit(" ")) & ~text.startswith("-")
    full = (F.substring(text, 5, 1) == "-") & (F.length(text) <= 10)
    return F.when(plain & ((F.length(text) == 4) | full), text.try_cast("date"))


PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def coerce_number(text: Column) -> Column:
    """Decimal numbers, also with an exponent; null for anything else, and for numbers beyond a double.

    The cast itself also reads ``5d``, ``1f``, ``0x1p3``, ``NaN`` and ``Infinity``.
    """
    trimmed = F.trim(text)
    value = trimmed.try_cast("double")
    return F.when(trimmed.rlike(PLAIN_NUMBER) & (F.abs(value) < float("inf")), value)


def coerce_integer(text: Column) -> Column:
    trimmed = F.trim(text)
    # the cast would also read "1.5"
    return F.when(~F.contains(trimmed, F.lit(".")), trimmed.try_cast("int"))


GRAINS = ("raw", "date", "week", "month", "quarter", "year", "day_of_month", "quarter_of_year")


def time_grains(df: DataFrame, col: str) -> DataFrame:
    """Add the reporting grains of one date column, named ``{col}_{grain}``."""
    c = F.col(col)
    grains = {
        "raw": c,
        "date": F.to_date(c),
        "week": F.to_date(F.date_trunc("week", c)),
        "month": F.date_format(c, "yyyy-MM"),
        "quarter": F.to_date(F.date_trunc("quarter", c)),
        "year": F.year(c),
        "day_of_month": F.dayofmonth(c),
        "quarter_of_year": F.concat(F.lit("Q"), F.quarter(c)),
    }
    return df.select("*", *[grains[g].alias(f"{col}_{g}") for g in GRAINS])
