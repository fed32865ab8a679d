"""Missing-data handling (FN22, and the no-data codes behind CLN1 and VAL2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The no-data markers of the tapes.
NO_DATA_CODES = ("ND", *(f"ND{i}" for i in range(10)))
NO_DATA_PREFIX = "ND"
CRE_NO_DATA = ("", "ND", "ND1", "ND2", "ND3", "ND4", "ND5", "NA")


def is_no_data(col: Column, mode: str = "pattern") -> Column:
    """True for a no-data code; ``prefix`` also takes any text that starts with ND."""
    if mode == "prefix":
        return col.startswith(NO_DATA_PREFIX)
    if mode == "pattern":
        return col.isin(*NO_DATA_CODES)
    raise ValueError(f"unknown no-data mode {mode!r}")


def null_no_data(col: Column, mode: str = "pattern") -> Column:
    return F.when(~is_no_data(col, mode), col)


def null_blank(col: Column, mode: str = "pattern") -> Column:
    """Empty text and no-data codes become null."""
    return F.when((col != "") & ~is_no_data(col, mode), col)


def cre_value(col: Column) -> Column:
    """Trimmed text, null for the commercial-real-estate no-data set."""
    text = F.trim(col)
    return F.when(~text.isin(*CRE_NO_DATA), text)


def first_non_empty(*cols: Column) -> Column:
    """The first alternative that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in cols])


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, null where den is zero."""
    return num / F.nullif(den, F.lit(0))


def fill_missing(df: DataFrame, cols: list[str], value: float = -999) -> DataFrame:
    """Fill nulls and NaN of numeric feature columns with one marker."""
    wanted = set(cols)
    return df.select(
        *[
            F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(float(value))).alias(c)
            if c in wanted
            else F.col(c)
            for c in df.columns
        ]
    )
