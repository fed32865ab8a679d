"""Ordinal buckets (FN1): right-closed intervals with fixed labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class BucketSpec:
    """``uppers[i]`` is the closed upper edge of ``labels[i]``; the last label is open-ended."""

    low: float
    include_low: bool
    uppers: tuple
    labels: tuple


# Edges and labels of the five bucket families.
BALANCE = BucketSpec(
    0, True,
    (100_000, 150_000, 200_000, 250_000, 300_000, 350_000, 400_000, 450_000, 500_000, 550_000, 600_000, 1e12),
    ("<100k", "100k-150k", "150k-200k", "200k-250k", "250k-300k", "300k-350k",
     "350k-400k", "400k-450k", "450k-500k", "500k-550k", "550k-600k", "600k+"),
)
LTV = BucketSpec(
    -1, False,
    (20, 30, 40, 50, 60, 70, 80, 90, 100, 1e6),
    ("<20", "20-30", "30-40", "40-50", "50-60", "60-70", "70-80", "80-90", "90-100", "100+"),
)
LTI = BucketSpec(
    -1, False,
    (1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0, 1e6),
    ("<1.5", "1.5-2.0", "2.0-2.5", "2.5-3.0", "3.0-3.5", "3.5-4.0",
     "4.0-4.5", "4.5-5.0", "5.0-5.5", "5.5-6.0", "6.0+"),
)
DSTI = BucketSpec(
    -1, False,
    (5, 10, 15, 20, 25, 30, 35, 1e6),
    ("<5", "5-10", "10-15", "15-20", "20-25", "25-30", "30-35", "35+"),
)
YEAR = BucketSpec(
    -1, False,
    (1945, 1960, 1970, 1980, 1985, 1990, 1995, 2000, 2005, 2010, 2015, 9999),
    ("<1945", "1945-1960", "1960-1970", "1970-1980", "1980-1985", "1985-1990",
     "1990-1995", "1995-2000", "2000-2005", "2005-2010", "2010-2015", "2015+"),
)


def bucket(col: Column, spec: BucketSpec) -> Column:
    """Label of the interval ``(previous edge, edge]`` that holds the value; null outside."""
    below = (col < spec.low) if spec.include_low else (col <= spec.low)
    out = F.when(below, F.lit(None).cast("string"))
    for upper, label in zip(spec.uppers, spec.labels):
        out = out.when(col <= upper, label)
    return out


def bucket_order(col: Column, spec: BucketSpec) -> Column:
    """Position of a bucket label, for ordering reports."""
    return F.array_position(F.array(*[F.lit(x) for x in spec.labels]), col)


def balance_bucket(col: Column) -> Column:
    return bucket(col, BALANCE)


def ltv_bucket(col: Column) -> Column:
    return bucket(col, LTV)


def lti_bucket(col: Column) -> Column:
    return bucket(col, LTI)


def dsti_bucket(col: Column) -> Column:
    return bucket(col, DSTI)


def year_bucket(col: Column) -> Column:
    return bucket(col, YEAR)
