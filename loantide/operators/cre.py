"""Commercial real estate exposures (RSH4, VAL6, VAL7)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from loantide.functions.nulls import cre_value
from loantide.functions.text import number_with_commas
from loantide.operators.silver import restrict

# Output name -> alternative field codes, and the rule names.
TEXT_FIELDS = {
    "deal_id": ("CREL1",),
    "obligor_id": ("CREL3", "CREL2"),
    "loan_id": ("CREL5", "CREL4"),
    "property_type": ("CREL26",),
    "country": ("CREL19",),
    "default_status": ("CREL68",),
    "special_servicing": ("CREL71",),
}
NUMBER_FIELDS = {
    "current_balance": ("CREL41", "CREL40"),
    "appraised_value": ("CREL32",),
    "dscr": ("CREL44",),
    "occupancy_rate": ("CREL59",),
}
RULES = ("negative_current_balance", "occupancy_out_of_range", "missing_loan_id", "non_numeric_dscr")
REQUIRED = ("CREL1", "CREL4")


def cre_normalise(df: DataFrame, allowed: Iterable[str] | None = None) -> DataFrame:
    """Business names for field codes, numbers without commas, and the raw values as a map (RSH4)."""
    raw = df if allowed is None else restrict(df, allowed)
    have = set(raw.columns)
    value = lambda c: cre_value(F.col(c)) if c in have else F.lit(None).cast("string")
    first = lambda codes: F.coalesce(*[value(c) for c in codes])
    return raw.select(
        *[first(codes).alias(n) for n, codes in TEXT_FIELDS.items()],
        *[number_with_commas(first(codes)).alias(n) for n, codes in NUMBER_FIELDS.items()],
        F.map_from_arrays(F.array(*[F.lit(c) for c in raw.columns]), F.array(*[value(c) for c in raw.columns])).alias("raw"),
    )


def cre_validate(df: DataFrame) -> DataFrame:
    """Add ``validation``: is_valid and the names of the broken rules (VAL6)."""
    occupancy = F.col("occupancy_rate")
    broken = [
        F.col("current_balance") < 0,
        (occupancy < 0) | (occupancy > 100),
        F.col("loan_id").isNull(),
        F.try_element_at("raw", F.lit("CREL44")).isNotNull() & F.col("dscr").isNull(),
    ]
    failed = F.array_compact(F.array(*[F.when(c, name) for name, c in zip(RULES, broken)]))
    return df.withColumn("validation", F.struct((F.size(failed) == 0).alias("is_valid"), failed.alias("failed_rules")))


def cre_summary(df: DataFrame) -> DataFrame:
    """Counts of valid and invalid rows, per rule, and of rows without identifiers (VAL7)."""
    valid = F.col("validation.is_valid")
    lost = [F.try_element_at("raw", F.lit(c)).isNull() for c in REQUIRED]
    return df.agg(
        F.count(F.lit(1)).alias("record_count"),
        F.count_if(lost[0] | lost[1]).alias("rows_missing_primary_identifiers"),
        F.count_if(valid).alias("valid_record_count"),
        F.count_if(~valid).alias("invalid_record_count"),
        *[F.count_if(F.array_contains("validation.failed_rules", r)).alias(r) for r in RULES],
    )
