"""Data-centre facilities: bronze flag, silver ratios, rollups and quality (VAL8, VAL9, FN9, FN10, AGG21, AGG22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loantide.functions import loanmath as M
from loantide.functions.dates import coerce_number
from loantide.operators.bronze import facility_bronze_columns

# Numeric, critical and non-negative fields of a facility row.
NUMERIC_FIELDS = (
    "gross_revenue_eur", "energy_cost_eur", "opex_eur", "debt_service_eur",
    "market_value_eur", "outstanding_debt_eur", "it_load_mw", "leased_capacity_mw",
)
CRITICAL_FIELDS = (
    "facility_id", "sponsor", "country", "report_date", "gross_revenue_eur", "debt_service_eur", "market_value_eur",
)
NON_NEGATIVE_FIELDS = ("it_load_mw", "leased_capacity_mw", "debt_service_eur", "market_value_eur", "gross_revenue_eur")


def dc_bronze(df: DataFrame, ingested_at: str) -> DataFrame:
    """Row hash, ingest time and whether all numeric fields can be read (VAL8, SCD5)."""
    present = set(df.columns)
    readable = [coerce_number(F.col(c)).isNotNull() if c in present else F.lit(False) for c in NUMERIC_FIELDS]
    ok = readable[0]
    for r in readable[1:]:
        ok = ok & r
    return facility_bronze_columns(df, ingested_at).withColumn("_is_valid_numeric", ok)


def dc_silver(bronze: DataFrame) -> DataFrame:
    """Credit ratios and covenant status of the readable rows (FN9, FN10)."""
    n = {c: coerce_number(F.col(c)) for c in NUMERIC_FIELDS}
    noi = M.net_operating_income(n["gross_revenue_eur"], n["energy_cost_eur"], n["opex_eur"])
    cover = M.dscr(noi, n["debt_service_eur"])
    debt = M.facility_ltv(n["outstanding_debt_eur"], n["market_value_eur"])
    return bronze.where("_is_valid_numeric").select(
        "facility_id", "sponsor", "country", "report_date",
        F.round(noi, 2).alias("noi_eur"),
        F.round(cover, 3).alias("dscr"),
        F.round(debt, 2).alias("ltv_pct"),
        F.round(M.occupancy(n["leased_capacity_mw"], n["it_load_mw"]), 2).alias("occupancy_pct"),
        F.round(M.energy_ratio(n["energy_cost_eur"], n["gross_revenue_eur"]), 2).alias("energy_cost_ratio_pct"),
        M.covenant_status(cover, debt).alias("junior_note_watch_status"),
    )


def _averages() -> list[Column]:
    status = F.col("junior_note_watch_status")
    # means of rounded figures often end in a 5: the decimal keeps the order of summing out of the result
    mean = lambda c, digits: F.round(F.avg(c).cast("decimal(30,9)"), digits).cast("double").alias(f"avg_{c}")
    return [
        F.count(F.lit(1)).alias("facility_count"),
        mean("dscr", 3),
        mean("ltv_pct", 2),
        mean("occupancy_pct", 2),
        F.count_if(status == "breach").alias("breach_count"),
        F.count_if(status == "watch").alias("watch_count"),
    ]


def sponsor_rollup(silver: DataFrame) -> DataFrame:
    """Averages and covenant counts per sponsor (AGG21)."""
    return silver.groupBy("sponsor").agg(*_averages())


def portfolio_dashboard(silver: DataFrame, as_of: str) -> DataFrame:
    """The same over all facilities; averages are null when there are none (AGG22)."""
    return silver.agg(*_averages()).withColumn("as_of", F.lit(as_of))


def quality_report(df: DataFrame) -> DataFrame:
    """Missing, invalid and suspicious values, and a score out of 100 (VAL9). One aggregation."""
    present = set(df.columns)
    text = lambda c: F.trim(F.col(c).cast("string")) if c in present else F.lit(None).cast("string")
    missing = lambda c: text(c).isNull() | (text(c) == "")
    date = text("report_date")
    bad_date = missing("report_date") | ~date.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") | date.try_cast("date").isNull()
    bad_number = lambda c: missing(c) | text(c).try_cast("double").isNull()
    critical = missing(CRITICAL_FIELDS[0])
    for c in CRITICAL_FIELDS[1:]:
        critical = critical | missing(c)
    plus = lambda cols: sum(cols[1:], cols[0])
    out = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(missing("facility_id")).alias("missing_key_identifiers"),
        F.count_if(critical).alias("missing_critical_fields"),
        F.count_if(bad_date).alias("invalid_dates"),
        plus([F.count_if(bad_number(c)) for c in NUMERIC_FIELDS]).alias("invalid_numeric_values"),
        plus([F.count_if(text(c).try_cast("double") < 0) for c in NON_NEGATIVE_FIELDS]).alias("suspicious_values"),
    )
    issues = plus([F.col(c) for c in out.columns[1:]])
    score = 100.0 - issues / F.greatest(F.col("row_count"), F.lit(1)) * 10.0
    return out.withColumn("overall_quality_score", F.round(F.greatest(F.lit(0.0), score), 2))
