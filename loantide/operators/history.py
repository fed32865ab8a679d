"""Per-loan history operators (WIN1 to WIN12).

Every window here partitions by loan and orders by date. A panel holds one row per
loan and reporting date, so a partition never exceeds the number of reporting dates
however many raw rows a loan has; ``one_per_date`` enforces that key. It keeps one
row per group with ``row_number() = 1``, which Spark cuts down on the map side
before the shuffle, so a loan that owns a third of the raw rows does no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from loantide.functions.states import CHARGED_OFF, DEFAULTED, DELINQUENT_STATES, DPD_STATES, PERFORMING, REDEEMED

KEY, DATE = "loan_id", "reporting_date"
MONTHS_IN_DEFAULT_TO_CHARGE_OFF = 9


def by_loan() -> Window:
    return Window.partitionBy(KEY).orderBy(DATE)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in the given order (WIN5)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def one_per_date(df: DataFrame, latest: Sequence[str | Column]) -> DataFrame:
    """One row per loan and reporting date: the first in the ``latest`` order."""
    return first_per_key(df, [KEY, DATE], latest)


# The columns whose previous value the lifecycle checks read.
LAGGED = {
    "current_balance": "prev_balance",
    "arrears_amount": "prev_arrears",
    "performing_status": "prev_status",
    "arrears_bucket": "prev_bucket",
    "seasoning_months": "prev_seasoning",
    "remaining_term_months": "prev_remaining_term",
    "reporting_date": "prev_reporting_date",
}


def lagged(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """Add the previous period's values (WIN1)."""
    wanted = LAGGED if columns is None else columns
    w = by_loan()
    return df.select("*", *[F.lag(c).over(w).alias(name) for c, name in wanted.items()])


def _ahead(horizon: int) -> Window:
    return by_loan().rowsBetween(1, horizon)


def forward_labels(df: DataFrame, horizon: int = 3, exclude_default: bool = False) -> DataFrame:
    """Add ``default_in_{h}m`` and ``prepay_in_{h}m`` (WIN2).

    A charged-off loan also has a zero balance; ``exclude_default`` keeps it out of prepayments.
    """
    repaid = F.col("current_balance") == 0
    if exclude_default:
        repaid = repaid & (F.col("performing_status") != CHARGED_OFF)
    ahead = _ahead(horizon)
    return df.select(
        "*",
        F.coalesce(F.max(F.col("default_crr_flag").cast("int")).over(ahead), F.lit(0)).alias(f"default_in_{horizon}m"),
        F.coalesce(F.max(repaid.cast("int")).over(ahead), F.lit(0)).alias(f"prepay_in_{horizon}m"),
    )


def with_full_horizon(df: DataFrame, horizon: int = 3) -> DataFrame:
    """Rows whose next ``horizon`` periods all carry a default flag, with ``obs_year`` (WIN4)."""
    known = F.count("default_crr_flag").over(_ahead(horizon))
    return (
        df.withColumn("_known", known)
        .where(F.col("_known") == horizon)
        .drop("_known")
        .withColumn("obs_year", F.year(DATE))
    )


def momentum(df: DataFrame, col: str = "current_balance", name: str = "balance_mom_1m") -> DataFrame:
    """Relative change on the previous period, when that was positive (WIN3)."""
    prev = F.lag(col).over(by_loan())
    return df.withColumn(name, F.when(prev > 0, (F.col(col) - prev) / prev))


def roll_rates(df: DataFrame) -> DataFrame:
    """Month-on-month roll, cure and charge-off figures by cut-off (WIN6)."""
    rows = df.select(KEY, DATE, "arrears_bucket", F.lag("arrears_bucket").over(by_loan()).alias("prev"))
    ladder = (PERFORMING, *DPD_STATES, DEFAULTED)
    names = ("perf_to_1_29", "d1_29_to_30_59", "d30_59_to_60_89", "d60_89_to_90", "d90_to_default")
    now, prev = F.col("arrears_bucket"), F.col("prev")

    def rate(before: Column, after: Column) -> Column:
        return 100.0 * F.count_if(before & after) / F.nullif(F.count_if(before), F.lit(0))

    rolls = [
        rate(prev == a, now == b).alias(name) for name, a, b in zip(names, ladder[:-1], ladder[1:])
    ]
    return (
        rows.where(prev.isNotNull())
        .groupBy(DATE)
        .agg(
            *rolls,
            rate(prev.isin(*DPD_STATES), now == PERFORMING).alias("cure_rate"),
            F.count_if((now == CHARGED_OFF) & (prev == DEFAULTED)).alias("new_charge_offs"),
        )
    )


def cures(df: DataFrame, include_defaulted: bool = False) -> DataFrame:
    """Per loan: did it ever go from past due back to performing (WIN7)."""
    states = DELINQUENT_STATES if include_defaulted else DPD_STATES
    prev = F.lag("arrears_bucket").over(by_loan())
    cured = prev.isin(*states) & (F.col("arrears_bucket") == PERFORMING)
    return (
        df.select(KEY, F.coalesce(cured, F.lit(False)).alias("_cured"))
        .groupBy(KEY)
        .agg(F.max("_cured").alias("had_cure"), F.count_if("_cured").alias("n_cures"))
    )


def step_ok(col: str, lo: float, hi: float, sign: int = 1) -> Column:
    """1.0 if the step from the previous period lies in [lo, hi], else 0.0; first rows count."""
    prev = F.lag(col).over(by_loan())
    step = (F.col(col) - prev) * sign
    return F.when(prev.isNull() | step.between(lo, hi), 1.0).otherwise(0.0)


def step_compliance(df: DataFrame, col: str, lo: float, hi: float, sign: int = 1) -> DataFrame:
    """Percent of rows whose step from the previous period lies in [lo, hi] (WIN8)."""
    return df.select(step_ok(col, lo, hi, sign).alias("_ok")).agg(F.round(100.0 * F.avg("_ok"), 2).alias("compliance_pct"))


def _streak(df: DataFrame, hit: Column, name: str) -> DataFrame:
    w = by_loan().rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("_hit", F.coalesce(hit, F.lit(False)).cast("int"))
    islands = marked.withColumn("_island", F.sum(1 - F.col("_hit")).over(w))
    inside = Window.partitionBy(KEY, "_island").orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    return islands.withColumn(name, F.sum("_hit").over(inside)).drop("_hit", "_island")


def arrears_streak(df: DataFrame) -> DataFrame:
    """Consecutive periods in arrears, reset on cure or exit (WIN10)."""
    hit = ~F.col("arrears_bucket").isin(PERFORMING, REDEEMED, CHARGED_OFF)
    return _streak(df, hit, "arrears_streak")


def default_streak(df: DataFrame, limit: int = MONTHS_IN_DEFAULT_TO_CHARGE_OFF) -> DataFrame:
    """Consecutive periods in default, and whether charge-off is due (WIN10)."""
    out = _streak(df, F.col("arrears_bucket") == DEFAULTED, "default_streak")
    return out.withColumn("charge_off_due", F.col("default_streak") >= limit)


def with_default_date(df: DataFrame) -> DataFrame:
    """Add each loan's first default date (JON4), without a join."""
    whole = Window.partitionBy(KEY)
    return df.withColumn("default_date", F.min(F.when(F.col("default_crr_flag"), F.col(DATE))).over(whole))


def months_to_default(df: DataFrame) -> DataFrame:
    """Days to the first default in 30-day months, ties to even; -1 if never (WIN11)."""
    days = F.datediff("default_date", DATE)
    months = F.coalesce(F.bround(days / 30.0, 0), F.lit(-1.0)).cast("int")
    return with_default_date(df).withColumn("months_to_default", months)
