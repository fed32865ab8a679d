"""Portfolio statistics on a loan-month panel (AGG1 to AGG18, FLT4, FLT5, TOP1, TOP2).

Columns are those of the panel; ``reporting_date`` is a date. Every aggregation is
partial on the map side. Global windows appear only over rows already grouped by
date or category.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from loantide.functions.states import (
    ARREARS_STATES,
    CHARGED_OFF,
    DEFAULTED,
    DELINQUENT_STATES,
    EPC_LABELS,
    NHG_CAP,
    PERFORMING,
    REDEEMED,
    is_active,
)
from loantide.operators.history import DATE, KEY
from loantide.operators.ranking import exact_quantiles, top_fraction_sum

QUANTILES = (0.05, 0.25, 0.50, 0.75, 0.95)
# Limits of the concentration classes.
HHI_MODERATE, HHI_HIGH = 1500, 2500


def _pct(cond: Column) -> Column:
    return 100.0 * F.count_if(cond) / F.count(F.lit(1))


def _with_share(grouped: DataFrame, pool: DataFrame) -> DataFrame:
    """Add the share of the pool; the pool size is one scalar, whatever the number of groups."""
    size = pool.agg(F.count(F.lit(1))).scalar()
    return grouped.withColumn("share_pct", 100.0 * F.col("n_loans") / size)


def at_cutoff(df: DataFrame, date: str | None = "first") -> DataFrame:
    """Rows of one snapshot: a given date, ``first`` or ``last``; None keeps all (FLT4)."""
    if date is None:
        return df
    if date in ("first", "last"):
        pick = F.min(DATE) if date == "first" else F.max(DATE)
        return df.where(F.col(DATE) == df.agg(pick).scalar())
    return df.where(F.col(DATE) == F.lit(date).cast("date"))


def active(df: DataFrame) -> DataFrame:
    """The active pool: neither redeemed nor charged off (FLT5)."""
    return df.where(is_active(F.col("arrears_bucket")))


def pool_overview(df: DataFrame, first: str, last: str) -> DataFrame:
    """Size, dates and balances of the pool (AGG1)."""
    at = lambda d: F.col(DATE) == F.lit(d).cast("date")
    billions = lambda c, d: (F.sum(F.when(at(d), F.col(c))) / 1e9)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(KEY).alias("n_loans"),
        F.count_distinct(DATE).alias("n_cutoffs"),
        F.min(DATE).alias("first_date"),
        F.max(DATE).alias("last_date"),
        billions("original_balance", first).alias("original_balance_bn"),
        billions("current_balance", first).alias("current_balance_first_bn"),
        billions("current_balance", last).alias("current_balance_last_bn"),
        billions("original_market_value_at_origination", first).alias("original_value_bn"),
    )


def monthly_composition(df: DataFrame) -> DataFrame:
    """Loans by status at each cut-off, and the change on the one before (AGG2)."""
    by_date = df.groupBy(DATE).agg(
        F.count(F.lit(1)).alias("n_loans"),
        F.count_if(F.col("arrears_bucket") == PERFORMING).alias("performing"),
        F.count_if(F.col("performing_status") == DEFAULTED).alias("defaulted"),
        F.count_if(F.col("performing_status") == REDEEMED).alias("redeemed"),
        F.count_if(F.col("performing_status") == CHARGED_OFF).alias("charged_off"),
    )
    # one row per cut-off from here on, so a global window is fine
    prior = F.lag("n_loans").over(Window.partitionBy(F.lit(0)).orderBy(DATE))
    return by_date.withColumn("change", F.col("n_loans") - prior)


def distribution(df: DataFrame, col: str, cutoff: str | None = "first") -> DataFrame:
    """Loans and share of the pool per value of one column (AGG3)."""
    pool = at_cutoff(df, cutoff)
    return _with_share(pool.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n_loans")), pool)


def distributions(df: DataFrame, cols: Sequence[str], cutoff: str | None = "first") -> DataFrame:
    """AGG3 for several columns in one scan: (dimension, value, n_loans, share_pct)."""
    pool = at_cutoff(df, cutoff)
    long = pool.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in cols])
        ).alias("x")
    )
    grouped = long.groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n_loans"))
    return _with_share(grouped, pool)


def quantiles(df: DataFrame, col: str, cutoff: str | None = "first") -> DataFrame:
    """Interpolated p5, p25, p50, p75, p95 and mean of one column (AGG4)."""
    return exact_quantiles(at_cutoff(df, cutoff), col, QUANTILES)


def quantile_table(df: DataFrame, cols: Sequence[str], cutoff: str | None = "first") -> DataFrame:
    """AGG4 for several columns in one scan."""
    long = at_cutoff(df, cutoff).select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in cols])
        ).alias("x")
    ).select("x.measure", "x.v")
    return exact_quantiles(long, "v", QUANTILES, ["measure"])


def risk_markers(df: DataFrame, cutoff: str | None = "first") -> DataFrame:
    """Shares of the nine risk markers (AGG5)."""
    yes = lambda c: F.col(c) == "Y"
    return at_cutoff(df, cutoff).agg(
        _pct(yes("nhg_flag")).alias("nhg_pct"),
        _pct(yes("buy_to_let_flag")).alias("buy_to_let_pct"),
        _pct(yes("self_employed_flag")).alias("self_employed_pct"),
        _pct(yes("interest_only_flag")).alias("interest_only_pct"),
        _pct(F.col("oltomv_original") > 90).alias("oltv_over_90_pct"),
        _pct(F.col("loan_to_income") > 5).alias("lti_over_5_pct"),
        _pct(yes("forbearance_flag")).alias("forbearance_pct"),
        _pct(yes("restructuring_flag")).alias("restructuring_pct"),
        _pct(yes("construction_deposit_flag")).alias("construction_deposit_pct"),
    )


def _state_name(state: str) -> str:
    return state.lower().replace("+", "_plus").replace("-", "_").replace(" ", "_")


def arrears_trajectory(df: DataFrame) -> DataFrame:
    """Share of each arrears state by cut-off (AGG6)."""
    return df.groupBy(DATE).agg(
        *[_pct(F.col("arrears_bucket") == s).alias(f"{_state_name(s)}_pct") for s in ARREARS_STATES]
    )


def vintage_profile(df: DataFrame, cutoff: str | None = "first") -> DataFrame:
    """Size, balance and loan-to-value by origination year (AGG7)."""
    pool = at_cutoff(df, cutoff)
    grouped = pool.groupBy("origination_year").agg(
        F.count(F.lit(1)).alias("n_loans"),
        F.avg("original_balance").alias("mean_original_balance"),
        F.avg("oltomv_original").alias("mean_oltv"),
    )
    return _with_share(grouped, pool)


def epc_profile(df: DataFrame, cutoff: str | None = "first") -> DataFrame:
    """Loans and energy demand per energy label, with the label's rank (AGG8)."""
    labels = F.array(*[F.lit(x) for x in EPC_LABELS])
    pool = at_cutoff(df, cutoff)
    grouped = pool.groupBy("epc_label").agg(
        F.count(F.lit(1)).alias("n_loans"), F.avg("primary_energy_demand_kwh_m2").alias("mean_demand")
    )
    return _with_share(grouped, pool).withColumn("label_rank", F.array_position(labels, F.col("epc_label")))


def exits_of(outcomes: DataFrame) -> DataFrame:
    """Where the starting pool ended up, from one row per loan."""
    flags = ("start_loans", "still_performing", "still_defaulted", "ever_redeemed", "ever_charged_off")
    counts = outcomes.agg(*[F.count_if(n).alias(n) for n in flags])
    return counts.withColumn("total_accounted", sum((F.col(n) for n in flags[2:]), F.col("still_performing")))


def exit_accounting(df: DataFrame, first: str, last: str) -> DataFrame:
    """Where the starting pool ended up (AGG9)."""
    return exits_of(loan_outcomes(df, first, last))


def rates_of(exits: DataFrame, peak: Column) -> DataFrame:
    """Cumulative rates from the exit counts and the peak defaulted share."""
    start = F.nullif(F.col("start_loans"), F.lit(0))
    return exits.select(
        (100.0 * F.col("ever_redeemed") / start).alias("prepayment_pct"),
        (100.0 * F.col("ever_charged_off") / start).alias("charge_off_pct"),
        (100.0 * F.col("still_defaulted") / start).alias("end_default_pct"),
        (100.0 * (F.col("ever_redeemed") + F.col("ever_charged_off")) / start).alias("attrition_pct"),
        peak.alias("peak_defaulted_pct"),
    )


def headline_rates(df: DataFrame, first: str, last: str) -> DataFrame:
    """Cumulative rates on the starting pool and the peak defaulted share (AGG10)."""
    by_date = df.groupBy(DATE).agg(_pct(F.col("arrears_bucket") == DEFAULTED).alias("p"))
    return rates_of(exit_accounting(df, first, last), by_date.agg(F.max("p")).scalar())


def delinquency_rates(df: DataFrame) -> DataFrame:
    """Delinquency shares of the active pool by cut-off (AGG11)."""
    state = F.col("arrears_bucket")
    return active(df).groupBy(DATE).agg(
        F.count(F.lit(1)).alias("n_active"),
        _pct(state.isin(*DELINQUENT_STATES)).alias("delinquent_pct"),
        _pct(state.isin(*DELINQUENT_STATES[1:])).alias("dpd30_pct"),
        _pct(state.isin(*DELINQUENT_STATES[3:])).alias("dpd90_pct"),
        _pct(state == DEFAULTED).alias("defaulted_pct"),
        _pct(F.col("foreclosure_flag") == "Y").alias("foreclosure_pct"),
    )


def compliance(df: DataFrame) -> DataFrame:
    """Policy compliance of the active pool by cut-off (AGG12)."""
    yes = lambda c: F.col(c) == "Y"
    return active(df).groupBy(DATE).agg(
        _pct(yes("nhg_flag")).alias("nhg_pct"),
        F.count_if(yes("nhg_flag") & (F.col("original_balance") > NHG_CAP)).alias("nhg_cap_breaches"),
        _pct(F.col("cltomv_current") > 100).alias("underwater_pct"),
        _pct(yes("forbearance_flag")).alias("forbearance_pct"),
        _pct(yes("restructuring_flag")).alias("restructuring_pct"),
        _pct(yes("default_crr_flag")).alias("default_flag_pct"),
    )


def pool_dynamics(df: DataFrame) -> DataFrame:
    """Balance, pool factor and balance-weighted averages of the active pool (AGG13).

    The pool factor is survivor-based: both sums run over active loans.
    """
    bal = F.col("current_balance")
    weighted = lambda c: F.sum(bal * F.col(c)) / F.nullif(F.sum(bal), F.lit(0.0))
    return active(df).groupBy(DATE).agg(
        (F.sum(bal) / 1e9).alias("balance_bn"),
        (F.sum(bal) / F.nullif(F.sum("original_balance"), F.lit(0.0))).alias("pool_factor"),
        weighted("current_interest_rate_pct").alias("wa_rate"),
        weighted("seasoning_months").alias("wa_seasoning"),
        weighted("remaining_term_months").alias("wa_remaining_term"),
    )


_OUTCOMES = {"ever_defaulted_pct": "ever_defaulted", "ever_charged_off_pct": "ever_charged_off", "ever_redeemed_pct": "ever_redeemed"}


def vintages_of(outcomes: DataFrame) -> DataFrame:
    """Outcome shares per vintage, from one row per loan."""
    return outcomes.groupBy("origination_year").agg(
        F.count(F.lit(1)).alias("cohort"), *[_pct(F.col(c)).alias(n) for n, c in _OUTCOMES.items()]
    )


def vintage_outcomes(df: DataFrame) -> DataFrame:
    """Share of each vintage that ever defaulted, was charged off or redeemed (AGG14)."""
    status = F.col("performing_status")
    outcomes = {"ever_defaulted": DEFAULTED, "ever_charged_off": CHARGED_OFF, "ever_redeemed": REDEEMED}
    return vintages_of(
        df.groupBy("origination_year", KEY).agg(*[F.max(status == s).alias(n) for n, s in outcomes.items()])
    )


def hhi(df: DataFrame, dim: str, cutoff: str | None = "first") -> DataFrame:
    """Concentration index of one dimension and its class (AGG15)."""
    shares = distribution(df, dim, cutoff)
    index = shares.agg(F.sum(F.pow(F.col("share_pct"), 2)).alias("hhi"))
    return index.select(
        F.lit(dim).alias("dimension"),
        "hhi",
        F.when(F.col("hhi") < HHI_MODERATE, "Unconcentrated")
        .when(F.col("hhi") < HHI_HIGH, "Moderately concentrated")
        .otherwise("Highly concentrated")
        .alias("concentration"),
    )


def losses_of(outcomes: DataFrame) -> DataFrame:
    """Loss figures of the charged-off loans, from one row per loan."""
    covered = F.sum(F.when(F.col("guaranteed"), F.col("at_default")).otherwise(0.0)) / 1e6
    return outcomes.where("ever_charged_off").agg(
        F.count(F.lit(1)).alias("n_charged_off"),
        (F.sum("at_default") / 1e6).alias("loss_m"),
        F.avg("at_default").alias("mean_loss"),
        (F.avg(F.col("at_default") / F.col("original")) * 100).alias("mean_lgd_pct"),
        covered.alias("guaranteed_m"),
        F.count_if("guaranteed").alias("n_guaranteed"),
    ).withColumn("net_loss_m", F.col("loss_m") - F.col("guaranteed_m"))


def lgd(df: DataFrame) -> DataFrame:
    """Loss proxy of charged-off loans: the largest balance seen while defaulted (AGG16, JON5).

    One conditional aggregation per loan takes the place of a self-join; columns that the
    losses do not need are pruned from it.
    """
    any_day = "1970-01-01"
    return losses_of(loan_outcomes(df, any_day, any_day))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (AGG17)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def non_constant(df: DataFrame, key: str, col: str, tol: float | None = None) -> DataFrame:
    """Keys whose column changes over time, or by more than ``tol`` (AGG18)."""
    lo, hi = F.min(col), F.max(col)
    moved = (lo != hi) if tol is None else (hi - lo > tol)
    return df.groupBy(key).agg(moved.alias("_moved")).where("_moved").drop("_moved")


def late_entrants(df: DataFrame) -> DataFrame:
    """Loans first seen after the pool's first date (AGG19)."""
    start = df.agg(F.min(DATE)).scalar()
    return df.groupBy(KEY).agg(F.min(DATE).alias("first_seen")).where(F.col("first_seen") > start)


def loan_labels(gold: DataFrame, label: str = "default_in_3m") -> DataFrame:
    """One label per loan: the maximum over time (AGG20)."""
    return gold.groupBy(KEY).agg(F.max(label).alias("label"))


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """Negatives per positive, and the positive rate (AGG26)."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(
        pos.alias("positives"),
        neg.alias("negatives"),
        (neg / F.greatest(pos, F.lit(1))).alias("pos_weight"),
        F.avg(F.col(label).cast("double")).alias("positive_rate"),
    )


def pivot_counts(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Counts of each value side by side (RSH3)."""
    counted = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    return counted.groupBy(row).agg(
        *[F.sum(F.when(F.col(col) == v, n).otherwise(0)).alias(_state_name(v)) for v in values],
        F.sum(n).alias("total"),
    )


def top_exposure(df: DataFrame, dim: str, k: int = 10, cutoff: str | None = "first") -> DataFrame:
    """The ``k`` largest groups by loans, ties by name (TOP1)."""
    pool = at_cutoff(df, cutoff)
    grouped = pool.groupBy(dim).agg(
        F.count(F.lit(1)).alias("n_loans"), (F.sum("current_balance") / 1e6).alias("balance_m")
    )
    return _with_share(grouped, pool).orderBy(F.desc("n_loans"), dim).limit(k)


def top_k_share(df: DataFrame, k: int, cutoff: str | None = "first") -> DataFrame:
    """Sum of the ``k`` largest balances and its share of the pool (TOP2)."""
    pool = at_cutoff(df, cutoff)
    top = pool.select("current_balance").orderBy(F.desc("current_balance")).limit(k)
    total = pool.agg(F.sum("current_balance")).scalar()
    return top.agg(F.sum("current_balance").alias("top_balance")).select(
        F.lit(k).cast("long").alias("k"), "top_balance", (100.0 * F.col("top_balance") / total).alias("share_pct")
    )


def top_share(df: DataFrame, frac: float = 0.01, cutoff: str | None = "first") -> DataFrame:
    """Balance held by the largest ``frac`` of loans (WIN9)."""
    return top_fraction_sum(at_cutoff(df, cutoff), "current_balance", frac)


def loan_outcomes(df: DataFrame, first: str, last: str) -> DataFrame:
    """One row per loan with what the exit, vintage and loss sections need: one shuffle for all of them."""
    at = lambda d: F.col(DATE) == F.lit(d).cast("date")
    status = F.col("performing_status")
    return df.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(at(first)).alias("start_loans"),
        F.max(at(last) & (status == "Non-defaulted")).alias("still_performing"),
        F.max(at(last) & (status == DEFAULTED)).alias("still_defaulted"),
        F.max(status == REDEEMED).alias("ever_redeemed"),
        F.max(status == CHARGED_OFF).alias("ever_charged_off"),
        F.max(status == DEFAULTED).alias("ever_defaulted"),
        F.max("origination_year").alias("origination_year"),
        # a boolean, since a maximum of text would turn the hash aggregation into a sort
        F.max(F.col("nhg_flag") == "Y").alias("guaranteed"),
        F.max(F.when(status == DEFAULTED, F.col("current_balance"))).alias("at_default"),
        F.max("original_balance").alias("original"),
    )


def cutoff_measures(df: DataFrame) -> DataFrame:
    """One row per cut-off with the figures of every section that groups by date: one scan for all of them.

    Columns that count the active pool only start with ``a_``.
    """
    state, status, bal = F.col("arrears_bucket"), F.col("performing_status"), F.col("current_balance")
    live = is_active(state)
    n_live = F.nullif(F.count_if(live), F.lit(0))
    share = lambda c: 100.0 * F.count_if(live & c) / n_live
    yes = lambda c: F.col(c) == "Y"
    kept = F.when(live, bal)
    weighted = lambda c: F.sum(kept * F.col(c)) / F.nullif(F.sum(kept), F.lit(0.0))
    return df.groupBy(DATE).agg(
        F.count(F.lit(1)).alias("n_loans"),
        F.count_if(state == PERFORMING).alias("performing"),
        *[F.count_if(status == s).alias(n) for n, s in (("defaulted", DEFAULTED), ("redeemed", REDEEMED), ("charged_off", CHARGED_OFF))],
        *[_pct(state == s).alias(f"{_state_name(s)}_pct") for s in ARREARS_STATES],
        F.sum("original_balance").alias("original_balance"),
        F.sum(bal).alias("current_balance"),
        F.sum("original_market_value_at_origination").alias("original_value"),
        F.count_if(live).alias("n_active"),
        share(state.isin(*DELINQUENT_STATES)).alias("a_delinquent_pct"),
        share(state.isin(*DELINQUENT_STATES[1:])).alias("a_dpd30_pct"),
        share(state.isin(*DELINQUENT_STATES[3:])).alias("a_dpd90_pct"),
        share(state == DEFAULTED).alias("a_defaulted_pct"),
        share(yes("foreclosure_flag")).alias("a_foreclosure_pct"),
        share(yes("nhg_flag")).alias("a_nhg_pct"),
        F.count_if(live & yes("nhg_flag") & (F.col("original_balance") > NHG_CAP)).alias("a_nhg_cap_breaches"),
        share(F.col("cltomv_current") > 100).alias("a_underwater_pct"),
        share(yes("forbearance_flag")).alias("a_forbearance_pct"),
        share(yes("restructuring_flag")).alias("a_restructuring_pct"),
        share(yes("default_crr_flag")).alias("a_default_flag_pct"),
        (F.sum(kept) / 1e9).alias("a_balance_bn"),
        (F.sum(kept) / F.nullif(F.sum(F.when(live, F.col("original_balance"))), F.lit(0.0))).alias("a_pool_factor"),
        weighted("current_interest_rate_pct").alias("a_wa_rate"),
        weighted("seasoning_months").alias("a_wa_seasoning"),
        weighted("remaining_term_months").alias("a_wa_remaining_term"),
    )
