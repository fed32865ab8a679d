"""The portfolio report: nineteen sections, few scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loantide.operators import history as H, portfolio as P
from loantide.operators.history import DATE
from loantide.session import written

# The columns of the snapshot sections.
SNAPSHOT_DIMENSIONS = (
    "province", "employment_status", "property_type", "construction_year_bucket", "occupancy", "balance_bucket",
    "repayment_type", "rate_type", "legal_maturity_months", "oltomv_original_bucket", "loan_to_income_bucket",
    "payment_due_to_income_pct_bucket",
)
SNAPSHOT_MEASURES = ("borrower_annual_income", "original_balance", "current_interest_rate_pct")
CONCENTRATION_DIMENSIONS = ("province", "economic_region_nuts3", "origination_year")
SNAPSHOT_COLUMNS = tuple(dict.fromkeys([
    *SNAPSHOT_DIMENSIONS, *SNAPSHOT_MEASURES, *CONCENTRATION_DIMENSIONS, "nhg_flag", "buy_to_let_flag", "self_employed_flag", "interest_only_flag",
    "oltomv_original", "loan_to_income", "forbearance_flag", "restructuring_flag", "construction_deposit_flag", "epc_label",
    "primary_energy_demand_kwh_m2", "current_balance",
]))

# Columns of the sections that group by date, as named in the shared table.
_COMPOSITION = ("n_loans", "performing", "defaulted", "redeemed", "charged_off")
_ACTIVE = {
    "13_delinquency_rates": ("n_active", "delinquent_pct", "dpd30_pct", "dpd90_pct", "defaulted_pct", "foreclosure_pct"),
    "14_compliance": ("nhg_pct", "nhg_cap_breaches", "underwater_pct", "forbearance_pct", "restructuring_pct", "default_flag_pct"),
    "15_pool_dynamics": ("balance_bn", "pool_factor", "wa_rate", "wa_seasoning", "wa_remaining_term"),
}


def portfolio_report(panel: DataFrame, first: str, last: str) -> dict[str, DataFrame]:
    """Every section as a table. The panel is read four times, not once per section.

    Three shared tables are written to the shared folder when the report is built: one row per
    cut-off, one row per loan, and the rows of the first cut-off with the columns of the snapshot sections.
    The sections that follow from them read those; only the roll rates read the panel.
    """
    by_date = written(P.cutoff_measures(panel), "report-dates")
    loans = written(P.loan_outcomes(panel, first, last), "report-loans")
    pool = written(P.at_cutoff(panel, first).select(*SNAPSHOT_COLUMNS), "report-pool")
    on = lambda d, c: F.sum(F.when(F.col(DATE) == F.lit(d).cast("date"), F.col(c))) / 1e9
    n_loans = loans.agg(F.count(F.lit(1))).scalar()
    overview = by_date.agg(
        F.sum("n_loans").alias("n_rows"), F.count(F.lit(1)).alias("n_cutoffs"), F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"),
        on(first, "original_balance").alias("original_balance_bn"), on(first, "current_balance").alias("current_balance_first_bn"),
        on(last, "current_balance").alias("current_balance_last_bn"), on(first, "original_value").alias("original_value_bn"),
    ).withColumn("n_loans", n_loans)
    change = F.col("n_loans") - F.lag("n_loans").over(Window.partitionBy(F.lit(0)).orderBy(DATE))
    shares = [c for c in by_date.columns if c.endswith("_pct") and not c.startswith("a_")]
    exits = P.exits_of(loans)
    out = {
        "01_pool_overview": overview,
        "02_monthly_composition": by_date.select(DATE, *_COMPOSITION, change.alias("change")),
        "03_to_06_distributions": P.distributions(pool, SNAPSHOT_DIMENSIONS, None),
        "03_to_06_quantiles": P.quantile_table(pool, SNAPSHOT_MEASURES, None),
        "07_risk_markers": P.risk_markers(pool, None),
        "08_arrears_trajectory": by_date.select(DATE, *shares),
        "09_vintage_profile": P.vintage_profile(pool, None),
        "10_energy_profile": P.epc_profile(pool, None),
        "11_exit_accounting": exits,
        "12_headline_rates": P.rates_of(exits, by_date.agg(F.max("defaulted_pct")).scalar()),
        **{
            name: by_date.where("n_active > 0").select(DATE, *[F.col(c if c == "n_active" else f"a_{c}").alias(c) for c in cols])
            for name, cols in _ACTIVE.items()
        },
        "16_roll_rates": H.roll_rates(panel),
        "17_vintage_outcomes": P.vintages_of(loans),
        "18_top_regions": P.top_exposure(pool, "economic_region_nuts3", 10, None),
        "18_top_10": P.top_k_share(pool, 10, None),
        "18_top_100": P.top_k_share(pool, 100, None),
        "18_top_1_pct": P.top_share(pool, 0.01, None),
        "19_loss_given_default": P.losses_of(loans),
    }
    for dim in CONCENTRATION_DIMENSIONS:
        out[f"18_concentration_{dim}"] = P.hhi(pool, dim, None)
    return out
