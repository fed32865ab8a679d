"""Panel split, gold features and joins (PRJ6, WIN2 to WIN4, FEA1, JON1 to JON4, JON12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loantide.operators.history import DATE, KEY, first_per_key, forward_labels, momentum, with_full_horizon

# The two silver tables and the gold feature list, in order.
STATIC_COLUMNS = """
loan_id origination_year original_balance legal_maturity_months repayment_type interest_only_flag rate_type
interest_payment_frequency principal_payment_frequency borrower_type debtor_count loan_part_count employment_status
self_employed_flag loan_purpose buy_to_let_flag borrower_annual_income loan_to_income payment_due_to_income_pct
scheduled_monthly_payment property_type province economic_region_nuts3 country construction_year occupancy
property_usage original_market_value_at_origination property_valuation_type oltomv_original nhg_flag guarantee_type
epc_label epc_issue_year primary_energy_demand_kwh_m2 construction_deposit_flag construction_deposit_pct
construction_deposit_amount transaction_name esma_transaction_identifier originator_name servicer_name currency
closing_date maturity_date_proxy
""".split()
DYNAMIC_COLUMNS = """
loan_id reporting_date current_balance current_interest_rate_pct remaining_interest_fixed_period_months
fixed_interest_period_end_in_months remaining_term_months seasoning_months cltomv_current cltimv_current
current_original_market_value indexed_market_value arrears_bucket arrears_amount days_past_due default_crr_flag
performing_status foreclosure_flag forbearance_flag restructuring_flag balance_bucket cltomv_current_bucket
cltimv_current_bucket oltomv_original_bucket loan_to_income_bucket payment_due_to_income_pct_bucket
construction_year_bucket
""".split()
GOLD_STATIC = """
origination_year original_balance legal_maturity_months repayment_type interest_only_flag rate_type borrower_type
debtor_count employment_status self_employed_flag loan_purpose buy_to_let_flag nhg_flag province
economic_region_nuts3 construction_year occupancy property_type property_usage oltomv_original
original_market_value_at_origination epc_label primary_energy_demand_kwh_m2 loan_to_income
payment_due_to_income_pct borrower_annual_income
""".split()
GOLD_DYNAMIC = """
current_balance current_interest_rate_pct remaining_term_months seasoning_months cltomv_current cltimv_current
arrears_bucket arrears_amount days_past_due default_crr_flag performing_status foreclosure_flag forbearance_flag
restructuring_flag balance_bucket cltomv_current_bucket
""".split()


def _flags_as_boolean(df: DataFrame) -> DataFrame:
    return df.select(
        *[(F.col(c) == "Y").alias(c) if c.endswith("_flag") else F.col(c) for c in df.columns]
    )


def split_panel(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Static loans (the first row of each loan) and dynamic performance; Y/N flags become booleans (PRJ6)."""
    have = set(panel.columns)
    static = first_per_key(
        panel.select(*[c for c in STATIC_COLUMNS if c in have], DATE), [KEY], [DATE]
    ).drop(DATE)
    dynamic = panel.select(*[c for c in DYNAMIC_COLUMNS if c in have])
    return _flags_as_boolean(static), _flags_as_boolean(dynamic)


def gold_features(static: DataFrame, dynamic: DataFrame, horizon: int = 3, exclude_default: bool = False) -> DataFrame:
    """Features and forward labels per loan and date (FEA1).

    All windows share one partitioning by loan, which the join on loan then reuses.
    """
    dyn = dynamic.select(KEY, DATE, *GOLD_DYNAMIC)
    labelled = with_full_horizon(momentum(forward_labels(dyn, horizon, exclude_default)), horizon)
    joined = labelled.join(static.select(KEY, *GOLD_STATIC), KEY)
    return joined.select(
        KEY, DATE, *GOLD_STATIC, *GOLD_DYNAMIC, "balance_mom_1m",
        f"default_in_{horizon}m", f"prepay_in_{horizon}m", "obs_year",
    )


def orphans(child: DataFrame, parent: DataFrame, key: str = KEY) -> DataFrame:
    """Child rows without a parent (JON2)."""
    return child.join(parent.select(key), key, "left_anti")


def with_embeddings(df: DataFrame, emb: DataFrame, key: str = KEY) -> DataFrame:
    """Rows that have an embedding, with it (JON3)."""
    return df.join(emb, key)


def attach_labels(seq: DataFrame, labels: DataFrame, default: int = 0) -> DataFrame:
    """Label per loan, ``default`` where there is none (JON12)."""
    return seq.join(labels.select(KEY, "label"), KEY, "left").withColumn(
        "label", F.coalesce("label", F.lit(default)).cast("int")
    )


def explode_embedding(df: DataFrame, col: str, width: int, prefix: str = "emb_") -> DataFrame:
    """One column per embedding position (RSH5); an array of another size is an error, a null array gives nulls."""
    keep = [c for c in df.columns if c != col]
    whole = F.when(F.col(col).isNull() | (F.size(col) == width), F.col(col)).otherwise(
        F.raise_error(F.concat(F.lit(f"{col} has not {width} positions but "), F.size(col).cast("string")))
    )
    return df.select(*keep, *[whole[i].cast("double").alias(f"{prefix}{i}") for i in range(width)])


def pack_embedding(df: DataFrame, name: str = "embedding", prefix: str = "emb_") -> DataFrame:
    """The reverse of ``explode_embedding``."""
    parts = sorted((c for c in df.columns if c.startswith(prefix)), key=lambda c: int(c[len(prefix):]))
    return df.select(*[c for c in df.columns if c not in parts], F.array(*parts).alias(name))
