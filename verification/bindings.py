"""How the given tables become loan inputs, in Spark and, independently, in SQL.

``panel``: one row per customer and month end, from the last order of that month.
Static attributes follow from the customer; the arrears state follows from order
status and priority. Nothing is sampled: every order takes part in the collapse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loantide.functions import buckets, dates, loanmath, states
from loantide.operators.history import DATE, KEY, first_per_key

FIRST, LAST = "1995-01-31", "2001-08-31"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pick(col, values):
    """The value at position ``col mod n`` of a fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(col, F.lit(len(values))) + 1).cast("int"))


def _yes(cond):
    return F.when(cond, "Y").otherwise("N")


# Column order of the panel.
PANEL_COLUMNS = """
loan_id transaction_name esma_transaction_identifier reporting_date closing_date originator_name servicer_name
currency country origination_year maturity_date_proxy original_balance current_balance repayment_type
interest_only_flag current_interest_rate_pct rate_type remaining_interest_fixed_period_months
fixed_interest_period_end_in_months seasoning_months remaining_term_months legal_maturity_months loan_part_count
debtor_count property_type province economic_region_nuts3 construction_year occupancy property_usage
employment_status self_employed_flag borrower_type loan_purpose buy_to_let_flag nhg_flag guarantee_type
oltomv_original cltomv_current cltimv_current original_market_value_at_origination current_original_market_value
indexed_market_value property_valuation_type loan_to_income payment_due_to_income_pct borrower_annual_income
scheduled_monthly_payment arrears_bucket arrears_amount days_past_due default_crr_flag performing_status
foreclosure_flag forbearance_flag restructuring_flag epc_label epc_issue_year primary_energy_demand_kwh_m2
construction_deposit_flag construction_deposit_pct construction_deposit_amount interest_payment_frequency
principal_payment_frequency balance_bucket cltomv_current_bucket cltimv_current_bucket oltomv_original_bucket
loan_to_income_bucket payment_due_to_income_pct_bucket construction_year_bucket
""".split()


def loans(spark: SparkSession, sf: str) -> DataFrame:
    """Static loan attributes, one row per customer."""
    k = F.col("c_custkey")
    base = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            k,
            F.concat(F.lit("L"), k.cast("string")).alias("loan_id"),
            F.col("n_name").alias("province"),
            F.concat(F.col("r_name"), F.lit("-"), F.pmod(k, F.lit(7)).cast("string")).alias("economic_region_nuts3"),
            F.col("c_mktsegment").alias("employment_status"),
            (150000.0 + 40.0 * F.col("c_acctbal")).alias("original_balance"),
            (40.5 + F.pmod(k * 7, F.lit(75))).alias("oltomv_original"),
            (1975 + F.pmod(k, F.lit(20))).cast("int").alias("origination_year"),
            _pick(k, [240, 300, 330, 360]).alias("legal_maturity_months"),
            _yes(F.pmod(k, F.lit(5)) == 0).alias("interest_only_flag"),
            (25000.0 + 1000.0 * F.pmod(k, F.lit(97))).alias("borrower_annual_income"),
            (1.0 + F.pmod(k, F.lit(40)) / 10.0).alias("base_rate"),
            _pick(k, ["Annuity", "Linear", "Bullet"]).alias("repayment_type"),
            _pick(k, ["Fixed", "Floating"]).alias("rate_type"),
            _pick(k, ["House", "Apartment", "Other"]).alias("property_type"),
            _pick(k, ["Owner occupied", "Let", "Vacant"]).alias("occupancy"),
            _pick(k, ["Residential", "Mixed"]).alias("property_usage"),
            _pick(k, ["Individual", "Company"]).alias("borrower_type"),
            _pick(k, ["Purchase", "Renovation", "Construction", "Refinance"]).alias("loan_purpose"),
            _yes(F.pmod(k, F.lit(7)) == 0).alias("buy_to_let_flag"),
            _yes(F.col("c_mktsegment") == "BUILDING").alias("self_employed_flag"),
            _pick(k, list(states.EPC_LABELS)).alias("epc_label"),
            (1930 + F.pmod(k, F.lit(95))).cast("int").alias("construction_year"),
            (F.pmod(k, F.lit(3)) + 1).cast("int").alias("loan_part_count"),
            (F.pmod(k, F.lit(2)) + 1).cast("int").alias("debtor_count"),
        )
    )
    return base.select(
        "*",
        states.nhg_flag(F.col("original_balance"), F.pmod(k, F.lit(3)) == 0).alias("nhg_flag"),
        loanmath.market_value(F.col("original_balance"), F.col("oltomv_original")).alias(
            "original_market_value_at_origination"
        ),
        loanmath.loan_to_income(F.col("original_balance"), F.col("borrower_annual_income")).alias("loan_to_income"),
        loanmath.scheduled_payment(
            F.col("original_balance"), F.col("base_rate"), F.col("legal_maturity_months"), F.col("interest_only_flag")
        ).alias("scheduled_monthly_payment"),
        states.construction_deposit_flag(F.col("loan_purpose"), F.pmod(k, F.lit(4)) == 1).alias(
            "construction_deposit_flag"
        ),
    )


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """The last order of each customer and month."""
    orders = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority",
        F.last_day(F.col("o_orderdate").cast("date")).alias(DATE),
    )
    return first_per_key(orders, ["o_custkey", DATE], [F.desc("o_orderdate"), F.desc("o_orderkey")])


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """The 71-column loan-month panel."""
    status, priority, k = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1), F.col("c_custkey")
    state = (
        F.when(status == "P", F.when(priority == "1", "Charged-Off").when(priority == "2", "Redeemed").otherwise("Performing"))
        .when(status == "O", F.when(priority == "1", "1-29 DPD").otherwise("Performing"))
        .when(priority == "1", "Defaulted")
        .when(priority == "2", "90+ DPD")
        .when(priority == "3", "60-89 DPD")
        .when(priority == "4", "30-59 DPD")
        .otherwise("1-29 DPD")
    )
    rows = observations(spark, sf).join(loans(spark, sf), F.col("o_custkey") == k).withColumn("arrears_bucket", state)
    s = F.col("arrears_bucket")
    rows = rows.select(
        "*",
        F.when(states.is_active(s), F.col("o_totalprice")).otherwise(0.0).alias("current_balance"),
        (F.col("base_rate") + F.pmod(F.col("o_orderkey"), F.lit(5)) / 100.0).alias("current_interest_rate_pct"),
        dates.seasoning_months(F.col(DATE), F.col("origination_year")).alias("seasoning_months"),
        states.days_past_due(s).alias("days_past_due"),
        states.performing_status(s).alias("performing_status"),
        states.default_flag(s).alias("default_crr_flag"),
        states.foreclosure_flag(s).alias("foreclosure_flag"),
        _yes(F.pmod(F.col("o_orderkey"), F.lit(11)) == 0).alias("forbearance_flag"),
        _yes(F.pmod(F.col("o_orderkey"), F.lit(17)) == 0).alias("restructuring_flag"),
        (F.year(DATE) - F.col("origination_year")).alias("loan_years"),
    )
    rows = rows.select(
        "*",
        dates.remaining_term(F.col("legal_maturity_months"), F.col("seasoning_months")).alias("remaining_term_months"),
        loanmath.uplift(F.col("original_market_value_at_origination"), F.col("loan_years")).alias("current_original_market_value"),
        loanmath.uplift(F.col("original_market_value_at_origination"), F.col("loan_years"), loanmath.INDEXED_GROWTH).alias("indexed_market_value"),
        loanmath.arrears_amount(F.col("scheduled_monthly_payment"), F.col("days_past_due")).alias("arrears_amount"),
        loanmath.payment_to_income(F.col("scheduled_monthly_payment"), F.col("borrower_annual_income")).alias("payment_due_to_income_pct"),
        states.construction_deposit_pct(F.col("construction_deposit_flag"), k).alias("construction_deposit_pct"),
    )
    rows = rows.select(
        "*",
        loanmath.ltv(F.col("current_balance"), F.col("current_original_market_value")).alias("cltomv_current"),
        loanmath.ltv(F.col("current_balance"), F.col("indexed_market_value")).alias("cltimv_current"),
        F.lit("Trade Book 1").alias("transaction_name"),
        F.lit("TRADEBOOK000000000001N199501").alias("esma_transaction_identifier"),
        F.lit("1995-01-02").cast("date").alias("closing_date"),
        F.lit("Originator A").alias("originator_name"),
        F.lit("Servicer A").alias("servicer_name"),
        F.lit("EUR").alias("currency"),
        F.lit("NL").alias("country"),
        dates.maturity_date(F.col("origination_year"), F.col("legal_maturity_months")).alias("maturity_date_proxy"),
        F.lit(60).alias("remaining_interest_fixed_period_months"),
        F.lit(60).alias("fixed_interest_period_end_in_months"),
        states.guarantee_type(F.col("nhg_flag")).alias("guarantee_type"),
        F.lit("Indexed").alias("property_valuation_type"),
        F.col("origination_year").alias("epc_issue_year"),
        states.energy_demand(F.col("epc_label")).alias("primary_energy_demand_kwh_m2"),
        states.construction_deposit_amount(F.col("original_balance"), F.col("construction_deposit_pct")).alias("construction_deposit_amount"),
        F.lit("Monthly").alias("interest_payment_frequency"),
        F.lit("Monthly").alias("principal_payment_frequency"),
    )
    rows = rows.select(
        "*",
        buckets.balance_bucket(F.col("current_balance")).alias("balance_bucket"),
        buckets.ltv_bucket(F.col("cltomv_current")).alias("cltomv_current_bucket"),
        buckets.ltv_bucket(F.col("cltimv_current")).alias("cltimv_current_bucket"),
        buckets.ltv_bucket(F.col("oltomv_original")).alias("oltomv_original_bucket"),
        buckets.lti_bucket(F.col("loan_to_income")).alias("loan_to_income_bucket"),
        buckets.dsti_bucket(F.col("payment_due_to_income_pct")).alias("payment_due_to_income_pct_bucket"),
        buckets.year_bucket(F.col("construction_year")).alias("construction_year_bucket"),
    )
    return rows.select(*PANEL_COLUMNS)


def _sql_pick(col: str, values: list) -> str:
    cases = " ".join(f"WHEN {i} THEN {v!r}" for i, v in enumerate(values))
    return f"(CASE {col} % {len(values)} {cases} END)"


def _sql_bucket(col: str, low: str, edges: list, labels: list) -> str:
    arms = " ".join(f"WHEN {col} <= {e} THEN '{x}'" for e, x in zip(edges, labels))
    return f"(CASE WHEN {low} THEN NULL {arms} END)"


_LTV_EDGES = [20, 30, 40, 50, 60, 70, 80, 90, 100, 1e6]
_LTV_LABELS = ["<20", "20-30", "30-40", "40-50", "50-60", "60-70", "70-80", "80-90", "90-100", "100+"]
_BAL_EDGES = [100000 + 50000 * i for i in range(11)] + [1e12]
_BAL_LABELS = ["<100k"] + [f"{100 + 50 * i}k-{150 + 50 * i}k" for i in range(10)] + ["600k+"]
_LTI_EDGES = [1.5 + 0.5 * i for i in range(10)] + [1e6]
_LTI_LABELS = ["<1.5"] + [f"{1.5 + 0.5 * i:.1f}-{2 + 0.5 * i:.1f}" for i in range(9)] + ["6.0+"]
_DSTI_EDGES = [5 * i for i in range(1, 8)] + [1e6]
_DSTI_LABELS = ["<5"] + [f"{5 * i}-{5 * i + 5}" for i in range(1, 7)] + ["35+"]
_YEAR_EDGES = [1945, 1960, 1970, 1980, 1985, 1990, 1995, 2000, 2005, 2010, 2015, 9999]
_YEAR_LABELS = ["<1945"] + [f"{a}-{b}" for a, b in zip(_YEAR_EDGES, _YEAR_EDGES[1:-1])] + ["2015+"]

# The panel as SQL: every statement below starts with this text.
PANEL_SQL = f"""
WITH obs AS (
  SELECT * FROM (
    SELECT *, last_day(CAST(o_orderdate AS DATE)) AS reporting_date,
           row_number() OVER (PARTITION BY o_custkey, last_day(CAST(o_orderdate AS DATE))
                              ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
    FROM orders) WHERE rn = 1
), loan AS (
  SELECT c_custkey AS k, 'L' || CAST(c_custkey AS VARCHAR) AS loan_id, n_name AS province,
         r_name || '-' || CAST(c_custkey % 7 AS VARCHAR) AS economic_region_nuts3,
         c_mktsegment AS employment_status,
         150000.0::DOUBLE + 40.0::DOUBLE * c_acctbal AS original_balance,
         40.5::DOUBLE + (c_custkey * 7) % 75 AS oltomv_original,
         CAST(1975 + c_custkey % 20 AS INTEGER) AS origination_year,
         {_sql_pick('c_custkey', [240, 300, 330, 360])} AS legal_maturity_months,
         CASE WHEN c_custkey % 5 = 0 THEN 'Y' ELSE 'N' END AS interest_only_flag,
         25000.0::DOUBLE + 1000.0::DOUBLE * (c_custkey % 97) AS borrower_annual_income,
         1.0::DOUBLE + CAST(c_custkey % 40 AS DOUBLE) / 10.0::DOUBLE AS base_rate,
         {_sql_pick('c_custkey', ['Annuity', 'Linear', 'Bullet'])} AS repayment_type,
         {_sql_pick('c_custkey', ['Fixed', 'Floating'])} AS rate_type,
         {_sql_pick('c_custkey', ['House', 'Apartment', 'Other'])} AS property_type,
         {_sql_pick('c_custkey', ['Owner occupied', 'Let', 'Vacant'])} AS occupancy,
         {_sql_pick('c_custkey', ['Residential', 'Mixed'])} AS property_usage,
         {_sql_pick('c_custkey', ['Individual', 'Company'])} AS borrower_type,
         {_sql_pick('c_custkey', ['Purchase', 'Renovation', 'Construction', 'Refinance'])} AS loan_purpose,
         CASE WHEN c_custkey % 7 = 0 THEN 'Y' ELSE 'N' END AS buy_to_let_flag,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'Y' ELSE 'N' END AS self_employed_flag,
         {_sql_pick('c_custkey', ['A+++', 'A++', 'A+', 'A', 'B', 'C', 'D', 'E', 'F', 'G'])} AS epc_label,
         {_sql_pick('c_custkey', [30, 60, 90, 130, 170, 210, 260, 310, 360, 420])} AS primary_energy_demand_kwh_m2,
         CAST(1930 + c_custkey % 95 AS INTEGER) AS construction_year,
         CAST(c_custkey % 3 + 1 AS INTEGER) AS loan_part_count,
         CAST(c_custkey % 2 + 1 AS INTEGER) AS debtor_count
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), loan2 AS (
  SELECT *, CASE WHEN original_balance <= 435000 AND k % 3 = 0 THEN 'Y' ELSE 'N' END AS nhg_flag,
         original_balance / (oltomv_original / 100.0::DOUBLE) AS original_market_value_at_origination,
         original_balance / borrower_annual_income AS loan_to_income,
         CASE WHEN interest_only_flag = 'Y' THEN original_balance * (base_rate / 100.0::DOUBLE / 12.0::DOUBLE)
              ELSE original_balance * (base_rate / 100.0::DOUBLE / 12.0::DOUBLE)
                   * pow(1.0::DOUBLE + base_rate / 100.0::DOUBLE / 12.0::DOUBLE, legal_maturity_months)
                   / (pow(1.0::DOUBLE + base_rate / 100.0::DOUBLE / 12.0::DOUBLE, legal_maturity_months) - 1.0::DOUBLE)
         END AS scheduled_monthly_payment,
         CASE WHEN k % 4 = 1 AND loan_purpose IN ('Renovation', 'Construction') THEN 'Y' ELSE 'N' END
           AS construction_deposit_flag
  FROM loan
), p1 AS (
  SELECT *, CASE WHEN o_orderstatus = 'P' THEN
                   CASE o_orderpriority[1] WHEN '1' THEN 'Charged-Off' WHEN '2' THEN 'Redeemed' ELSE 'Performing' END
                 WHEN o_orderstatus = 'O' THEN
                   CASE o_orderpriority[1] WHEN '1' THEN '1-29 DPD' ELSE 'Performing' END
                 ELSE CASE o_orderpriority[1] WHEN '1' THEN 'Defaulted' WHEN '2' THEN '90+ DPD'
                      WHEN '3' THEN '60-89 DPD' WHEN '4' THEN '30-59 DPD' ELSE '1-29 DPD' END
            END AS arrears_bucket
  FROM obs JOIN loan2 ON o_custkey = k
), p2 AS (
  SELECT *, CASE WHEN arrears_bucket IN ('Redeemed', 'Charged-Off') THEN 0.0::DOUBLE ELSE o_totalprice END AS current_balance,
         base_rate + CAST(o_orderkey % 5 AS DOUBLE) / 100.0::DOUBLE AS current_interest_rate_pct,
         CAST(greatest((year(reporting_date) - origination_year) * 12 + month(reporting_date) - 7, 1) AS INTEGER) AS seasoning_months,
         CASE arrears_bucket WHEN '1-29 DPD' THEN 15 WHEN '30-59 DPD' THEN 45 WHEN '60-89 DPD' THEN 75
              WHEN '90+ DPD' THEN 120 WHEN 'Defaulted' THEN 200 WHEN 'Charged-Off' THEN 200 ELSE 0 END AS days_past_due,
         CASE WHEN arrears_bucket IN ('Defaulted', 'Charged-Off', 'Redeemed') THEN arrears_bucket ELSE 'Non-defaulted' END
           AS performing_status,
         CASE WHEN arrears_bucket IN ('90+ DPD', 'Defaulted', 'Charged-Off') THEN 'Y' ELSE 'N' END AS default_crr_flag,
         CASE WHEN arrears_bucket IN ('Defaulted', 'Charged-Off') THEN 'Y' ELSE 'N' END AS foreclosure_flag,
         CASE WHEN o_orderkey % 11 = 0 THEN 'Y' ELSE 'N' END AS forbearance_flag,
         CASE WHEN o_orderkey % 17 = 0 THEN 'Y' ELSE 'N' END AS restructuring_flag
  FROM p1
), p3 AS (
  SELECT *, CAST(greatest(legal_maturity_months - seasoning_months, 0) AS INTEGER) AS remaining_term_months,
         original_market_value_at_origination * pow(1.03::DOUBLE, year(reporting_date) - origination_year)
           AS current_original_market_value,
         original_market_value_at_origination * pow(1.045::DOUBLE, year(reporting_date) - origination_year)
           AS indexed_market_value,
         scheduled_monthly_payment * CASE days_past_due WHEN 0 THEN 0 ELSE greatest(ceil(days_past_due / 30.0), 1) END
           AS arrears_amount,
         scheduled_monthly_payment * 12 / borrower_annual_income * 100 AS payment_due_to_income_pct,
         CAST(CASE WHEN construction_deposit_flag = 'Y' THEN k % 15 + 10 ELSE 0 END AS INTEGER) AS construction_deposit_pct
  FROM p2
), p4 AS (
  SELECT *, CASE WHEN current_original_market_value = 0 THEN 0 ELSE current_balance / current_original_market_value * 100 END
           AS cltomv_current,
         CASE WHEN indexed_market_value = 0 THEN 0 ELSE current_balance / indexed_market_value * 100 END AS cltimv_current,
         'Trade Book 1' AS transaction_name, 'TRADEBOOK000000000001N199501' AS esma_transaction_identifier,
         DATE '1995-01-02' AS closing_date, 'Originator A' AS originator_name, 'Servicer A' AS servicer_name,
         'EUR' AS currency, 'NL' AS country,
         make_date(origination_year + legal_maturity_months // 12, legal_maturity_months % 12 + 1, 28) AS maturity_date_proxy,
         CASE WHEN nhg_flag = 'Y' THEN 'NHG' ELSE 'None' END AS guarantee_type,
         origination_year AS epc_issue_year,
         original_balance * construction_deposit_pct / 100.0::DOUBLE AS construction_deposit_amount
  FROM p3
), panel AS (
  SELECT *, {_sql_bucket('current_balance', 'current_balance < 0', _BAL_EDGES, _BAL_LABELS)} AS balance_bucket,
         {_sql_bucket('cltomv_current', 'cltomv_current <= -1', _LTV_EDGES, _LTV_LABELS)} AS cltomv_current_bucket,
         {_sql_bucket('cltimv_current', 'cltimv_current <= -1', _LTV_EDGES, _LTV_LABELS)} AS cltimv_current_bucket,
         {_sql_bucket('oltomv_original', 'oltomv_original <= -1', _LTV_EDGES, _LTV_LABELS)} AS oltomv_original_bucket,
         {_sql_bucket('loan_to_income', 'loan_to_income <= -1', _LTI_EDGES, _LTI_LABELS)} AS loan_to_income_bucket,
         {_sql_bucket('payment_due_to_income_pct', 'payment_due_to_income_pct <= -1', _DSTI_EDGES, _DSTI_LABELS)}
           AS payment_due_to_income_pct_bucket,
         {_sql_bucket('construction_year', 'construction_year <= -1', _YEAR_EDGES, _YEAR_LABELS)} AS construction_year_bucket
  FROM p4
)"""
