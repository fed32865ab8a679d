"""Portfolio report sections (AGG1 to AGG16, TOP1, TOP2, WIN9) and scalar buckets."""

from __future__ import annotations

from loantide.functions import buckets
from loantide.operators import portfolio as P
from verification.bindings import FIRST, LAST, PANEL_SQL, panel
from verification.shape import plain

SNAP = f"reporting_date = DATE '{FIRST}'"
SHARE = f"100.0::DOUBLE * count(*) / (SELECT count(*) FROM panel WHERE {SNAP})"
DIMENSIONS = [
    "province", "employment_status", "property_type", "construction_year_bucket", "occupancy", "balance_bucket",
    "repayment_type", "rate_type", "legal_maturity_months", "oltomv_original_bucket", "loan_to_income_bucket",
    "payment_due_to_income_pct_bucket",
]
MEASURES = ["borrower_annual_income", "original_balance", "current_interest_rate_pct"]
STATES = ["Performing", "1-29 DPD", "30-59 DPD", "60-89 DPD", "90+ DPD", "Defaulted", "Charged-Off", "Redeemed"]
STATE_COLS = ["performing", "1_29_dpd", "30_59_dpd", "60_89_dpd", "90_plus_dpd", "defaulted", "charged_off", "redeemed"]
ACTIVE = "arrears_bucket NOT IN ('Redeemed', 'Charged-Off')"


def on_panel(fn, digits=6):
    return lambda spark, sf: plain(fn(panel(spark, sf)), digits)


def _pct(cond: str) -> str:
    return f"round(100.0::DOUBLE * sum(CASE WHEN {cond} THEN 1 ELSE 0 END) / count(*), 6)"


def _n(cond: str) -> str:
    return f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


DT = "CAST(reporting_date AS VARCHAR) AS reporting_date"
QUERIES, ORACLE = {}, {}


def add(name, fn, sql, digits=6):
    QUERIES[name] = on_panel(fn, digits)
    ORACLE[name] = PANEL_SQL + sql


add("agg13_pool_dynamics", P.pool_dynamics, f"""
SELECT {DT}, round(sum(current_balance) / 1e9, 6) AS balance_bn,
       round(sum(current_balance) / nullif(sum(original_balance), 0), 6) AS pool_factor,
       round(sum(current_balance * current_interest_rate_pct) / nullif(sum(current_balance), 0), 6) AS wa_rate,
       round(sum(current_balance * seasoning_months) / nullif(sum(current_balance), 0), 6) AS wa_seasoning,
       round(sum(current_balance * remaining_term_months) / nullif(sum(current_balance), 0), 6) AS wa_remaining_term
FROM panel WHERE {ACTIVE} GROUP BY reporting_date""")

add("agg01_pool_overview", lambda d: P.pool_overview(d, FIRST, LAST), f"""
SELECT count(*) AS n_rows, count(DISTINCT loan_id) AS n_loans, count(DISTINCT reporting_date) AS n_cutoffs,
       CAST(min(reporting_date) AS VARCHAR) AS first_date, CAST(max(reporting_date) AS VARCHAR) AS last_date,
       round(sum(original_balance) FILTER (WHERE {SNAP}) / 1e9, 6) AS original_balance_bn,
       round(sum(current_balance) FILTER (WHERE {SNAP}) / 1e9, 6) AS current_balance_first_bn,
       round(sum(current_balance) FILTER (WHERE reporting_date = DATE '{LAST}') / 1e9, 6) AS current_balance_last_bn,
       round(sum(original_market_value_at_origination) FILTER (WHERE {SNAP}) / 1e9, 6) AS original_value_bn
FROM panel""")

add("agg02_monthly_composition", P.monthly_composition, f"""
SELECT {DT}, count(*) AS n_loans, {_n("arrears_bucket = 'Performing'")} AS performing,
       {_n("performing_status = 'Defaulted'")} AS defaulted, {_n("performing_status = 'Redeemed'")} AS redeemed,
       {_n("performing_status = 'Charged-Off'")} AS charged_off,
       count(*) - lag(count(*)) OVER (ORDER BY reporting_date) AS change
FROM panel GROUP BY reporting_date""")

for _dim in DIMENSIONS:
    add(f"agg03_distribution_{_dim}", lambda d, c=_dim: P.distribution(d, c, FIRST), f"""
SELECT {_dim if _dim != 'legal_maturity_months' else f'CAST({_dim} AS BIGINT)'} AS value, count(*) AS n_loans,
       round({SHARE}, 6) AS share_pct
FROM panel WHERE {SNAP} GROUP BY {_dim}""")

add("agg03_distributions_one_scan", lambda d: P.distributions(d, DIMENSIONS, None), " UNION ALL ".join(f"""
SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, count(*) AS n_loans,
       round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM panel), 6) AS share_pct
FROM panel GROUP BY {d}""" for d in DIMENSIONS))


def _quantiles(c: str, src: str) -> str:
    q = ", ".join(f"round(quantile_cont({c}, {p}), 6) AS {n}" for p, n in
                  [(0.05, "p5"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.95, "p95")])
    return f"SELECT {q}, round(avg({c}), 6) AS mean FROM {src}"


for _m in MEASURES:
    add(f"agg04_quantiles_{_m}", lambda d, c=_m: P.quantiles(d, c, FIRST), _quantiles(_m, f"panel WHERE {SNAP}"))
add("agg04_quantile_table_all_dates", lambda d: P.quantile_table(d, MEASURES + ["current_balance"], None),
    " UNION ALL ".join(_quantiles(m, "panel").replace("SELECT", f"SELECT '{m}' AS measure,", 1) for m in MEASURES + ["current_balance"]))

add("agg05_risk_markers", lambda d: P.risk_markers(d, FIRST), f"""
SELECT {_pct("nhg_flag = 'Y'")} AS nhg_pct, {_pct("buy_to_let_flag = 'Y'")} AS buy_to_let_pct,
       {_pct("self_employed_flag = 'Y'")} AS self_employed_pct, {_pct("interest_only_flag = 'Y'")} AS interest_only_pct,
       {_pct("oltomv_original > 90")} AS oltv_over_90_pct, {_pct("loan_to_income > 5")} AS lti_over_5_pct,
       {_pct("forbearance_flag = 'Y'")} AS forbearance_pct, {_pct("restructuring_flag = 'Y'")} AS restructuring_pct,
       {_pct("construction_deposit_flag = 'Y'")} AS construction_deposit_pct
FROM panel WHERE {SNAP}""")

add("agg06_arrears_trajectory", P.arrears_trajectory, f"""
SELECT {DT}, {", ".join(f'{_pct(f"arrears_bucket = {s!r}")} AS "{c}_pct"' for s, c in zip(STATES, STATE_COLS))}
FROM panel GROUP BY reporting_date""")

add("rsh3_pivot_counts", lambda d: P.pivot_counts(d, "reporting_date", "arrears_bucket", STATES), f"""
SELECT {DT}, {", ".join(f'{_n(f"arrears_bucket = {s!r}")} AS "{c}"' for s, c in zip(STATES, STATE_COLS))}, count(*) AS total
FROM panel GROUP BY reporting_date""")

add("agg07_vintage_profile", lambda d: P.vintage_profile(d, FIRST), f"""
SELECT CAST(origination_year AS BIGINT) AS origination_year, count(*) AS n_loans,
       round(avg(original_balance), 6) AS mean_original_balance, round(avg(oltomv_original), 6) AS mean_oltv,
       round({SHARE}, 6) AS share_pct
FROM panel WHERE {SNAP} GROUP BY origination_year""")

add("agg08_epc_profile", lambda d: P.epc_profile(d, FIRST), f"""
SELECT epc_label, count(*) AS n_loans, round(avg(primary_energy_demand_kwh_m2), 6) AS mean_demand,
       round({SHARE}, 6) AS share_pct,
       CAST(list_position(['A+++', 'A++', 'A+', 'A', 'B', 'C', 'D', 'E', 'F', 'G'], epc_label) AS BIGINT) AS label_rank
FROM panel WHERE {SNAP} GROUP BY epc_label""")

_EXIT = f"""
SELECT (SELECT count(DISTINCT loan_id) FROM panel WHERE {SNAP}) AS start_loans,
       (SELECT count(DISTINCT loan_id) FROM panel WHERE reporting_date = DATE '{LAST}' AND performing_status = 'Non-defaulted') AS still_performing,
       (SELECT count(DISTINCT loan_id) FROM panel WHERE reporting_date = DATE '{LAST}' AND performing_status = 'Defaulted') AS still_defaulted,
       (SELECT count(DISTINCT loan_id) FROM panel WHERE performing_status = 'Redeemed') AS ever_redeemed,
       (SELECT count(DISTINCT loan_id) FROM panel WHERE performing_status = 'Charged-Off') AS ever_charged_off"""
add("agg09_exit_accounting", lambda d: P.exit_accounting(d, FIRST, LAST),
    f"SELECT *, still_performing + still_defaulted + ever_redeemed + ever_charged_off AS total_accounted FROM ({_EXIT})")
add("agg10_headline_rates", lambda d: P.headline_rates(d, FIRST, LAST), f"""
SELECT round(100.0::DOUBLE * ever_redeemed / start_loans, 6) AS prepayment_pct,
       round(100.0::DOUBLE * ever_charged_off / start_loans, 6) AS charge_off_pct,
       round(100.0::DOUBLE * still_defaulted / start_loans, 6) AS end_default_pct,
       round(100.0::DOUBLE * (ever_redeemed + ever_charged_off) / start_loans, 6) AS attrition_pct,
       (SELECT max(x) FROM (SELECT {_pct("arrears_bucket = 'Defaulted'")} AS x FROM panel GROUP BY reporting_date)) AS peak_defaulted_pct
FROM ({_EXIT})""")

add("agg11_delinquency_rates", P.delinquency_rates, f"""
SELECT {DT}, count(*) AS n_active,
       {_pct("arrears_bucket IN ('1-29 DPD', '30-59 DPD', '60-89 DPD', '90+ DPD', 'Defaulted')")} AS delinquent_pct,
       {_pct("arrears_bucket IN ('30-59 DPD', '60-89 DPD', '90+ DPD', 'Defaulted')")} AS dpd30_pct,
       {_pct("arrears_bucket IN ('90+ DPD', 'Defaulted')")} AS dpd90_pct,
       {_pct("arrears_bucket = 'Defaulted'")} AS defaulted_pct, {_pct("foreclosure_flag = 'Y'")} AS foreclosure_pct
FROM panel WHERE {ACTIVE} GROUP BY reporting_date""")

add("agg12_compliance", P.compliance, f"""
SELECT {DT}, {_pct("nhg_flag = 'Y'")} AS nhg_pct, {_n("nhg_flag = 'Y' AND original_balance > 435000")} AS nhg_cap_breaches,
       {_pct("cltomv_current > 100")} AS underwater_pct, {_pct("forbearance_flag = 'Y'")} AS forbearance_pct,
       {_pct("restructuring_flag = 'Y'")} AS restructuring_pct, {_pct("default_crr_flag = 'Y'")} AS default_flag_pct
FROM panel WHERE {ACTIVE} GROUP BY reporting_date""")

add("agg14_vintage_outcomes", P.vintage_outcomes, """
SELECT CAST(origination_year AS BIGINT) AS origination_year, count(DISTINCT loan_id) AS cohort,
       round(100.0::DOUBLE * count(DISTINCT CASE WHEN performing_status = 'Defaulted' THEN loan_id END) / count(DISTINCT loan_id), 6) AS ever_defaulted_pct,
       round(100.0::DOUBLE * count(DISTINCT CASE WHEN performing_status = 'Charged-Off' THEN loan_id END) / count(DISTINCT loan_id), 6) AS ever_charged_off_pct,
       round(100.0::DOUBLE * count(DISTINCT CASE WHEN performing_status = 'Redeemed' THEN loan_id END) / count(DISTINCT loan_id), 6) AS ever_redeemed_pct
FROM panel GROUP BY origination_year""")

for _dim in ["province", "origination_year", "economic_region_nuts3"]:
    add(f"agg15_hhi_{_dim}", lambda d, c=_dim: P.hhi(d, c, FIRST), f""", a AS (
SELECT count(*) AS n FROM panel WHERE {SNAP} GROUP BY {_dim}), h AS (
SELECT sum(pow(100.0::DOUBLE * n / (SELECT sum(n) FROM a), 2)) AS v FROM a)
SELECT '{_dim}' AS dimension, round(v, 6) AS hhi,
       CASE WHEN v < 1500 THEN 'Unconcentrated' WHEN v < 2500 THEN 'Moderately concentrated' ELSE 'Highly concentrated' END AS concentration
FROM h""")

add("agg16_lgd", P.lgd, """, c AS (SELECT DISTINCT loan_id FROM panel WHERE performing_status = 'Charged-Off'), b AS (
SELECT loan_id, nhg_flag, max(CASE WHEN performing_status = 'Defaulted' THEN current_balance END) AS bal, max(original_balance) AS orig
FROM panel JOIN c USING (loan_id) GROUP BY 1, 2)
SELECT count(*) AS n_charged_off, round(sum(bal) / 1e6, 6) AS loss_m, round(avg(bal), 6) AS mean_loss,
       round(avg(bal / orig) * 100, 6) AS mean_lgd_pct,
       round(sum(CASE WHEN nhg_flag = 'Y' THEN bal ELSE 0 END) / 1e6, 6) AS guaranteed_m,
       CAST(sum(CASE WHEN nhg_flag = 'Y' THEN 1 ELSE 0 END) AS BIGINT) AS n_guaranteed,
       round(sum(bal) / 1e6 - sum(CASE WHEN nhg_flag = 'Y' THEN bal ELSE 0 END) / 1e6, 6) AS net_loss_m
FROM b""")

add("agg17_duplicates", lambda d: P.duplicates(d, ["reporting_date", "province", "epc_label"]), f"""
SELECT {DT}, province, epc_label, count(*) AS n FROM panel GROUP BY reporting_date, province, epc_label HAVING count(*) > 1""")
add("agg18_non_constant", lambda d: P.non_constant(d, "loan_id", "forbearance_flag"),
    "SELECT loan_id FROM panel GROUP BY loan_id HAVING count(DISTINCT forbearance_flag) > 1")
add("agg18_non_constant_tolerance", lambda d: P.non_constant(d, "loan_id", "current_interest_rate_pct", 0.025),
    "SELECT loan_id FROM panel GROUP BY loan_id HAVING max(current_interest_rate_pct) - min(current_interest_rate_pct) > 0.025")
add("agg19_late_entrants", P.late_entrants, """
SELECT loan_id, CAST(min(reporting_date) AS VARCHAR) AS first_seen FROM panel GROUP BY loan_id
HAVING min(reporting_date) > (SELECT min(reporting_date) FROM panel)""")

add("top1_top_exposure", lambda d: P.top_exposure(d, "economic_region_nuts3", 10, FIRST), f"""
SELECT economic_region_nuts3, count(*) AS n_loans, round(sum(current_balance) / 1e6, 6) AS balance_m, round({SHARE}, 6) AS share_pct
FROM panel WHERE {SNAP} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
for _k in (10, 100):
    add(f"top2_top_{_k}_share", lambda d, k=_k: P.top_k_share(d, k, FIRST), f"""
SELECT CAST({_k} AS BIGINT) AS k, round(sum(current_balance), 6) AS top_balance,
       round(100.0::DOUBLE * sum(current_balance) / (SELECT sum(current_balance) FROM panel WHERE {SNAP}), 6) AS share_pct
FROM (SELECT current_balance FROM panel WHERE {SNAP} ORDER BY current_balance DESC LIMIT {_k})""")
add("win9_top_share", lambda d: P.top_share(d, 0.01, None), """, r AS (
SELECT current_balance AS b, row_number() OVER (ORDER BY current_balance DESC) AS rn FROM panel)
SELECT count(*) AS n_rows, round(sum(b), 2) AS top_sum, (SELECT round(sum(b), 2) FROM r) AS total,
       round(100 * sum(b) / (SELECT sum(b) FROM r), 2) AS share_pct
FROM r WHERE rn <= (SELECT count(*) FROM r) * 0.01""", 2)
add("flt4_at_cutoff_last", lambda d: P.at_cutoff(d, "last").groupBy("performing_status").count().withColumnRenamed("count", "n"),
    f"SELECT performing_status, count(*) AS n FROM panel WHERE reporting_date = (SELECT max(reporting_date) FROM panel) GROUP BY 1")
add("flt5_active", lambda d: P.active(d).groupBy("performing_status").count().withColumnRenamed("count", "n"),
    f"SELECT performing_status, count(*) AS n FROM panel WHERE {ACTIVE} GROUP BY 1")
_BUCKET_COLS = ["balance_bucket", "cltomv_current_bucket", "cltimv_current_bucket", "oltomv_original_bucket",
                "loan_to_income_bucket", "payment_due_to_income_pct_bucket", "construction_year_bucket"]
add("fn01_buckets", lambda d: d.groupBy(*_BUCKET_COLS).count().withColumnRenamed("count", "n"),
    f"SELECT {', '.join(_BUCKET_COLS)}, count(*) AS n FROM panel GROUP BY ALL")
