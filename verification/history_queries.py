"""Loan histories, gold features, checks (WIN*, FEA1, JON*, PRJ6, VAL10 to VAL15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loantide.operators import checks as K, history as H, panels as G, portfolio as P
from verification.bindings import FIRST, LAST, PANEL_SQL, loans, panel, table
from verification.portfolio_queries import DT, _n, on_panel
from verification.shape import plain

QUERIES, ORACLE = {}, {}
W = "OVER (PARTITION BY loan_id ORDER BY reporting_date)"
AS_OF = "2001-12-31"


def add(name, fn, sql, digits=6):
    QUERIES[name] = on_panel(fn, digits)
    if sql is not None:
        ORACLE[name] = PANEL_SQL + sql


def split(d):
    return G.split_panel(d)


def dynamic(d):
    return split(d)[1]


def gold(d):
    return G.gold_features(*split(d))


# Silver and gold tables as SQL, after the panel.
SILVER_SQL = """, static_loans AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY loan_id ORDER BY reporting_date) AS first_rn FROM panel) WHERE first_rn = 1
), dyn AS (
  SELECT loan_id, reporting_date, current_balance, current_interest_rate_pct, remaining_term_months, seasoning_months,
         cltomv_current, cltimv_current, arrears_bucket, arrears_amount, days_past_due, default_crr_flag = 'Y' AS default_crr_flag,
         performing_status, foreclosure_flag = 'Y' AS foreclosure_flag, forbearance_flag = 'Y' AS forbearance_flag,
         restructuring_flag = 'Y' AS restructuring_flag, balance_bucket, cltomv_current_bucket
  FROM panel
), leads AS (
  SELECT *, lead(default_crr_flag, 1) OVER w AS d1, lead(default_crr_flag, 2) OVER w AS d2, lead(default_crr_flag, 3) OVER w AS d3,
         lead(current_balance, 1) OVER w AS b1, lead(current_balance, 2) OVER w AS b2, lead(current_balance, 3) OVER w AS b3,
         lead(performing_status, 1) OVER w AS s1, lead(performing_status, 2) OVER w AS s2, lead(performing_status, 3) OVER w AS s3,
         lag(current_balance) OVER w AS pb
  FROM dyn WINDOW w AS (PARTITION BY loan_id ORDER BY reporting_date)
), labelled AS (
  SELECT *, CASE WHEN coalesce(d1, false) OR coalesce(d2, false) OR coalesce(d3, false) THEN 1 ELSE 0 END AS default_in_3m,
         CASE WHEN coalesce(b1, 1) = 0 OR coalesce(b2, 1) = 0 OR coalesce(b3, 1) = 0 THEN 1 ELSE 0 END AS prepay_in_3m,
         CASE WHEN pb > 0 THEN (current_balance - pb) / pb END AS balance_mom_1m, year(reporting_date) AS obs_year
  FROM leads
), gold AS (
  SELECT l.*, s.* EXCLUDE (loan_id, reporting_date, current_balance, current_interest_rate_pct, remaining_term_months,
         seasoning_months, cltomv_current, cltimv_current, arrears_bucket, arrears_amount, days_past_due, default_crr_flag,
         performing_status, foreclosure_flag, forbearance_flag, restructuring_flag, balance_bucket, cltomv_current_bucket)
  FROM labelled l JOIN static_loans s ON l.loan_id = s.loan_id
  WHERE d1 IS NOT NULL AND d2 IS NOT NULL AND d3 IS NOT NULL
)"""

_BOOLS = {c for c in G.GOLD_STATIC + G.GOLD_DYNAMIC if c.endswith("_flag")}
_INTS = {"origination_year", "legal_maturity_months", "debtor_count", "construction_year", "primary_energy_demand_kwh_m2",
         "remaining_term_months", "seasoning_months", "days_past_due", "default_in_3m", "prepay_in_3m", "obs_year"}
_DOUBLES = {"original_balance", "oltomv_original", "original_market_value_at_origination", "loan_to_income",
            "payment_due_to_income_pct", "borrower_annual_income", "current_balance", "current_interest_rate_pct",
            "cltomv_current", "cltimv_current", "arrears_amount", "balance_mom_1m"}


def sql_col(c: str, digits: int = 4, raw_flags: bool = False) -> str:
    if c == "reporting_date":
        return DT
    if c in _BOOLS and c in G.GOLD_STATIC:
        return f"{c} = 'Y' AS {c}"
    if c in _INTS:
        return f"CAST({c} AS BIGINT) AS {c}"
    if c in _DOUBLES:
        return f"round({c}, {digits}) AS {c}"
    return c


GOLD_OUT = ["loan_id", "reporting_date", *G.GOLD_STATIC, *G.GOLD_DYNAMIC, "balance_mom_1m", "default_in_3m", "prepay_in_3m", "obs_year"]

add("win1_lagged", lambda d: H.lagged(d).select("loan_id", "reporting_date", *H.LAGGED.values()), f"""
SELECT loan_id, {DT}, round(lag(current_balance) {W}, 6) AS prev_balance, round(lag(arrears_amount) {W}, 6) AS prev_arrears,
       lag(performing_status) {W} AS prev_status, lag(arrears_bucket) {W} AS prev_bucket,
       CAST(lag(seasoning_months) {W} AS BIGINT) AS prev_seasoning, CAST(lag(remaining_term_months) {W} AS BIGINT) AS prev_remaining_term,
       CAST(lag(reporting_date) {W} AS VARCHAR) AS prev_reporting_date
FROM panel""")
add("win2_forward_labels", lambda d: H.forward_labels(dynamic(d)).select("loan_id", "reporting_date", "default_in_3m", "prepay_in_3m"),
    SILVER_SQL + f"SELECT loan_id, {DT}, CAST(default_in_3m AS BIGINT) AS default_in_3m, CAST(prepay_in_3m AS BIGINT) AS prepay_in_3m FROM labelled")
add("win2_forward_labels_exclude_default",
    lambda d: H.forward_labels(dynamic(d), exclude_default=True).groupBy("prepay_in_3m").agg(F.count(F.lit(1)).alias("n")),
    SILVER_SQL + """
SELECT CAST(CASE WHEN (b1 = 0 AND s1 <> 'Charged-Off') OR (b2 = 0 AND s2 <> 'Charged-Off') OR (b3 = 0 AND s3 <> 'Charged-Off') THEN 1 ELSE 0 END AS BIGINT)
       AS prepay_in_3m, count(*) AS n FROM leads GROUP BY 1""")
add("win3_momentum", lambda d: H.momentum(d).select("loan_id", "reporting_date", "balance_mom_1m"), f"""
SELECT loan_id, {DT}, round(CASE WHEN pb > 0 THEN (current_balance - pb) / pb END, 6) AS balance_mom_1m
FROM (SELECT *, lag(current_balance) {W} AS pb FROM panel)""")
add("win4_with_full_horizon", lambda d: H.with_full_horizon(dynamic(d)).select("loan_id", "reporting_date", "obs_year"),
    SILVER_SQL + f"SELECT loan_id, {DT}, CAST(obs_year AS BIGINT) AS obs_year FROM labelled WHERE d1 IS NOT NULL AND d2 IS NOT NULL AND d3 IS NOT NULL")
add("win5_first_per_key", lambda d: H.first_per_key(d, ["loan_id"], ["reporting_date"]).select("loan_id", "reporting_date", "arrears_bucket"),
    f"SELECT loan_id, {DT}, arrears_bucket FROM (SELECT *, row_number() {W} AS rn1 FROM panel) WHERE rn1 = 1")


def _rate(before: str, after: str) -> str:
    return (f"round(100.0::DOUBLE * sum(CASE WHEN {before} AND {after} THEN 1 ELSE 0 END)"
            f" / nullif(sum(CASE WHEN {before} THEN 1 ELSE 0 END), 0), 6)")


_LADDER = ["Performing", "1-29 DPD", "30-59 DPD", "60-89 DPD", "90+ DPD", "Defaulted"]
_NAMES = ["perf_to_1_29", "d1_29_to_30_59", "d30_59_to_60_89", "d60_89_to_90", "d90_to_default"]
_DPD = "('1-29 DPD', '30-59 DPD', '60-89 DPD', '90+ DPD')"
add("win6_roll_rates", H.roll_rates, f""", l AS (SELECT reporting_date, arrears_bucket AS b, lag(arrears_bucket) {W} AS p FROM panel)
SELECT {DT}, {", ".join(f'{_rate(f"p = {a!r}", f"b = {b!r}")} AS {n}' for n, a, b in zip(_NAMES, _LADDER, _LADDER[1:]))},
       {_rate(f"p IN {_DPD}", "b = 'Performing'")} AS cure_rate, {_n("b = 'Charged-Off' AND p = 'Defaulted'")} AS new_charge_offs
FROM l WHERE p IS NOT NULL GROUP BY reporting_date""")
for _inc, _set in ((False, _DPD), (True, "('1-29 DPD', '30-59 DPD', '60-89 DPD', '90+ DPD', 'Defaulted')")):
    add("win7_cures" + ("_incl_defaulted" if _inc else ""), lambda d, i=_inc: H.cures(d, i), f"""
, l AS (SELECT loan_id, arrears_bucket = 'Performing' AND coalesce(lag(arrears_bucket) {W} IN {_set}, false) AS c FROM panel)
SELECT loan_id, bool_or(c) AS had_cure, CAST(count(*) FILTER (WHERE c) AS BIGINT) AS n_cures FROM l GROUP BY loan_id""")
add("win8_step_compliance", lambda d: H.step_compliance(d, "seasoning_months", 0, 2).union(H.step_compliance(d, "remaining_term_months", -1, 2, -1)), f"""
, o AS (SELECT seasoning_months - lag(seasoning_months) {W} AS s, lag(remaining_term_months) {W} - remaining_term_months AS t FROM panel)
SELECT round(100.0::DOUBLE * sum(CASE WHEN s IS NULL OR s BETWEEN 0 AND 2 THEN 1 ELSE 0 END) / count(*), 2) AS compliance_pct FROM o
UNION ALL SELECT round(100.0::DOUBLE * sum(CASE WHEN t IS NULL OR t BETWEEN -1 AND 2 THEN 1 ELSE 0 END) / count(*), 2) FROM o""")


def _streak_sql(hit: str) -> str:
    return f""", m AS (SELECT *, CASE WHEN {hit} THEN 1 ELSE 0 END AS h FROM panel),
 g AS (SELECT *, sum(1 - h) OVER (PARTITION BY loan_id ORDER BY reporting_date ROWS UNBOUNDED PRECEDING) AS isl FROM m),
 r AS (SELECT *, CAST(sum(h) OVER (PARTITION BY loan_id, isl ORDER BY reporting_date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM g)"""


add("win10_arrears_streak", lambda d: H.arrears_streak(d).select("loan_id", "reporting_date", "arrears_streak"),
    _streak_sql("arrears_bucket NOT IN ('Performing', 'Redeemed', 'Charged-Off')") + f"SELECT loan_id, {DT}, streak AS arrears_streak FROM r")
add("win10_default_streak", lambda d: H.default_streak(d, 2).select("loan_id", "reporting_date", "default_streak", "charge_off_due"),
    _streak_sql("arrears_bucket = 'Defaulted'") + f"SELECT loan_id, {DT}, streak AS default_streak, streak >= 2 AS charge_off_due FROM r")
add("win11_months_to_default", lambda d: H.months_to_default(dynamic(d)).select("loan_id", "reporting_date", "default_date", "months_to_default"),
    SILVER_SQL + f""", f AS (SELECT *, min(CASE WHEN default_crr_flag THEN reporting_date END) OVER (PARTITION BY loan_id) AS dd FROM dyn)
SELECT loan_id, {DT}, CAST(dd AS VARCHAR) AS default_date,
       CAST(coalesce(round_even(datediff('day', reporting_date, dd) / 30.0::DOUBLE, 0), -1) AS BIGINT) AS months_to_default FROM f""")
add("jon4_with_default_date", lambda d: H.with_default_date(dynamic(d)).groupBy("loan_id").agg(F.min("default_date").alias("default_date")),
    SILVER_SQL + "SELECT loan_id, CAST(min(reporting_date) FILTER (WHERE default_crr_flag) AS VARCHAR) AS default_date FROM dyn GROUP BY loan_id")

add("prj6_static_loans", lambda d: split(d)[0].select("loan_id", *G.GOLD_STATIC),
    SILVER_SQL + f"SELECT {', '.join(sql_col(c) for c in ['loan_id', *G.GOLD_STATIC])} FROM static_loans", 4)
add("prj6_dynamic_performance", lambda d: dynamic(d).select("loan_id", "reporting_date", *G.GOLD_DYNAMIC),
    SILVER_SQL + f"SELECT {', '.join(sql_col(c) for c in ['loan_id', 'reporting_date', *G.GOLD_DYNAMIC])} FROM dyn", 4)
add("fea1_gold_features", gold, SILVER_SQL + f"SELECT {', '.join(sql_col(c) for c in GOLD_OUT)} FROM gold", 4)
add("jon1_static_dynamic", lambda d: (lambda s, y: y.join(s, "loan_id").groupBy("province").agg(F.count(F.lit(1)).alias("n")))(*split(d)),
    SILVER_SQL + "SELECT s.province, count(*) AS n FROM dyn JOIN static_loans s USING (loan_id) GROUP BY 1")
add("agg20_loan_labels", lambda d: P.loan_labels(gold(d)),
    SILVER_SQL + "SELECT loan_id, CAST(max(default_in_3m) AS BIGINT) AS label FROM gold GROUP BY loan_id")
add("agg26_class_weight", lambda d: P.class_weight(gold(d), "default_in_3m"), SILVER_SQL + """
SELECT count(*) FILTER (WHERE default_in_3m = 1) AS positives, count(*) FILTER (WHERE default_in_3m = 0) AS negatives,
       round(count(*) FILTER (WHERE default_in_3m = 0)::DOUBLE / greatest(count(*) FILTER (WHERE default_in_3m = 1), 1), 6) AS pos_weight,
       round(avg(default_in_3m), 6) AS positive_rate FROM gold""")


def _orphans(spark, sf):
    """Line items against all orders; those of line 7 point to orders that do not exist."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("loan_id"))
    key = F.when(F.col("l_linenumber") == 7, -F.col("l_orderkey")).otherwise(F.col("l_orderkey"))
    lines = table(spark, sf, "lineitem").select(key.alias("loan_id"), "l_linenumber")
    return plain(G.orphans(lines, orders).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n")))


QUERIES["jon2_orphans"] = _orphans
ORACLE["jon2_orphans"] = """
SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n FROM (SELECT l_linenumber, CASE WHEN l_linenumber = 7 THEN -l_orderkey ELSE l_orderkey END AS k FROM lineitem)
LEFT JOIN orders ON k = o_orderkey WHERE o_orderkey IS NULL GROUP BY 1"""

EXPECT = K.PanelExpectation(originator="Originator A", servicer="Servicer A", n_cutoffs=80)
_LATE = "('1-29 DPD', '30-59 DPD', '60-89 DPD', '90+ DPD', 'Defaulted')"


def _panel_check_sql() -> str:
    rows = {
        "B01": "currency <> 'EUR'", "B02": "country <> 'NL'", "B03": "originator_name <> 'Originator A'",
        "B04": "servicer_name <> 'Servicer A'",
        "B08": r"NOT regexp_matches(CAST(closing_date AS VARCHAR), '^\d{4}-\d{2}-\d{2}$')",
        "C01": "arrears_bucket NOT IN ('Performing', '1-29 DPD', '30-59 DPD', '60-89 DPD', '90+ DPD', 'Defaulted', 'Charged-Off', 'Redeemed')",
        "C02": "days_past_due NOT IN (0, 15, 45, 75, 120, 200)",
        "C03": "performing_status NOT IN ('Non-defaulted', 'Defaulted', 'Charged-Off', 'Redeemed')",
        "C04": "nhg_flag NOT IN ('Y', 'N')", "C05": "interest_only_flag NOT IN ('Y', 'N')",
        "C06": "epc_label NOT IN ('A+++', 'A++', 'A+', 'A', 'B', 'C', 'D', 'E', 'F', 'G')",
        "C07": "legal_maturity_months NOT IN (240, 300, 330, 360)",
        "C08": "NOT oltomv_original BETWEEN 0 AND 200", "C09": "NOT cltomv_current BETWEEN 0 AND 200",
        "C10": "NOT cltimv_current BETWEEN 0 AND 200", "C11": "NOT original_balance BETWEEN 500 AND 5000000",
        "C12": "current_balance > original_balance + 1.0", "C13": "nhg_flag = 'Y' AND guarantee_type <> 'NHG'",
        "C14": "nhg_flag = 'Y' AND original_balance > 435000",
        "C15": "NOT (country = 'NL' AND currency = 'EUR' AND originator_name = 'Originator A')",
        "F03": "performing_status = 'Redeemed' AND abs(current_balance) > 0.01",
        "F04": "performing_status = 'Charged-Off' AND abs(current_balance) > 0.01",
        "F05": "arrears_bucket = 'Performing' AND abs(arrears_amount) > 0.01",
        "F06": "arrears_bucket = 'Performing' AND days_past_due <> 0",
        "F10": "performing_status = 'Defaulted' AND foreclosure_flag <> 'Y'",
        "F11": "arrears_bucket IN ('90+ DPD', 'Defaulted', 'Charged-Off') AND default_crr_flag <> 'Y'",
    }
    lag = {
        "E01": "pd IS NOT NULL AND reporting_date <= pd", "E02": "ps IS NOT NULL AND seasoning_months - ps <> 1",
        "E03": "pt IS NOT NULL AND pt - remaining_term_months <> 1 AND remaining_term_months > 0",
        "F01": "pb IS NOT NULL AND arrears_bucket = 'Performing' AND pk = 'Performing' AND interest_only_flag = 'N' AND current_balance > pb + 0.01",
        "F02": f"pb IS NOT NULL AND arrears_bucket IN {_LATE} AND pk IN {_LATE} AND abs(current_balance - pb) > 0.01",
        "F07": f"pk IN {_LATE} AND arrears_bucket = 'Performing' AND arrears_amount <> 0",
        "F08": f"pk IN {_LATE} AND arrears_bucket IN {_LATE} AND abs(arrears_amount - pa - scheduled_monthly_payment) > 0.5",
        "F09": "pb IS NOT NULL AND interest_only_flag = 'Y' AND arrears_bucket = 'Performing' AND pk = 'Performing' AND abs(current_balance - pb) > 0.01",
        "G02": "pst IN ('Redeemed', 'Charged-Off')",
    }
    one = "CASE WHEN count(DISTINCT {0}) <> 1 THEN 1 ELSE 0 END"
    const = lambda c: f"(SELECT count(*) FROM (SELECT loan_id FROM panel GROUP BY 1 HAVING count(DISTINCT {c}) > 1))"
    pool = {
        "A01": "(SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM panel)",
        "A02": "(SELECT CASE WHEN count(DISTINCT reporting_date) <> 80 THEN 1 ELSE 0 END FROM panel)",
        "A03": "0",
        "A04": "(SELECT count(*) FROM (SELECT 1 FROM panel GROUP BY reporting_date, loan_id HAVING count(*) > 1))",
        "B05": f"(SELECT {one.format('closing_date')} FROM panel)",
        "B06": f"(SELECT {one.format('transaction_name')} FROM panel)",
        "B07": f"(SELECT {one.format('esma_transaction_identifier')} FROM panel)",
        "D01": const("origination_year"), "D02": const("original_balance"), "D03": const("province"), "D04": const("nhg_flag"),
        "D05": const("legal_maturity_months"), "D06": const("interest_only_flag"),
        "D07": "(SELECT count(*) FROM (SELECT loan_id FROM panel GROUP BY 1 HAVING max(scheduled_monthly_payment) - min(scheduled_monthly_payment) > 0.01))",
        "G01": "(SELECT count(*) FROM (SELECT loan_id FROM panel GROUP BY 1 HAVING min(reporting_date) > (SELECT min(reporting_date) FROM panel)))",
        "H01": "(SELECT CASE WHEN avg(CASE WHEN performing_status = 'Non-defaulted' THEN 1.0 ELSE 0.0 END) < 0.9 THEN 1 ELSE 0 END FROM panel WHERE reporting_date = (SELECT min(reporting_date) FROM panel))",
        "H02": "(SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM panel WHERE reporting_date = (SELECT max(reporting_date) FROM panel) AND performing_status = 'Defaulted')",
        "H03": "(SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM panel WHERE performing_status IN ('Redeemed', 'Charged-Off'))",
    }
    arms = [f"SELECT '{i}' AS check_id, (SELECT count(*) FROM panel WHERE {c}) AS v" for i, c in rows.items()]
    arms += [f"SELECT '{i}', (SELECT count(*) FROM l WHERE {c})" for i, c in lag.items()]
    arms += [f"SELECT '{i}', {c}" for i, c in pool.items()]
    return f""", l AS (SELECT *, lag(current_balance) {W} AS pb, lag(arrears_amount) {W} AS pa, lag(performing_status) {W} AS pst,
  lag(arrears_bucket) {W} AS pk, lag(seasoning_months) {W} AS ps, lag(remaining_term_months) {W} AS pt, lag(reporting_date) {W} AS pd FROM panel),
t AS ({" UNION ALL ".join(arms)}),
results AS (SELECT check_id, check_id[1] AS section, CAST(v AS BIGINT) AS violations, CASE WHEN v = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM t)"""


_CHECKS = _panel_check_sql()
_PF = "count(*) AS total, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'FAIL') AS failed"
add("val10_panel_checks", lambda d: K.run_panel_checks(d, EXPECT).drop("name"), _CHECKS + "SELECT * FROM results")
add("val10_section_summary", lambda d: K.summarise(K.run_panel_checks(d, EXPECT)), _CHECKS + f"SELECT section, {_PF} FROM results GROUP BY section")
add("val10_overall_summary", lambda d: K.summarise(K.run_panel_checks(d, EXPECT), None), _CHECKS + f"""
SELECT {_PF}, CAST(sum(violations) AS BIGINT) AS total_violations,
       CASE WHEN count(*) FILTER (WHERE status = 'FAIL') = 0 THEN 'ALL PASS' ELSE 'FAILURES' END AS overall FROM results""")


def _gold_checks(d):
    static, dyn = split(d)
    return K.run_gold_checks(static, dyn, G.gold_features(static, dyn), AS_OF, [*K.GOLD_CHECKS, K.ARREARS_WITHIN_BALANCE])


_GOLD_VALUES = {
    "schema.static_loans_nonempty": ("(SELECT count(*) FROM static_loans)", "v > 0"),
    "schema.dynamic_nonempty": ("(SELECT count(*) FROM dyn)", "v > 0"),
    "schema.gold_nonempty": ("(SELECT count(*) FROM gold)", "v > 0"),
    "schema.fk_integrity": ("(SELECT count(*) FROM dyn LEFT JOIN static_loans s USING (loan_id) WHERE s.province IS NULL)", "v = 0"),
    "schema.pk_uniqueness": ("(SELECT count(*) FROM (SELECT 1 FROM dyn GROUP BY loan_id, reporting_date HAVING count(*) > 1))", "v = 0"),
    "schema.cutoff_count": ("(SELECT count(DISTINCT reporting_date) FROM dyn)", "v >= 12"),
    "temporal.seasoning_increment": (f"(SELECT round(100.0::DOUBLE * sum(CASE WHEN s IS NULL OR s BETWEEN 0 AND 2 THEN 1 ELSE 0 END) / count(*), 2) FROM (SELECT seasoning_months - lag(seasoning_months) {W} AS s FROM dyn))", "v >= 95"),
    "temporal.remaining_term_decrements": (f"(SELECT round(100.0::DOUBLE * sum(CASE WHEN s IS NULL OR s BETWEEN -1 AND 2 THEN 1 ELSE 0 END) / count(*), 2) FROM (SELECT lag(remaining_term_months) {W} - remaining_term_months AS s FROM dyn))", "v >= 90"),
    "temporal.no_negative_seasoning": ("(SELECT count(*) FROM dyn WHERE seasoning_months < 0)", "v = 0"),
    "temporal.no_future_dates": (f"(SELECT count(*) FROM dyn WHERE reporting_date > DATE '{AS_OF}')", "v = 0"),
    "lifecycle.nonneg_balance": ("(SELECT count(*) FROM dyn WHERE current_balance < 0)", "v = 0"),
    "lifecycle.nonneg_dpd": ("(SELECT count(*) FROM dyn WHERE days_past_due < 0)", "v = 0"),
    "lifecycle.nonneg_interest_rate": ("(SELECT count(*) FROM dyn WHERE current_interest_rate_pct < 0)", "v = 0"),
    "lifecycle.positive_original_balance": ("(SELECT count(*) FROM static_loans WHERE original_balance <= 0 OR original_balance IS NULL)", "v = 0"),
    "gold.label_distribution": ("(SELECT sum(default_in_3m) FROM gold)", "v > 0"),
    "gold.label_rate": ("(SELECT round(100.0::DOUBLE * avg(default_in_3m), 4) FROM gold)", "v BETWEEN 0.1 AND 50"),
    "gold.no_null_loan_id": ("(SELECT count(*) FROM gold WHERE loan_id IS NULL)", "v = 0"),
    "gold.no_null_reporting_date": ("(SELECT count(*) FROM gold WHERE reporting_date IS NULL)", "v = 0"),
    "lifecycle.arrears_within_balance": ("(SELECT count(*) FROM dyn WHERE arrears_amount > current_balance AND arrears_bucket NOT IN ('Redeemed', 'Charged-Off'))", "v = 0"),
}
_GOLD_SQL = SILVER_SQL + ", t AS (" + " UNION ALL ".join(
    f"SELECT '{i}' AS check_id, CAST({v} AS DOUBLE) AS v" for i, (v, _) in _GOLD_VALUES.items()) + """),
g AS (SELECT check_id, split_part(check_id, '.', 1) AS category, round(v, 6) AS value,
       CASE check_id """ + " ".join(f"WHEN '{i}' THEN {c}" for i, (_, c) in _GOLD_VALUES.items()) + " END AS passed FROM t)"
add("val11_gold_checks", lambda d: _gold_checks(d).drop("detail"), _GOLD_SQL + "SELECT * FROM g")
add("val11_gold_summary", lambda d: K.gold_summary(_gold_checks(d)),
    _GOLD_SQL + "SELECT category, count(*) AS total, count(*) FILTER (WHERE passed) AS passed FROM g GROUP BY category")
add("val12_profile", lambda d: K.profile(d, ["loan_id", "reporting_date"], ["loan_id", "original_balance", "reporting_date", "current_balance"]), """
SELECT 'duplicate_keys' AS metric, (SELECT count(*) FROM (SELECT 1 FROM panel GROUP BY loan_id, reporting_date HAVING count(*) > 1)) AS value
UNION ALL SELECT 'loan_id_nulls', (SELECT count(*) FROM panel WHERE loan_id IS NULL)
UNION ALL SELECT 'original_balance_nulls', (SELECT count(*) FROM panel WHERE original_balance IS NULL)
UNION ALL SELECT 'reporting_date_nulls', (SELECT count(*) FROM panel WHERE reporting_date IS NULL)
UNION ALL SELECT 'current_balance_nulls', (SELECT count(*) FROM panel WHERE current_balance IS NULL)
UNION ALL SELECT 'distinct_dates', (SELECT count(DISTINCT reporting_date) FROM panel)
UNION ALL SELECT 'unique_loans', (SELECT count(DISTINCT loan_id) FROM panel)""")
add("val13_table_status", lambda d: K.table_status(gold(d), label="default_in_3m"), SILVER_SQL + """
SELECT count(*) AS n_rows, CAST(min(reporting_date) AS VARCHAR) AS first_date, CAST(max(reporting_date) AS VARCHAR) AS last_date,
       count(DISTINCT reporting_date) AS n_dates, round(100.0::DOUBLE * avg(default_in_3m), 3) AS label_rate_pct FROM gold""")


def _constraints(spark, sf):
    """The whole tables; loans in long arrears point to a parent that does not exist."""
    static, dyn = split(panel(spark, sf))
    dyn = dyn.withColumn("loan_id", F.when(F.col("days_past_due") > 60, F.concat("loan_id", F.lit("-lost"))).otherwise(F.col("loan_id")))
    spec = K.Constraints(("loan_id", "reporting_date"), (("loan_id", static),),
                         ("current_balance >= 0 OR current_balance IS NULL", "days_past_due >= 0", "current_balance < 400000"))
    return plain(K.check_constraints(dyn, spec))


QUERIES["val14_check_constraints"] = _constraints
ORACLE["val14_check_constraints"] = PANEL_SQL + SILVER_SQL + """, child AS (SELECT * REPLACE (CASE WHEN days_past_due > 60 THEN loan_id || '-lost' ELSE loan_id END AS loan_id) FROM dyn)
SELECT 'primary key loan_id, reporting_date' AS rule, (SELECT count(*) FROM (SELECT 1 FROM child GROUP BY loan_id, reporting_date HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'foreign key loan_id', (SELECT count(*) FROM child WHERE loan_id NOT IN (SELECT loan_id FROM static_loans))
UNION ALL SELECT 'current_balance >= 0 OR current_balance IS NULL', (SELECT count(*) FROM child WHERE current_balance < 0)
UNION ALL SELECT 'days_past_due >= 0', (SELECT count(*) FROM child WHERE days_past_due < 0)
UNION ALL SELECT 'current_balance < 400000', (SELECT count(*) FROM child WHERE NOT current_balance < 400000)"""
