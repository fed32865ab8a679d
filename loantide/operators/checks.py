"""Declarative data-quality checks (VAL10 to VAL15, SET1).

A check is data: an id, a section and a violation expression. Checks that need the
same shape of input share one aggregation. The panel suite reads the panel twice: once by cut-off, combined before the
shuffle, and once by loan, where one shuffle serves the checks over a loan and those over neighbouring rows. Whether a
text varies is decided by a 64-bit hash of it, since a minimum of text would turn the hash aggregation into a sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from loantide.operators.history import DATE, KEY, by_loan, lagged, step_ok
from loantide.functions.states import (
    ARREARS_STATES, DAYS_PAST_DUE, DELINQUENT_STATES, EPC_LABELS, NHG_CAP, PERFORMING_STATUSES,
)


@dataclass(frozen=True)
class Check:
    """``shape`` is row, pool, lagged or loan.

    row and lagged count rows that satisfy ``violation``; loan counts loans whose aggregate
    does; pool is one aggregate over the table with a row per cut-off that is true when violated.
    """

    id: str
    name: str
    shape: str
    violation: str

    @property
    def section(self) -> str:
        return self.id[0]


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


# Expected constants, limits and counts of the panel suite.
@dataclass(frozen=True)
class PanelExpectation:
    originator: str
    servicer: str
    currency: str = "EUR"
    country: str = "NL"
    n_cutoffs: int = 24
    n_columns: int = 71
    maturities: tuple = (240, 300, 330, 360)
    balance_range: tuple = (500, 5_000_000)
    first_non_defaulted: float = 0.90


def panel_checks(x: PanelExpectation) -> list[Check]:
    """The panel suite, except A03, A04 and G01, which are no expression over rows, loans or cut-offs."""
    late = _in(DELINQUENT_STATES)
    active_pair = f"arrears_bucket IN {late} AND prev_bucket IN {late}"
    one_value = "min({0}_lo) IS NULL OR min({0}_lo) <> max({0}_hi)"
    varies = "max({0}) <> min({0})"
    text_varies = varies.format("CASE WHEN {0} IS NOT NULL THEN xxhash64({0}) END")
    lo, hi = x.balance_range
    C = Check
    return [
        C("A01", "panel has rows", "pool", "coalesce(sum(n), 0) = 0"),
        C("A02", "expected number of cut-offs", "pool", f"count({DATE}) <> {x.n_cutoffs}"),
        C("B01", "currency constant", "row", f"currency <> '{x.currency}'"),
        C("B02", "country constant", "row", f"country <> '{x.country}'"),
        C("B03", "originator constant", "row", f"originator_name <> '{x.originator}'"),
        C("B04", "servicer constant", "row", f"servicer_name <> '{x.servicer}'"),
        C("B05", "one closing date", "pool", one_value.format("closing_date")),
        C("B06", "one transaction name", "pool", one_value.format("transaction_name")),
        C("B07", "one transaction identifier", "pool", one_value.format("esma_transaction_identifier")),
        C("B08", "closing date is ISO", "row", r"NOT CAST(closing_date AS STRING) RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'"),
        C("C01", "arrears state known", "row", f"arrears_bucket NOT IN {_in(ARREARS_STATES)}"),
        C("C02", "days past due known", "row", f"days_past_due NOT IN {_in(sorted(set(DAYS_PAST_DUE)))}"),
        C("C03", "status known", "row", f"performing_status NOT IN {_in(PERFORMING_STATUSES)}"),
        C("C04", "guarantee flag is Y or N", "row", "nhg_flag NOT IN ('Y', 'N')"),
        C("C05", "interest-only flag is Y or N", "row", "interest_only_flag NOT IN ('Y', 'N')"),
        C("C06", "energy label known", "row", f"epc_label NOT IN {_in(EPC_LABELS)}"),
        C("C07", "legal maturity known", "row", f"legal_maturity_months NOT IN {_in(x.maturities)}"),
        C("C08", "original loan-to-value range", "row", "oltomv_original < 0 OR oltomv_original > 200"),
        C("C09", "current loan-to-value range", "row", "cltomv_current < 0 OR cltomv_current > 200"),
        C("C10", "indexed loan-to-value range", "row", "cltimv_current < 0 OR cltimv_current > 200"),
        C("C11", "original balance plausible", "row", f"original_balance < {lo} OR original_balance > {hi}"),
        C("C12", "current balance within original", "row", "current_balance > original_balance + 1.0"),
        C("C13", "guarantee flag implies type", "row", "nhg_flag = 'Y' AND guarantee_type <> 'NHG'"),
        C("C14", "guarantee cap", "row", f"nhg_flag = 'Y' AND original_balance > {NHG_CAP}"),
        C("C15", "country, currency, originator agree", "row",
          f"NOT (country = '{x.country}' AND currency = '{x.currency}' AND originator_name = '{x.originator}')"),
        C("D01", "origination year constant", "loan", varies.format("origination_year")),
        C("D02", "original balance constant", "loan", varies.format("original_balance")),
        C("D03", "province constant", "loan", text_varies.format("province")),
        C("D04", "guarantee flag constant", "loan", text_varies.format("nhg_flag")),
        C("D05", "legal maturity constant", "loan", varies.format("legal_maturity_months")),
        C("D06", "interest-only flag constant", "loan", text_varies.format("interest_only_flag")),
        C("D07", "scheduled payment constant", "loan", "max(scheduled_monthly_payment) - min(scheduled_monthly_payment) > 0.01"),
        C("E01", "dates increase", "lagged", f"prev_reporting_date IS NOT NULL AND {DATE} <= prev_reporting_date"),
        C("E02", "seasoning grows by one", "lagged", "seasoning_months - prev_seasoning <> 1"),
        C("E03", "remaining term falls by one", "lagged", "prev_remaining_term - remaining_term_months <> 1 AND remaining_term_months > 0"),
        C("F01", "amortising balance never grows", "lagged",
          "arrears_bucket = 'Performing' AND prev_bucket = 'Performing' AND interest_only_flag = 'N' AND current_balance > prev_balance + 0.01"),
        C("F02", "balance frozen in arrears", "lagged", f"{active_pair} AND abs(current_balance - prev_balance) > 0.01"),
        C("F03", "redeemed balance is zero", "row", "performing_status = 'Redeemed' AND abs(current_balance) > 0.01"),
        C("F04", "charged-off balance is zero", "row", "performing_status = 'Charged-Off' AND abs(current_balance) > 0.01"),
        C("F05", "performing has no arrears", "row", "arrears_bucket = 'Performing' AND abs(arrears_amount) > 0.01"),
        C("F06", "performing is not past due", "row", "arrears_bucket = 'Performing' AND days_past_due <> 0"),
        C("F07", "cure clears arrears", "lagged", f"prev_bucket IN {late} AND arrears_bucket = 'Performing' AND arrears_amount <> 0"),
        C("F08", "arrears grow by one payment", "lagged",
          f"{active_pair} AND abs((arrears_amount - prev_arrears) - scheduled_monthly_payment) > 0.5"),
        C("F09", "interest-only balance constant", "lagged",
          "interest_only_flag = 'Y' AND arrears_bucket = 'Performing' AND prev_bucket = 'Performing' AND abs(current_balance - prev_balance) > 0.01"),
        C("F10", "defaulted is in foreclosure", "row", "performing_status = 'Defaulted' AND foreclosure_flag <> 'Y'"),
        C("F11", "90+ carries the default flag", "row",
          "arrears_bucket IN ('90+ DPD', 'Defaulted', 'Charged-Off') AND default_crr_flag <> 'Y'"),
        C("G02", "closed loans stay closed", "lagged", "prev_status IN ('Redeemed', 'Charged-Off')"),
        C("H01", "first cut-off mostly performing", "pool",
          f"min_by(performing, {DATE}) < {x.first_non_defaulted} * min_by(n, {DATE})"),
        C("H02", "last cut-off has defaults", "pool", f"max_by(defaulted, {DATE}) = 0"),
        C("H03", "some loans left the pool", "pool", "sum(gone) = 0"),
    ]


def _long(wide: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One row per check from one row with a column per check."""
    entry = lambda c: F.struct(
        F.lit(c.id).alias("check_id"),
        F.lit(c.name).alias("name"),
        F.lit(c.section).alias("section"),
        F.coalesce(F.col(c.id), F.lit(0)).cast("long").alias("violations"),
    )
    return wide.select(F.explode(F.array(*[entry(c) for c in checks])).alias("c")).select("c.*")


# What the pool checks need of each cut-off; of texts the hashes of their values.
_ONE_VALUE = ("closing_date", "transaction_name", "esma_transaction_identifier")
_OF_CUTOFF = {
    "n": "count(*)", "performing": "count_if(performing_status = 'Non-defaulted')", "defaulted": "count_if(performing_status = 'Defaulted')",
    "gone": "count_if(performing_status IN ('Redeemed', 'Charged-Off'))",
    **{f"{c}_{end}": f"{f}(CASE WHEN {c} IS NOT NULL THEN xxhash64(CAST({c} AS STRING)) END)" for c in _ONE_VALUE for end, f in (("lo", "min"), ("hi", "max"))},
}
# Columns that the checks by loan read besides the lagged ones.
_LOAN_INPUT = [KEY, DATE, "current_balance", "arrears_amount", "performing_status", "arrears_bucket", "seasoning_months", "remaining_term_months",
               "interest_only_flag", "scheduled_monthly_payment", "origination_year", "original_balance", "province", "nhg_flag", "legal_maturity_months"]


def run_panel_checks(panel: DataFrame, expect: PanelExpectation) -> DataFrame:
    """(check_id, name, section, violations, status) for the whole suite, in two scans (VAL10)."""
    checks = panel_checks(expect)
    shaped = lambda shape: [c for c in checks if c.shape == shape]
    width = Check("A03", "expected number of columns", "pool", f"{len(panel.columns)} <> {expect.n_columns}")
    unique = Check("A04", "one row per loan and cut-off", "lagged", "")
    closed = Check("G01", "closed pool", "loan", "")

    by_date = panel.groupBy(DATE).agg(
        *[F.expr(e).alias(c) for c, e in _OF_CUTOFF.items()], *[F.count_if(F.expr(c.violation)).alias(c.id) for c in shaped("row")]
    )
    pool = [*shaped("pool"), width]
    flat = by_date.agg(*[F.sum(c.id).alias(c.id) for c in shaped("row")], *[F.expr(f"CAST(({c.violation}) AS INT)").alias(c.id) for c in pool])

    moves = lagged(panel.select(*_LOAN_INPUT))
    moves = moves.withColumn("_second", second_of_pair())
    by_row = shaped("lagged")
    per_loan = moves.groupBy(KEY).agg(
        F.min(DATE).alias("_first"), F.count_if("_second").alias("A04"),
        *[F.expr(c.violation).alias(c.id) for c in shaped("loan")], *[F.count_if(F.expr(c.violation)).alias(c.id) for c in by_row],
    )
    # one row per first cut-off: the loans of the earliest one are the closed pool
    firsts = per_loan.groupBy("_first").agg(
        F.count("_first").alias("_n"), *[F.count_if(c.id).alias(c.id) for c in shaped("loan")], *[F.sum(c.id).alias(c.id) for c in [unique, *by_row]]
    )
    loans = [*shaped("loan"), unique, *by_row]
    sums = firsts.agg(*[F.sum(c.id).alias(c.id) for c in loans], (F.sum("_n") - F.min_by("_n", "_first")).alias("G01"))
    return with_status(_long(flat, [*shaped("row"), *pool]).unionByName(_long(sums, [*loans, closed])))


def with_status(results: DataFrame) -> DataFrame:
    return results.withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


def summarise(results: DataFrame, by: str | None = "section") -> DataFrame:
    """Totals per section, or overall with ``by=None``."""
    failed = F.count_if(F.col("status") == "FAIL")
    aggs = [F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "PASS").alias("passed"), failed.alias("failed")]
    if by:
        return results.groupBy(by).agg(*aggs)
    aggs += [
        F.sum("violations").alias("total_violations"),
        F.when(failed == 0, "ALL PASS").otherwise("FAILURES").alias("overall"),
    ]
    return results.agg(*aggs)


@dataclass(frozen=True)
class GoldCheck:
    """A measured value with the condition it must meet, and a sentence about it."""

    id: str
    table: str
    value: str
    passes: str
    detail: str
    category: str = field(default="")


# The gold suite. ``value`` is an aggregate over ``table``.
GOLD_CHECKS = [
    GoldCheck("schema.static_loans_nonempty", "static", "count(*)", "v > 0", "rows"),
    GoldCheck("schema.dynamic_nonempty", "dynamic", "count(*)", "v > 0", "rows"),
    GoldCheck("schema.gold_nonempty", "gold", "count(*)", "v > 0", "rows"),
    GoldCheck("schema.fk_integrity", "dynamic", "count_if(_orphan)", "v = 0", "orphaned dynamic rows"),
    GoldCheck("schema.pk_uniqueness", "dynamic", "count_if(_second)", "v = 0", "duplicate pairs"),
    GoldCheck("schema.cutoff_count", "dynamic", f"count(DISTINCT {DATE})", "v >= 12", "distinct reporting dates"),
    GoldCheck("temporal.seasoning_increment", "dynamic", "round(100.0 * avg(_seasoning_ok), 2)", "v >= 95.0", "% compliant"),
    GoldCheck("temporal.remaining_term_decrements", "dynamic", "round(100.0 * avg(_term_ok), 2)", "v >= 90.0", "% compliant"),
    GoldCheck("temporal.no_negative_seasoning", "dynamic", "count_if(seasoning_months < 0)", "v = 0", "negative values"),
    GoldCheck("temporal.no_future_dates", "dynamic", f"count_if({DATE} > _as_of)", "v = 0", "future dates"),
    GoldCheck("lifecycle.nonneg_balance", "dynamic", "count_if(current_balance < 0)", "v = 0", "negative balances"),
    GoldCheck("lifecycle.nonneg_dpd", "dynamic", "count_if(days_past_due < 0)", "v = 0", "negative rows"),
    GoldCheck("lifecycle.nonneg_interest_rate", "dynamic", "count_if(current_interest_rate_pct < 0)", "v = 0", "negative rate rows"),
    GoldCheck("lifecycle.positive_original_balance", "static", "count_if(original_balance <= 0 OR original_balance IS NULL)", "v = 0", "invalid balances"),
    GoldCheck("gold.label_distribution", "gold", "sum(default_in_3m)", "v > 0", "positive label rows"),
    GoldCheck("gold.label_rate", "gold", "round(100.0 * avg(default_in_3m), 4)", "v BETWEEN 0.1 AND 50.0", "% default rate"),
    GoldCheck("gold.no_null_loan_id", "gold", "count_if(loan_id IS NULL)", "v = 0", "nulls"),
    GoldCheck("gold.no_null_reporting_date", "gold", "count_if(reporting_date IS NULL)", "v = 0", "nulls"),
]
# Described in the governance rules: arrears never exceed the balance of an open loan (VAL15).
ARREARS_WITHIN_BALANCE = GoldCheck(
    "lifecycle.arrears_within_balance", "dynamic",
    "count_if(arrears_amount > current_balance AND arrears_bucket NOT IN ('Redeemed', 'Charged-Off'))",
    "v = 0", "rows with arrears above balance",
)


def second_of_pair(key: str = DATE) -> Column:
    """True for one row of each loan and date that occur more than once."""
    same = lambda k: F.coalesce(F.lag(F.struct(key), k).over(by_loan()).eqNullSafe(F.struct(key)), F.lit(False))
    return same(1) & ~same(2)


def _with_steps(dynamic: DataFrame, static: DataFrame, as_of: str) -> DataFrame:
    rows = dynamic.select(
        "*", F.lit(as_of).cast("date").alias("_as_of"), second_of_pair().alias("_second"),
        step_ok("seasoning_months", 0, 2).alias("_seasoning_ok"), step_ok("remaining_term_months", -1, 2, sign=-1).alias("_term_ok"),
    )
    parents = static.select(KEY).distinct().withColumn("_parent", F.lit(True))
    return rows.join(parents, KEY, "left").withColumn("_orphan", F.col("_parent").isNull())


def run_gold_checks(
    static: DataFrame, dynamic: DataFrame, gold: DataFrame, as_of: str, checks: Sequence[GoldCheck] = tuple(GOLD_CHECKS)
) -> DataFrame:
    """(check_id, category, value, passed, detail); one aggregation for each input table (VAL11).

    Steps, repeated keys and orphans are columns of the dynamic rows: its partitioning by loan serves the windows and the
    join with the loans.
    """
    tables = {"static": lambda: static, "dynamic": lambda: _with_steps(dynamic, static, as_of), "gold": lambda: gold}
    out = None
    for name in dict.fromkeys(c.table for c in checks):
        mine = [c for c in checks if c.table == name]
        wide = tables[name]().agg(*[F.expr(f"CAST({c.value} AS DOUBLE)").alias(f"v{i}") for i, c in enumerate(mine)])
        rows = [
            F.struct(
                F.lit(c.id).alias("check_id"),
                F.lit(c.category or c.id.split(".")[0]).alias("category"),
                F.col(f"v{i}").alias("value"),
                F.coalesce(F.expr(c.passes.replace("v ", f"v{i} ")), F.lit(False)).alias("passed"),
                F.lit(c.detail).alias("detail"),
            )
            for i, c in enumerate(mine)
        ]
        part = wide.select(F.explode(F.array(*rows)).alias("c")).select("c.*")
        out = part if out is None else out.unionByName(part)
    return out


def gold_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("category").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed")
    )


def profile(df: DataFrame, keys: Sequence[str], critical: Sequence[str], date: str = DATE, loan: str = KEY) -> DataFrame:
    """Duplicate keys, critical nulls, distinct dates and loans, as (metric, value) (VAL12)."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1)).scalar()
    wide = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in critical],
        F.count_distinct(date).alias("distinct_dates"),
        F.count_distinct(loan).alias("unique_loans"),
    ).withColumn("duplicate_keys", repeated)
    return wide.select(
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in wide.columns
        ])).alias("m")
    ).select("m.*")


def table_status(df: DataFrame, date: str = DATE, label: str | None = None) -> DataFrame:
    """Rows, date range and label rate of one table (VAL13)."""
    rate = F.round(100.0 * F.avg(F.col(label).cast("double")), 3) if label else F.lit(None).cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        F.count_distinct(date).alias("n_dates"),
        rate.alias("label_rate_pct"),
    )


@dataclass(frozen=True)
class Constraints:
    primary_key: tuple = ()
    foreign_keys: tuple = ()  # (column, parent DataFrame)
    ranges: tuple = ()  # SQL conditions that must not be false


def check_constraints(df: DataFrame, spec: Constraints) -> DataFrame:
    """Rows that break each constraint, as (rule, violations) (VAL14)."""
    parts = []
    if spec.primary_key:
        repeated = df.groupBy(*spec.primary_key).agg(F.count(F.lit(1)).alias("n"))
        parts.append(repeated.agg(F.count_if(F.col("n") > 1).alias("violations")).select(
            F.lit(f"primary key {', '.join(spec.primary_key)}").alias("rule"), "violations"))
    for col, parent in spec.foreign_keys:
        lost = df.where(F.col(col).isNotNull()).join(parent.select(col), col, "left_anti")
        parts.append(lost.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(f"foreign key {col}").alias("rule"), "violations"))
    if spec.ranges:
        wide = df.agg(*[F.count_if(~F.expr(r)).alias(f"r{i}") for i, r in enumerate(spec.ranges)])
        parts.append(wide.select(F.explode(F.array(*[
            F.struct(F.lit(r).alias("rule"), F.col(f"r{i}").alias("violations")) for i, r in enumerate(spec.ranges)
        ])).alias("c")).select("c.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
