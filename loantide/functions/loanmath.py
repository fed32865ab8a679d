"""Loan and facility arithmetic (FN2 to FN10)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loantide.functions.states import PERFORMING, is_active

# Yearly growth of market and indexed values, covenant limits.
MARKET_GROWTH = 1.030
INDEXED_GROWTH = 1.045
MONTHLY_DRIFT_YEARLY = 1.03
DSCR_WATCH, DSCR_BREACH = 1.35, 1.20
LTV_WATCH, LTV_BREACH = 74.0, 78.0


def monthly_rate(rate_pct: Column) -> Column:
    return rate_pct / 100.0 / 12.0


def scheduled_payment(principal: Column, rate_pct: Column, months: Column, interest_only: Column) -> Column:
    """Level monthly payment; interest alone for an interest-only loan."""
    r = monthly_rate(rate_pct)
    growth = F.pow(1.0 + r, months)
    return F.when(interest_only == "Y", principal * r).otherwise(principal * r * growth / (growth - 1.0))


def annuity_balance(principal: Column, rate_pct: Column, months: Column, t: Column, interest_only: Column) -> Column:
    """Balance after ``t`` level payments, in closed form."""
    r = monthly_rate(rate_pct)
    full, paid = F.pow(1.0 + r, months), F.pow(1.0 + r, t)
    return F.when(interest_only == "Y", principal).otherwise(principal * (full - paid) / (full - 1.0))


def next_balance(prev: Column, rate_pct: Column, payment: Column, interest_only: Column, state: Column) -> Column:
    """One month on: paid down while performing, frozen in arrears, zero once closed."""
    paid = F.greatest(prev * (1.0 + monthly_rate(rate_pct)) - payment, F.lit(0.0))
    return (
        F.when(~is_active(state), F.lit(0.0))
        .when((state == PERFORMING) & (interest_only != "Y"), paid)
        .otherwise(prev)
    )


def ltv(balance: Column, value: Column) -> Column:
    """Balance as a percentage of value; 0 when the value is 0."""
    return F.when(value == 0, F.lit(0.0)).otherwise(balance / F.nullif(value, F.lit(0.0)) * 100)


def loan_to_income(balance: Column, income: Column) -> Column:
    return balance / income


def payment_to_income(payment: Column, income: Column) -> Column:
    """Yearly payments as a percentage of yearly income."""
    return payment * 12 / income * 100


def market_value(balance: Column, oltv_pct: Column) -> Column:
    """Value at origination implied by balance and original loan-to-value."""
    return balance / (oltv_pct / 100.0)


def uplift(value: Column, years: Column, growth: float = MARKET_GROWTH) -> Column:
    return value * F.pow(F.lit(growth), years)


def monthly_drift(value: Column, months: Column | None = None) -> Column:
    """House-price drift by one month, or by a number of months."""
    step = F.lit(1) if months is None else months
    return value * F.pow(F.lit(MONTHLY_DRIFT_YEARLY), step / 12.0)


def arrears_amount(payment: Column, dpd: Column) -> Column:
    """One missed payment for each started 30 days past due."""
    return payment * F.when(dpd == 0, 0).otherwise(F.greatest(F.ceil(dpd / 30.0), F.lit(1)))


def _ratio_or_zero(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num / F.nullif(den, F.lit(0.0)))


def net_operating_income(revenue: Column, energy: Column, opex: Column) -> Column:
    return revenue - energy - opex


def dscr(noi: Column, debt_service: Column) -> Column:
    return _ratio_or_zero(noi, debt_service)


def facility_ltv(debt: Column, value: Column) -> Column:
    return _ratio_or_zero(debt, value) * 100.0


def occupancy(leased: Column, capacity: Column) -> Column:
    return _ratio_or_zero(leased, capacity) * 100.0


def energy_ratio(energy: Column, revenue: Column) -> Column:
    return _ratio_or_zero(energy, revenue) * 100.0


def covenant_status(dscr_raw: Column, ltv_raw: Column) -> Column:
    """breach, watch or ok, on unrounded inputs."""
    return (
        F.when((dscr_raw < DSCR_BREACH) | (ltv_raw > LTV_BREACH), "breach")
        .when((dscr_raw < DSCR_WATCH) | (ltv_raw > LTV_WATCH), "watch")
        .otherwise("ok")
    )
