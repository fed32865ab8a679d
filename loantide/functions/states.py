"""Delinquency states and what follows from them (FN11), and the guarantee rules (FN12)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The eight arrears states, in order, with days past due.
PERFORMING, DEFAULTED, CHARGED_OFF, REDEEMED = "Performing", "Defaulted", "Charged-Off", "Redeemed"
DPD_STATES = ("1-29 DPD", "30-59 DPD", "60-89 DPD", "90+ DPD")
ARREARS_STATES = (PERFORMING, *DPD_STATES, DEFAULTED, CHARGED_OFF, REDEEMED)
DAYS_PAST_DUE = (0, 15, 45, 75, 120, 200, 200, 0)
PERFORMING_STATUSES = ("Non-defaulted", DEFAULTED, CHARGED_OFF, REDEEMED)
TERMINAL_STATES = (REDEEMED, CHARGED_OFF)
DELINQUENT_STATES = (*DPD_STATES, DEFAULTED)
CRR_DEFAULT_STATES = ("90+ DPD", DEFAULTED, CHARGED_OFF)
NHG_CAP = 435_000
EPC_LABELS = ("A+++", "A++", "A+", "A", "B", "C", "D", "E", "F", "G")
EPC_DEMAND = (30, 60, 90, 130, 170, 210, 260, 310, 360, 420)
RENOVATION_PURPOSES = ("Renovation", "Construction")


def _lookup(keys, values) -> Column:
    return F.create_map(*[F.lit(x) for pair in zip(keys, values) for x in pair])


def _flag(cond: Column) -> Column:
    return F.when(cond, "Y").otherwise("N")


def days_past_due(state: Column) -> Column:
    return F.element_at(_lookup(ARREARS_STATES, DAYS_PAST_DUE), state)


def performing_status(state: Column) -> Column:
    return F.when(state.isin(DEFAULTED, CHARGED_OFF, REDEEMED), state).otherwise("Non-defaulted")


def default_flag(state: Column) -> Column:
    return _flag(state.isin(*CRR_DEFAULT_STATES))


def foreclosure_flag(state: Column) -> Column:
    return _flag(state.isin(DEFAULTED, CHARGED_OFF))


def is_active(state: Column) -> Column:
    return ~state.isin(*TERMINAL_STATES)


def nhg_flag(original_balance: Column, eligible: Column) -> Column:
    """Guaranteed only up to the cap."""
    return _flag((original_balance <= NHG_CAP) & eligible)


def guarantee_type(nhg: Column) -> Column:
    return F.when(nhg == "Y", "NHG").otherwise("None")


def construction_deposit_flag(loan_purpose: Column, drawn: Column) -> Column:
    return _flag(drawn & loan_purpose.isin(*RENOVATION_PURPOSES))


def construction_deposit_pct(flag: Column, spread: Column) -> Column:
    """10 to 24 percent when a deposit exists, else 0."""
    return F.when(flag == "Y", F.pmod(spread, F.lit(15)) + 10).otherwise(0).cast("int")


def construction_deposit_amount(original_balance: Column, pct: Column) -> Column:
    return original_balance * pct / 100.0


def energy_demand(epc_label: Column) -> Column:
    return F.element_at(_lookup(EPC_LABELS, EPC_DEMAND), epc_label)
