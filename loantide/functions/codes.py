"""Coded dimensions and their labels (FN16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UNKNOWN = "unknown"

_FREQUENCY = ("monthly", "quarterly", "semi annual", "annual", "bullet", "other")

# Dimension -> (tape field, labels of the codes 1, 2, 3, ...).
CODEBOOK: dict[str, tuple[str, tuple[str, ...]]] = {
    "purpose": ("AS57", (
        "purchase", "re-mortgage", "renovation", "equity release", "construction real estate",
        "construction other", "debt consolidation", "re-mortgage with equity release",
        "re-mortgage on different terms", "combination mortgage", "investment mortgage",
        "working capital", "other")),
    "principal_payment_frequency": ("AS58", _FREQUENCY),
    "interest_payment_frequency": ("AS59", _FREQUENCY),
    "amortisation_type": ("AS62", (
        "linear", "french", "fix amortisation schedule", "bullet", "partial bullet", "revolving", "other")),
    "type_of_loan": ("AS65", ("term", "revolving credit line", "other")),
    "payment_type": ("AS68", ("direct debit", "standing order", "cheque", "cash", "other")),
    "interest_rate_type": ("AS83", (
        "floating rate loan",
        "floating rate loan linked to Libor, Euribor, BoE reverting to the Bank's SVR, ECB reverting to Bank’s SVR",
        "fixed rate loan", "fixed with future periodic resets",
        "fixed rate loan with compulsory future switch to floating", "capped", "discount",
        "switch optionality", "borrower swapped", "other")),
    "current_interest_rate_index": ("AS84", (
        "1 month LIBOR", "1 month EURIBOR", "3 months LIBOR", "3 months EURIBOR", "6 months LIBOR",
        "6 months EURIBOR", "12 months LIBOR", "12 months EURIBOR", "BoE base rate", "ECB base rate",
        "standard variable rate", "other")),
    "interest_rate_period": ("AS94", ("annual", "semi-annual", "quarterly", "monthly", "not apply", "other")),
    "original_valuation_type": ("CS13", (
        "full", "drive by", "AVM", "indexed", "desktop", "managing/estate agent", "purchase price",
        "hair cut", "other")),
    "ranking": ("CS14", ("1st lien", "2nd lien", "other")),
    "originator_channel": ("CS23", ("office network", "broker", "internet", "other")),
    "security_type": ("CS3", (
        "liquidation of collateral", "enforcements of guarantees", "additional lending",
        "cash recoveries", "other")),
    "collateral_type": ("CS6", (
        "auto vehicles", "industrial vehicles", "commercial trucks", "rail vehicles",
        "nautical commercial vehicles", "nautical leisure vehicles", "aeroplanes", "machine tools",
        "industrial equipment", "office equipment", "medical equipment", "energy related equipment",
        "commercial building", "residential building", "industrial building", "other vehicles",
        "other equipment", "other real estate", "securities", "third party guarantee",
        "unsecured guarantee", "other financial assets", "no collateral")),
    "business_type": ("AS18", ("public company", "limited company", "partnership", "individual", "other")),
    "borrower_basel_III_segment": ("AS22", ("corporate", "SME treated as corporate", "retail", "other")),
    "asset_type": ("AS25", (
        "loan", "guarantee", "promissory note", "partecipation rights", "overdraft", "letter of credit",
        "working capital facility", "other")),
    "seniority": ("AS26", ("senior secured", "senior unsecured", "junior", "junior unsecured", "other")),
    "reason_for_default_basel_II": ("AS123", (
        "bankruptcy/insolvency", "failure to pay", "breach of terms", "other")),
    "recovery_source": ("AS129", (
        "liquidation of collateral", "enforcements of guarantees", "additional lending",
        "cash recoveries", "mixed", "other")),
}


def label_of(code: Column, labels: tuple[str, ...]) -> Column:
    """Label of a 1-based code held as text; ``unknown`` for anything else."""
    # keyed by the code text itself, so "01" or "1.0" stay unknown
    table = F.create_map(*[F.lit(x) for i, t in enumerate(labels, 1) for x in (str(i), t)])
    return F.coalesce(F.try_element_at(table, code), F.lit(UNKNOWN))


def decode(df: DataFrame, codebook: dict[str, tuple[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """Add the label column of every coded dimension whose field is present."""
    book = CODEBOOK if codebook is None else codebook
    have = set(df.columns)
    return df.select(
        "*", *[label_of(F.col(f), labels).alias(name) for name, (f, labels) in book.items() if f in have]
    )
