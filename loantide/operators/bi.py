"""Star joins and measures (JON6, JON7, AGG23, FN17)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from loantide.functions.text import compound_key


def measures(df: DataFrame, dims: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Count, and minimum, maximum and average of each numeric column, per dimension value (AGG23)."""
    aggs = [F.count(F.lit(1)).alias("count")]
    for c in cols:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_avg")]
    return df.groupBy(*dims).agg(*aggs)


def _join_left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that adds only the columns the left side lacks."""
    have = set(left.columns)
    return left.join(right.select(*keys, *[c for c in right.columns if c not in have]), list(keys), "left")


CUTOFF = ("pcd_year", "pcd_month")


def star_keys(on_cutoff: bool = True, loan: str = "AS3", cutoff: Sequence[str] = CUTOFF) -> list[str]:
    """The columns on which ``loan_star`` joins."""
    return [loan, "dl_code", *(cutoff if on_cutoff else ())]


def loan_star(
    loans: DataFrame,
    dimensions: Sequence[DataFrame],
    industry_codes: DataFrame | None = None,
    loan: str = "AS3",
    cutoff: Sequence[str] = CUTOFF,
    industry: str = "AS42",
    on_cutoff: bool = True,
) -> DataFrame:
    """Loans with their performance, financial, interest and obligor rows, and the industry name (JON6).

    All joins share one key, so one partitioning serves the chain; tables that already lie by ``star_keys`` (``project_topics``
    with ``together``) are not shuffled again. ``on_cutoff=False`` joins on
    loan and deal alone, which multiplies the snapshots. The industry table is left to Spark to
    broadcast when its size allows.
    """
    keys = star_keys(on_cutoff, loan, cutoff)
    out = loans
    for d in dimensions:
        out = _join_left(out, d, keys)
    if industry_codes is not None:
        out = out.join(industry_codes.withColumnRenamed("code", industry), industry, "left")
    return out


def bond_star(info: DataFrame, collaterals: DataFrame, tranches: DataFrame, date: str = "BS1", issuer: str = "BS2") -> DataFrame:
    """Bond info with its collaterals and tranches, on deal, report date and issuer (JON7)."""
    keys = ["dl_code", date, issuer]
    return _join_left(_join_left(info, collaterals, keys), tranches, keys)


def bond_key(df: DataFrame, date: str = "BS1", issuer: str = "BS2") -> DataFrame:
    """The compound key of bond views (FN17)."""
    return df.withColumn("bond_key", compound_key(F.col(date), F.col(issuer)))
