"""Exact order statistics without a single-task sort.

A global ``Window.orderBy`` sends every row to one task, and the built-in exact
``percentile`` merges every distinct value into one buffer. Both stop working when
the column has billions of distinct values. Here the input is first reduced to one
row per distinct value, cut into value slices of about equal size, summed per
slice, and only the slice totals (a bounded number of rows) are ordered globally.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_SLICES = 2000


def _slice_count(df: DataFrame) -> int:
    return max(8, min(MAX_SLICES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def running_totals(
    df: DataFrame,
    value: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Add ``{s}_before`` (sum over earlier values) and ``{s}_total`` for each column in ``sums``.

    ``df`` must hold one row per (``by``, ``value``), without null values.
    """
    by = list(by)
    n = _slice_count(df)
    # slice edges: one small array, computed once as a scalar subquery
    edges = df.agg(
        F.percentile_approx(value, F.lit([i / n for i in range(1, n)]), 10_000).alias("e")
    ).scalar()
    position = F.size(F.filter("_edges", lambda e: e < F.col(value)))
    sliced = (
        df.withColumn("_edges", edges)
        .withColumn("_slice", -position if descending else position)
        .drop("_edges")
    )
    groups = [*by, "_slice"]
    across = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = across.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # at most (slices x groups) rows from here on
    offsets = (
        sliced.groupBy(*groups)
        .agg(*[F.sum(s).alias(f"_{s}") for s in sums])
        .select(
            *groups,
            *[F.coalesce(F.sum(f"_{s}").over(earlier), F.lit(0)).alias(f"_{s}_offset") for s in sums],
            *[F.sum(f"_{s}").over(across).alias(f"{s}_total") for s in sums],
        )
    )
    order = F.col(value).desc() if descending else F.col(value).asc()
    within = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    left, right = sliced.alias("l"), offsets.alias("r")
    on = [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in groups]
    joined = left.join(right, on).select(
        "l.*", *[f"r._{s}_offset" for s in sums], *[f"r.{s}_total" for s in sums]
    )
    return joined.select(
        *df.columns,
        *[
            (F.col(f"_{s}_offset") + F.coalesce(F.sum(s).over(within), F.lit(0))).alias(f"{s}_before")
            for s in sums
        ],
        *[f"{s}_total" for s in sums],
    )


def _name(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Interpolated quantiles ``p5 …`` and ``mean`` of one column, per group."""
    by = list(by)
    counts = (
        df.where(F.col(col).isNotNull())
        .groupBy(*by, F.col(col).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running_totals(counts, "_v", ["_n"], by)

    def value_at(position: Column) -> Column:
        inside = (F.col("_n_before") <= position) & (position < F.col("_n_before") + F.col("_n"))
        return F.max(F.when(inside, F.col("_v")))

    def quantile(p: float) -> Column:
        position = F.lit(float(p)) * (F.col("_n_total") - 1)
        low, high = F.floor(position), F.ceil(position)
        part = F.max(position - low)
        lower = value_at(low)
        return lower + (value_at(high) - lower) * part

    return ranked.groupBy(*by).agg(
        *[quantile(p).alias(_name(p)) for p in probs],
        (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean"),
    )


def top_fraction_sum(df: DataFrame, col: str, frac: float) -> DataFrame:
    """Sum of the largest ``frac`` of rows by ``col``, the total and the share (WIN9)."""
    counts = (
        df.where(F.col(col).isNotNull())
        .groupBy(F.col(col).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running_totals(counts, "_v", ["_n"], descending=True)
    # rows of this value that still fit below the cut
    room = F.floor(F.col("_n_total") * F.lit(float(frac))) - F.col("_n_before")
    taken = F.greatest(F.lit(0), F.least(F.col("_n"), room))
    return ranked.agg(
        F.sum(taken).cast("long").alias("n_rows"),
        F.sum(F.col("_v") * taken).alias("top_sum"),
        F.sum(F.col("_v") * F.col("_n")).alias("total"),
    ).withColumn("share_pct", 100 * F.col("top_sum") / F.col("total"))
