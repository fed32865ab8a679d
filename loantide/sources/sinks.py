"""Writers (SNK1 to SNK7)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from loantide.operators.bronze import load_bronze
from loantide.sources.snapshots import MAX_RECORDS_PER_FILE, new_load, read_load, read_snapshot, replace_units, units_of, version
from loantide.sources.tapes import read_bronze


def _writer(df: DataFrame):
    return df.write.option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)


def write_silver(df: DataFrame, path: str, replace: bool = False, by: Sequence[str] = ("pcd_year", "pcd_month"), gather: bool = True) -> None:
    """Append by year and month; ``replace`` overwrites only the partitions present, so a re-run adds nothing (SNK1).

    ``gather=False`` where ``ranges`` of ``distinct_dimension`` has brought the rows of a month together.
    """
    w = _writer(df.hint("rebalance", *by) if gather else df).partitionBy(*by)
    if replace:
        w.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        w.mode("append").parquet(path)


def write_bronze(df: DataFrame, path: str, gather: bool = True) -> None:
    """Append by partition label (SNK2); ``gather=False`` where ``to_bronze`` has brought the rows of a label together."""
    _writer(df.hint("rebalance", "part") if gather else df).partitionBy("part").mode("append").parquet(path)


BRONZE_UNIT = ("dl_code", "part")


def merge_bronze(batch: DataFrame, path: str, keys: Sequence[str], mode: str = "merge") -> None:
    """Bring a batch into the bronze table at ``path``: only its deals are read and replaced, all at once or not at all.

    ``merge`` derives the history of the batch's deals anew (of the keys that it names); ``skip`` adds only deals and
    months that the table lacks. Two writers of one deal cannot overwrite each other: the later one gets an error.
    """
    spark = batch.sparkSession
    keys = list(dict.fromkeys(["dl_code", *keys]))  # a loan id alone may occur in several deals
    base = version(spark, path)
    if not base:
        old = read_bronze(spark, path)  # of ``write_bronze``: goes into the first version
        both = load_bronze(None, batch, keys) if old is None else load_bronze(with_columns_of(old, batch), with_columns_of(batch, old), keys, mode)
        replace_units(both, path, BRONZE_UNIT, BRONZE_UNIT, base=0)
    elif mode == "skip":
        there = units_of(spark, path, base)
        same = reduce(and_, [batch[c].eqNullSafe(there[c]) for c in BRONZE_UNIT])
        replace_units(batch.join(there, same, "left_anti"), path, BRONZE_UNIT, BRONZE_UNIT, base=base)
    else:
        deals = batch.select("dl_code").distinct()
        old = read_snapshot(spark, path, deals, base)
        both = load_bronze(with_columns_of(old, batch), with_columns_of(batch, old), keys)
        replace_units(both, path, BRONZE_UNIT, BRONZE_UNIT, covers=deals, base=base)


def with_columns_of(df: DataFrame, other: DataFrame) -> DataFrame:
    """The same rows with all columns of both, null where ``df`` has none."""
    lacking = [f for f in other.schema.fields if f.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in lacking])


def replace_deals(df: DataFrame, path: str, deals: DataFrame, by: Sequence[str] = ("pcd_year",)) -> None:
    """Put ``df`` in the place of all silver rows of ``deals`` (SNK1); other deals are not read. Files lie by deal and year."""
    replace_units(df, path, ["dl_code"], ["dl_code", *[c for c in by if c in df.columns]], covers=deals)


def write_deals(df: DataFrame, path: str) -> None:
    """Replace the deal table (SNK3)."""
    _writer(df).mode("overwrite").parquet(path)


def write_quarantine(clean: DataFrame, dirty: DataFrame, path: str, both: DataFrame | None = None) -> str:
    """Clean rows and dirty rows with reasons, in one table and one step (SNK4); ``read_quarantine`` reads a side. Returns the load.

    A load replaces what earlier loads said of its files (of its deals and cut-offs, without file names): a corrected file
    leaves no stale dirty row, and other files keep theirs, rows without a deal or cut-off too. ``both``: the rows of both as
    ``validate.sides`` gives them; they are evaluated once then, while each of the two evaluates what it derives from.
    """
    if both is None:
        side = lambda df, name: df.select(F.lit(name).alias("side"), *df.columns)
        both = side(clean, "clean").unionByName(side(dirty, "dirty"), allowMissingColumns=True)
    unit = ["filename"] if "filename" in both.columns else [c for c in ("dl_code", "pcd") if c in both.columns]
    load = new_load()
    # two sides: tasks write their rows where they are, at most two files each
    if unit:
        replace_units(both, path, unit, ["side"], gather=False, load=load)
    else:  # nothing tells the rows apart: the table is one unit
        whole = both.sparkSession.range(1).select(F.lit(1).alias("whole"))
        replace_units(both.withColumn("whole", F.lit(1)), path, ["whole"], ["side"], covers=whole, gather=False, load=load)
    return load


def read_quarantine(spark: SparkSession, path: str, side: str) -> DataFrame | None:
    """The ``clean`` or ``dirty`` rows of all loads."""
    df = read_snapshot(spark, path)
    return None if df is None else df.where(F.col("side") == side).drop("side", "whole")


def read_clean(spark: SparkSession, path: str, load: str, columns: T.StructType) -> DataFrame:
    """The clean rows of one load, with the given columns: what it wrote need not be staged for those who go on with it."""
    stored = T.StructType([*columns.fields, T.StructField("side", T.StringType())])
    return read_load(spark, path, load, stored, ["side"]).where("side = 'clean'").select(*columns.names)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row (SNK5)."""
    _writer(df).mode("overwrite").json(path)


def write_sequences(df: DataFrame, path: str) -> None:
    """Token sequences as snappy Parquet (SNK6)."""
    _writer(df).mode("overwrite").option("compression", "snappy").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; an empty dataset is refused (SNK7)."""
    if df.isEmpty():
        raise ValueError(f"refusing to write an empty dataset to {path}")
    _writer(df).mode("overwrite").option("header", True).csv(path)
