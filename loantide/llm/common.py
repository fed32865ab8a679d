"""Helpers that the operators share: whole texts, staged tables, Arrow maps."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes between words: space and the control characters 9 to 13.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of every row; a null text is the empty text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def text_key(text: str | Column = "text") -> Column:
    """Tells the texts of rows with one doc_id apart."""
    return F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def words(text: Column) -> Column:
    """The maximal runs of characters other than space and 9-13."""
    core = F.btrim(text, F.lit(SPACES))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, "[\\x20\\x09-\\x0D]+", -1))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where the driver runs it from a checkout; on a cluster give it as ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers can import this package."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
