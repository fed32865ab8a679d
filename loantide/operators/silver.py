"""Cleaning, reshaping and topic projection (CLN1 to CLN3, RSH1, RSH2, RSH6, PRJ1 to PRJ4)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from loantide.functions.dates import coerce_date, coerce_integer, coerce_number
from loantide.functions.nulls import null_no_data
from loantide.functions.text import row_digest, same_zero
from loantide.templates.classes import DEAL_TYPES, Template
from loantide.templates.rules import AMORTISATION_FIELDS

GENERAL = ("dl_code", "pcd_year", "pcd_month")


def _text_columns(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}


def null_nd(df: DataFrame, mode: str = "pattern", keep: Iterable[str] = ("dl_code", "pcd", "filename", "part", "checksum")) -> DataFrame:
    """No-data codes become null in every text column (CLN1)."""
    text = _text_columns(df) - set(keep)
    return df.select(*[null_no_data(F.col(c), mode).alias(c) if c in text else F.col(c) for c in df.columns])


def flags_to_bool(df: DataFrame, cols: Iterable[str], ignore_case: bool = False) -> DataFrame:
    """Y is true, N false, other text false, null stays null (CLN2)."""
    wanted = set(cols) & _text_columns(df)

    def flag(c: str) -> Column:
        text = F.upper(c) if ignore_case else F.col(c)
        return F.when(F.col(c).isNotNull(), (text == "Y") | (F.lower(c) == "true"))

    return df.select(*[flag(c).alias(c) if c in wanted else F.col(c) for c in df.columns])


_CASTS = {
    "date": coerce_date,
    "double": lambda c: F.round(coerce_number(c), 2),
    "int": coerce_integer,
    "string": lambda c: c,
    "boolean": lambda c: F.lower(c) == "true",
}


def cast_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns cast to their declared types; unreadable values become null (CLN3).

    Doubles are rounded half up to 2 digits. Declared columns that are absent are skipped.
    """
    text = _text_columns(df)
    cast = lambda c: _CASTS[types[c]](F.col(c)).alias(c) if c in types and c in text else F.col(c)
    return df.select(*[cast(c) for c in df.columns])


def clean(df: DataFrame, template: Template, nd_mode: str = "pattern", ignore_case: bool = False) -> DataFrame:
    """CLN1 to CLN3 in the order of a silver load."""
    flags = [c for c, t in template.types.items() if t == "boolean"]
    return cast_types(flags_to_bool(null_nd(df, nd_mode), flags, ignore_case), template.types)


def _range(template: Template, lo: int, hi: int, have: set[str]) -> list[str]:
    names = [f"{template.prefix}{i}" for i in range(lo, hi + 1)]
    return [n for n in names if n in have]


def project_topics(
    df: DataFrame, template: Template, lead: Sequence[str] | None = None, together: bool = False, ranges: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """One distinct table per topic: general columns, then the topic's fields that are present (PRJ1, PRJ2).

    ``lead``, ``together`` and ``ranges``: as of ``distinct_dimension``.
    """
    have = set(df.columns)
    general = [c for c in GENERAL if c in have] + _range(template, *template.general, have)
    return {
        topic: distinct_dimension(df.select(*general, *[c for c in _range(template, lo, hi, have) if c not in general]), lead, together, ranges)
        for topic, (lo, hi) in template.topics.items()
    }


def distinct_dimension(df: DataFrame, lead: Sequence[str] | None = None, together: bool = False, ranges: Sequence[str] = ()) -> DataFrame:
    """The whole table without repeated rows (PRJ3, SET4).

    With ``lead`` rows are told apart by these columns and a digest of the whole row, so the shuffle carries those and what
    the caller reads of the result, not all columns: for callers that count, or read few columns. With ``together`` rows
    of equal ``lead`` come to one partition, in which later joins and aggregations on ``lead`` find them. With ``ranges`` the one
    shuffle of whole rows deals them into even ranges of these columns (of equal ones by a hash of the row), so that a writer
    that parts the table by them need not shuffle again.
    """
    if ranges:
        told = df.withColumn("_hash", F.xxhash64(*[same_zero(f) for f in df.schema.fields]))
        # sorted rather than held in hash tables: one copy of the rows, which spills
        same = Window.partitionBy(*ranges, "_hash", *[c for c in df.columns if c not in ranges]).orderBy("_hash")
        return told.repartitionByRange(*ranges, "_hash").withColumn("_rn", F.row_number().over(same)).where("_rn = 1").drop("_hash", "_rn")
    digest = None if lead is None else row_digest(df.schema)
    if digest is None:
        return df.dropDuplicates()
    told = df.select(*[same_zero(f).alias(f.name) for f in df.schema.fields], digest.alias("_digest"))
    return (told.repartition(*lead) if together and lead else told).dropDuplicates([*lead, "_digest"]).drop("_digest")


def deal_details(current: DataFrame) -> DataFrame:
    """Deal rows with their types, without repeated rows (CLN3, PRJ3); fields that are absent are skipped."""
    return distinct_dimension(cast_types(current, DEAL_TYPES))


def restrict(df: DataFrame, allowed: Iterable[str]) -> DataFrame:
    """Columns of a taxonomy that are present (PRJ4)."""
    ok = set(allowed)
    return df.select(*[c for c in df.columns if c in ok])


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str], var: str = "FEATURE_NAME", value: str = "FEATURE_VALUE") -> DataFrame:
    """Wide to long without null values; values become text (RSH1)."""
    text = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in cols])
    return text.unpivot(list(ids), list(cols), var, value).where(F.col(value).isNotNull())


def amortisation_long(df: DataFrame, pairing: str = "period") -> DataFrame:
    """Per loan the dates and balances of its amortisation profile (RSH2).

    ``period`` pairs the date and balance of one period; ``all`` pairs every date with
    every balance of the row. Both happen inside the row, so no join is needed.
    """
    have = set(df.columns)
    even = [i for i in AMORTISATION_FIELDS if i % 2 == 0]
    balance = lambda i: F.col(f"AS{i}").cast("double") if f"AS{i}" in have else F.lit(None).cast("double")
    date = lambda i: F.col(f"AS{i + 1}").cast("date") if f"AS{i + 1}" in have else F.lit(None).cast("date")
    used = [i for i in even if f"AS{i}" in have or f"AS{i + 1}" in have]
    ids = [c for c in ("dl_code", "AS3", "pcd_year", "pcd_month") if c in have]
    if pairing == "period":
        pairs = F.array(*[F.struct(date(i).alias("DATE_VALUE"), balance(i).alias("DOUBLE_VALUE")) for i in used])
        long = df.select(*ids, F.explode(pairs).alias("p")).select(*ids, "p.*")
        long = long.where("DATE_VALUE IS NOT NULL AND DOUBLE_VALUE IS NOT NULL")
    elif pairing == "all":
        once = lambda cols: F.array_distinct(F.array_compact(F.array(*cols)))
        zero = lambda c: F.when(c == 0, F.lit(0.0)).otherwise(c)
        rows = df.select(*ids, once([zero(balance(i)) for i in used]).alias("b"), once([date(i) for i in used]).alias("d"))
        crossed = lambda x: x.select(*ids, "b", F.explode("d").alias("DATE_VALUE")).select(*ids, "DATE_VALUE", F.explode("b").alias("DOUBLE_VALUE"))
        if not ids:
            return crossed(rows).dropDuplicates()
        # a row alone with its ids has no pair twice; only the pairs of others are compared. Rows that lack an id share no window
        lacking = reduce(or_, [F.col(c).isNull() for c in ids])
        mine = Window.partitionBy(*ids, F.when(lacking, F.xxhash64("b", "d")))
        # one number: no filter on ids reaches the input, so both sides read one shuffle
        told = rows.withColumn("_shared", F.sum(F.when(lacking, 2).otherwise(1)).over(mine) > 1)
        return crossed(told.where("NOT _shared")).unionByName(crossed(told.where("_shared")).dropDuplicates())
    else:
        raise ValueError(f"unknown pairing {pairing!r}")
    return long.dropDuplicates()


def field_length(df: DataFrame) -> DataFrame:
    """Length of the first column's text (RSH6)."""
    return df.withColumn("field_length", F.length(F.col(df.columns[0]).cast("string")))
