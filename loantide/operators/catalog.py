"""Typed filters and projection on catalogued tables (FLT1 to FLT3, FLT6, FLT7, PRJ5)."""

from __future__ import annotations

import datetime
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Operators per column type.
OPERATORS = {
    "DATE": (":", ">", "<", "<=", ">="),
    "BOOL": (":",),
    "FLOAT": (":", ">", "<", "<=", ">="),
    "INTEGER": (":", ">", "<", "<=", ">="),
    "STRING": (":", "~"),
}
CONDITION = re.compile(r"^(-?)(\w+)(<=|>=|:|<|>|~)([%\w].*)$")


class FilterError(ValueError):
    """A filter or column list that the catalog does not allow."""


@dataclass(frozen=True)
class ColumnInfo:
    type: str
    is_filter: bool = True


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value: str
    negated: bool = False


Table = dict[str, ColumnInfo]


def table_of(catalog: dict[str, dict[str, Table]], credit_type: str, table: str) -> Table:
    """The columns of a catalogued table, or an error that names what exists (FLT6)."""
    if credit_type not in catalog:
        raise FilterError(f"unknown credit type {credit_type}; one of {', '.join(sorted(catalog))}")
    if table not in catalog[credit_type]:
        raise FilterError(f"unknown table {table}; one of {', '.join(sorted(catalog[credit_type]))}")
    return catalog[credit_type][table]


def _kind(info: ColumnInfo) -> str:
    return "BOOL" if info.type == "BOOLEAN" else info.type


def _typed(value: str, kind: str):
    try:
        if kind == "DATE":
            return datetime.datetime.strptime(value, "%Y-%m-%d").date()
        if kind == "FLOAT":
            return float(value)
        if kind == "INTEGER":
            return int(value)
    except ValueError as e:
        raise FilterError(f"wrong value {value!r} for type {kind}") from e
    return value == "TRUE" if kind == "BOOL" else value


def predicate(cond: Condition, table: Table) -> Column:
    """One condition as a Column; column names match in any case, values are upper case."""
    names = {n.upper(): n for n in table}
    name = names.get(cond.column.upper())
    if name is None:
        raise FilterError(f"wrong column name {cond.column}")
    if not table[name].is_filter:
        raise FilterError(f"column {name} is not filterable")
    kind = _kind(table[name])
    if cond.operator not in OPERATORS[kind]:
        raise FilterError(f"operator {cond.operator} does not apply to {kind}")
    c, v = F.col(f"`{name}`"), F.lit(_typed(cond.value, kind))
    test = {
        ":": lambda: c == v,
        "<": lambda: c < v,
        ">": lambda: c > v,
        "<=": lambda: c <= v,
        ">=": lambda: c >= v,
        "~": lambda: F.upper(c).like(cond.value),
    }[cond.operator]()
    return ~test if cond.negated else test


def conditions(text: str) -> list[list[Condition]]:
    """Alternatives (OR) of conjunctions (AND) from ``[-]COL(op)VALUE`` words; AND binds tighter."""
    words = text.upper().split(" ")
    if len(words) % 2 == 0:
        raise FilterError("query is incomplete")
    groups: list[list[Condition]] = [[]]
    for i, word in enumerate(words):
        if i % 2:
            if word not in ("AND", "OR"):
                raise FilterError(f"expected AND or OR, not {word}")
            if word == "OR":
                groups.append([])
            continue
        if word in ("AND", "OR"):
            raise FilterError("query is incomplete")
        m = CONDITION.match(word)
        if not m:
            raise FilterError(f"wrong operator used in {word}")
        groups[-1].append(Condition(m[2], m[3], m[4], m[1] == "-"))
    return groups


def filter_table(df: DataFrame, table: Table, where: str | Sequence[Sequence[Condition]]) -> DataFrame:
    """Rows that meet a filter text or a list of alternatives of conjunctions (FLT1)."""
    groups = conditions(where) if isinstance(where, str) else where
    any_of = None
    for group in groups:
        all_of = None
        for cond in group:
            p = predicate(cond, table)
            all_of = p if all_of is None else all_of & p
        any_of = all_of if any_of is None else any_of | all_of
    return df.where(any_of)


def select_cols(df: DataFrame, table: Table, columns: str) -> DataFrame:
    """An ordered, comma-separated column subset; names are case-sensitive (PRJ5)."""
    wanted = [c.strip() for c in columns.strip(" ,").split(",")]
    for c in wanted:
        if c not in table:
            raise FilterError(f"column {c} is not part of the table")
    return df.select(*[f"`{c}`" for c in wanted])


def page(df: DataFrame, order_by: Sequence[str], limit: int, offset: int = 0) -> DataFrame:
    """One page in a stated order, of exactly the size asked for (FLT2).

    The rows up to the page's end are held by one task: for deep reading filter on the order's last values instead.
    """
    if limit is None or limit < 0:
        raise FilterError("a page needs a limit of at least 0")
    return df.orderBy(*order_by).offset(offset or 0).limit(limit)


def rows(df: DataFrame, detailed: bool = True) -> DataFrame:
    """A page as named columns, or each row packed into one array of texts (FLT3)."""
    return df if detailed else df.select(F.array(*[F.col(c).cast("string") for c in df.columns]).alias("values"))


def quality_summaries(df: DataFrame, order_by: Sequence[str], limit: int, offset: int = 0) -> DataFrame:
    """Stored quality reports, paged (FLT7)."""
    return page(df, order_by, limit, offset)
