"""Spans of regular expressions with code-point positions, in built-in functions only.

A match's place follows from the lengths of what lies before it: ``split`` gives the text between
matches and ``regexp_extract_all`` the matches, both left to right and without overlap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPAN = "array<struct<s:int,k:int,e:int,kind:string,found:string>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def spans(text: Column, pattern: str, kind: str, order: int, valid: Callable[[Column], Column], hint: Column | None = None) -> Column:
    """All matches that pass ``valid`` as (start, order, end, kind, found), end exclusive; others are consumed and dropped.

    ``hint`` is a cheap condition that every text with a match fulfils.
    """

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.coalesce(F.length(x["found"]), F.lit(0))
        keep = x["found"].isNotNull() & F.coalesce(valid(x["found"]), F.lit(False))
        one = F.array(F.struct(s.alias("s"), F.lit(order).alias("k"), e.alias("e"), F.lit(kind).alias("kind"), x["found"].alias("found")))
        return F.struct(e.alias("at"), F.when(keep, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    found = F.aggregate(both, F.struct(F.lit(0).alias("at"), no_spans().alias("spans")), step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern) if hint is None else hint & text.rlike(pattern), found).otherwise(no_spans())


def joined(all_spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.sort_array(all_spans), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def masked(text: Column, all_spans: Column) -> Column:
    """The text with every stretch that spans cover replaced by ``<kind>`` of the first span in it."""
    init = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s, e = x["s"] + 1, x["e"] + 1
        put = F.concat(acc["out"], F.substring(text, acc["at"], s - acc["at"]), F.lit("<"), x["kind"], F.lit(">"))
        return F.struct(F.greatest(acc["at"], e).alias("at"), F.when(s >= acc["at"], put).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(F.sort_array(all_spans), init, step, lambda a: F.concat(a["out"], F.substring(text, a["at"], F.length(text))))
    return F.when(F.size(all_spans) == 0, text).otherwise(whole)
