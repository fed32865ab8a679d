"""Row validation against a template's rules (VAL1 to VAL5, SNK4)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from loantide.functions.dates import coerce_date, coerce_integer, coerce_number
from loantide.functions.nulls import null_blank
from loantide.session import split_huge_methods
from loantide.templates.rules import Rule

# Named coercions; a new one is a function from Column to Column (UDX1).
COERCIONS = {
    "string": lambda c: c,
    "number": coerce_number,
    "integer": coerce_integer,
    "datetime": coerce_date,
}
NOT_OF_TYPE = {"number": "not_a_number", "integer": "not_an_integer", "datetime": "not_a_date"}
CORRUPT = "_corrupt_record"
FIELDS, FILE_ERROR, SURPLUS = "_fields", "_file_error", "_surplus"  # what the readers say of a row's file
READER_COLUMNS = (CORRUPT, FIELDS, FILE_ERROR, SURPLUS)
# Columns added by the readers; they are not tape fields.
SYSTEM_COLUMNS = frozenset(
    ["filename", "dl_code", "pcd", "pcd_year", "pcd_month", "valid_from", "valid_to", "iscurrent", "last_seen", "checksum", "part", "seen",
     *READER_COLUMNS]
)
ERRORS, OK = "qc_errors", "qc_ok"


def _limit(value, as_of: str, type_: str) -> Column:
    if type_ != "datetime":
        return F.lit(value)
    if str(value).startswith("today"):
        days = int(str(value)[6:] or 0)
        return F.date_add(F.lit(as_of).cast("date"), days)
    return F.lit(value).cast("date")


def _reasons(rule: Rule, text: Column, value: Column, as_of: str, on_fail: str) -> list[tuple[str, Column]]:
    """(reason, condition) pairs of one field."""
    # with on_fail="null" a value that cannot be read counts as missing
    missing = value.isNull() if on_fail == "null" else text.isNull()
    out = []
    if not rule.nullable:
        out.append(("null_not_allowed", missing))
    if rule.type != "string" and on_fail == "error":
        out.append((NOT_OF_TYPE[rule.type], text.isNotNull() & value.isNull()))
    if rule.min is not None:
        out.append(("below_min", value < _limit(rule.min, as_of, rule.type)))
    if rule.max is not None:
        out.append(("above_max", value > _limit(rule.max, as_of, rule.type)))
    if rule.allowed is not None:
        out.append(("unallowed_value", text.isNotNull() & ~text.isin(*rule.allowed)))
    if rule.regex is not None:
        out.append(("regex_mismatch", ~text.rlike(rule.regex)))
    if rule.maxlength is not None:
        out.append(("too_long", F.length(text) > rule.maxlength))
    return out


def validate(
    df: DataFrame,
    rules: dict[str, Rule],
    as_of: str,
    nd_mode: str = "pattern",
    on_fail: str = "error",
    system: Iterable[str] = SYSTEM_COLUMNS,
) -> DataFrame:
    """Add ``qc_ok`` and ``qc_errors``: an array of (field, reason) with every broken rule of the row.

    No shuffle and no Python. Missing codes are blanked and values are read once per field, in
    projections of their own; the broken rules are gathered as one text, which compiles to code,
    and only that short text is turned into an array.
    A field without a rule is an error on every row of the files that have it; a rule without a field is not, file by
    file. A row that stands for a file that could not be read has that reason only. A class without
    any rules has nothing to break: its rows pass, unless they cannot be read.

    The session gets ``hugeMethodLimit=8000`` unless it names a limit of its own: one method for all rules is never compiled.
    """
    split_huge_methods(df.sparkSession)
    known = set(system)
    fields = [c for c in df.columns if c not in known]
    ruled = [c for c in fields if c in rules]
    texts = df.select("*", *[null_blank(F.col(c), nd_mode).alias(f"_t_{c}") for c in ruled])
    typed = [c for c in ruled if rules[c].type != "string"]
    values = texts.select("*", *[COERCIONS[rules[c].type](F.col(f"_t_{c}")).alias(f"_v_{c}") for c in typed])
    # without a list of the file's fields every row has every column
    has = (lambda c: F.coalesce(F.array_contains(FIELDS, c), F.lit(True))) if FIELDS in df.columns else (lambda c: F.lit(True))
    found = [F.when(has(c), F.lit(f"{c}:unknown_field")) for c in fields if rules and c not in rules]
    for c in ruled:
        text = F.col(f"_t_{c}")
        value = F.col(f"_v_{c}") if rules[c].type != "string" else COERCIONS["string"](text)
        # only a missing value can come from a missing field
        mine = lambda reason, cond, c=c: has(c) & cond if reason == "null_not_allowed" else cond
        found += [F.when(mine(reason, cond), F.lit(f"{c}:{reason}")) for reason, cond in _reasons(rules[c], text, value, as_of, on_fail)]
    if CORRUPT in df.columns:
        found.append(F.when(F.col(CORRUPT).isNotNull(), F.lit("file:unreadable_row")))
    codes = F.concat_ws(";", *found) if found else F.lit("")
    if FILE_ERROR in df.columns:
        codes = F.when(F.col(FILE_ERROR).isNotNull(), F.concat(F.lit("file:"), F.col(FILE_ERROR))).otherwise(codes)
    coded = values.select(*df.columns, codes.alias("_codes"))
    pair = lambda x: F.struct(F.substring_index(x, ":", 1).alias("field"), F.substring_index(x, ":", -1).alias("reason"))
    none = F.array().cast("array<struct<field:string,reason:string>>")
    errors = F.when(F.col("_codes") != "", F.transform(F.split("_codes", ";"), pair)).otherwise(none)
    return coded.select(*df.columns, (F.col("_codes") == "").alias(OK), errors.alias(ERRORS))


def _marked(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    lacking = [F.when(F.col(k).isNull(), F.struct(F.lit(k).alias("field"), F.lit("null_key").alias("reason"))) for k in keys]
    if not lacking:
        return df
    if FILE_ERROR in df.columns:  # such a row has its reason already
        lacking = [F.when(F.col(FILE_ERROR).isNull(), x) for x in lacking]
    every = F.concat(ERRORS, F.array_compact(F.array(*lacking)))
    return df.withColumn(ERRORS, every).withColumn(OK, F.size(ERRORS) == 0)


def split_clean_dirty(df: DataFrame, keys: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows without errors, and the rest with the reasons as JSON text (SNK4).

    A row that lacks one of ``keys`` can have no history; it is dirty, with the reason ``null_key``.
    Both sides evaluate the rules; ``sides`` has both at once.
    """
    df = _marked(df, keys)
    clean = df.where(OK).drop(OK, ERRORS, FIELDS, FILE_ERROR)
    dirty = df.where(~F.col(OK)).withColumn(ERRORS, F.to_json(ERRORS)).drop(OK, FIELDS)
    return clean, dirty


def sides(df: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """The rows of both sides of ``split_clean_dirty``, told apart by ``side``: one pass over ``df``, which need not be written first."""
    df = _marked(df, keys)
    dirty = [c for c in df.columns if c in (ERRORS, FILE_ERROR)]
    shown = lambda c: F.when(~F.col(OK), F.to_json(c) if c == ERRORS else F.col(c)).alias(c)
    kept = [c for c in df.columns if c not in (OK, FIELDS, *dirty)]
    return df.select(F.when(F.col(OK), "clean").otherwise("dirty").alias("side"), *kept, *[shown(c) for c in dirty])


def error_counts(df: DataFrame) -> DataFrame:
    """Rows per field and reason."""
    return (
        # outer: a plain explode would infer a filter that evaluates every rule a second time
        df.select(F.explode_outer(ERRORS).alias("e"))
        .where("e IS NOT NULL")
        .groupBy("e.field", "e.reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )
