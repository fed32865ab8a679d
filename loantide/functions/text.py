"""Text and hash helpers (FN17 to FN19, SRC4)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

ESCAPE_RUN = r"(?:\\u[0-9a-fA-F]{4})+"


def compound_key(*cols: Column) -> Column:
    """Key text of several columns; a null part stays visible."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols])


def sequence_id(prefix: str, number: Column, width: int = 6) -> Column:
    """``prefix_000001`` style identifiers; longer numbers are kept whole."""
    text = number.cast("string")
    return F.concat(F.lit(prefix + "_"), F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.length(text), F.lit(0))), text)


def strip_namespace(tag: Column) -> Column:
    return F.regexp_replace(tag, r"\{[^}]*\}", "")


def number_with_commas(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def key_hash(*cols: Column) -> Column:
    return F.md5(compound_key(*cols))


def row_hash(df_columns: list[str]) -> Column:
    """sha256 of all values joined by ``|`` in sorted column order."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None")) for c in sorted(df_columns)]
    return F.sha2(F.concat_ws("|", *parts), 256)


_TOLD = (T.IntegralType, T.BooleanType, T.DateType, T.TimestampNTZType, T.DecimalType)


def same_zero(f: T.StructField) -> Column:
    """The column, with one zero where there are two, as grouping has it."""
    c = F.col(f"`{f.name}`")
    return F.when(c == 0, F.lit(0).cast(f.dataType)).otherwise(c) if isinstance(f.dataType, T.FractionalType) else c


def row_digest(schema: T.StructType) -> Column | None:
    """128 bits of SHA-256 over all columns: equal for rows that grouping takes as equal, and only for those.

    Each value stands with its length, so no two rows make one text. None if a column has a type without an exact text.
    """
    parts = []
    for f in schema.fields:
        c, t = same_zero(f), f.dataType
        if isinstance(t, T.TimestampType):
            text = F.unix_micros(c).cast("string")
        elif t == T.StringType() or isinstance(t, (*_TOLD, T.FloatType, T.DoubleType)):
            text = c.cast("string")
        else:
            return None
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("~")))
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def clean_text(col: Column, unescape: bool = True) -> Column:
    """Drop byte-order marks and NULs, and turn ``\\uXXXX`` runs into their characters.

    Text that holds none of them, as nearly all does, is found by three searches and passed on as it is.
    """
    dropped = F.contains(col, F.lit("\ufeff")) | F.contains(col, F.lit("\u0000"))
    out = F.translate(col, "\ufeff\u0000", "")
    if not unescape:
        return F.when(dropped, out).otherwise(col)
    pieces = F.split(out, ESCAPE_RUN)
    runs = F.regexp_extract_all(out, F.lit(f"({ESCAPE_RUN})"), F.lit(1))
    decoded = F.transform(runs, lambda r: F.decode(F.unhex(F.regexp_replace(r, r"\\u", "")), "UTF-16BE"))
    joined = F.array_join(F.zip_with(pieces, decoded, lambda p, d: F.concat(p, F.coalesce(d, F.lit("")))), "")
    repaired = F.when(out.rlike(ESCAPE_RUN), joined).otherwise(out)
    return F.when(dropped | F.contains(col, F.lit("\\")), repaired).otherwise(col)
