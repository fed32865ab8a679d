"""Results in plain column types, so that two engines can be compared value by value."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Dates as text, counts as bigint, doubles rounded, arrays as joined text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(t, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",", "null")
        out.append(c.alias(f.name))
    return df.select(*out)
