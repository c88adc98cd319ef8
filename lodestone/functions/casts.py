"""Read-time casts of model attributes. The strict profile raises on bad times, the lenient one gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cast(c: Column, kind: str, dtype: T.DataType, lenient: bool = False) -> Column:
    """kind: int, double, bool, string, datetime or json; dtype: the column's type."""
    if kind == "int":
        if isinstance(dtype, T.IntegralType):
            return c.cast("long")
        digits = c.cast("string")
        return F.when(F.trim(digits).rlike(r"^[+-]?[0-9]+$"), digits).try_cast("long")
    if kind == "double":
        return c.cast("string").try_cast("double")
    if kind == "bool":
        if isinstance(dtype, T.BooleanType):
            return F.coalesce(c, F.lit(False))
        if isinstance(dtype, T.NumericType):
            return F.coalesce(c == 1, F.lit(False))
        return F.coalesce(c.cast("string") == "true", F.lit(False))
    if kind == "string":
        return c.cast("string")
    if kind == "datetime":
        if lenient:
            return F.try_to_timestamp(c.cast("string")).cast("timestamp_ntz")
        return c.cast("string").cast("timestamp_ntz")
    if kind == "json":
        return F.parse_json(c)
    raise ValueError(f"no cast {kind!r}")
