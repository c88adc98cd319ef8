"""Predicate tree to Column, directed by the schema.

Literals are coerced when the plan is built, never by implicit casts: text against numbers compares as text in ranges and is
never equal, ISO strings become literals of a timestamp column's own type. Conjunctions stay bare comparisons, so Parquet
sees them; only a NOT wraps its operand, since it must be true where the operand is null.
"""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as texts
from lodestone.plans import ast

NUMERIC = (T.NumericType,)
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _kind(dtype: T.DataType) -> str:
    for kinds, name in ((NUMERIC, "number"), (TIMES, "time"), ((T.StringType, T.VarcharType, T.CharType), "text"), ((T.BooleanType,), "bool")):
        if isinstance(dtype, kinds):
            return name
    return "other"


def _value_kind(value: Any) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float, Decimal)):
        return "number"
    if isinstance(value, (datetime, date)):
        return "time"
    return "text" if isinstance(value, str) else "other"


def show(value: Any) -> str:
    """A literal as text, for comparisons across kinds."""
    if isinstance(value, bool):
        return "true" if value else "false"
    return value.isoformat() if isinstance(value, (datetime, date)) else str(value)


def _time_literal(value: Any, dtype: T.DataType) -> Column:
    """A literal of the column's own type; a text that is no ISO time raises ValueError."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value.replace("Z", "+00:00"))
    shown = value.isoformat(sep=" ") if isinstance(value, datetime) else value.isoformat()
    return F.lit(shown).cast(dtype)


def compare(column: Column, dtype: T.DataType, op: str, value: Any) -> Column:
    """One comparison; null columns give null or false, never an error."""
    if op == "ne":
        return ~F.coalesce(column.eqNullSafe(F.lit(None)) if value is None else compare(column, dtype, "eq", value), F.lit(False))
    if value is None:
        return F.lit(True)
    mine, its = _kind(dtype), _value_kind(value)
    if op in ("contains", "starts_with", "ends_with"):
        if mine != "text":
            return F.lit(False)
        return {"contains": column.contains, "starts_with": column.startswith, "ends_with": column.endswith}[op](value)
    if mine == "time" and its in ("time", "text"):
        column, literal = column, _time_literal(value, dtype)
    elif mine == its:
        literal = F.lit(value)
    elif op == "eq":
        return F.lit(False)
    else:
        column, literal = column.cast("string"), F.lit(show(value))
    return {"eq": column.__eq__, "gt": column.__gt__, "gte": column.__ge__, "lt": column.__lt__, "lte": column.__le__}[op](literal)


def compile_node(node: ast.Node, schema: T.StructType) -> Column:
    """The Column of a predicate. A field that the schema lacks is null in every row."""

    def of(name: str) -> tuple[Column, T.DataType]:
        if name in schema.fieldNames():
            return F.col(f"`{name}`"), schema[name].dataType
        return F.lit(None).cast("string"), T.StringType()

    match node:
        case ast.Compare(name, op, value):
            return compare(*of(name), op, value)
        case ast.In(name, values):
            column, dtype = of(name)
            some = [v for v in values if v is not None]
            same = [v for v in some if _kind(dtype) == _value_kind(v) or (_kind(dtype) == "time" and _value_kind(v) == "text")]
            literals = [_time_literal(v, dtype) for v in same] if _kind(dtype) == "time" else same
            found = column.isin(literals) if literals else F.lit(False)
            return found | column.isNull() if len(some) < len(values) else found
        case ast.Null(name, is_null):
            column, _ = of(name)
            return column.isNull() if is_null else column.isNotNull()
        case ast.Between(name, low, high):
            parts = [compare(*of(name), op, v) for op, v in (("gte", low), ("lte", high)) if v is not None]
            return parts[0] & parts[1] if len(parts) == 2 else parts[0] if parts else F.lit(True)
        case ast.Fuzzy(name, text, threshold, prefilter):
            column, dtype = of(name)
            if _kind(dtype) != "text":
                return F.lit(False)
            found = texts.window_score(column, text) >= threshold
            return texts.shares_trigram(column, text) & found if prefilter else found
        case ast.And(parts):
            out = F.lit(True)
            for k, p in enumerate(parts):
                out = out & compile_node(p, schema) if k else compile_node(p, schema)
            return out
        case ast.Or(parts):
            out = F.lit(False)
            for k, p in enumerate(parts):
                out = out | compile_node(p, schema) if k else compile_node(p, schema)
            return out
        case ast.Not(part):
            return ~F.coalesce(compile_node(part, schema), F.lit(False))
    raise TypeError(f"not a predicate: {node!r}")
