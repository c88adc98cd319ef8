"""Schema differences as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def diff(spark: SparkSession, old: dict[str, T.StructType], new: dict[str, T.StructType]) -> DataFrame:
    """kind (new_table, new_column, removed_column, changed_type, dropped_table), table, column, type; null where it does
    not apply."""
    rows: list[tuple] = []
    for table, schema in sorted(new.items()):
        if table not in old:
            rows.append(("new_table", table, None, None))
            continue
        before, after = ({f.name: f.dataType.simpleString() for f in s} for s in (old[table], schema))
        rows += [("new_column", table, c, t) for c, t in after.items() if c not in before]
        rows += [("removed_column", table, c, t) for c, t in before.items() if c not in after]
        rows += [("changed_type", table, c, t) for c, t in after.items() if before.get(c, t) != t]
    rows += [("dropped_table", t, None, None) for t in sorted(set(old) - set(new))]
    return spark.createDataFrame(rows, "kind string, table string, column string, type string")


def annotate(schema: T.StructType, **notes: dict) -> T.StructType:
    """The schema with metadata on its fields: collection, relation and index notes travel with the data."""
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable, {**f.metadata, **notes.get(f.name, {})}) for f in schema])
