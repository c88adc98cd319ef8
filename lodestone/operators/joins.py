"""Plain joins of two row sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner equi-join in which null keys match: columns `left` and `right`, structs of the two rows."""
    a = left.select(F.struct(*left.columns).alias("left"))
    b = right.select(F.struct(*right.columns).alias("right"))
    return a.join(b, F.col(f"left.{left_key}").eqNullSafe(F.col(f"right.{right_key}")))


def semi_join(left: DataFrame, right: DataFrame, left_field: str, right_field: str, nulls_match: bool = False) -> DataFrame:
    """Rows of left with a partner in right; nulls_match: null meets null. Both forms plan as hash or merge joins."""
    keys = right.select(F.col(right_field).alias("_r"))
    same = left[left_field].eqNullSafe(keys["_r"]) if nulls_match else left[left_field] == keys["_r"]
    return left.join(keys, same, "left_semi")
