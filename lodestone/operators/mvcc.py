"""Multi-version records as rows: seq (insertion order), tx, key, value columns, deleted, committed.

A transaction sees its own versions and the committed ones of transactions up to its id, newest inserted first. Visibility
goes by id, not by the set of transactions active at the start, and there is no conflict detection.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_at(versions: DataFrame, tx: int, key: str = "key") -> DataFrame:
    """The records that transaction tx sees; deleted ones are absent."""
    seen = versions.where((F.col("tx") == tx) | (F.col("committed") & (F.col("tx") <= tx)))
    values = [c for c in versions.columns if c not in (key, "seq", "tx", "committed")]
    last = seen.groupBy(key).agg(F.max_by(F.struct(*values), "seq").alias("_v")).where("not _v.deleted")
    return last.select(key, *[F.col(f"_v.{c}").alias(c) for c in values if c != "deleted"])


def keys(versions: DataFrame, tx: int, key: str = "key") -> DataFrame:
    return read_at(versions, tx, key).select(key)


def write(versions: DataFrame, rows: DataFrame, tx: int, deleted: bool = False) -> DataFrame:
    """Append uncommitted versions after all there are, in the rows' own order."""
    seq = (versions.agg(F.max("seq")).first()[0] or 0) + 1
    new = rows.withColumns({"tx": F.lit(tx).cast(versions.schema["tx"].dataType), "deleted": F.lit(deleted), "committed": F.lit(False), "seq": (F.monotonically_increasing_id() + seq).cast(versions.schema["seq"].dataType)})
    return versions.unionByName(new, allowMissingColumns=True)


def delete(versions: DataFrame, rows: DataFrame, tx: int) -> DataFrame:
    return write(versions, rows, tx, deleted=True)


def commit(versions: DataFrame, tx: int) -> DataFrame:
    return versions.withColumn("committed", F.col("committed") | (F.col("tx") == tx))


def rollback(versions: DataFrame, tx: int) -> DataFrame:
    """Without the transaction's uncommitted versions."""
    return versions.where(~((F.col("tx") == tx) & ~F.col("committed")))


class Transactions:
    """Hands out increasing transaction ids and knows the active ones."""

    def __init__(self) -> None:
        self._ids: Iterator[int] = count(1)
        self._active: set[int] = set()

    def begin(self) -> int:
        self._active.add(tx := next(self._ids))
        return tx

    def end(self, tx: int) -> None:
        self._active.discard(tx)

    def is_active(self, tx: int) -> bool:
        return tx in self._active
