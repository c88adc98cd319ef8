"""Named dataset: a DataFrame supplier, key columns and relations; over a change log also its write side."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.changelog import ChangeLog
from lodestone.plans.cache import ResultCache
from lodestone.sources.tables import read_table

#: Up to so many looked-up keys are broadcast.
BROADCAST_KEYS = 100_000
TRASHED = ("deleted_at", "deletedAt")


@dataclass
class Dataset:
    """name; supply() gives the current rows; key identifies a row (a column, or several); relations by name; scopes apply to
    every query; log takes what is written; cache keeps results that queries ask it to keep, until the next write here."""

    name: str
    supply: Callable[[], DataFrame]
    key: str | tuple[str, ...] = "id"
    relations: dict = field(default_factory=dict)
    scopes: dict[str, Callable] = field(default_factory=dict)
    log: ChangeLog | None = None
    cache: ResultCache = field(default_factory=ResultCache)

    @property
    def key_columns(self) -> tuple[str, ...]:
        return (self.key,) if isinstance(self.key, str) else tuple(self.key)

    @classmethod
    def stored(cls, spark: SparkSession, path: str, key: str, name: str = "data") -> Dataset:
        """The live records of a change log, which save, delete and destroy write to."""
        log = ChangeLog(spark, path, key)
        return cls(name, log.state, key, log=log)

    @classmethod
    def open(cls, spark: SparkSession, sf_dir: str, name: str, key: str | tuple[str, ...]) -> Dataset:
        """A Parquet table of a data directory."""
        return cls(name, lambda: read_table(spark, sf_dir, name), key)

    @classmethod
    def of(cls, df: DataFrame, key: str | tuple[str, ...], name: str = "data") -> Dataset:
        return cls(name, lambda: df, key)

    def relate(self, **relations) -> Dataset:  # noqa: ANN003
        self.relations |= relations
        return self

    def all(self) -> DataFrame:
        """Every row, soft-deleted ones included."""
        return self.supply()

    def scan(self, predicate: Column | Callable) -> DataFrame:
        """Rows that satisfy a Column, or a callable from this dataset's columns to one."""
        df = self.supply()
        return df.where(predicate(df) if callable(predicate) and not isinstance(predicate, Column) else predicate)

    def get(self, key: object) -> DataFrame:
        """The row of a key (a tuple where it has several columns), soft-deleted or not."""
        return self.supply().where(self._is(key))

    find = get

    def _is(self, key: object) -> Column:
        schema = self.supply().schema
        values = (key,) if isinstance(self.key, str) else tuple(key)

        def same(column: str, value: object) -> Column:
            if schema[column].dataType.typeName() in ("byte", "short", "integer", "long"):
                return F.col(column) == int(value) if str(value).lstrip("+-").isdigit() else F.lit(False)
            return F.col(column).cast("string") == F.lit(str(value))

        return reduce(lambda a, b: a & b, [same(c, v) for c, v in zip(self.key_columns, values, strict=True)])

    def get_many(self, keys: Iterable) -> DataFrame:
        """Rows in the order of the given keys (column `pos`); missing keys are skipped, repeated ones repeat. The keys are a list
        of the caller's, so they are broadcast up to BROADCAST_KEYS of them."""
        df, own = self.supply(), self.key_columns
        given = [(i, *map(str, (k,) if isinstance(self.key, str) else k)) for i, k in enumerate(keys)]
        wanted = df.sparkSession.createDataFrame(given, ", ".join(["pos int", *[f"_k{i} string" for i in range(len(own))]]))
        wanted = wanted.select("pos", *[F.col(f"_k{i}").try_cast(df.schema[c].dataType).alias(f"_k{i}") for i, c in enumerate(own)])
        same = reduce(lambda a, b: a & b, [df[c] == wanted[f"_k{i}"] for i, c in enumerate(own)])
        return df.join(F.broadcast(wanted) if len(given) <= BROADCAST_KEYS else wanted, same).drop(*[f"_k{i}" for i in range(len(own))]).orderBy("pos")

    def keys(self) -> DataFrame:
        return self.supply().select(*self.key_columns)

    def save(self, rows: DataFrame, pos: str | None = None) -> None:
        """Put records; of keys repeated in rows the last counts, by pos or by the rows' own order."""
        self._log().put(rows, pos)
        self.cache.clear(self.name)

    def delete(self, rows: DataFrame) -> None:
        """Delete the records with the keys of rows, softly where they have deleted_at."""
        self._log().delete(rows)
        self.cache.clear(self.name)

    def destroy(self, *keys: object) -> None:
        """Delete by key values."""
        state = self.supply()
        kind = state.schema[self.key].dataType
        self.delete(state.sparkSession.createDataFrame([(str(k),) for k in keys], "k string").select(F.col("k").try_cast(kind).alias(self.key)).dropna())

    def close(self) -> None:
        """Stop compaction in the background and forget cached results."""
        self.cache.clear(self.name)
        if self.log is not None:
            self.log.close()

    def _log(self) -> ChangeLog:
        if self.log is None:
            raise ValueError(f"{self.name} is read only: it has no change log")
        return self.log

    def contains(self, key: object) -> DataFrame:
        """One row: `found`."""
        return self.get(key).limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))

    def count(self) -> DataFrame:
        return self.supply().agg(F.count(F.lit(1)).alias("n"))

    def query(self, *without: str):  # noqa: ANN201
        """A query under the dataset's scopes but those named."""
        from lodestone.plans.query import Query

        return reduce(lambda q, name: q if name in without else self.scopes[name](q), self.scopes, Query(self))


def trashed(df: DataFrame) -> Column | None:
    """Whether a row is soft-deleted: a stamp that is not null and not empty; None if the rows have no such column."""
    found = [F.coalesce(F.col(c).cast("string") != "", F.lit(False)) for c in TRASHED if c in df.columns]
    return reduce(lambda a, b: a | b, found) if found else None
