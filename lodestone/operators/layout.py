"""Index declarations as write layouts, lookups as predicates, and the uniqueness check.

Spark prunes by file statistics: a sorted layout plays the part of a range index, bucketing that of a hash index.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import trigrams


@dataclass(frozen=True)
class Index:
    """kind: hash, range, compound, unique or fuzzy; columns it covers."""

    kind: str
    columns: tuple[str, ...]


class UniqueError(ValueError):
    """Several rows share a unique key."""


def violations(df: DataFrame, *columns: str) -> DataFrame:
    """Keys held by several rows: the columns and `n`. Keys with a null are not indexed."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return df.where(known).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_unique(df: DataFrame, *columns: str) -> DataFrame:
    """df itself, or UniqueError."""
    if found := violations(df, *columns).limit(3).collect():
        raise UniqueError(f"{columns} repeat: {found}")
    return df


#: Partitions of a hash index.
BUCKETS = 64


def write_indexed(df: DataFrame, path: str, indexes: list[Index], files: int | None = None) -> None:
    """Write sorted by the first range or compound index, so that lookups on it skip files and row groups; unique keys are
    checked. One table has one order: further indexes are tables of their own, see Indexes."""
    for i in indexes:
        if i.kind == "unique":
            check_unique(df, *i.columns)
    order = next((i.columns for i in indexes if i.kind in ("range", "compound", "unique", "hash")), ())
    if order:
        df = (df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)).sortWithinPartitions(*order)
    df.write.mode("overwrite").parquet(path)


@dataclass(frozen=True)
class Indexes:
    """Index tables beside a dataset: each has the key and the indexed values, laid out for its kind of lookup.

    hash: partitioned by a hash of the values, an equality reads one partition. range, compound, unique: sorted, a range skips
    files and row groups. fuzzy: a row per trigram of the lower-case text, partitioned by its hash. Lookups give keys; rows
    with a null in the indexed columns are not indexed. build() over new rows replaces all tables.
    """

    spark: SparkSession
    folder: str
    key: str
    indexes: tuple[Index, ...]

    @classmethod
    def build(cls, df: DataFrame, folder: str, key: str, indexes: list[Index], files: int | None = None) -> Indexes:
        """Write all tables; files: of a sorted one, by default as many as its size asks for."""
        made = cls(df.sparkSession, folder.rstrip("/"), key, tuple(indexes))
        for i in indexes:
            rows = df.select(F.col(key).alias("_key"), *i.columns).dropna(subset=list(i.columns))
            if i.kind == "unique":
                check_unique(rows, *i.columns)
            if i.kind == "fuzzy":
                rows = rows.select("_key", F.explode(F.array_distinct(trigrams(F.col(i.columns[0])))).alias("gram"))
            if i.kind in ("hash", "fuzzy"):
                own = ["gram"] if i.kind == "fuzzy" else list(i.columns)
                rows = rows.withColumn("_bucket", _bucket(*map(F.col, own)))
                rows.repartition("_bucket").sortWithinPartitions(*own).write.mode("overwrite").partitionBy("_bucket").parquet(made.path(i))
            else:
                dealt = rows.repartitionByRange(files, *i.columns) if files else rows.repartitionByRange(*i.columns)
                dealt.sortWithinPartitions(*i.columns).write.mode("overwrite").parquet(made.path(i))
        return made

    def path(self, index: Index) -> str:
        return f"{self.folder}/{index.kind}-{'-'.join(index.columns)}"

    def _table(self, kinds: tuple[str, ...], columns: tuple[str, ...]) -> tuple[Index, DataFrame]:
        for i in self.indexes:
            if i.kind in kinds and i.columns == columns:
                return i, self.spark.read.parquet(self.path(i))
        raise KeyError(f"no index of {kinds} on {columns}")

    def equal(self, **values: object) -> DataFrame:
        """Keys of the rows with these values."""
        index, table = self._table(("hash", "unique", "range", "compound"), tuple(values))
        found = compound_equal(values)
        if index.kind == "hash":
            kinds = {c: table.schema[c].dataType for c in values}
            (spot,) = self.spark.range(1).select(_bucket(*[F.lit(v).cast(kinds[c]) for c, v in values.items()])).first()
            found = (F.col("_bucket") == spot) & found
        return table.where(found).select(F.col("_key").alias(self.key))

    def between(self, low: dict[str, object], high: dict[str, object]) -> DataFrame:
        """Keys of the rows between two bounds, inclusive, in the order of the columns."""
        _, table = self._table(("range", "compound", "unique"), tuple(low))
        return table.where(compound_range(low, high)).select(F.col("_key").alias(self.key))

    def fuzzy(self, column: str, text: str) -> DataFrame:
        """key, hits: rows that share trigrams with the text, and how many."""
        _, table = self._table(("fuzzy",), (column,))
        grams = self.spark.range(1).select(F.explode(F.array_distinct(trigrams(F.lit(text)))).alias("gram")).select("gram", _bucket(F.col("gram")).alias("b")).collect()
        wanted = F.col("_bucket").isin([g["b"] for g in grams]) & F.col("gram").isin([g["gram"] for g in grams])
        return table.where(wanted).groupBy(F.col("_key").alias(self.key)).agg(F.count(F.lit(1)).alias("hits"))


def _bucket(*values: Column) -> Column:
    return F.pmod(F.xxhash64(*values), F.lit(BUCKETS)).cast("int")


def compound_equal(values: dict[str, object]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in values.items()])


def compound_range(low: dict[str, object], high: dict[str, object]) -> Column:
    """Inclusive lexicographic range over the columns in order; rows with a null in them are not indexed."""
    names = list(low)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names])
    key = F.struct(*names)
    bounds = [F.struct(*[F.lit(x[c]).alias(c) for c in names]) for x in (low, high)]
    # The leading column's bounds again by themselves: those are pushed down to the files.
    return known & F.col(names[0]).between(F.lit(low[names[0]]), F.lit(high[names[0]])) & key.between(*bounds)
