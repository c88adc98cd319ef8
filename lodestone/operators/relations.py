"""Relations as joins. A relation knows the parent's column and gives its links: `_k` (the parent's value) and `_row` (the
related row as a struct). Existence is a left semi join, counts are aggregated before the join, eager loading nests arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.sources.dataset import Dataset


@dataclass
class Relation:
    """related: the dataset on the other side; parent: the parent's column; many: whether it holds several rows."""

    related: Dataset
    parent: str
    many: bool = True

    def links(self, rows: DataFrame | None = None) -> DataFrame:
        """_k, _row over all related rows, or over the given ones."""
        raise NotImplementedError

    def _links(self, rows: DataFrame, key: Column) -> DataFrame:
        return rows.select(key.alias("_k"), F.struct(*rows.columns).alias("_row")).where(F.col("_k").isNotNull())

    def _on(self, parents: DataFrame, links: DataFrame) -> Column:
        left, right = parents.schema[self.parent].dataType, links.schema["_k"].dataType
        if left == right or {left.typeName(), right.typeName()} <= {"integer", "long", "short", "byte"}:
            return parents[self.parent] == links["_k"]
        return parents[self.parent].cast("string") == links["_k"].cast("string")

    def having(self, parents: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """Parents with a related row."""
        links = self.links(rows).select("_k")
        return parents.join(links, self._on(parents, links), "left_semi")

    def lacking(self, parents: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """Parents without a related row."""
        links = self.links(rows).select("_k")
        return parents.join(links, self._on(parents, links), "left_anti")

    def marked(self, parents: DataFrame, name: str, rows: DataFrame | None = None) -> DataFrame:
        """Parents with whether they have a related row."""
        links = self.links(rows).select("_k").distinct()
        return parents.join(links, self._on(parents, links), "left").withColumn(name, F.col("_k").isNotNull()).drop("_k")

    def counted(self, parents: DataFrame, name: str) -> DataFrame:
        """Parents with the number of related rows, soft-deleted ones included."""
        n = self.links().groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
        return parents.join(n, self._on(parents, n), "left").withColumn(name, F.coalesce("_n", F.lit(0)).cast("long")).drop("_k", "_n")

    def loaded(self, parents: DataFrame, name: str, rows: DataFrame | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
        """Parents with the related rows, or those columns of them, in column name: an array in the related key's order, or one
        struct or null. A parent's rows are one value of one row; joined() gives rows instead."""
        links = self.links(rows)
        order = F.struct(*[F.col(f"_row.{k}").alias(f"_{i}") for i, k in enumerate(self.related.key_columns)])
        value = F.struct(*[F.col(f"_row.{c}").alias(c) for c in columns]) if columns else F.col("_row")
        by_key = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("_o"), value.alias("_row")))), lambda x: x["_row"])
        grouped = links.groupBy("_k").agg(by_key.alias("_rows"))
        joined = parents.join(grouped, self._on(parents, grouped), "left")
        value = F.coalesce("_rows", F.array().cast(grouped.schema["_rows"].dataType)) if self.many else F.get("_rows", F.lit(0))
        return joined.withColumn(name, value).drop("_k", "_rows")

    def joined(self, parents: DataFrame, how: str = "inner", columns: tuple[str, ...] = ()) -> DataFrame:
        """Parent and related columns (or those named) side by side; the related ones must have other names."""
        links = self.links()
        own = [f"_row.{c}" for c in columns] or ["_row.*"]
        return parents.join(links, self._on(parents, links), how).select(*[parents[c] for c in parents.columns], *own)

    def of(self, parents: DataFrame) -> DataFrame:
        """The related rows of these parents, each once however many parents it has."""
        links = self.links()
        return links.join(parents.select(self.parent), self._on(parents, links), "left_semi").select("_row.*")


@dataclass
class HasMany(Relation):
    foreign_key: str = ""

    def links(self, rows: DataFrame | None = None) -> DataFrame:
        rows = self.related.all() if rows is None else rows
        return self._links(rows, rows[self.foreign_key])


@dataclass
class HasOne(HasMany):
    """The first related row by order_by, then by key."""

    order_by: str = ""
    many: bool = False

    def links(self, rows: DataFrame | None = None) -> DataFrame:
        rows = self.related.all() if rows is None else rows
        order = [F.col(c).asc_nulls_last() for c in (self.order_by, *self.related.key_columns) if c]
        first = F.row_number().over(W.partitionBy(self.foreign_key).orderBy(*order))
        kept = rows.withColumn("_first", first).where("_first = 1").drop("_first")
        return self._links(kept, kept[self.foreign_key])


@dataclass
class BelongsTo(Relation):
    """parent: the column that holds the related row's key."""

    many: bool = False

    def links(self, rows: DataFrame | None = None) -> DataFrame:
        rows = self.related.all() if rows is None else rows
        return self._links(rows, rows[self.related.key])


class Pivot:
    """A set of (left, right) pairs."""

    def __init__(self, df: DataFrame, left: str, right: str) -> None:
        self.df = df.select(F.col(left).alias("left"), F.col(right).alias("right")).distinct()

    def attach(self, pairs: DataFrame) -> Pivot:
        return Pivot(self.df.unionByName(pairs.toDF("left", "right")), "left", "right")

    def detach(self, pairs: DataFrame) -> Pivot:
        return Pivot(self.df.join(pairs.toDF("left", "right"), ["left", "right"], "left_anti"), "left", "right")

    def forward(self, left: object) -> DataFrame:
        return self.df.where(F.col("left") == F.lit(left)).select("right")

    def reverse(self, right: object) -> DataFrame:
        return self.df.where(F.col("right") == F.lit(right)).select("left")


@dataclass
class ManyToMany(Relation):
    pivot: Pivot | None = None

    def links(self, rows: DataFrame | None = None) -> DataFrame:
        rows = self.related.all() if rows is None else rows
        met = self.pivot.df.join(rows, F.col("right") == rows[self.related.key])
        return met.select(F.col("left").alias("_k"), F.struct(*[rows[c] for c in rows.columns]).alias("_row"))

    def of(self, parents: DataFrame) -> DataFrame:
        rows = self.related.all()
        pairs = self.pivot.df.join(parents.select(F.col(self.parent).alias("_p")), F.col("left") == F.col("_p"), "left_semi")
        return rows.join(pairs, rows[self.related.key] == pairs["right"], "left_semi")


@dataclass
class MorphMany(Relation):
    """Related rows whose type_field names the parent's kind and whose id_field is its key."""

    type_field: str = ""
    id_field: str = ""
    morph_name: str = ""

    def links(self, rows: DataFrame | None = None) -> DataFrame:
        rows = self.related.all() if rows is None else rows
        rows = rows.where(F.col(self.type_field) == self.morph_name)
        return self._links(rows, rows[self.id_field])


def morph_to(rows: DataFrame, type_field: str, id_field: str, kinds: dict[str, Dataset], columns: Callable[[str, DataFrame], list[Column]]) -> DataFrame:
    """rows with the target's columns: each type's rows joined to its dataset by key, unknown types and ids with nulls.

    columns(type, target) gives the same column names for every type.
    """
    out = None
    for kind, dataset in kinds.items():
        target = dataset.all()
        picked = target.select(target[dataset.key].cast("string").alias("_k"), *columns(kind, target))
        mine = rows.where(F.col(type_field) == kind)
        part = mine.join(picked, mine[id_field].cast("string") == picked["_k"], "left").drop("_k")
        out = part if out is None else out.unionByName(part)
    rest = rows.where(~F.coalesce(F.col(type_field).isin(list(kinds)), F.lit(False)))
    return out.unionByName(rest, allowMissingColumns=True)


def resolve(dataset: Dataset, path: str) -> list[Relation]:
    """The relations of a dotted path; an unknown name raises KeyError."""
    out: list[Relation] = []
    for name in path.split("."):
        out.append(dataset.relations[name])
        dataset = out[-1].related
    return out


def leaf_of(dataset: Dataset, path: str, condition: Callable | None = None) -> DataFrame:
    """The distinct rows at the end of a path that hang from any row of the dataset."""
    rows = dataset.all()
    steps = resolve(dataset, path)
    for relation in steps:
        rows = relation.of(rows)
    if condition is not None:
        rows = condition(replace(steps[-1].related, supply=lambda: rows).query()).to_df()
    return rows
