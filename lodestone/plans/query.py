"""Immutable fluent query over a dataset; to_df() gives one lazily planned DataFrame."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.relations import resolve
from lodestone.plans import ast
from lodestone.plans.compiler import compile_node
from lodestone.sources.dataset import Dataset, trashed
from lodestone.sources.tables import materialize

#: How often each field was filtered on, in this process.
usage: Counter = Counter()


@dataclass(frozen=True)
class Page:
    """data: the page's rows; total and last_page over all matches."""

    data: DataFrame
    page: int
    per_page: int
    total: int

    @property
    def last_page(self) -> int:
        return math.ceil(self.total / self.per_page) if self.per_page else 0


@dataclass(frozen=True)
class Query:
    """Every method returns a new query."""

    dataset: Dataset
    predicate: ast.Node | None = None
    sort: tuple[tuple[str, bool], ...] = ()  # (field, descending)
    size: int | None = None
    skip: int = 0
    trash: str = "hide"  # hide, with, only
    has: tuple[tuple[tuple[str, Callable | None], ...], ...] = ()  # all of these, each any of its paths
    hasnt: tuple[str, ...] = ()
    counts: tuple[str, ...] = ()
    includes: tuple[tuple[str, tuple[str, ...]], ...] = ()

    # filters
    def where(self, predicate: ast.Node | Callable | str, /, *args: Any, **ops: Any) -> Query:
        """A predicate, a lambda on a field proxy, or a field name with keyword operators."""
        node = self._node(predicate, *args, **ops)
        return replace(self, predicate=node if self.predicate is None else ast.And((self.predicate, node)))

    def or_where(self, predicate: ast.Node | Callable | str, /, *args: Any, **ops: Any) -> Query:
        """Everything so far, or this."""
        node = self._node(predicate, *args, **ops)
        return replace(self, predicate=node if self.predicate is None else ast.Or((self.predicate, node)))

    @staticmethod
    def _node(predicate: ast.Node | Callable | str, *args: Any, **ops: Any) -> ast.Node:
        if isinstance(predicate, str):
            node = ast.from_keywords(predicate, **({"eq": args[0]} if args else {}), **ops)
        else:
            node = predicate if isinstance(predicate, ast.Node) else predicate(ast.Proxy())
        usage.update(ast.fields_of(node))
        return node

    def where_in(self, name: str, values: list) -> Query:
        return self.where(ast.In(name, tuple(values)))

    def where_null(self, name: str) -> Query:
        return self.where(ast.Null(name))

    def where_between(self, name: str, low: Any = None, high: Any = None) -> Query:
        return self.where(ast.Between(name, low, high))

    def where_has(self, path: str, condition: Callable[[Query], Query] | None = None) -> Query:
        """Rows with a related row, along a dotted path; condition narrows the last step and hides its trashed rows."""
        return replace(self, has=(*self.has, ((path, condition),)))

    def where_has_any(self, *paths: str) -> Query:
        return replace(self, has=(*self.has, tuple((p, None) for p in paths)))

    def where_doesnt_have(self, path: str) -> Query:
        return replace(self, hasnt=(*self.hasnt, path))

    def with_trashed(self) -> Query:
        return self if self.trash == "only" else replace(self, trash="with")

    def only_trashed(self) -> Query:
        return replace(self, trash="only")

    def scope(self, f: Callable[[Query], Query]) -> Query:
        return f(self)

    # order and page
    def order_by(self, name: str, desc: bool = False) -> Query:
        """The last call is the first key; the dataset's key breaks ties."""
        return replace(self, sort=((name, desc), *self.sort))

    def order_by_desc(self, name: str) -> Query:
        return self.order_by(name, True)

    sort_by = order_by

    def limit(self, n: int) -> Query:
        return replace(self, size=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    # related data
    def with_count(self, name: str) -> Query:
        """Adds `{name}_count`."""
        return replace(self, counts=(*self.counts, name))

    def with_relation(self, path: str, *columns: str) -> Query:
        """Adds the related rows as nested columns, along a dotted path; columns: only these of the last step's rows."""
        return replace(self, includes=(*self.includes, (path, columns)))

    def joined(self, name: str, *columns: str, how: str = "left") -> DataFrame:
        """The matches side by side with their related rows (or those columns of them), a row per pair: eager loading for
        relations that are too wide for one nested value."""
        return self.dataset.relations[name].joined(self.to_df(), how, columns)

    def numbered(self, name: str = "pos") -> DataFrame:
        """The matches with their place in the order (from 1): sorted once, written, and counted by partition."""
        spot = F.monotonically_increasing_id()
        rows = materialize(self.to_df().withColumn(name, spot), "numbered").withColumn("_part", F.shiftright(name, 33))
        sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min(name).alias("_first"))
        before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
        starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"), "_first")
        return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col(name) - F.col("_first") + F.col("_before") + 1).drop("_part", "_before", "_first")

    include = with_relation

    # plan
    def _filtered(self) -> DataFrame:
        df = self.dataset.all()
        gone = trashed(df)
        if gone is not None and self.trash != "with":
            df = df.where(gone if self.trash == "only" else ~gone)
        elif gone is None and self.trash == "only":
            df = df.where(F.lit(False))
        if self.predicate is not None:
            df = df.where(compile_node(self.predicate, df.schema))
        for paths in self.has:
            if len(paths) == 1:
                df = self._having(df, *paths[0])
            else:
                own, marks = df.columns, [f"_has{i}" for i in range(len(paths))]
                for mark, (path, condition) in zip(marks, paths, strict=True):
                    df = resolve(self.dataset, path)[0].marked(df, mark, self._rows(path, condition))
                df = df.where(reduce(lambda a, b: a | b, map(F.col, marks))).select(*own)
        for path in self.hasnt:
            first, *_ = resolve(self.dataset, path)
            df = first.lacking(df, self._rows(path, None))
        return df

    def _rows(self, path: str, condition: Callable | None) -> DataFrame | None:
        """Rows of the path's first step that the rest of the path and the condition leave; None for all."""
        steps = resolve(self.dataset, path)
        rows = condition(steps[-1].related.query()).to_df().select(*steps[-1].related.all().columns) if condition else None
        for at in range(len(steps) - 1, 0, -1):
            rows = steps[at].having(steps[at - 1].related.all(), rows)
        return rows

    def _having(self, df: DataFrame, path: str, condition: Callable | None) -> DataFrame:
        return resolve(self.dataset, path)[0].having(df, self._rows(path, condition))

    def _counted(self, df: DataFrame) -> DataFrame:
        for name in self.counts:
            if name in self.dataset.relations:
                df = self.dataset.relations[name].counted(df, f"{name}_count")
        return df

    def _paged(self, df: DataFrame) -> DataFrame:
        if self.sort:
            keys = [F.col(n).desc_nulls_first() if d else F.col(n).asc_nulls_last() for n, d in self.sort]
            keys += [F.col(k).asc_nulls_last() for k in self.dataset.key_columns if k not in [n for n, _ in self.sort]]
            df = df.orderBy(*keys)
        elif self.size is not None or self.skip:
            df = df.orderBy(*[F.col(k).asc_nulls_last() for k in self.dataset.key_columns])
        if self.skip:
            df = df.offset(self.skip)
        return df if self.size is None else df.limit(self.size)

    def to_df(self) -> DataFrame:
        """Filter, then count and page (page first unless a count is sorted on), then attach related rows."""
        df = self._filtered()
        by_count = any(n == f"{c}_count" for n, _ in self.sort for c in self.counts)
        paging = self.size is not None or self.skip
        if self.counts and not by_count and paging:
            df = self._paged(self._counted(self._paged(df))) if self.skip == 0 else self._resorted(self._counted(self._paged(df)))
        else:
            df = self._paged(self._counted(df))
        for path, columns in self.includes:
            df = self._included(df, self.dataset, path, columns)
        return df

    def _resorted(self, df: DataFrame) -> DataFrame:
        return replace(self, size=None, skip=0)._paged(df)

    @staticmethod
    def _included(df: DataFrame, dataset: Dataset, path: str, columns: tuple[str, ...]) -> DataFrame:
        """Leaf first: the related rows get their own related rows, then hang on the parents. Unknown names are ignored."""
        name, _, rest = path.partition(".")
        if name not in dataset.relations:
            return df
        relation = dataset.relations[name]
        rows = Query._included(relation.related.all(), relation.related, rest, columns) if rest else None
        return relation.loaded(df, name, rows, () if rest else columns)

    find = get = to_df

    def cached(self) -> DataFrame:
        """to_df(), kept until the dataset is written through save, delete or destroy."""
        return self.dataset.cache.rows(self.dataset.name, self.to_df())

    def first(self) -> DataFrame:
        return self.limit(1).to_df()

    def count(self) -> DataFrame:
        """One row `n`: matches, after limit and offset."""
        return replace(self, includes=(), counts=()).to_df().agg(F.count(F.lit(1)).alias("n"))

    def paginate(self, page: int = 1, per_page: int = 15) -> Page:
        """1-based page; the total respects all filters and the trash mode."""
        plain = replace(self, size=None, skip=0, counts=(), includes=(), sort=())
        total = plain.count().first()["n"]
        return Page(self.offset((page - 1) * per_page).limit(per_page).to_df(), page, per_page, total)

    def explain(self) -> list[str]:
        """Logical steps in order: scan, filter, semi join, sort, paginate, count, attach."""
        steps = [f"scan {self.dataset.name}"]
        steps += [f"filter {self.predicate}"] if self.predicate is not None else []
        steps += [f"semi join {' or '.join(p for p, _ in paths)}" for paths in self.has] + [f"anti join {p}" for p in self.hasnt]
        steps += [f"count {c}" for c in self.counts]
        steps += [f"sort {', '.join(n + (' desc' if d else '') for n, d in self.sort)}"] if self.sort else []
        steps += [f"paginate {self.skip}, {self.size}"] if self.size is not None or self.skip else []
        return steps + [f"attach {p}" for p, _ in self.includes]
