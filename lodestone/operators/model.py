"""Declarative model: the column pipeline between stored rows and what callers see."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.casts import cast
from lodestone.operators.layout import Index


@dataclass(frozen=True)
class Model:
    """fillable, guarded: columns that mass assignment takes or refuses ('*': all); mutators run on write, casts and then
    accessors on read; hidden and visible choose the output, appends are computed for it; indexed, unique and fuzzy_indexed are
    columns to index."""

    key: str = "id"
    fillable: tuple[str, ...] = ()
    guarded: tuple[str, ...] = ("*",)
    hidden: tuple[str, ...] = ()
    visible: tuple[str, ...] = ()
    casts: dict[str, str] = field(default_factory=dict)
    accessors: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    mutators: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    appends: dict[str, Column | Callable[[DataFrame], Column]] = field(default_factory=dict)
    lenient: bool = False
    indexed: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    fuzzy_indexed: tuple[str, ...] = ()

    def indexes(self) -> list[Index]:
        """The declared indexes."""
        return [Index(kind, (c,)) for kind, own in (("hash", self.indexed), ("unique", self.unique), ("fuzzy", self.fuzzy_indexed)) for c in own]

    def is_fillable(self, column: str) -> bool:
        if self.fillable:
            return column in self.fillable
        return "*" not in self.guarded and column not in self.guarded

    def fill(self, rows: DataFrame) -> DataFrame:
        """Key and fillable columns, mutated: what a mass assignment stores."""
        return self._mutated(rows.select(*[c for c in rows.columns if c == self.key or self.is_fillable(c)]))

    def force_fill(self, rows: DataFrame) -> DataFrame:
        return self._mutated(rows)

    def _mutated(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({c: f(F.col(c)) for c, f in self.mutators.items() if c in rows.columns})

    def create(self, rows: DataFrame) -> DataFrame:
        """Filled rows with a key where there is none: a hash of the row and its place, the same whenever the plan is run."""
        numbered = rows.withColumn("_new", F.md5(F.concat_ws(":", F.monotonically_increasing_id(), F.to_json(F.struct(*rows.columns)))))
        made = self._mutated(numbered.select("_new", *[c for c in rows.columns if c == self.key or self.is_fillable(c)]))
        key = F.coalesce(F.col(self.key).cast("string"), "_new") if self.key in made.columns else F.col("_new")
        return made.withColumn(self.key, key).drop("_new")

    def read(self, rows: DataFrame) -> DataFrame:
        """Casts, then accessors, of the columns there are."""
        rows = rows.withColumns({c: cast(F.col(c), k, rows.schema[c].dataType, self.lenient) for c, k in self.casts.items() if c in rows.columns})
        return rows.withColumns({c: f(F.col(c)) for c, f in self.accessors.items() if c in rows.columns})

    def output(self, rows: DataFrame) -> DataFrame:
        """What is shown: key first, without hidden, only visible ones if given, with appended columns."""
        rows = self.read(rows)
        extra = {c: (f(rows) if callable(f) and not isinstance(f, Column) else f) for c, f in self.appends.items()}
        shown = [c for c in rows.columns if c != self.key and c not in self.hidden and (not self.visible or c in self.visible)]
        return rows.withColumns(extra).select(*([self.key] if self.key in rows.columns else []), *shown, *extra)

    def to_json(self, rows: DataFrame) -> DataFrame:
        """One column `json` per row of the output."""
        out = self.output(rows)
        return out.select(F.to_json(F.struct(*out.columns)).alias("json"))


def resource(rows: DataFrame, **shape: Column) -> DataFrame:
    """Rows in another shape: one column per name."""
    return rows.select(*[c.alias(n) for n, c in shape.items()])


def dirty(original: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """key and `changed`, the sorted names of the columns that differ, of the rows in both with any; nulls compare safely."""
    names = sorted(c for c in original.columns if c != key and c in current.columns)
    a = original.select(key, F.struct(*names).alias("_a"))
    b = current.select(key, F.struct(*names).alias("_b"))
    marks = F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in names])
    return a.join(b, key).select(key, F.array_compact(marks).alias("changed")).where(F.size("changed") > 0)


@dataclass(frozen=True)
class Tracked:
    """Records with the state they were last read or saved in."""

    original: DataFrame
    current: DataFrame
    key: str = "id"

    @classmethod
    def hydrate(cls, rows: DataFrame, key: str = "id") -> Tracked:
        """Rows as they are stored, neither filtered nor mutated: nothing is dirty."""
        return cls(rows, rows, key)

    def set(self, model: Model | None = None, **columns: Column) -> Tracked:
        """New values for columns; with a model only for fillable ones, through its mutators."""
        taken = {c: v for c, v in columns.items() if model is None or model.is_fillable(c)}
        if model is not None:
            taken = {c: model.mutators[c](v) if c in model.mutators else v for c, v in taken.items()}
        return replace(self, current=self.current.withColumns(taken))

    def dirty(self) -> DataFrame:
        """key, changed: see dirty()."""
        return dirty(self.original, self.current, self.key)

    def sync(self) -> Tracked:
        """The current state becomes the original one."""
        return replace(self, original=self.current)


class Events:
    """Listeners by event name: saving, saved, creating, created, updating, updated, deleting, deleted."""

    def __init__(self) -> None:
        self._listeners: dict[str, list[Callable]] = {}

    def on(self, name: str, listener: Callable) -> None:
        self._listeners.setdefault(name, []).append(listener)

    def fire(self, name: str, payload: object) -> bool:
        """False if a listener returned False, which stops the operation."""
        return all(f(payload) is not False for f in self._listeners.get(name, []))
