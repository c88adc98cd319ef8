"""Models kept in a change log: create, save and delete with events, uniqueness and declared indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import layout
from lodestone.operators.changelog import last_of_batch
from lodestone.operators.model import Events, Model, Tracked
from lodestone.sources.dataset import Dataset
from lodestone.sources.tables import materialize


class Repository:
    """Records of a model in a folder.

    Every operation is set-wise and fires its events once with the rows it is about; a listener of a `...ing` event that
    returns False stops it. Operations return the rows written, None if they were stopped.
    """

    def __init__(self, spark: SparkSession, path: str, model: Model, events: Events | None = None) -> None:
        self.spark, self.path, self.model, self.events = spark, path.rstrip("/"), model, events or Events()
        self.data = Dataset.stored(spark, f"{self.path}/log", model.key)

    @property
    def log(self):  # noqa: ANN201
        return self.data.log

    def create(self, rows: DataFrame) -> DataFrame | None:
        """Store new records of the fillable columns, with generated keys where there are none."""
        return self._write(self.model.create(rows), "creating", "created")

    def save(self, rows: DataFrame | Tracked) -> DataFrame | None:
        """Store whole records; of a tracked set those that changed."""
        if isinstance(rows, Tracked):
            rows = rows.current.join(rows.dirty().select(rows.key), rows.key, "left_semi")
        return self._write(rows, "updating", "updated")

    def _write(self, rows: DataFrame, before: str, after: str) -> DataFrame | None:
        rows = materialize(last_of_batch(rows, self.model.key), "records")
        if not (self.events.fire("saving", rows) and self.events.fire(before, rows)):
            return None
        if self.model.unique:
            others = [self.data.all().join(rows, self.model.key, "left_anti")] if self.log.exists() else []
            for column in self.model.unique:
                every = rows.select(column)
                for o in others:
                    every = every.unionByName(o.select(column))
                layout.check_unique(every, column)
        self.data.save(rows)
        self.events.fire(after, rows)
        self.events.fire("saved", rows)
        return rows

    def delete(self, rows: DataFrame) -> DataFrame | None:
        """Delete the records with the keys of rows, softly where they have deleted_at."""
        rows = rows.select(self.model.key)
        if not self.events.fire("deleting", rows):
            return None
        self.data.delete(rows)
        self.events.fire("deleted", rows)
        return rows

    def destroy(self, *keys: object) -> DataFrame | None:
        """Delete by key values."""
        kind = self.data.all().schema[self.model.key].dataType
        made = self.spark.createDataFrame([(str(k),) for k in keys], "k string")
        return self.delete(made.select(F.col("k").try_cast(kind).alias(self.model.key)).dropna())

    def find(self, key: object) -> DataFrame:
        """The record as callers see it."""
        return self.model.output(self.data.get(key))

    def query(self):  # noqa: ANN201
        return self.data.query()

    def build_indexes(self) -> layout.Indexes:
        """Write the declared indexes over the live records; rebuilding replaces them."""
        return layout.Indexes.build(self.data.all(), f"{self.path}/indexes", self.model.key, self.model.indexes())
