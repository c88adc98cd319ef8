"""Change streams and live queries over Structured Streaming.

Change events are rows of a log folder (key, seq, op and the record's columns). A live query keeps the latest state in a
folder, dealt to buckets by key; a micro-batch rewrites the buckets that it touches, and a manifest says which version of
each bucket counts. Then the same plan runs again; transitions tell how each changed key moved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.changelog import DELETE, last_of_batch
from lodestone.sources.tables import file_system


def changes(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None, glob: str | None = None) -> DataFrame:
    """The log folder as a stream; glob: only files of such names."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def watch_key(stream: DataFrame, key: str, value: object) -> DataFrame:
    return stream.where(F.col(key) == F.lit(value))


def merge(state: DataFrame, batch: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The state (record columns, seq and op, tombstones included) after a batch of events in any order."""
    return last_of_batch_keep(state.unionByName(batch, allowMissingColumns=True), key, seq)


def last_of_batch_keep(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Like last_of_batch, with the order column."""
    return last_of_batch(rows.withColumn("_pos", F.col(seq)), key, "_pos")


def transitions(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, transition of keys in either result: enter, leave or update (in both)."""
    a = before.select(F.col(key), F.lit(1).alias("_a")).distinct()
    b = after.select(F.col(key), F.lit(1).alias("_b")).distinct()
    moved = F.when(F.col("_a").isNull(), "enter").when(F.col("_b").isNull(), "leave").otherwise("update")
    return a.join(b, key, "full").select(key, moved.alias("transition"))


class LiveQuery:
    """Runs plan(state) after every micro-batch and hands publish(result, transitions, batch id) the outcome.

    folder: where the state lives. A batch writes new versions of the buckets that its keys fall in and its own manifest, so a
    repeated batch gives the same state; versions that the last two manifests do not name are deleted. by_row: the plan looks
    at each record alone, so transitions are found among the touched buckets only; else the plan runs over both whole states.
    """

    def __init__(self, spark: SparkSession, key: str, schema: T.StructType, plan: Callable[[DataFrame], DataFrame], publish: Callable[[DataFrame, DataFrame, int], None], folder: str, buckets: int = 64, by_row: bool = False) -> None:
        self.spark, self.key, self.schema, self.plan, self.publish, self.folder = spark, key, schema, plan, publish, folder.rstrip("/")
        self.buckets, self.by_row = buckets, by_row

    def _manifest(self, batch: int) -> dict[int, int]:
        """Bucket to the batch that wrote its current version."""
        fs, p = file_system(self.spark, f"{self.folder}/manifests/{batch}")
        if batch < 0 or not fs.exists(p):
            return {}
        return {r["bucket"]: r["version"] for r in self.spark.read.schema("bucket int, version long").parquet(p.toString()).collect()}

    def _state(self, manifest: dict[int, int], only: list[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/state-{v}/_bucket={b}" for b, v in manifest.items() if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _live(self, state: DataFrame) -> DataFrame:
        return self.plan(state.where(F.col("op") != DELETE).drop("op", "seq"))

    def on_batch(self, events: DataFrame, batch: int) -> None:
        events = events.select(*self.schema.names).withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")).persist()
        before = self._manifest(batch - 1)
        hit = [r["_bucket"] for r in events.select("_bucket").distinct().collect()]  # at most `buckets` numbers
        after = before | dict.fromkeys(hit, batch)
        if hit:
            merged = merge(self._state(before, hit), events.drop("_bucket"), self.key).select(*self.schema.names)
            dealt = merged.withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")).repartition("_bucket")
            dealt.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/state-{batch}")
        self.spark.createDataFrame(list(after.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifests/{batch}")
        touched = events.select(self.key).distinct()
        part = hit if self.by_row else None
        old, new = self._live(self._state(before, part)), self._live(self._state(after, part))
        moved = transitions(old.join(touched, self.key, "left_semi"), new.join(touched, self.key, "left_semi"), self.key)
        self.publish(self._live(self._state(after)), moved, batch)
        events.unpersist()
        self._drop_old(batch, set(before.items()) | set(after.items()))

    def _drop_old(self, batch: int, named: set[tuple[int, int]]) -> None:
        fs, p = file_system(self.spark, self.folder)
        for folder in fs.listStatus(p):
            name = folder.getPath().getName()
            if name.startswith("state-") and int(name[6:]) < batch:
                kept = [b for b, v in named if v == int(name[6:])]
                for part in fs.listStatus(folder.getPath()):
                    if (own := part.getPath().getName()).startswith("_bucket=") and int(own[8:]) not in kept:
                        fs.delete(part.getPath(), True)
                if not kept:
                    fs.delete(folder.getPath(), True)

    def start(self, stream: DataFrame, checkpoint: str, **trigger):  # noqa: ANN003, ANN201
        """Start; by default process what there is and stop."""
        return stream.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def transition_of(existed: Column, matches: Column) -> Column:
    """The transition table as a Column: leave, enter, update, or null if it never matched."""
    return F.when(existed & ~matches, "leave").when(~existed & matches, "enter").when(existed & matches, "update")
