"""Keyed change log: appended puts and deletes, the latest state, soft deletes, compaction.

A log has the record's columns and `seq` (total order), `op` ('put' or 'delete'). The state is the last entry of each key;
tombstones hide it. Batches are set-wise, so a batch of any size is one append. Rows of a batch have an order too: that of a
position column, or that in which the DataFrame yields them.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.tables import file_system

PUT, DELETE = "put", "delete"

#: Compaction: not under so many bytes, then beyond that share of garbage.
MIN_BYTES, MAX_GARBAGE = 100 * 1024 * 1024, 0.3


def latest(log: DataFrame, key: str, seq: str = "seq", op: str = "op") -> DataFrame:
    """The live records: last entry per key, tombstones dropped; columns of the log without op and seq.

    One aggregation with map-side combine, so a key's history is reduced before the exchange. Records of any width are
    compared by seq alone; since they are structs, Spark plans the aggregation with sorts by key within the tasks.
    """
    values = [c for c in log.columns if c not in (key, seq)]
    last = log.groupBy(key).agg(F.max_by(F.struct(*values), seq).alias("_last")).where(F.col(f"_last.{op}") != DELETE)
    return last.select(key, *[F.col(f"_last.{c}").alias(c) for c in values if c != op])


def last_of_batch(rows: DataFrame, key: str, pos: str | None = None) -> DataFrame:
    """Of a key's repeated rows in a batch, the last by pos (dropped), or by the rows' own order."""
    if pos is None:
        rows, pos = rows.withColumn("_pos", F.monotonically_increasing_id()), "_pos"
    values = [c for c in rows.columns if c not in (key, pos)]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*values, F.lit(0).alias("_")), pos).alias("_last"))
    return last.select(key, *[F.col(f"_last.{c}").alias(c) for c in values])


def upsert(state: DataFrame, rows: DataFrame, key: str, pos: str | None = None) -> DataFrame:
    """The state with rows put: same keys replaced, new ones added, missing columns null; of repeated keys the last counts."""
    last = last_of_batch(rows, key, pos)
    return state.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def remove(state: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The state without these keys; keys it lacks do nothing."""
    return state.join(keys.select(key), key, "left_anti")


def soft_delete(state: DataFrame, which: Column, at: Column | None = None, column: str = "deleted_at") -> DataFrame:
    """Stamp the rows; records with the column are never removed physically by a delete."""
    kind = state.schema[column].dataType
    stamp = (F.localtimestamp() if at is None else at).cast(kind)
    return state.withColumn(column, F.when(which, stamp).otherwise(F.col(column)))


def restore(state: DataFrame, which: Column, column: str = "deleted_at") -> DataFrame:
    kind = state.schema[column].dataType
    return state.withColumn(column, F.when(which, F.lit(None).cast(kind)).otherwise(F.col(column)))


def delete(state: DataFrame, keys: DataFrame, key: str, at: Column | None = None) -> DataFrame:
    """Soft where the records have a deletion column, else physical."""
    if "deleted_at" not in state.columns:
        return remove(state, keys, key)
    hit = keys.select(F.col(key).alias("_d")).distinct()
    marked = state.join(hit, state[key] == hit["_d"], "left")
    return soft_delete(marked, F.col("_d").isNotNull(), at).drop("_d")


def should_compact(log_bytes: int, live_bytes: int) -> bool:
    """Whether a log of that size, with so many live bytes, is worth rewriting."""
    if log_bytes < MIN_BYTES:
        return False
    return live_bytes <= 0 or (log_bytes - live_bytes) / log_bytes > MAX_GARBAGE


def sizes(log: DataFrame, key: str, bytes_of: Column) -> DataFrame:
    """One row: log_bytes, live_bytes (of the entries that make up the state)."""
    sized = log.select(key, "seq", "op", bytes_of.cast("long").alias("_b"))
    each = sized.groupBy(key).agg(F.sum("_b").alias("_all"), F.max_by(F.struct("op", "_b"), "seq").alias("_last"))
    live = F.sum(F.when(F.col("_last.op") != DELETE, F.col("_last._b")))
    return each.agg(F.coalesce(F.sum("_all"), F.lit(0)).alias("log_bytes"), F.coalesce(live, F.lit(0)).alias("live_bytes"))


#: Bytes of a file that compaction aims at.
FILE_BYTES = 128 * 1024 * 1024


class ChangeLog:
    """A log in a folder.

    Entries are Parquet files under data-G for generation G; empty marker files under commits and generations, which only one
    writer can create, hand out sequence numbers and say which generation counts. Appends may run side by side. Compaction
    writes the next generation beside the current one and then marks it, so a crash leaves one or the other whole; it must
    not run beside appends.
    """

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._closers: list[Callable[[], None]] = []

    def _marks(self, kind: str) -> list[int]:
        fs, p = file_system(self.spark, f"{self.path}/{kind}")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(p)) if fs.exists(p) else []

    def _mark(self, kind: str, number: int) -> bool:
        """Create a marker; False if another writer has."""
        fs, p = file_system(self.spark, f"{self.path}/{kind}/{number:012d}")
        fs.mkdirs(p.getParent())
        try:
            fs.create(p, False).close()
        except Py4JJavaError:
            if fs.exists(p):
                return False
            raise
        return True

    def _commit(self) -> int:
        seq = self.next_seq()
        while not self._mark("commits", seq):
            seq += 1
        return seq

    @property
    def generation(self) -> int:
        return max(self._marks("generations"), default=0)

    def _data(self, generation: int) -> str:
        return f"{self.path}/data-{generation}"

    def _append(self, rows: DataFrame, op: str) -> None:
        rows.withColumns({"op": F.lit(op), "seq": F.lit(self._commit()).cast("long")}).write.mode("append").parquet(self._data(self.generation))

    def read(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(self._data(self.generation))

    def exists(self) -> bool:
        fs, p = file_system(self.spark, self._data(self.generation))
        return fs.exists(p)

    def next_seq(self) -> int:
        return max(self._marks("commits"), default=0) + 1

    def put(self, rows: DataFrame, pos: str | None = None) -> None:
        """Append a batch; of keys repeated in it the last counts, by pos or by the rows' own order."""
        self._append(last_of_batch(rows, self.key, pos), PUT)

    append = put

    def delete(self, keys: DataFrame) -> None:
        """Append tombstones, or stamped records where the records have deleted_at; keys that are not there do nothing."""
        if not self.exists():
            return
        state = self.state()
        if "deleted_at" in state.columns:
            self._append(soft_delete(state.join(keys.select(self.key), self.key, "left_semi"), F.lit(True)), PUT)
        else:
            self._append(keys.select(self.key).distinct(), DELETE)

    def state(self) -> DataFrame:
        return latest(self.read(), self.key)

    def compact(self) -> None:
        """Rewrite the log with the live records only, in files of about FILE_BYTES; an empty state leaves an empty log."""
        now, seq = self.generation, self._commit()
        fs, old = file_system(self.spark, self._data(now))
        files = max(1, -(-fs.getContentSummary(old).getLength() // FILE_BYTES))
        live = self.state().withColumns({"op": F.lit(PUT), "seq": F.lit(seq).cast("long")})
        live.repartition(files, self.key).write.mode("overwrite").parquet(self._data(now + 1))
        if not self._mark("generations", now + 1):
            raise RuntimeError("another compaction was faster")
        fs.delete(old, True)

    def live_bytes(self) -> tuple[int, int]:
        """(log bytes, live bytes), by the length of the records as JSON."""
        log = self.read()
        r = sizes(log, self.key, F.length(F.to_json(F.struct(*log.columns)))).first()
        return r["log_bytes"], r["live_bytes"]

    def maybe_compact(self) -> bool:
        """Compact if the policy says so; whether it did."""
        if due := should_compact(*self.live_bytes()):
            self.compact()
        return due

    def watch(self, seconds: float = 60.0) -> Callable[[], None]:
        """Run maybe_compact every so many seconds beside the caller, who must pause appends meanwhile; returns what stops it."""
        stop = threading.Event()

        def run() -> None:
            while not stop.wait(seconds):
                if self.exists():
                    self.maybe_compact()

        worker = threading.Thread(target=run, daemon=True)
        worker.start()

        def close() -> None:
            stop.set()
            worker.join()

        self._closers.append(close)
        return close

    def close(self) -> None:
        """Stop what runs in the background."""
        while self._closers:
            self._closers.pop()()

    def snapshot(self, path: str) -> None:
        """Write the state as a table of its own."""
        self.state().write.mode("overwrite").parquet(path)
