"""Shared pieces: intermediate tables, salted group statistics, Arrow helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import tables
from lodestone.sources.tables import read_table

#: Sub-groups into which a hot key is dealt before its rows meet again.
SALTS = 64

#: Rows of an Arrow batch, unless the session says otherwise: batches hold whole texts, in the JVM and in Python at once.
ARROW_ROWS = 1_000

#: White space of the word and line definitions: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"

_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: Applications that have the package.
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver has it, and bound Arrow batches.

    The package's sources go to the workers as a file of the application. A Python operator knows the files that were there
    when it was built, so this comes first in every function that builds one. The batch bound is the session's own setting; where
    the session leaves it unset, it becomes ARROW_ROWS for the rest of the session.
    """
    if _ARROW not in spark.conf.getAll:
        spark.conf.set(_ARROW, str(ARROW_ROWS))
    if (app := spark.sparkContext.applicationId) not in _shipped:
        _shipped.add(app)
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="lodestone-")  # the driver serves it from here
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(path := f"{folder}/{package.name}.zip", "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        spark.sparkContext.addPyFile(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data directory, by Spark's own reader."""
    ship(spark)
    return read_table(spark, sf_dir, name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors."""
    ship(df.sparkSession)
    return tables.materialize(df, name)


def salt(*cols: str) -> Column:
    """A sub-group number in [0, SALTS) that depends only on the row's own identity."""
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def group_stats(df: DataFrame, keys: list[str], aggs: dict[str, tuple[Column, Callable[[Column], Column]]]) -> DataFrame:
    """Two-step aggregation of df, which has a column `_salt`: first by keys and salt, then by keys.

    aggs: name -> (first step's aggregate, function of that column for the second step). The result has the keys, the
    aggregates and `_salts`, the at most SALTS salts that the group uses.
    """
    first = df.groupBy(*keys, "_salt").agg(*[a.alias(n) for n, (a, _) in aggs.items()])
    return first.groupBy(*keys).agg(*[f(F.col(n)).alias(n) for n, (_, f) in aggs.items()], F.collect_set("_salt").alias("_salts"))


def attach(df: DataFrame, stats: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join group statistics back to the rows by keys and salt, so that a hot group is spread over SALTS sub-groups."""
    return df.join(stats.withColumn("_salt", F.explode("_salts")).drop("_salts"), [*keys, "_salt"], how)


def text_bytes(col: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return col.cast(pa.binary() if not pa.types.is_large_string(col.type) else pa.large_binary()).to_pylist()


def crc_bucket(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4: remainder 2 is held out from training."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))
