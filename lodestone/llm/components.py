"""Distributed connected components by alternating large and small stars, with hubs spread over salted sub-groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import attach, group_stats, materialize, salt, ship

#: Edges that a task contracts at a time.
CHUNK = 200_000


def contract(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node of these edges to its component's smallest node, without loops."""
    nodes, index = np.unique(np.concatenate([src, dst]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(index[: len(src)].tolist(), index[len(src) :].tolist(), strict=True):
        a, b = find(a), find(b)
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    root = np.array([find(x) for x in range(len(nodes))], np.int64) if len(nodes) else np.zeros(0, np.int64)
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def contract_locally(edges: DataFrame) -> DataFrame:
    """src, dst of the same components, each task's edges contracted in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                a, b = contract(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held.clear()
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["src", "dst"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(a) for a, _ in held) >= CHUNK:
                yield from flush()
        yield from flush()

    return edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src is not null and dst is not null and src <> dst").mapInArrow(run, "src long, dst long")


def _hub_min(edges: DataFrame, floor: Column) -> DataFrame:
    """edges (u, v) with m, the least of floor and all v of the same u."""
    salted = edges.withColumn("_salt", salt("v"))
    stats = group_stats(salted, ["u"], {"m": (F.min("v"), F.min)}).withColumn("m", F.least("m", floor))
    return attach(salted, stats, ["u"])


def connected_components(edges: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every id in edges (src, dst: long) that is not its own component.

    Loops, repeated and reversed edges and nulls do no harm; no edges give no rows. Every round is written to the shared
    folder. Stops when the edges are stars: no id has two parents, no parent is a child.
    """
    ship(edges.sparkSession)
    held = materialize(contract_locally(edges).select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "cc")
    while True:
        each = held.select(F.col("u").alias("id"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(held.select(F.col("v").alias("id"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        tangled = each.groupBy("id").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c > 1 or (c = 1 and p = 1)")
        if not tangled.limit(1).count():
            return held.select(F.col("u").alias("id"), F.col("v").alias("component"))
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hub_min(both, F.col("u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _hub_min(large, F.col("u"))
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v")
        held = materialize(nxt.distinct(), "cc")
