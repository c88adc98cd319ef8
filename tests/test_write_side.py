"""Keys of several columns, batches, generations of a log, repositories, index tables, recovery of boxes, numbered rows."""

import struct
import time
from pathlib import Path

import pytest
from lodestone.operators import changelog, layout, model, mvcc
from lodestone.operators.relations import HasMany, ManyToMany, Pivot, leaf_of
from lodestone.operators.repository import Repository
from lodestone.plans import query
from lodestone.plans.ast import field
from lodestone.sources import logfile as L
from lodestone.sources.dataset import Dataset
from pyspark.sql import functions as F


def rows(df, *columns):
    return sorted([tuple(r[c] for c in columns) for r in df.collect()], key=repr)


def test_keys_of_several_columns(spark):
    d = Dataset.of(spark.createDataFrame([(1, "a", 5), (1, "b", 6), (2, "a", 7)], "x long, y string, v int"), ("x", "y"))
    assert rows(d.get((1, "b")), "v") == [(6,)] and d.get((1, "c")).count() == 0 and d.get(("z", "a")).count() == 0
    assert [r.v for r in d.get_many([(2, "a"), (9, "a"), (1, "a"), (2, "a")]).collect()] == [7, 5, 7]
    assert d.keys().columns == ["x", "y"] and [r.v for r in d.query().limit(2).to_df().collect()] == [5, 6]
    parent = Dataset.of(spark.createDataFrame([(1,), (2,)], "id long"), "id").relate(kids=HasMany(d, "id", foreign_key="x"))
    assert [[k.v for k in r.kids] for r in parent.query().with_relation("kids", "v").order_by("id").to_df().collect()] == [[5, 6], [7]]
    assert rows(parent.query().joined("kids", "v"), "id", "v") == [(1, 5), (1, 6), (2, 7)]


def test_related_rows_without_a_unique_key(spark):
    child = Dataset.of(spark.createDataFrame([(1, 1, "p"), (1, 1, "q"), (2, 1, "p"), (2, 1, "p")], "o long, n long, v string"), ("o", "n"))
    parent = Dataset.of(spark.createDataFrame([(1,), (2,), (3,)], "id long"), "id").relate(kids=HasMany(child, "id", foreign_key="o"))
    assert leaf_of(parent, "kids").count() == 4 and leaf_of(parent, "kids", lambda q: q.where("v", "p")).count() == 3
    many = ManyToMany(child, "id", pivot=Pivot(spark.createDataFrame([(1, 2), (2, 2), (3, 9)], "a long, b long"), "a", "b"))
    many.related = Dataset.of(child.all(), "o")
    assert rows(many.of(parent.all()), "o", "v") == [(2, "p"), (2, "p")]


def test_any_of_several_relations(spark):
    kid = Dataset.of(spark.createDataFrame([(1, 1), (2, 3)], "k long, p long"), "k")
    pet = Dataset.of(spark.createDataFrame([(1, 3), (2, 4), (3, 4)], "k long, p long"), "k")
    parent = Dataset.of(spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "id long"), "id").relate(kids=HasMany(kid, "id", foreign_key="p"), pets=HasMany(pet, "id", foreign_key="p"))
    assert rows(parent.query().where_has_any("kids", "pets").to_df(), "id") == [(1,), (3,), (4,)]


def test_batches_with_repeats(spark):
    state = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    batch = spark.createDataFrame([(1, "x"), (3, "y"), (1, "z"), (3, None)], "k long, v string").coalesce(1)
    assert rows(changelog.upsert(state, batch, "k"), "k", "v") == [(1, "z"), (2, "b"), (3, None)]
    assert rows(changelog.upsert(state, batch.withColumn("at", -F.length("v")), "k", "at"), "k", "v")[0][0] == 1
    assert rows(changelog.last_of_batch(spark.createDataFrame([(1,), (1,), (2,)], "k long"), "k"), "k") == [(1,), (2,)]
    versions = spark.createDataFrame([(1, 1, 7, "a", False, True)], "seq long, tx long, key long, value string, deleted boolean, committed boolean")
    more = mvcc.write(versions, spark.createDataFrame([(7, "b"), (7, "c")], "key long, value string").coalesce(1), 2)
    assert rows(mvcc.read_at(more, 2), "value") == [("c",)]


def test_generations(spark, tmp_path, monkeypatch):
    log = changelog.ChangeLog(spark, str(tmp_path / "log"), "k")
    df = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    log.delete(df((1, "a")))
    assert not log.exists()
    log.put(df((1, "a"), (2, "b")))
    other = changelog.ChangeLog(spark, log.path, "k")
    assert other._mark("commits", 2) and not log._mark("commits", 2)  # another writer has drawn 2
    log.put(df((2, "c")))
    assert log.read().agg(F.max("seq")).first()[0] == 3
    # A compaction that stops before its mark leaves the log as it was, and the next one is whole.
    monkeypatch.setattr(changelog.ChangeLog, "_mark", lambda self, kind, n: False if kind == "generations" else Path(f"{self.path}/{kind}/{n:012d}").touch() is None)
    with pytest.raises(RuntimeError):
        log.compact()
    monkeypatch.undo()
    assert log.generation == 0 and rows(log.state(), "k", "v") == [(1, "a"), (2, "c")]
    monkeypatch.setattr(changelog, "FILE_BYTES", 500)
    log.compact()
    assert log.generation == 1 and log.read().count() == 2 and not (tmp_path / "log/data-0").exists()
    assert len(list((tmp_path / "log/data-1").glob("*.parquet"))) > 1
    log.put(df((1, "z")))
    assert rows(other.state(), "k", "v") == [(1, "z"), (2, "c")]


def test_background_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changelog, "MIN_BYTES", 1)
    log = changelog.ChangeLog(spark, str(tmp_path / "log"), "k")
    for i in range(4):
        log.put(spark.createDataFrame([(1, str(i))], "k long, v string"))
    close = log.watch(0.1)
    for _ in range(300):
        if log.generation:
            break
        time.sleep(0.1)
    close()
    log.close()
    assert log.generation == 1 and rows(log.read(), "k", "v") == [(1, "3")]


def test_repository(spark, tmp_path):
    m = model.Model(key="id", fillable=("name", "age"), mutators={"name": F.trim}, unique=("name",), indexed=("age",), fuzzy_indexed=("name",))
    events = model.Events()
    repo = Repository(spark, str(tmp_path / "repo"), m, events)
    made = repo.create(spark.createDataFrame([(" ann ", 5, "x"), ("bob", 6, "x"), ("bob ben", 6, "x")], "name string, age int, role string"))
    assert made.columns == repo.data.all().select(*made.columns).columns and "role" not in made.columns
    assert rows(repo.data.all(), "name", "age") == [("ann", 5), ("bob ben", 6), ("bob", 6)]
    assert rows(made, "id") == rows(repo.data.all(), "id")
    tracked = model.Tracked.hydrate(repo.data.all()).set(m, age=F.col("age") + F.when(F.col("name") == "bob", 1).otherwise(0), role=F.lit("no"))
    assert repo.save(tracked).count() == 1 and ("bob", 7) in rows(repo.data.all(), "name", "age")
    with pytest.raises(layout.UniqueError):
        repo.create(spark.createDataFrame([("ann", 9)], "name string, age int"))
    assert repo.data.all().count() == 3
    stop = []
    events.on("deleting", lambda r: not stop)
    ids = {r.name: r.id for r in repo.data.all().collect()}
    stop.append(1)
    assert repo.destroy(ids["ann"]) is None and repo.data.all().count() == 3
    stop.clear()
    repo.destroy(ids["ann"], "nobody")
    assert rows(repo.query().to_df(), "name") == [("bob ben",), ("bob",)]
    indexes = repo.build_indexes()
    assert rows(indexes.equal(age=7), "id") == [(ids["bob"],)] and rows(indexes.equal(name="bob ben"), "id") == [(ids["bob ben"],)]
    assert rows(indexes.fuzzy("name", "Bob Be"), "id", "hits") == sorted([(ids["bob"], 1), (ids["bob ben"], 4)], key=repr)
    with pytest.raises(KeyError):
        indexes.equal(role="x")
    with pytest.raises(ValueError):
        Dataset.of(made, "id").save(made)


def test_indexes_skip_files(spark, tmp_path):
    df = spark.range(20_000).select("id", (F.col("id") * 7919 % 20_011).alias("v"), (F.col("id") % 100).cast("string").alias("s"))
    indexes = layout.Indexes.build(df.repartition(8), str(tmp_path / "x"), "id", [layout.Index("range", ("v",)), layout.Index("hash", ("s",))], files=6)
    ranged = spark.read.parquet(indexes.path(indexes.indexes[0]))
    files = ranged.where("v between 100 and 120").select(F.input_file_name()).distinct().count()
    assert files == 1 < ranged.select(F.input_file_name()).distinct().count()
    assert "PushedFilters: [IsNotNull(v)" in ranged.where("v between 100 and 120")._jdf.queryExecution().toString()
    found = indexes.equal(s="42")
    assert found.count() == 200
    assert "PartitionFilters: [isnotnull(_bucket" in found._jdf.queryExecution().toString()


def test_numbered_rows(spark):
    df = spark.range(5000).select("id", (F.col("id") * 37 % 101).alias("v")).repartition(7)
    got = Dataset.of(df, "id").query().order_by("v").numbered().collect()
    assert {r.id: r.pos for r in got} == {i: n + 1 for n, i in enumerate(sorted(range(5000), key=lambda i: (i * 37 % 101, i)))}
    assert Dataset.of(df.limit(0), "id").query().order_by("v").numbered().count() == 0


def test_usage_counts_every_form(spark):
    before = query.usage["n"]
    q = Dataset.of(spark.range(3).withColumnRenamed("id", "n"), "n").query()
    q.where("n", gt=1).where(lambda x: (x.n > 1) | ~(x.n < 5)).or_where(field("n").is_null()).where_between("n", 1, 2)
    assert query.usage["n"] == before + 5


def test_recovery_of_boxes(spark, tmp_path):
    put, gone = L.encode_record("a", {"v": 1}), L.encode_record("a", None)
    log = put + L.encode_record("b", {"v": 2}) + gone + L.encode_record("c", {"v": 3})
    at = {k: i for i, _, k, _ in reversed(list(L.records(log)))}
    end = len(put) + len(L.encode_record("b", {"v": 2}))
    hint = L.encode_hint("a", 0) + L.encode_hint("b", at["b"]) + L.encode_hint("a", end) + L.encode_hint("x", 10_000) + b"\0\0"
    assert L.recover(log, hint, None) == ("hint", {"b": at["b"]})
    assert L.recover(log, b"", L.encode_snapshot({"c": at["c"]})) == ("snapshot", {"c": at["c"]})
    assert L.recover(log, None, b"DBIX?") == ("scan", {"b": at["b"], "c": at["c"]})
    assert L.record_at(log, at["c"]) == ("put", {"v": 3}) and L.record_at(log, len(log) - 3) is None and L.record_at(log[:-1], at["c"]) is None
    for name, parts in {"one": {"db": log, "hint": hint}, "two": {"db": log, "idx": L.encode_snapshot({"c": at["c"], "z": 5})}, "three": {"db": log}, "four": {"hint": hint}, "five": {"db": b""}}.items():
        for suffix, data in parts.items():
            (tmp_path / f"{name}.{suffix}").write_bytes(data)
    got = rows(L.read_boxes(spark, str(tmp_path)), "box", "source", "key", "value")
    assert got == [("one", "hint", "b", '{"v": 2}'), ("three", "scan", "b", '{"v": 2}'), ("three", "scan", "c", '{"v": 3}'), ("two", "snapshot", "c", '{"v": 3}')]
    assert struct.unpack_from(">i", L.encode_hint("ab", 1))[0] == 2


def test_written_boxes(spark, tmp_path):
    events = spark.createDataFrame([(2, "delete", "a", None), (1, "put", "a", ("x", None)), (3, "put", "b", ("y", 5))], "seq long, op string, key string, value struct<s: string, n: int>")
    L.write_box(events, str(tmp_path), "box", hint=True, index=True)
    log = (tmp_path / "box.db").read_bytes()
    assert [(op, k, v) for _, op, k, v in L.records(log)] == [("put", "a", {"s": "x", "n": None}), ("delete", "a", None), ("put", "b", {"s": "y", "n": 5})]
    offsets = {k: i for i, op, k, _ in L.records(log) if k == "b"}
    assert L.snapshot((tmp_path / "box.idx").read_bytes()) == offsets and [k for k, _ in L.hints((tmp_path / "box.hint").read_bytes())] == ["a", "a", "b"]


def test_cached_results(spark, tmp_path):
    d = Dataset.stored(spark, str(tmp_path / "log"), "k")
    d.save(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"))
    d.cache.most = 2
    first = d.query().where("k", gt=0).cached()
    assert d.query().where("k", gt=0).cached() is first and first.is_cached
    d.query().where("k", gt=1).cached()
    d.query().where("k", gt=2).cached()
    assert len(d.cache) == 2 and not first.is_cached
    d.destroy(1)
    assert len(d.cache) == 0 and rows(d.query().cached(), "v") == [("b",)]
    d.close()
    assert len(d.cache) == 0
