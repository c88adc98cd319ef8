"""Hand-made rows: nulls, coercion, soft deletes, scores, casts, versions, pages, relations, logs, streams."""

import pytest
from lodestone.functions import casts, text
from lodestone.operators import changelog, layout, migrate, model, mvcc
from lodestone.operators.relations import HasMany, HasOne
from lodestone.plans.ast import field
from lodestone.plans.query import Query
from lodestone.sources.dataset import Dataset
from lodestone.streaming import live
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ids(df, c="id"):
    return [r[c] for r in df.collect()]


@pytest.fixture(scope="module")
def nulls(spark):
    return Dataset.of(spark.createDataFrame([(1, 5, "b", True), (2, None, "a", False), (3, -5, None, None)], "id long, n long, s string, b boolean"), "id")


@pytest.mark.parametrize(
    "node, want",
    [
        (field("n") > 0, {1}), (~(field("n") > 0), {2, 3}), (field("n") != 5, {2, 3}), (field("n").is_in([5, None]), {1, 2}),
        (field("n").between(), {1, 2, 3}), (field("n").between(None, 0), {3}), (field("s") == 5, set()), (field("n") == "5", set()),
        (field("b") == 1, set()), (field("b") > False, {1}), (field("missing").is_null(), {1, 2, 3}), (field("missing") == 1, set()),
        (field("n").contains("5"), set()), (field("s") != None, {1, 2}), ((field("n") > 0) | (field("s") == "a"), {1, 2}),  # noqa: E711
        (field("n") == True, set()),  # noqa: E712
    ],
)
def test_two_valued_predicates(nulls, node, want):
    assert set(ids(nulls.query().where(node).to_df())) == want


def test_sorting_puts_nulls_last_ascending(nulls):
    assert ids(nulls.query().order_by("n").to_df()) == [3, 1, 2]
    assert ids(nulls.query().order_by("n", desc=True).to_df()) == [2, 1, 3]


def test_soft_deletes(spark):
    d = Dataset.of(spark.createDataFrame([(1, None), (2, ""), (3, "2024-01-01T00:00:00")], "id long, deleted_at string"), "id")
    q = d.query()
    assert set(ids(q.to_df())) == {1, 2} and set(ids(q.with_trashed().to_df())) == {1, 2, 3}
    assert set(ids(q.only_trashed().to_df())) == set(ids(q.only_trashed().with_trashed().to_df())) == set(ids(q.with_trashed().only_trashed().to_df())) == {3}
    assert set(ids(d.get(3))) == {3}
    assert q.paginate(1, 1).total == 2 and q.with_trashed().paginate(1, 2).last_page == 2


def test_text_against_numbers(spark):
    d = Dataset.of(spark.createDataFrame([(1, "10"), (2, "9"), (3, "abc")], "id long, v string"), "id")
    assert set(ids(d.query().where(lambda x: x.v > 9).to_df())) == {3}
    assert ids(d.query().where("v", eq=9).to_df()) == []


def test_times(spark):
    d = Dataset.of(spark.sql("select 1L id, timestamp_ntz'2024-01-01 10:00:00' t"), "id")
    assert ids(d.query().where(lambda x: x.t >= "2024-01-01T10:00:00").to_df()) == [1]
    assert ids(d.query().where(lambda x: x.t.is_in(["2024-01-01 10:00:00"])).to_df()) == [1]
    with pytest.raises(ValueError):
        d.query().where(lambda x: x.t > "soon").to_df()


@pytest.mark.parametrize("q, t, window, whole", [("wigdet", "red widget", 0.6667, 0.4), ("ali", "alice", 1.0, 0.6), ("ali", "bob", 0.0, 0.0), ("alicia", "ali", 0.5, 0.5), ("laptop", "desktop", 0.5, 0.4286), ("monitr", "monitor", 0.8333, 0.8571)])
def test_scores(spark, q, t, window, whole):
    r = spark.range(1).select(text.window_score(F.lit(t), q).alias("w"), text.similarity(F.lit(q), F.lit(t)).alias("s")).first()
    assert round(r.w, 4) == window and round(r.s, 4) == whole


def test_normalisation(spark):
    cases = {"أحمد إلي": "احمد الی", "\ufeffA\u2003\u0085 b": "a \u0085 b", "\u1680x\u202f": "x", "علي": "علی", "كتاب": "کتاب", "كِتـاب": "کتاب", "  A \t B ": "a b", "a b": "a b", "": ""}
    got = spark.createDataFrame([(k, v) for k, v in cases.items()], "a string, b string").select(text.normalize(F.col("a")).alias("x"), "b").collect()
    assert [r.x for r in got] == [r.b for r in got]
    assert all(text.normalized(k) == v for k, v in cases.items())
    assert spark.range(1).select(text.studly(F.lit("first_naME_x"))).first()[0] == "FirstNaMEX"


def test_casts(spark):
    rows = spark.createDataFrame([("3",), ("3.0",), ("x",), (None,), ("true",), ("1",)], "v string")
    got = rows.select(casts.cast(F.col("v"), "int", T.StringType()).alias("i"), casts.cast(F.col("v"), "bool", T.StringType()).alias("b"), casts.cast(F.col("v"), "double", T.StringType()).alias("d")).collect()
    assert [r.i for r in got] == [3, None, None, None, None, 1]
    assert [r.b for r in got] == [False, False, False, False, True, False]
    assert [r.d for r in got] == [3.0, 3.0, None, None, None, 1.0]


def test_versions(spark):
    rows = spark.createDataFrame([(1, 1, "k", "a", False, True), (2, 2, "k", "b", False, False), (3, 3, "k", None, True, True)], "seq long, tx long, key string, value string, deleted boolean, committed boolean")
    see = lambda v, tx: [r.value for r in mvcc.read_at(v, tx).collect()]
    assert see(rows, 2) == ["b"] and see(rows, 3) == [] and see(rows, 1) == ["a"] and see(rows, 4) == []
    two = rows.where("seq <> 3")
    assert see(two, 4) == ["a"] and see(mvcc.commit(two, 2), 4) == ["b"]
    new = mvcc.write(two, spark.createDataFrame([("k", "c")], "key string, value string"), 7)
    assert see(new, 7) == ["c"] and see(new, 8) == ["a"] and see(mvcc.rollback(new, 7), 7) == ["a"]
    assert see(mvcc.delete(two, spark.createDataFrame([("k",)], "key string"), 5), 5) == []
    tx = mvcc.Transactions()
    first, second = tx.begin(), tx.begin()
    tx.end(first)
    assert second > first and tx.is_active(second) and not tx.is_active(first)


def test_pages(spark):
    q = Dataset.of(spark.range(1, 11), "id").query().order_by("id")
    page = q.paginate(2, 3)
    assert ids(page.data) == [4, 5, 6] and page.last_page == 4 and page.total == 10
    assert ids(q.offset(10).to_df()) == [] and ids(q.limit(0).to_df()) == []
    assert q.size is None and q.skip == 0  # paginate left it alone
    assert q.explain()[0] == "scan data"


def test_relations(spark):
    child = Dataset.of(spark.createDataFrame([(10, 1, "a"), (11, 1, "b"), (12, 2, "a"), (13, None, "a")], "cid long, pid long, kind string"), "cid")
    parent = Dataset.of(spark.createDataFrame([(1,), (2,), (3,), (None,)], "id long"), "id").relate(kids=HasMany(child, "id", foreign_key="pid"), kid=HasOne(child, "id", foreign_key="pid", order_by="kind"))
    has = lambda k: lambda q: q.where("kind", k)
    assert ids(parent.query().where_has("kids", has("a")).where_has("kids", has("b")).to_df()) == [1]
    assert set(ids(parent.query().where_has("kids").to_df())) == {1, 2}
    assert set(ids(parent.query().where_doesnt_have("kids").to_df())) == {3, None}
    rows = {r.id: r for r in parent.query().with_relation("kids").with_relation("kid").with_count("kids").with_count("nothing").to_df().collect()}
    assert [k.cid for k in rows[1].kids] == [10, 11] and rows[3].kids == [] and rows[3].kid is None and rows[1].kid.cid == 10
    assert [rows[i].kids_count for i in (1, 2, 3, None)] == [2, 1, 0, 0]
    with pytest.raises(KeyError):
        parent.query().where_has("nothing").to_df()


def test_log_scenarios(spark, tmp_path):
    log = changelog.ChangeLog(spark, str(tmp_path / "users"), "key")
    df = lambda rows: spark.createDataFrame(rows, "key string, id long, name string")
    log.put(spark.range(10_000).select(F.concat(F.lit("user:"), "id").alias("key"), "id", F.concat(F.lit("User "), "id").alias("name")))
    assert log.state().count() == 10_000
    log.put(df([("user:1", 1, "Before")]))
    log.put(df([("user:1", 1, "After")]))
    assert log.state().where("key = 'user:1'").first().name == "After"
    log.delete(df([("user:1", None, None), ("user:3", None, None), ("user:5", None, None), ("nobody", None, None)]))
    assert log.state().count() == 9_997
    before = log.read().count()
    log.compact()
    assert log.read().count() == 9_997 < before and log.state().count() == 9_997
    assert not log.maybe_compact() and log.live_bytes()[0] > 0
    log.snapshot(str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 9_997
    log.delete(log.state())
    log.compact()
    assert log.state().count() == 0


def test_log_repeats_and_soft_delete(spark, tmp_path):
    log = changelog.ChangeLog(spark, str(tmp_path / "posts"), "key")
    log.put(spark.createDataFrame([("p", 1, None, 0), ("p", 2, None, 1), ("q", 3, None, 0)], "key string, v long, deleted_at timestamp_ntz, pos int"), pos="pos")
    assert {r.key: r.v for r in log.state().collect()} == {"p": 2, "q": 3}
    log.delete(spark.createDataFrame([("p",)], "key string"))
    state = {r.key: r.deleted_at for r in log.state().collect()}
    assert state["p"] is not None and state["q"] is None
    assert changelog.should_compact(200 << 20, 100 << 20) and not changelog.should_compact(200 << 20, 190 << 20)
    assert not changelog.should_compact(99 << 20, 0) and changelog.should_compact(101 << 20, 0)


def test_models(spark):
    m = model.Model(fillable=("name", "age"), hidden=("password",), casts={"age": "int"}, mutators={"name": F.trim}, accessors={"name": F.upper}, appends={"label": lambda df: F.concat("name", F.lit("!"))})
    made = m.create(spark.createDataFrame([(" ann ", "7", "x"), ("bob", "y", "x")], "name string, age string, role string"))
    assert sorted(made.columns) == ["age", "id", "name"] and made.select("id").distinct().count() == 2
    out = m.output(spark.createDataFrame([("1", "ann", "7", "s")], "id string, name string, age string, password string")).first()
    assert out.asDict() == {"id": "1", "name": "ANN", "age": 7, "label": "ANN!"}
    assert model.Model().fill(made).columns == ["id"]
    a = spark.createDataFrame([(1, "a", None), (2, "b", 1)], "id long, x string, y long")
    b = spark.createDataFrame([(1, "a", 3), (2, "b", 1)], "id long, x string, y long")
    assert [(r.id, r.changed) for r in model.dirty(a, b, "id").collect()] == [(1, ["y"])]
    seen = []
    ev = model.Events()
    ev.on("saving", lambda p: seen.append(p))
    ev.on("saving", lambda p: False)
    assert ev.fire("saved", 1) and not ev.fire("saving", 2) and seen == [2]


def test_layout(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id long, k string")
    assert [(r.k, r.n) for r in layout.violations(df, "k").collect()] == [("a", 2)]
    with pytest.raises(layout.UniqueError):
        layout.check_unique(df, "k")
    layout.write_indexed(df, str(tmp_path / "x"), [layout.Index("unique", ("id",))], files=2)
    assert spark.read.parquet(str(tmp_path / "x")).count() == 4


def test_schema_diff(spark):
    one = T.StructType().add("a", T.IntegerType())
    assert migrate.diff(spark, {"t": one}, {"t": one}).count() == 0
    assert migrate.annotate(one, a={"index": "range"})["a"].metadata == {"index": "range"}


@pytest.mark.parametrize("by_row", [False, True])
def test_live_query(spark, tmp_path, by_row):
    schema = T._parse_datatype_string("key string, v long, op string, seq long")
    events = [[("a", 1, "put", 1), ("b", 9, "put", 2)], [("a", 8, "put", 3), ("b", 9, "delete", 4), ("c", 1, "put", 5)], [("a", 7, "put", 6), ("c", 1, "delete", 7)]]
    for batch in events:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        seen = {}
        q = live.LiveQuery(spark, "key", schema, lambda df: df.where("v > 5"), lambda new, moved, n: seen.update({n: (sorted(map(tuple, new.collect())), {r.key: r.transition for r in moved.collect()})}), str(tmp_path / "states"), buckets=4, by_row=by_row)
        q.start(live.changes(spark, str(tmp_path / "log"), schema), str(tmp_path / "checkpoint")).awaitTermination(60)
        batch.append(seen)
    assert list(events[0][-1].values()) == [([("b", 9)], {"b": "enter"})]
    assert list(events[1][-1].values()) == [([("a", 8)], {"a": "enter", "b": "leave"})]
    assert list(events[2][-1].values()) == [([("a", 7)], {"a": "update"})]
    named = {(r["bucket"], r["version"]) for b in (1, 2) for r in spark.read.parquet(str(tmp_path / f"states/manifests/{b}")).collect()}
    kept = {(int(p.name[8:]), int(p.parent.name[6:])) for p in (tmp_path / "states").glob("state-*/_bucket=*")}
    assert kept == named


def test_watch_key_and_table(spark):
    df = spark.createDataFrame([("a", True, False), ("b", False, True), ("c", True, True), ("d", False, False)], "key string, was boolean, now boolean")
    got = {r.key: r.t for r in df.select("key", live.transition_of(F.col("was"), F.col("now")).alias("t")).collect()}
    assert got == {"a": "leave", "b": "enter", "c": "update", "d": None}
    assert ids(live.watch_key(df, "key", "b"), "key") == ["b"]


def test_queries_are_values(nulls):
    q = nulls.query()
    q.where("n", gt=1).order_by("s").limit(1)
    assert q == Query(nulls)
    with pytest.raises(TypeError):
        q.where("n", near=1)
