"""Registered queries over the driver's tables and the SQL each must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import casts, text
from lodestone.operators import changelog, joins, layout, migrate, model, mvcc
from lodestone.operators.relations import BelongsTo, HasMany, HasOne, ManyToMany, MorphMany, Pivot, leaf_of, morph_to, resolve
from lodestone.operators.repository import Repository
from lodestone.plans import query as queries
from lodestone.plans.ast import field
from lodestone.plans.query import Query
from lodestone.sources import logfile
from lodestone.sources.dataset import Dataset
from lodestone.sources.tables import read_table, scratch_dir
from lodestone.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey",
    "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id", "pages": "page_id", "benchmark": "item_id",
}


def register(name: str, sql: str | None = None) -> Callable:
    """Register a query of (spark, dir); sql: its oracle."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder in the scratch folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store(spark: SparkSession, sf_dir: str) -> dict[str, Dataset]:
    """The driver's tables as datasets with their relations."""
    d = {name: Dataset.open(spark, sf_dir, name, key) for name, key in KEYS.items()}
    # Line numbers repeat within an order, so even these columns name several rows here and there: they only give an order.
    d["lineitem"] = Dataset.open(spark, sf_dir, "lineitem", ("l_orderkey", "l_linenumber"))
    lines = lambda name, condition: Dataset(name, lambda: read_table(spark, sf_dir, "lineitem").where(condition), d["lineitem"].key)
    d["region"].relate(nations=HasMany(d["nation"], "r_regionkey", foreign_key="n_regionkey"))
    d["nation"].relate(region=BelongsTo(d["region"], "n_regionkey"), customers=HasMany(d["customer"], "n_nationkey", foreign_key="c_nationkey"))
    d["customer"].relate(
        nation=BelongsTo(d["nation"], "c_nationkey"),
        orders=HasMany(d["orders"], "c_custkey", foreign_key="o_custkey"),
        first_order=HasOne(d["orders"], "c_custkey", foreign_key="o_custkey", order_by="o_orderdate"),
    )
    d["orders"].relate(customer=BelongsTo(d["customer"], "o_custkey"), lines=HasMany(d["lineitem"], "o_orderkey", foreign_key="l_orderkey"))
    for name, condition in (("returned", "l_returnflag = 'R'"), ("bulk", "l_quantity > 49")):
        d["orders"].relate(**{name: HasMany(lines(name, condition), "o_orderkey", foreign_key="l_orderkey")})
    d["part"].relate(suppliers=ManyToMany(d["supplier"], "p_partkey", pivot=Pivot(d["lineitem"].all(), "l_partkey", "l_suppkey")))
    comments = Dataset("comments", lambda: comment_rows(spark, sf_dir), "cid")
    d["documents"].relate(label=HasOne(d["labels"], "doc_id", foreign_key="doc_id"), comments=MorphMany(comments, "doc_id", type_field="commentable_type", id_field="commentable_id", morph_name="document"))
    d["comments"] = comments
    return d


def comment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polymorphic comments: labels on documents, benchmark items on items, one on an unknown kind."""
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("cid"), F.lit("document").alias("commentable_type"), F.col("doc_id").alias("commentable_id"), F.col("quality").cast("string").alias("body"))
    items = read_table(spark, sf_dir, "benchmark").select((F.col("item_id") + 100_000_000).alias("cid"), F.lit("item").alias("commentable_type"), F.col("item_id").alias("commentable_id"), F.lit("b").alias("body"))
    other = labels.sparkSession.range(1).select(F.lit(200_000_000).cast("long").alias("cid"), F.lit("video").alias("commentable_type"), F.lit(1).cast("long").alias("commentable_id"), F.lit("v").alias("body"))
    return labels.unionByName(items).unionByName(other)


COMMENTS = """(
  SELECT doc_id AS cid, 'document' AS commentable_type, doc_id AS commentable_id, CAST(quality AS VARCHAR) AS body FROM labels
  UNION ALL SELECT item_id + 100000000, 'item', item_id, 'b' FROM benchmark
  UNION ALL SELECT 200000000, 'video', 1, 'v')"""


def soft_orders(spark: SparkSession, sf_dir: str) -> Dataset:
    """Orders, those in status P soft-deleted on their date."""
    rows = read_table(spark, sf_dir, "orders").withColumn("deleted_at", F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")))
    return Dataset.of(rows, "o_orderkey", "orders")


def nullable_orders(spark: SparkSession, sf_dir: str) -> Dataset:
    """Orders with status P and the customers divisible by seven nulled."""
    rows = read_table(spark, sf_dir, "orders").withColumns({"st": F.expr("nullif(o_orderstatus, 'P')"), "cust": F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey"))})
    return Dataset.of(rows, "o_orderkey", "orders")


NULLABLE = "(SELECT *, nullif(o_orderstatus, 'P') AS st, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS cust FROM orders)"


def filtered(name: str, table: str, node: Callable, where: str, columns: str) -> None:
    """A filter query over one table and its SQL condition."""
    names = [c.strip() for c in columns.split(",")]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return store(spark, sf_dir)[table].query().where(node).to_df().select(*names)

    register(name, f"SELECT {columns} FROM {table} WHERE {where}")(run)


# --- predicates ----------------------------------------------------------------------------------------------------

ORDER = "o_orderkey, o_orderstatus, o_totalprice"
filtered("filter_eq", "orders", lambda x: x.o_orderstatus == "F", "o_orderstatus = 'F'", ORDER)
filtered("filter_neq", "orders", lambda x: x.o_orderstatus != "F", "o_orderstatus IS DISTINCT FROM 'F'", ORDER)
filtered("filter_gt", "orders", lambda x: x.o_totalprice > 200000, "o_totalprice > 200000", ORDER)
filtered("filter_lt", "orders", lambda x: x.o_totalprice < 50000, "o_totalprice < 50000", ORDER)
filtered("filter_gte", "orders", lambda x: x.o_orderkey >= 700, "o_orderkey >= 700", ORDER)
filtered("filter_lte", "orders", lambda x: x.o_orderkey <= 700, "o_orderkey <= 700", ORDER)
filtered("filter_contains", "part", lambda x: x.p_name.contains("red"), "contains(p_name, 'red')", "p_partkey, p_name")
filtered("filter_starts_with", "part", lambda x: x.p_name.starts_with("blue"), "starts_with(p_name, 'blue')", "p_partkey, p_name")
filtered("filter_ends_with", "part", lambda x: x.p_name.ends_with("widget"), "suffix(p_name, 'widget')", "p_partkey, p_name")
filtered("filter_in", "orders", lambda x: x.o_orderpriority.is_in(["1-URGENT", "5-LOW"]), "o_orderpriority IN ('1-URGENT', '5-LOW')", "o_orderkey, o_orderpriority")
filtered("filter_in_empty", "orders", lambda x: x.o_orderpriority.is_in([]), "FALSE", "o_orderkey, o_orderpriority")
filtered("filter_between", "lineitem", lambda x: x.l_quantity.between(10, 12), "l_quantity BETWEEN 10 AND 12", "l_orderkey, l_linenumber, l_quantity")
filtered("between_open_low", "lineitem", lambda x: x.l_quantity.between(None, 3), "l_quantity <= 3", "l_orderkey, l_linenumber, l_quantity")
filtered("between_open_high", "lineitem", lambda x: x.l_quantity.between(48), "l_quantity >= 48", "l_orderkey, l_linenumber, l_quantity")
filtered("filter_and", "orders", lambda x: (x.o_orderstatus == "F") & (x.o_totalprice > 100000), "o_orderstatus = 'F' AND o_totalprice > 100000", ORDER)
filtered("filter_or", "orders", lambda x: (x.o_orderstatus == "P") | (x.o_totalprice > 400000), "o_orderstatus = 'P' OR o_totalprice > 400000", ORDER)
filtered("filter_nested_bool", "orders", lambda x: ~((x.o_orderstatus == "F") & (x.o_totalprice > 100000)) & ((x.o_orderpriority == "5-LOW") | ~(x.o_orderkey > 50)), "NOT (o_orderstatus = 'F' AND o_totalprice > 100000) AND (o_orderpriority = '5-LOW' OR NOT o_orderkey > 50)", ORDER)
filtered("coerce_string_vs_number", "part", lambda x: x.p_brand > 9, "p_brand > '9'", "p_partkey, p_brand")
filtered("coerce_string_eq_number", "part", lambda x: x.p_brand == 9, "FALSE", "p_partkey, p_brand")
filtered("coerce_number_vs_string", "part", lambda x: x.p_size > "5", "CAST(p_size AS VARCHAR) > '5'", "p_partkey, p_size")
filtered("coerce_ts_vs_string", "events", lambda x: x.ts.between("2024-01-05", "2024-01-06T00:00:00"), "ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'", "event_id, ts")


@register("filter_in_with_null", f"SELECT o_orderkey, st FROM {NULLABLE} WHERE st = 'F' OR st IS NULL")
def filter_in_with_null(spark, sf_dir):
    return nullable_orders(spark, sf_dir).query().where_in("st", ["F", None]).to_df().select("o_orderkey", "st")


@register("filter_is_null", f"SELECT o_orderkey FROM {NULLABLE} WHERE st IS NULL")
def filter_is_null(spark, sf_dir):
    return nullable_orders(spark, sf_dir).query().where_null("st").to_df().select("o_orderkey")


@register("filter_is_not_null", f"SELECT o_orderkey FROM {NULLABLE} WHERE st IS NOT NULL")
def filter_is_not_null(spark, sf_dir):
    return nullable_orders(spark, sf_dir).query().where("st", is_null=False).to_df().select("o_orderkey")


@register("filter_not", f"SELECT o_orderkey, st FROM {NULLABLE} WHERE NOT coalesce(st = 'F', FALSE)")
def filter_not(spark, sf_dir):
    return nullable_orders(spark, sf_dir).query().where(~(field("st") == "F")).to_df().select("o_orderkey", "st")


@register("filter_neq_null", f"SELECT o_orderkey, st FROM {NULLABLE} WHERE st IS DISTINCT FROM 'F'")
def filter_neq_null(spark, sf_dir):
    return nullable_orders(spark, sf_dir).query().where(lambda x: x.st != "F").to_df().select("o_orderkey", "st")


@register("filter_keywords", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 90000 AND starts_with(o_orderpriority, '2')")
def filter_keywords(spark, sf_dir):
    return store(spark, sf_dir)["orders"].query().where("o_totalprice", gte=1000, lt=90000).where("o_orderpriority", starts_with="2").to_df().select("o_orderkey")


@register("or_where", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderkey <= 20")
def or_where(spark, sf_dir):
    return store(spark, sf_dir)["orders"].query().where("o_orderstatus", "P").or_where(lambda x: x.o_orderkey <= 20).to_df().select("o_orderkey")


@register("scope", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000")
def scope(spark, sf_dir):
    big = lambda q: q.where(lambda x: x.o_totalprice > 300000)
    return store(spark, sf_dir)["orders"].query().where("o_orderstatus", "F").scope(big).to_df().select("o_orderkey")


@register("scan_predicate", "SELECT o_orderkey FROM orders WHERE o_totalprice > o_orderkey * 10")
def scan_predicate(spark, sf_dir):
    return store(spark, sf_dir)["orders"].scan(lambda df: df.o_totalprice > df.o_orderkey * 10).select("o_orderkey")


# --- order, pages, counts ------------------------------------------------------------------------------------------


def sorted_rows(q: Query) -> DataFrame:
    return q.to_df().select("o_orderkey", "o_totalprice")


@register("minimum_slice", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000 ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 20")
def minimum_slice(spark, sf_dir):
    return sorted_rows(store(spark, sf_dir)["orders"].query().where(lambda x: (x.o_orderpriority == "1-URGENT") & (x.o_totalprice > 100000)).order_by_desc("o_orderdate").limit(20))


@register("sort_asc", f"SELECT o_orderkey, cust, row_number() OVER (ORDER BY cust ASC NULLS LAST, o_orderkey) AS pos FROM {NULLABLE}")
def sort_asc(spark, sf_dir):
    return nullable_orders(spark, sf_dir).query().order_by("cust").numbered().select("o_orderkey", "cust", "pos")


@register("sort_desc_nulls", f"SELECT o_orderkey, cust, row_number() OVER (ORDER BY cust DESC NULLS FIRST, o_orderkey) AS pos FROM {NULLABLE}")
def sort_desc_nulls(spark, sf_dir):
    return nullable_orders(spark, sf_dir).query().order_by_desc("cust").numbered().select("o_orderkey", "cust", "pos")


@register("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(spark, sf_dir):
    return sorted_rows(store(spark, sf_dir)["orders"].query().order_by_desc("o_totalprice").limit(10))


@register("page_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25 OFFSET 50")
def page_offset(spark, sf_dir):
    return sorted_rows(store(spark, sf_dir)["orders"].query().order_by("o_totalprice").offset(50).limit(25))


@register("first_row", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def first_row(spark, sf_dir):
    return store(spark, sf_dir)["orders"].query().where("o_orderstatus", "O").order_by_desc("o_totalprice").first().select("o_orderkey", "o_totalprice")


@register("count_rows", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def count_rows(spark, sf_dir):
    return store(spark, sf_dir)["orders"].query().where("o_orderstatus", "F").count()


@register("count_limited", "SELECT count(*) AS n FROM (SELECT 1 FROM orders WHERE o_orderstatus = 'F' LIMIT 17)")
def count_limited(spark, sf_dir):
    return store(spark, sf_dir)["orders"].query().where("o_orderstatus", "F").limit(17).count()


@register("paginate_total", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total, CAST(ceil((SELECT count(*) FROM orders WHERE o_orderstatus = 'F') / 15.0) AS BIGINT) AS last_page FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 15 OFFSET 30")
def paginate_total(spark, sf_dir):
    page = store(spark, sf_dir)["orders"].query().where("o_orderstatus", "F").order_by("o_totalprice").paginate(3, 15)
    return page.data.select("o_orderkey", "o_totalprice", F.lit(page.total).cast("long").alias("total"), F.lit(page.last_page).cast("long").alias("last_page"))


# --- lookups -------------------------------------------------------------------------------------------------------


@register("get_by_key", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def get_by_key(spark, sf_dir):
    return store(spark, sf_dir)["customer"].get("42").select("c_custkey", "c_name")


@register("get_many", "SELECT pos, c_custkey FROM (VALUES (0, 7), (1, 3), (2, 7), (3, -1), (4, 11)) v(pos, k) JOIN customer ON c_custkey = k ORDER BY pos")
def get_many(spark, sf_dir):
    return store(spark, sf_dir)["customer"].get_many([7, 3, 7, -1, 11]).select("pos", "c_custkey")


@register("key_listing", "SELECT c_custkey FROM customer")
def key_listing(spark, sf_dir):
    return store(spark, sf_dir)["customer"].keys()


@register("contains_key", "SELECT count(*) > 0 AS found FROM customer WHERE c_custkey = 42")
def contains_key(spark, sf_dir):
    return store(spark, sf_dir)["customer"].contains(42)


@register("dataset_count", "SELECT count(*) AS n FROM lineitem")
def dataset_count(spark, sf_dir):
    return store(spark, sf_dir)["lineitem"].count()


# --- soft deletes --------------------------------------------------------------------------------------------------

SOFT = "(SELECT *, CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS deleted_at FROM orders)"


@register("soft_default", f"SELECT o_orderkey FROM {SOFT} WHERE deleted_at IS NULL")
def soft_default(spark, sf_dir):
    return soft_orders(spark, sf_dir).query().to_df().select("o_orderkey")


@register("soft_with_trashed", f"SELECT o_orderkey, deleted_at FROM {SOFT}")
def soft_with_trashed(spark, sf_dir):
    return soft_orders(spark, sf_dir).query().with_trashed().to_df().select("o_orderkey", "deleted_at")


@register("soft_only_trashed", f"SELECT o_orderkey, deleted_at FROM {SOFT} WHERE deleted_at IS NOT NULL")
def soft_only_trashed(spark, sf_dir):
    return soft_orders(spark, sf_dir).query().only_trashed().with_trashed().to_df().select("o_orderkey", "deleted_at")


@register("soft_delete_restore", f"SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN TIMESTAMP '2024-06-01' ELSE deleted_at END AS deleted_at FROM {SOFT}")
def soft_delete_restore(spark, sf_dir):
    rows = soft_orders(spark, sf_dir).all()
    rows = changelog.soft_delete(rows, F.col("o_orderstatus") == "F", F.lit("2024-06-01").cast("timestamp_ntz"))
    return changelog.restore(rows, F.col("o_orderkey") % 2 == 0).select("o_orderkey", "deleted_at")


# --- relations -----------------------------------------------------------------------------------------------------


@register("has_many", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey")
def has_many(spark, sf_dir):
    d = store(spark, sf_dir)["customer"]
    return d.relations["orders"].joined(d.all()).select("c_custkey", "o_orderkey")


@register("has_one_first", "SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS LAST, o_orderkey) AS r FROM orders) ON o_custkey = c_custkey AND r = 1")
def has_one_first(spark, sf_dir):
    d = store(spark, sf_dir)["customer"]
    return d.relations["first_order"].joined(d.all()).select("c_custkey", "o_orderkey")


@register("belongs_to", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def belongs_to(spark, sf_dir):
    d = store(spark, sf_dir)["orders"]
    return d.relations["customer"].joined(d.all(), "left").select("o_orderkey", "c_name")


@register("many_to_many", "SELECT p_partkey, s_suppkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_name = 'red widget'")
def many_to_many(spark, sf_dir):
    d = store(spark, sf_dir)["part"]
    return d.relations["suppliers"].joined(d.query().where("p_name", "red widget").to_df()).select("p_partkey", "s_suppkey")


@register("pivot_attach_detach", "SELECT l_partkey AS left, l_suppkey AS right FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem UNION SELECT p_partkey, 0 FROM part WHERE p_size = 1) WHERE l_suppkey % 2 = 0")
def pivot_attach_detach(spark, sf_dir):
    pivot = Pivot(read_table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")
    added = read_table(spark, sf_dir, "part").where("p_size = 1").select("p_partkey", F.lit(0).cast("long").alias("z"))
    return pivot.attach(added).detach(pivot.df.where("right % 2 = 1")).df


@register("morph_many", f"SELECT d.doc_id, c.cid, c.body FROM documents d JOIN {COMMENTS} c ON c.commentable_type = 'document' AND c.commentable_id = d.doc_id")
def morph_many(spark, sf_dir):
    d = store(spark, sf_dir)["documents"]
    docs = d.all().select("doc_id")
    return d.relations["comments"].joined(docs).select("doc_id", "cid", "body")


@register("morph_to", f"SELECT c.cid, c.commentable_type, coalesce(d.n_chars, length(b.text)) AS size FROM {COMMENTS} c LEFT JOIN documents d ON c.commentable_type = 'document' AND c.commentable_id = d.doc_id LEFT JOIN benchmark b ON c.commentable_type = 'item' AND c.commentable_id = b.item_id")
def morph_to_query(spark, sf_dir):
    d = store(spark, sf_dir)
    size = lambda kind, t: [(t["n_chars"] if kind == "document" else F.length(t["text"]).cast("long")).alias("size")]
    return morph_to(d["comments"].all(), "commentable_type", "commentable_id", {"document": d["documents"], "item": d["benchmark"]}, size).select("cid", "commentable_type", "size")


@register("where_has", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def where_has(spark, sf_dir):
    return store(spark, sf_dir)["customer"].query().where_has("orders").to_df().select("c_custkey")


@register("where_has_callback", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 100000)")
def where_has_callback(spark, sf_dir):
    return store(spark, sf_dir)["customer"].query().where_has("orders", lambda q: q.where(lambda x: (x.o_orderstatus == "P") & (x.o_totalprice > 100000))).to_df().select("c_custkey")


@register("where_has_nested", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_quantity > 49)")
def where_has_nested(spark, sf_dir):
    return store(spark, sf_dir)["customer"].query().where_has("orders.lines", lambda q: q.where(lambda x: x.l_quantity > 49)).to_df().select("c_custkey")


@register("where_has_deep", "SELECT r_regionkey FROM region WHERE EXISTS (SELECT 1 FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE n_regionkey = r_regionkey AND o_orderpriority = '1-URGENT')")
def where_has_deep(spark, sf_dir):
    return store(spark, sf_dir)["region"].query().where_has("nations.customers.orders", lambda q: q.where("o_orderpriority", "1-URGENT")).to_df().select("r_regionkey")


@register("where_has_multi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def where_has_multi(spark, sf_dir):
    q = store(spark, sf_dir)["customer"].query().where_has("orders", lambda q: q.where("o_orderstatus", "P")).where_has("orders", lambda q: q.where("o_totalprice", gt=400000))
    return q.to_df().select("c_custkey")


@register("where_has_any", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def where_has_any(spark, sf_dir):
    return store(spark, sf_dir)["orders"].query().where_has_any("returned", "bulk").to_df().select("o_orderkey")


@register("where_doesnt_have", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def where_doesnt_have(spark, sf_dir):
    return store(spark, sf_dir)["orders"].query().where_doesnt_have("lines").to_df().select("o_orderkey")


@register("nested_leaf", "SELECT DISTINCT o_orderkey FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def nested_leaf(spark, sf_dir):
    return leaf_of(store(spark, sf_dir)["nation"], "customers.orders", lambda q: q.where("o_orderstatus", "P")).select("o_orderkey")


@register("nested_leaf_lines", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey")
def nested_leaf_lines(spark, sf_dir):
    return leaf_of(store(spark, sf_dir)["customer"], "orders.lines").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@register("lazy_related", "SELECT o_orderkey, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0")
def lazy_related(spark, sf_dir):
    d = store(spark, sf_dir)["customer"]
    return d.relations["orders"].of(d.query().where("c_acctbal", lt=0).to_df()).select("o_orderkey", "o_totalprice")


@register("lazy_related_many", "SELECT DISTINCT s_suppkey, s_name FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey WHERE p_size = 7")
def lazy_related_many(spark, sf_dir):
    d = store(spark, sf_dir)["part"]
    return d.relations["suppliers"].of(d.query().where("p_size", 7).to_df()).select("s_suppkey", "s_name")


@register("relation_path", "SELECT * FROM (VALUES (0, 'HasMany', 'nation'), (1, 'HasMany', 'customer'), (2, 'BelongsTo', 'nation')) t(step, kind, name)")
def relation_path(spark, sf_dir):
    steps = resolve(store(spark, sf_dir)["region"], "nations.customers.nation")
    return spark.createDataFrame([(i, type(r).__name__, r.related.name) for i, r in enumerate(steps)], "step int, kind string, name string")


@register("with_count", "SELECT o_orderkey, count(l_orderkey) AS lines_count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def with_count(spark, sf_dir):
    return store(spark, sf_dir)["orders"].query().with_count("lines").to_df().select("o_orderkey", "lines_count")


@register("with_count_sorted", "SELECT c_custkey, count(o_orderkey) AS orders_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey ORDER BY orders_count DESC, c_custkey LIMIT 30")
def with_count_sorted(spark, sf_dir):
    return store(spark, sf_dir)["customer"].query().with_count("orders").order_by_desc("orders_count").limit(30).to_df().select("c_custkey", "orders_count")


@register("with_count_paged", "SELECT c_custkey, count(o_orderkey) AS orders_count FROM (SELECT * FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 10) LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def with_count_paged(spark, sf_dir):
    return store(spark, sf_dir)["customer"].query().with_count("orders").order_by("c_acctbal").offset(10).limit(20).to_df().select("c_custkey", "orders_count")


@register("flagship", "SELECT c_custkey, c_name, count(o_orderkey) AS orders_count FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL ORDER BY orders_count DESC, c_custkey LIMIT 20")
def flagship(spark, sf_dir):
    q = store(spark, sf_dir)["customer"].query().where_has("orders", lambda q: q.where("o_orderstatus", "F")).with_count("orders")
    return q.order_by_desc("orders_count").limit(20).to_df().select("c_custkey", "c_name", "orders_count")


@register("eager_load_flat", "SELECT n_nationkey, c_custkey FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey")
def eager_load_flat(spark, sf_dir):
    nested = store(spark, sf_dir)["nation"].query().with_relation("customers", "c_custkey").to_df()
    return nested.select("n_nationkey", F.explode_outer("customers").alias("c")).select("n_nationkey", "c.c_custkey")


@register("eager_load_joined", "SELECT n_nationkey, c_custkey, c_name FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey")
def eager_load_joined(spark, sf_dir):
    return store(spark, sf_dir)["nation"].query().joined("customers", "c_custkey", "c_name").select("n_nationkey", "c_custkey", "c_name")


@register("eager_load_nested", "SELECT r_regionkey, count(DISTINCT n_nationkey) AS nations, count(c_custkey) AS customers FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_regionkey")
def eager_load_nested(spark, sf_dir):
    nested = store(spark, sf_dir)["region"].query().with_relation("nations.customers", "c_custkey").to_df()
    inner = F.aggregate("nations", F.lit(0).cast("long"), lambda a, n: a + F.size(n["customers"]))
    return nested.select("r_regionkey", F.size("nations").cast("long").alias("nations"), inner.alias("customers"))


@register("eager_load_one", "SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def eager_load_one(spark, sf_dir):
    return store(spark, sf_dir)["documents"].query().with_relation("label").to_df().select("doc_id", F.col("label.toxic").alias("toxic"))


# --- joins ---------------------------------------------------------------------------------------------------------


def null_keyed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation = read_table(spark, sf_dir, "nation").withColumn("nk", F.expr("nullif(n_regionkey, 0)"))
    return nation, read_table(spark, sf_dir, "region").withColumn("rk", F.expr("nullif(r_regionkey, 0)"))


NULL_KEYED = "(SELECT *, nullif(n_regionkey, 0) AS nk FROM nation) n {} (SELECT *, nullif(r_regionkey, 0) AS rk FROM region) r"


@register("hash_join_null_safe", "SELECT n_nationkey, r_name FROM " + NULL_KEYED.format("JOIN") + " ON nk IS NOT DISTINCT FROM rk")
def hash_join_null_safe(spark, sf_dir):
    return joins.hash_join(*null_keyed(spark, sf_dir), "nk", "rk").select("left.n_nationkey", "right.r_name")


@register("semi_join_hash", "SELECT n_nationkey FROM " + NULL_KEYED.format("SEMI JOIN") + " ON nk = rk")
def semi_join_hash(spark, sf_dir):
    return joins.semi_join(*null_keyed(spark, sf_dir), "nk", "rk").select("n_nationkey")


@register("semi_join_nested_loop", "SELECT n_nationkey FROM " + NULL_KEYED.format("SEMI JOIN") + " ON nk IS NOT DISTINCT FROM rk")
def semi_join_nested_loop(spark, sf_dir):
    return joins.semi_join(*null_keyed(spark, sf_dir), "nk", "rk", nulls_match=True).select("n_nationkey")


# --- text ----------------------------------------------------------------------------------------------------------

WINDOW = "list_min(list_transform(range(1, greatest(length(p_name) - {n} + 1, 1) + 1), lambda i: levenshtein('{q}', substring(p_name, i, {n}))))"


@register("fuzzy_window", f"SELECT p_partkey, p_name FROM part WHERE 1 - least({WINDOW.format(n=6, q='wigdet')}, 6) / 6.0 >= 0.6")
def fuzzy_window(spark, sf_dir):
    return store(spark, sf_dir)["part"].query().where(lambda x: x.p_name.fuzzy("wigdet", 0.6)).to_df().select("p_partkey", "p_name")


@register("fuzzy_prefilter", f"SELECT p_partkey FROM part WHERE 1 - least({WINDOW.format(n=6, q='widgit')}, 6) / 6.0 >= 0.4 AND (contains(p_name, 'wid') OR contains(p_name, 'idg') OR contains(p_name, 'dgi') OR contains(p_name, 'git'))")
def fuzzy_prefilter(spark, sf_dir):
    return store(spark, sf_dir)["part"].query().where(field("p_name").fuzzy("widgit", prefilter=True)).to_df().select("p_partkey")


@register("fuzzy_similarity_ranked", "SELECT CAST(p_partkey AS BIGINT) AS key, p_name AS text, round(1 - levenshtein(lower(p_name), 'red wigdet') / greatest(length(p_name), 10)::DOUBLE, 6) AS score FROM part WHERE 1 - levenshtein(lower(p_name), 'red wigdet') / greatest(length(p_name), 10)::DOUBLE >= 0.5 AND len(list_filter(['red', 'ed ', 'd w', ' wi', 'wig', 'igd', 'gde', 'det'], lambda g: contains(lower(p_name), g))) > 0")
def fuzzy_similarity_ranked(spark, sf_dir):
    found = text.search(read_table(spark, sf_dir, "part"), "p_partkey", "p_name", "red wigdet", 0.5)
    return found.select("key", "text", F.round("score", 6).alias("score"))


@register("trigram_candidates", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'bol') OR contains(lower(p_name), 'olt')")
def trigram_candidates(spark, sf_dir):
    return read_table(spark, sf_dir, "part").where(text.shares_trigram(F.col("p_name"), "Bolt")).select("p_partkey")


@register("trigram_hits", "SELECT p_partkey, len(list_filter(['wid', 'idg', 'dge', 'get', 'et ', 't b', ' bo', 'bol', 'olt'], lambda g: contains(lower(p_name), g))) AS hits FROM part")
def trigram_hits(spark, sf_dir):
    return read_table(spark, sf_dir, "part").select("p_partkey", text.trigram_hits(F.col("p_name"), "Widget Bolt").cast("long").alias("hits"))


@register("normalize_text", "SELECT p_partkey, trim(regexp_replace(lower(p_name || '  X ' || p_brand), '\\s+', ' ', 'g')) AS t FROM part")
def normalize_text(spark, sf_dir):
    return read_table(spark, sf_dir, "part").select("p_partkey", text.normalize(F.concat("p_name", F.lit("  X "), "p_brand")).alias("t"))


#: The normaliser over an expression: letters, the elongation sign, marks, blanks.
NORMALIZED = r"trim(regexp_replace(regexp_replace(translate(lower({x}), 'يكؤإأۀـ', 'یکوااه'), '[\x{{064B}}-\x{{065F}}]', '', 'g'), '[\t\n\x0b\f\r \x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{feff}}]+', ' ', 'g'))"


@register("normalize_letters", f"SELECT CAST(c AS INTEGER) AS code, {NORMALIZED.format(x="' A' || chr(CAST(c AS INTEGER)) || '  b' || chr(CAST(c AS INTEGER)) || ' '")} AS t FROM (SELECT * FROM range(1536, 1792) UNION ALL SELECT * FROM range(8192, 8208) UNION ALL SELECT * FROM (VALUES (160), (12288), (65279))) r(c)")
def normalize_letters(spark, sf_dir):
    """Every letter, mark and sign of the Arabic block, and blanks of all kinds."""
    codes = [*range(1536, 1792), *range(8192, 8208), 160, 12288, 65279]
    rows = spark.createDataFrame([(c, f" A{chr(c)}  b{chr(c)} ") for c in codes], "code int, t string")
    return rows.select("code", text.normalize(F.col("t")).alias("t"))


@register("normalize_documents", f"SELECT doc_id, {NORMALIZED.format(x='text')} AS t FROM documents")
def normalize_documents(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("t"))


@register("studly_case", "SELECT event_id, upper(event_type[1]) || event_type[2:] || 'Row' AS t FROM events")
def studly_case(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", text.studly(F.concat("event_type", F.lit("_row"))).alias("t"))


# --- casts and models ----------------------------------------------------------------------------------------------

MIXED = "CASE p_size % 6 WHEN 0 THEN '3' WHEN 1 THEN '3.5' WHEN 2 THEN 'x' WHEN 3 THEN NULL WHEN 4 THEN 'true' ELSE '2024-01-02 03:04:05' END"


def mixed(spark: SparkSession, sf_dir: str, kind: str, lenient: bool = False) -> DataFrame:
    rows = read_table(spark, sf_dir, "part").select("p_partkey", F.expr(MIXED).alias("v"))
    return rows.select("p_partkey", casts.cast(F.col("v"), kind, T.StringType(), lenient).alias("v"))


@register("cast_int", f"SELECT p_partkey, CASE WHEN regexp_full_match({MIXED}, '[+-]?[0-9]+') THEN CAST({MIXED} AS BIGINT) END AS v FROM part")
def cast_int(spark, sf_dir):
    return mixed(spark, sf_dir, "int")


@register("cast_double", f"SELECT p_partkey, TRY_CAST({MIXED} AS DOUBLE) AS v FROM part")
def cast_double(spark, sf_dir):
    return mixed(spark, sf_dir, "double")


@register("cast_bool", f"SELECT p_partkey, coalesce({MIXED} = 'true', FALSE) AS v FROM part")
def cast_bool(spark, sf_dir):
    return mixed(spark, sf_dir, "bool")


@register("cast_string", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS v FROM orders")
def cast_string(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select("o_orderkey", casts.cast(F.col("o_custkey"), "string", T.LongType()).alias("v"))


@register("cast_datetime", f"SELECT p_partkey, TRY_CAST(CASE WHEN p_size % 6 = 5 THEN {MIXED} END AS TIMESTAMP) AS v FROM part")
def cast_datetime(spark, sf_dir):
    rows = read_table(spark, sf_dir, "part").select("p_partkey", F.expr(f"CASE WHEN p_size % 6 IN (2, 4, 5) THEN {MIXED} END").alias("v"))
    return rows.select("p_partkey", casts.cast(F.col("v"), "datetime", T.StringType(), lenient=True).alias("v"))


@register("cast_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def cast_json(spark, sf_dir):
    rows = read_table(spark, sf_dir, "events").select("event_id", casts.cast(F.col("props"), "json", T.StringType()).alias("v"))
    return rows.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"))


CUSTOMER = model.Model(
    key="c_custkey", fillable=("c_name", "c_mktsegment"), hidden=("c_acctbal", "c_nationkey"),
    accessors={"c_mktsegment": F.initcap}, mutators={"c_name": lambda c: F.lower(F.trim(c))},
    appends={"label": lambda df: F.concat_ws(" / ", df["c_name"], df["c_mktsegment"])},
)


@register("project_hidden", "SELECT c_custkey, c_name, c_mktsegment[1] || lower(c_mktsegment[2:]) AS c_mktsegment, c_name || ' / ' || c_mktsegment[1] || lower(c_mktsegment[2:]) AS label FROM customer")
def project_hidden(spark, sf_dir):
    return CUSTOMER.output(read_table(spark, sf_dir, "customer"))


@register("project_visible", "SELECT c_custkey, c_acctbal FROM customer")
def project_visible(spark, sf_dir):
    return model.Model(key="c_custkey", visible=("c_acctbal",)).output(read_table(spark, sf_dir, "customer"))


@register("mass_assignment", "SELECT c_custkey, lower(trim(c_name)) AS c_name, c_mktsegment FROM customer")
def mass_assignment(spark, sf_dir):
    return CUSTOMER.fill(read_table(spark, sf_dir, "customer"))


@register("model_json", "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region")
def model_json(spark, sf_dir):
    return model.Model(key="r_regionkey").to_json(read_table(spark, sf_dir, "region"))


@register("resource_shape", "SELECT c_custkey AS id, upper(c_name) AS title FROM customer")
def resource_shape(spark, sf_dir):
    return model.resource(read_table(spark, sf_dir, "customer"), id=F.col("c_custkey"), title=F.upper("c_name"))


@register("dirty_diff", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'o_orderstatus,o_totalprice' WHEN o_orderstatus = 'P' THEN 'o_orderstatus' ELSE 'o_totalprice' END AS changed FROM orders WHERE o_orderstatus = 'P' OR o_orderkey % 3 = 0")
def dirty_diff(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    now = orders.withColumns({"o_orderstatus": F.expr("nullif(o_orderstatus, 'P')"), "o_totalprice": F.expr("if(o_orderkey % 3 = 0, o_totalprice + 1, o_totalprice)")})
    return model.dirty(orders, now, "o_orderkey").select("o_orderkey", F.array_join("changed", ",").alias("changed"))


# --- layout --------------------------------------------------------------------------------------------------------


@register("unique_violations", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    return layout.violations(read_table(spark, sf_dir, "part"), "p_name")


@register("compound_equal", "SELECT o_orderkey FROM orders WHERE o_custkey = 100 AND o_orderstatus = 'F'")
def compound_equal(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").where(layout.compound_equal({"o_custkey": 100, "o_orderstatus": "F"})).select("o_orderkey")


@register("compound_range", "SELECT o_orderkey FROM orders WHERE (o_custkey > 100 OR (o_custkey = 100 AND o_orderkey >= 50)) AND (o_custkey < 105 OR (o_custkey = 105 AND o_orderkey <= 9))")
def compound_range(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").where(layout.compound_range({"o_custkey": 100, "o_orderkey": 50}, {"o_custkey": 105, "o_orderkey": 9})).select("o_orderkey")


@register("ordered_values", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > 1500 ORDER BY p_retailprice, p_partkey")
def ordered_values(spark, sf_dir):
    return store(spark, sf_dir)["part"].query().where("p_retailprice", gt=1500).order_by("p_retailprice").to_df().select("p_partkey", "p_retailprice")


# --- change log, versions, streams ---------------------------------------------------------------------------------


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: key user_id, seq event_id, a delete where the type is 'error'."""
    return read_table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), "event_id", "value")


LAST = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)"


@register("latest_by_key", f"SELECT user_id, event_id, value FROM {LAST} WHERE r = 1 AND event_type <> 'error'")
def latest_by_key(spark, sf_dir):
    return changelog.latest(event_log(spark, sf_dir), "user_id")


@register("tombstone_hide", f"SELECT user_id FROM {LAST} WHERE r = 1 AND event_type = 'error'")
def tombstone_hide(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return log.select("user_id").distinct().join(changelog.latest(log, "user_id").select("user_id"), "user_id", "left_anti")


@register("batch_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer UNION ALL SELECT c_custkey + 1000000000, 'added' FROM customer WHERE c_custkey <= 3")
def batch_upsert(spark, sf_dir):
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    rows = customer.where("c_custkey % 5 = 0").withColumn("c_name", F.lit("new")).unionByName(customer.where("c_custkey <= 3").select((F.col("c_custkey") + 1_000_000_000).alias("c_custkey"), F.lit("added").alias("c_name")))
    return changelog.upsert(customer, rows, "c_custkey")


@register("batch_delete", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def batch_delete(spark, sf_dir):
    gone = read_table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return changelog.delete(read_table(spark, sf_dir, "orders"), gone, "o_orderkey").select("o_orderkey")


@register("compact_live_size", f"SELECT (SELECT CAST(sum(length(props)) AS BIGINT) FROM events) AS log_bytes, CAST(sum(length(props)) AS BIGINT) AS live_bytes FROM {LAST} WHERE r = 1 AND event_type <> 'error'")
def compact_live_size(spark, sf_dir):
    log = read_table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), "props")
    return changelog.sizes(log, "user_id", F.length("props"))


VERSIONS = "(SELECT event_id AS seq, 1 + event_id % 9 AS tx, user_id AS key, value, event_type = 'error' AS deleted, event_id % 4 <> 0 AS committed FROM events)"


@register("mvcc_visible", f"SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM {VERSIONS} WHERE tx = 5 OR (committed AND tx <= 5)) WHERE r = 1 AND NOT deleted")
def mvcc_visible(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    versions = events.select(F.col("event_id").alias("seq"), (1 + F.col("event_id") % 9).alias("tx"), F.col("user_id").alias("key"), "value", (F.col("event_type") == "error").alias("deleted"), (F.col("event_id") % 4 != 0).alias("committed"))
    return mvcc.read_at(versions, 5)


@register("mvcc_commit_rollback", f"SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM {VERSIONS} WHERE (committed OR tx = 3) AND tx <= 8) WHERE r = 1 AND NOT deleted")
def mvcc_commit_rollback(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    versions = events.select(F.col("event_id").alias("seq"), (1 + F.col("event_id") % 9).alias("tx"), F.col("user_id").alias("key"), "value", (F.col("event_type") == "error").alias("deleted"), (F.col("event_id") % 4 != 0).alias("committed"))
    return mvcc.read_at(mvcc.rollback(mvcc.commit(versions, 3), 8), 8)


@register("watch_transitions", "WITH a AS (SELECT DISTINCT user_id FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) r FROM events WHERE 2 * event_id < (SELECT max(event_id) FROM events)) WHERE r = 1 AND value > 50), b AS (SELECT DISTINCT user_id FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) r FROM events) WHERE r = 1 AND value > 50) SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'enter' WHEN b.user_id IS NULL THEN 'leave' ELSE 'update' END AS transition FROM a FULL JOIN b ON a.user_id = b.user_id")
def watch_transitions(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.lit("put").alias("op"), "value")
    plan = lambda log: changelog.latest(log, "user_id").where("value > 50")
    (last,) = events.agg(F.max("seq")).first()
    return live.transitions(plan(events.where(2 * F.col("seq") < last)), plan(events), "user_id")


@register("schema_diff", "SELECT * FROM (VALUES ('changed_type', 'a', 'y', 'bigint'), ('new_column', 'a', 'z', 'string'), ('removed_column', 'a', 'x', 'int'), ('new_table', 'b', NULL, NULL), ('dropped_table', 'c', NULL, NULL)) t(kind, \"table\", \"column\", \"type\")")
def schema_diff(spark, sf_dir):
    of = lambda s: T._parse_datatype_string(s)
    return migrate.diff(spark, {"a": of("x int, y int"), "c": of("q int")}, {"a": of("y bigint, z string"), "b": of("q int")})


@register("live_query", f"SELECT user_id, value FROM {LAST} WHERE r = 1 AND event_type <> 'error' AND value > 50")
def live_query(spark, sf_dir):
    """The events as a stream: the last published result of a live query over the latest row per user."""
    events = read_table(spark, sf_dir, "events")
    folder = fresh(spark, "live")
    stream = live.changes(spark, sf_dir, events.schema, glob="events.parquet")
    log = stream.select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), "value")
    query = live.LiveQuery(spark, "user_id", log.schema, lambda df: df.where("value > 50"), lambda new, moved, n: new.write.mode("overwrite").parquet(f"{folder}/result"), f"{folder}/state", by_row=True)
    query.start(log, f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/result")


@register("watch_key_stream", "SELECT event_id, value FROM events WHERE user_id = 7")
def watch_key_stream(spark, sf_dir):
    """The changes of one key, from a stream."""
    folder = fresh(spark, "watch")
    stream = live.changes(spark, sf_dir, read_table(spark, sf_dir, "events").schema, glob="events.parquet")
    seen = live.watch_key(stream, "user_id", 7).select("event_id", "value")
    seen.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(seen.schema).parquet(f"{folder}/out")


# --- writing -------------------------------------------------------------------------------------------------------


@register("batch_upsert_repeats", f"SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events) UNION ALL SELECT user_id, 'event ' || event_id FROM {LAST} WHERE r = 1")
def batch_upsert_repeats(spark, sf_dir):
    """A batch with many rows a key: the last one counts."""
    rows = read_table(spark, sf_dir, "events").orderBy("event_id").select(F.col("user_id").alias("c_custkey"), F.concat(F.lit("event "), "event_id").alias("c_name"))
    return changelog.upsert(read_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), rows, "c_custkey")


def written_log(spark: SparkSession, sf_dir: str) -> changelog.ChangeLog:
    """Events in two batches by user, the users divisible by five deleted in between."""
    log = changelog.ChangeLog(spark, fresh(spark, "log"), "user_id")
    events = read_table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    (last,) = events.agg(F.max("event_id")).first()
    log.put(events.where(2 * F.col("event_id") < last), pos="event_id")
    log.delete(events.where("user_id % 5 = 0"))
    log.append(events.where((2 * F.col("event_id") >= last) & (F.col("user_id") % 10 != 0)).orderBy("event_id"))
    return log


STATE = "(SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE user_id % 10 <> 0 AND (user_id % 5 <> 0 OR 2 * event_id >= (SELECT max(event_id) FROM events)))"


@register("log_state", f"SELECT user_id, event_id, value FROM {STATE} WHERE r = 1")
def log_state(spark, sf_dir):
    return written_log(spark, sf_dir).state().select("user_id", "event_id", "value")


@register("compact_state", f"SELECT user_id, event_id, value, 'put' AS op FROM {STATE} WHERE r = 1")
def compact_state(spark, sf_dir):
    """What a compacted log holds: the live records alone."""
    log = written_log(spark, sf_dir)
    log.compact()
    return log.read().select("user_id", "event_id", "value", "op")


@register("log_snapshot", f"SELECT user_id, event_id, value FROM {STATE} WHERE r = 1")
def log_snapshot(spark, sf_dir):
    written_log(spark, sf_dir).snapshot(path := fresh(spark, "snapshot"))
    return spark.read.parquet(path)


@register("compact_policy", "SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, a * 30 >= 100 AND (b = 0 OR (a * 30 - b * 30) / (a * 30.0) > 0.3) AS due FROM range(9) x(a), range(9) y(b) WHERE b <= a")
def compact_policy(spark, sf_dir):
    """When a log of so many times 30 MB with so many times 30 MB of live records is compacted."""
    mb = 30 << 20
    return spark.createDataFrame([(a, b, changelog.should_compact(a * mb, b * mb)) for a in range(9) for b in range(a + 1)], "a int, b int, due boolean")


@register("dataset_write", "SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN upper(n_name) ELSE n_name END AS n_name FROM nation WHERE n_nationkey % 3 <> 0 AND n_nationkey NOT IN (7, 8)")
def dataset_write(spark, sf_dir):
    data = Dataset.stored(spark, fresh(spark, "nations"), "n_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    data.save(nation)
    data.save(nation.where("n_nationkey % 4 = 0").withColumn("n_name", F.upper("n_name")))
    data.delete(nation.where("n_nationkey % 3 = 0"))
    data.destroy(7, "8", 999)
    return data.query().to_df().select("n_nationkey", "n_name")


@register("cached_query", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey <> 2 UNION ALL SELECT 99, 'added'")
def cached_query(spark, sf_dir):
    """A kept result, and what it is after a write."""
    data = Dataset.stored(spark, fresh(spark, "nations"), "n_nationkey", "nations")
    data.save(read_table(spark, sf_dir, "nation"))
    wanted = data.query().where("n_regionkey", 1)
    if wanted.cached().count() != data.query().where(lambda x: x.n_regionkey == 1).cached().count() or len(data.cache) != 1:
        raise AssertionError("one plan, one result")
    data.save(spark.createDataFrame([(99, "added", 1)], "n_nationkey int, n_name string, n_regionkey int"))
    data.destroy(2)
    return wanted.cached().select("n_nationkey", "n_name")


PERSON = model.Model(key="c_custkey", fillable=("c_name", "c_mktsegment"), mutators={"c_name": F.trim}, indexed=("c_mktsegment",), unique=("c_name",), fuzzy_indexed=("c_name",))


def people(spark: SparkSession, sf_dir: str, events: model.Events | None = None) -> Repository:
    """Customers created, some saved under another segment, some destroyed."""
    repo = Repository(spark, fresh(spark, "people"), PERSON, events)
    customer = read_table(spark, sf_dir, "customer")
    repo.create(customer)
    repo.save(customer.where("c_custkey % 6 = 0").select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name", F.lit("MOVED").alias("c_mktsegment")))
    repo.delete(customer.where("c_custkey % 6 = 1").select(F.col("c_custkey").cast("string").alias("c_custkey")))
    repo.destroy(2, 3)
    return repo


LEFT = "(SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, trim(c_name) AS c_name, CASE WHEN c_custkey % 6 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 6 <> 1 AND c_custkey NOT IN (2, 3))"


@register("model_save_delete", f"SELECT * FROM {LEFT}")
def model_save_delete(spark, sf_dir):
    return people(spark, sf_dir).data.all().select("c_custkey", "c_name", "c_mktsegment")


@register("model_find", f"SELECT c_custkey, c_name, c_mktsegment FROM {LEFT} WHERE c_custkey = '12'")
def model_find(spark, sf_dir):
    return people(spark, sf_dir).find(12).select("c_custkey", "c_name", "c_mktsegment")


@register("model_events", "SELECT * FROM (VALUES ('saving', 2), ('creating', 1), ('created', 1), ('updating', 1), ('updated', 1), ('saved', 2), ('deleting', 2), ('deleted', 2)) t(name, n)")
def model_events(spark, sf_dir):
    """How often each event fired."""
    events, seen = model.Events(), {}
    for name in ("saving", "saved", "creating", "created", "updating", "updated", "deleting", "deleted"):
        events.on(name, lambda rows, name=name: seen.update({name: seen.get(name, 0) + 1}))
    people(spark, sf_dir, events)
    return spark.createDataFrame(list(seen.items()), "name string, n int")


@register("model_indexes", f"SELECT c_custkey, 'segment' AS kind FROM {LEFT} WHERE c_mktsegment = 'MOVED' UNION ALL SELECT c_custkey, 'name' FROM {LEFT} WHERE c_name = (SELECT max(c_name) FROM {LEFT} WHERE c_custkey < '5')")
def model_indexes(spark, sf_dir):
    """Lookups by the indexes that a model declares."""
    repo = people(spark, sf_dir)
    indexes = repo.build_indexes()
    (name,) = repo.data.all().where("c_custkey < '5'").agg(F.max("c_name")).first()
    return indexes.equal(c_mktsegment="MOVED").withColumn("kind", F.lit("segment")).unionByName(indexes.equal(c_name=name).withColumn("kind", F.lit("name")))


@register("generated_ids", "SELECT count(*) AS n, count(*) AS ids, count(*) AS again FROM customer")
def generated_ids(spark, sf_dir):
    """Generated keys differ, and are the same when the plan runs again."""
    made = [model.Model(fillable=("c_mktsegment",)).create(read_table(spark, sf_dir, "customer")) for _ in range(2)]
    same = made[0].select("id").join(made[1].select("id"), "id", "left_semi").agg(F.count(F.lit(1)).alias("again"))
    n, ids = made[0].agg(F.count(F.lit(1)), F.count_distinct("id")).first()
    return same.select(F.lit(n).cast("long").alias("n"), F.lit(ids).cast("long").alias("ids"), "again")


@register("hydrate_dirty", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_name <> upper(c_name) THEN 'c_acctbal,c_name' WHEN c_custkey % 2 = 0 THEN 'c_acctbal' ELSE 'c_name' END AS changed FROM customer WHERE c_custkey % 2 = 0 OR c_name <> upper(c_name)")
def hydrate_dirty(spark, sf_dir):
    """Changes since the records were read; nothing is dirty after a sync."""
    rows = model.Tracked.hydrate(read_table(spark, sf_dir, "customer"), "c_custkey")
    changed = rows.set(c_name=F.upper("c_name"), c_acctbal=F.expr("if(c_custkey % 2 = 0, c_acctbal + 1, c_acctbal)"))
    found = changed.dirty().unionByName(rows.dirty()).unionByName(changed.sync().dirty())
    return found.select("c_custkey", F.array_join("changed", ",").alias("changed"))


# --- binary logs, versions, indexes, notes -------------------------------------------------------------------------


def box_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the events of a box: two thirds as many keys as rows, every seventh row a delete."""
    customer = read_table(spark, sf_dir, "customer")
    n = F.col("c_custkey")
    gone = n % 7 == 0
    value = F.struct("c_name", F.col("c_nationkey").alias("nation"), "c_acctbal")
    return customer.select(n.alias("seq"), F.when(gone, "delete").otherwise("put").alias("op"), F.concat(F.lit("k"), F.floor(n * 2 / 3)).alias("key"), F.when(~gone, value).alias("value"))


BOX = "(SELECT 'k' || CAST(floor(c_custkey * 2 / 3) AS BIGINT) AS key, c_custkey, c_name, c_nationkey AS nation, c_acctbal, row_number() OVER (PARTITION BY CAST(floor(c_custkey * 2 / 3) AS BIGINT) ORDER BY c_custkey DESC) AS r FROM customer)"


@register("log_scan", f"SELECT key, c_name, nation, c_acctbal FROM {BOX} WHERE r = 1 AND c_custkey % 7 <> 0")
def log_scan(spark, sf_dir):
    """The live records of a binary log."""
    folder = fresh(spark, "box")
    logfile.write_box(box_events(spark, sf_dir), folder, "customers")
    state = logfile.state_of_log(spark, f"{folder}/customers.db")
    return state.select("key", F.from_json("value", "c_name string, nation int, c_acctbal double").alias("v")).select("key", "v.*")


@register("log_recovery", f"SELECT box, source, key, c_name FROM {BOX}, (VALUES ('a', 'hint'), ('b', 'snapshot'), ('c', 'scan')) t(box, source) WHERE r = 1 AND c_custkey % 7 <> 0")
def log_recovery(spark, sf_dir):
    """Three boxes of a folder, each recovered its own way: by hints, by an index snapshot, by a scan."""
    folder = fresh(spark, "boxes")
    for name, hint, index in (("a", True, True), ("b", False, True), ("c", False, False)):
        logfile.write_box(box_events(spark, sf_dir), folder, name, hint, index)
    return logfile.read_boxes(spark, folder).select("box", "source", "key", F.get_json_object("value", "$.c_name").alias("c_name"))


def versions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    return events.select(F.col("event_id").alias("seq"), (1 + F.col("event_id") % 9).alias("tx"), F.col("user_id").alias("key"), "value", (F.col("event_type") == "error").alias("deleted"), (F.col("event_id") % 4 != 0).alias("committed"))


@register("mvcc_keys", f"SELECT key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM {VERSIONS} WHERE tx = 5 OR (committed AND tx <= 5)) WHERE r = 1 AND NOT deleted")
def mvcc_keys(spark, sf_dir):
    return mvcc.keys(versions_of(spark, sf_dir), 5)


@register("mvcc_write_delete", f"SELECT key, CASE WHEN key % 3 = 0 THEN -1.0 ELSE value END AS value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM {VERSIONS} WHERE committed AND tx <= 20) WHERE r = 1 AND key % 5 <> 0 AND (NOT deleted OR key % 3 = 0)")
def mvcc_write_delete(spark, sf_dir):
    """What a transaction sees of its own writes and deletes."""
    versions = versions_of(spark, sf_dir)
    keys = versions.where("committed").select("key").distinct()
    mine = mvcc.write(versions, keys.where("key % 3 = 0").withColumn("value", F.lit(-1.0)), 20)
    return mvcc.read_at(mvcc.delete(mine, keys.where("key % 5 = 0"), 20), 20)


@register("mvcc_begin", "SELECT CAST(n AS INTEGER) AS n, CAST(n + 1 AS INTEGER) AS tx, n % 2 = 1 AS active FROM range(6) t(n)")
def mvcc_begin(spark, sf_dir):
    hand = mvcc.Transactions()
    ids = [hand.begin() for _ in range(6)]
    for tx in ids[::2]:
        hand.end(tx)
    return spark.createDataFrame([(i, tx, hand.is_active(tx)) for i, tx in enumerate(ids)], "n int, tx int, active boolean")


def order_indexes(spark: SparkSession, sf_dir: str) -> layout.Indexes:
    kinds = [layout.Index("hash", ("o_custkey",)), layout.Index("range", ("o_totalprice",)), layout.Index("compound", ("o_orderstatus", "o_totalprice")), layout.Index("unique", ("o_orderkey",))]
    return layout.Indexes.build(read_table(spark, sf_dir, "orders"), fresh(spark, "indexes"), "o_orderkey", kinds)


@register("index_equal", "SELECT o_orderkey FROM orders WHERE o_custkey = 77 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey = 5")
def index_equal(spark, sf_dir):
    indexes = order_indexes(spark, sf_dir)
    return indexes.equal(o_custkey=77).unionByName(indexes.equal(o_orderkey=5))


@register("index_range", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 110000")
def index_range(spark, sf_dir):
    return order_indexes(spark, sf_dir).between({"o_totalprice": 100_000.0}, {"o_totalprice": 110_000.0})


@register("index_compound", "SELECT o_orderkey FROM orders WHERE o_orderstatus > 'F' AND o_orderstatus < 'O' OR o_orderstatus = 'F' AND o_totalprice >= 400000 OR o_orderstatus = 'O' AND o_totalprice <= 2000")
def index_compound(spark, sf_dir):
    return order_indexes(spark, sf_dir).between({"o_orderstatus": "F", "o_totalprice": 400_000.0}, {"o_orderstatus": "O", "o_totalprice": 2_000.0})


@register("index_fuzzy_hits", "SELECT p_partkey, hits FROM (SELECT p_partkey, len(list_filter(['red', 'ed ', 'd w', ' wi', 'wig', 'igd', 'gde', 'det'], lambda g: contains(lower(p_name), g))) AS hits FROM part) WHERE hits > 0")
def index_fuzzy_hits(spark, sf_dir):
    indexes = layout.Indexes.build(read_table(spark, sf_dir, "part"), fresh(spark, "indexes"), "p_partkey", [layout.Index("fuzzy", ("p_name",))])
    return indexes.fuzzy("p_name", "red wigdet")


@register("natural_order", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 7")
def natural_order(spark, sf_dir):
    return store(spark, sf_dir)["orders"].query().offset(7).limit(20).to_df().select("o_orderkey")


@register("filter_keywords_more", "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 5 AND 9000 AND o_orderpriority IN ('1-URGENT', '5-LOW') AND contains(o_orderstatus, 'F')")
def filter_keywords_more(spark, sf_dir):
    q = store(spark, sf_dir)["orders"].query().where("o_orderkey", between_start=5, between_end=9000).where("o_orderpriority", in_values=["1-URGENT", "5-LOW"])
    return q.where("o_orderstatus", contains="F", is_null=False).to_df().select("o_orderkey")


@register("filter_usage", "SELECT * FROM (VALUES ('o_orderkey', 2), ('o_orderstatus', 2), ('o_totalprice', 1)) t(name, n)")
def filter_usage(spark, sf_dir):
    """How often each field was filtered on, in predicates of every form."""
    before = dict(queries.usage)
    q = store(spark, sf_dir)["orders"].query().where("o_orderkey", gt=5).where(lambda x: (x.o_orderstatus == "F") | ~(x.o_totalprice > 5))
    q.or_where(field("o_orderkey") == 3).where_in("o_orderstatus", ["P"])
    return spark.createDataFrame([(k, n - before.get(k, 0)) for k, n in queries.usage.items() if n > before.get(k, 0)], "name string, n int")


@register("schema_notes", "SELECT * FROM (VALUES ('r_name', 'fuzzy'), ('r_regionkey', 'unique')) t(name, kind)")
def schema_notes(spark, sf_dir):
    """Notes on columns travel with the data."""
    rows = read_table(spark, sf_dir, "region")
    notes = migrate.annotate(rows.schema, r_name={"index": "fuzzy"}, r_regionkey={"index": "unique"})
    noted = rows.select(*[F.col(f.name).alias(f.name, metadata=f.metadata) for f in notes])
    noted.write.parquet(path := fresh(spark, "noted"))
    return spark.createDataFrame([(f.name, f.metadata["index"]) for f in spark.read.parquet(path).schema], "name string, kind string")
