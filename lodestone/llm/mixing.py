"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Each source's target is its weight's share of all tokens, at most `max_epochs` times its own size; what exceeds that goes
to the other sources by weight. A source is taken floor(target / size) times whole, and the rest of the target comes from
the documents whose hash lies under a threshold. The threshold is found without sorting documents: tokens are summed by
source and hash bucket, the bucket in which the running sum crosses the budget is found, and only that bucket's documents
are split by the next digits of the hash, until the crossing bucket of every source holds one hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import materialize

#: Weights of the sources in the order of their names' code points, null last, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source is repeated at most so often.
MAX_EPOCHS = 3
#: Hexadecimal digits of the hash that one histogram level resolves (4096 buckets), and levels at most.
DIGITS, LEVELS = 3, 10
#: Up to so many sources the source table is broadcast (a row has a name and five numbers); beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000


def token_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: source, source_size (a row per source). Adds `target`.

    Shares overflow until none is above its cap: the fixed point is target = min(cap, weight * level), where the level
    spends all tokens. Sources are few, so they are ordered in one window.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.partitionBy(F.lit(0))
    n = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (n + 1).cast("int"))
    cap = F.col("source_size").cast("double") * max_epochs
    # A source is capped once the level passes cap / weight; in that order, the level that spends the rest is known.
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    return (
        sizes.withColumns({"weight": weight, "cap": cap})
        .withColumn("all", F.sum("source_size").over(everything).cast("double"))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", F.max(F.when((F.col("all") - F.col("capped")) / F.col("open") <= F.col("cap") / F.col("weight"), F.struct(-F.col("capped"), ((F.col("all") - F.col("capped")) / F.col("open")).alias("at")))).over(everything)["at"])
        .withColumn("target", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), "cap")))
        .select("source", "source_size", "target")
    )


def _join(df: DataFrame, sources: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """Attach source rows; null sources match. Many sources: both sides are dealt by source, hot ones split by AQE."""
    s = sources.withColumnRenamed("source", "_s")
    return df.join(F.broadcast(s) if few else s, df["source"].eqNullSafe(s["_s"]), how).drop("_s")


def _hash() -> Column:
    """Of the id; rows without one go by their texts, so that many of them are not taken or left together."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.coalesce("text", F.lit("")))).cast("binary"))


def thresholds(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, DataFrame, bool]:
    """(rows, sources, few): rows has doc_id, source, size, hash; sources has a row per source with source_size, target,
    epochs and prefix (a document is taken epochs times, and once more if its hash is less than prefix); few: whether the
    sources may be broadcast."""
    rows = materialize(docs.select("doc_id", "source", token_count(F.col("text")).alias("size"), _hash().alias("hash")), "mix")
    sources = materialize(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs), "mix-sources")
    few = sources.count() <= BROADCAST_SOURCES
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    # left: tokens still to find; prefix: hash digits fixed so far, all hashes before it are in.
    state = sources.withColumn("epochs", whole).withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    state = state.withColumns({"prefix": F.lit(""), "done": F.col("left") <= 0})
    for level in range(LEVELS):
        at = level * DIGITS
        open_rows = _join(rows, state.where("not done").select("source", "prefix"), few).where(F.substring("hash", 1, at) == F.col("prefix"))
        bucket = F.substring("hash", at + 1, DIGITS)
        hist = open_rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        run = W.partitionBy("source").orderBy("bucket")
        hist = _join(hist.withColumn("upto", F.sum("n").over(run)), state.select("source", "left"), few)
        # The first bucket whose running sum exceeds the budget.
        edge = hist.where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min_by(F.struct("bucket", "n", "upto", "lo", "hi"), "bucket").alias("edge"))
        e = F.col("edge")
        before = e["upto"] - e["n"]
        one = e["lo"] == e["hi"]
        nearer = one & (e["upto"] - F.col("left") < F.col("left") - before)
        # No crossing bucket: every open hash is in. "g" lies behind every digit; "~" after a hash lets that hash in.
        state = _join(state, edge, few, "left").select(
            "source", "source_size", "target", "epochs",
            F.when(F.col("done") | e.isNull(), F.col("left")).otherwise(F.col("left") - before).alias("left"),
            F.when(F.col("done"), F.col("prefix")).when(e.isNull(), F.concat("prefix", F.lit("g"))).when(nearer, F.concat(e["lo"], F.lit("~"))).when(one, e["lo"]).otherwise(F.concat("prefix", e["bucket"])).alias("prefix"),
            (F.col("done") | e.isNull() | one).alias("done"),
        )
        state = materialize(state, f"mix-level{level}")
        if not state.where("not done").limit(1).count():
            break
    return rows, state.select("source", "source_size", "target", "epochs", "prefix"), few


def _copies(max_epochs: int) -> Column:
    return F.least(F.col("epochs") + (F.col("hash") < F.col("prefix")).cast("int"), F.lit(max_epochs))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies (times it is taken), taken (copies * size).

    docs: doc_id, text, source; other columns are ignored. Null text: size 0. Null source: a source of its own, last.
    The hash is of doc_id (of the text, if that is null), so rows of one id are taken or left together and reruns agree; the
    last hash goes in if that brings the sum nearer to the target. A source without tokens has target 0. An empty table gives no rows.
    """
    rows, sources, few = thresholds(docs, weights, max_epochs)
    copies = _copies(max_epochs)
    return _join(rows, sources, few).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The rows of docs with their own columns, each as often as the mix takes it; odd rows as in mix()."""
    _, sources, few = thresholds(docs, weights, max_epochs)
    own = docs.select("source", F.struct(*docs.columns).alias("_doc"), _hash().alias("hash"))
    taken = _join(own, sources, few).withColumn("_copies", _copies(max_epochs)).where("_copies > 0")
    return taken.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select("_doc.*")
