"""The corpus pipeline: documents without toxic ones, without repeated lines, one of each near-duplicate group, mixed to
target weights and packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and hands
the reread table to the next stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import lines, mixing, neardup, packing, toxicity
from lodestone.llm.common import materialize, read


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold, learned from this stage's documents and the labels.

    Null and empty texts are kept: nothing in them is toxic. Texts of any length are scored whole; repeated rows, and rows with
    the same text, stay or go together. Without labels nothing goes. An empty table gives no rows. Extra columns stay, also
    one named toxicity.
    """
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    name = unused(docs, "toxicity")
    kept = (F.col(name) < toxicity.THRESHOLD) | (F.coalesce(F.length("text"), F.lit(0)) == 0)
    return toxicity.score(docs, model, name).where(kept).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that five of them share but in the last one; n_chars follows the text.

    A null text becomes an empty one. Repeated rows count one by one and are treated alike; a null doc_id is smaller than any
    other. An empty table gives no rows. Extra columns stay, also ones named n_lines or n_dropped.
    """
    out = lines.dedup_lines(docs, counts=(unused(docs, "n_lines"), unused(docs, "n_dropped")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id.

    Documents without words (null, empty, blank) and rows without a doc_id are groups of their own and stay. Rows of one
    doc_id are one document: they stay or go together. An empty table gives no rows. Extra columns stay.
    """
    return neardup.first_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it.

    Documents without words have size 0: they are taken as often as their hash says and change no sum. Null sources are one
    source, the last. Rows of one doc_id are taken alike, rows without one by their texts. An empty table gives no rows.
    Extra columns stay.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens; a row per piece.

    A null or empty text is its closing id alone. Repeated rows and rows without a doc_id are packed one by one, texts of any
    length in as many pieces as they need. An empty table gives no rows. Extra columns are not returned.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL cannot express the classifier, the signatures or the tokeniser: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data directory."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
