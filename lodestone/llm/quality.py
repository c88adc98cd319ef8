"""Quality rules as a bitmask ledger, in DataFrame operations only.

Every rule is evaluated once per document: the ledger stores the measurements and one bit per failed rule. Policies are
versioned sets of rules, applied afterwards by a bitwise AND, and ablations count the documents that fail by one rule
alone. All measurements come from the row itself, so the plan has no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import BLANKS
from lodestone.llm.licenses import let

#: Rule name and its failing condition over the measurements; its place is its bit. New rules go to the end.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 5 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 30 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 10 * n_dup_lines > 5 * n_lines"),
    ("capitals", "10 * n_capitals > 5 * word_chars"),
    ("exclamations", "10 * n_exclamations > 5 * n_words"),
)

#: Version to the rules it applies.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(n for n, _ in RULES),
}

WORD = r"[^\x20\x09-\x0D]+"


def mask(policy: str | tuple[str, ...]) -> int:
    """The bits of a policy's rules."""
    names = [n for n, _ in RULES]
    return sum(1 << names.index(n) for n in (POLICIES[policy] if isinstance(policy, str) else policy))


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text, the first included.

    Windows are 64-bit hashes sorted with their places, equal neighbours are repeats; the covered words follow from the
    sorted places, of which each adds at most 3.
    """
    places = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(places, lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def repeated(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(let(F.sort_array(windows), repeated), covered)


def ledger(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, the measurements and fail_bits (bit k: rule k failed).

    docs: doc_id, text; other columns are ignored. Null and empty texts have no words and fail few_words. A line counts
    if it has a word. Repeated rows give repeated rows, an empty table none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    counted = docs.select(
        "doc_id",
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("l"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        _count_of(text, "#*$%&|<>").alias("n_symbols"),
        _count_of(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        _count_of(text, "!").alias("n_exclamations"),
    )
    measured = counted.select(
        "doc_id", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.d").alias("n_dup_lines"),
        F.col("w.r").alias("n_repeat_words"), F.col("l.n").alias("n_lines"), "n_capitals", "n_exclamations",
    )
    bits = [F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, condition) in enumerate(RULES)]
    return measured.withColumn("fail_bits", sum(bits[1:], bits[0]).cast("long"))


def apply_policy(book: DataFrame, policy: str | tuple[str, ...]) -> Column:
    """Whether a ledger row passes all rules of the policy."""
    return book["fail_bits"].bitwiseAND(F.lit(mask(policy))) == 0


def ablations(book: DataFrame, policy: str | tuple[str, ...]) -> DataFrame:
    """Per rule of the policy: rule, n_failed, n_only (documents that fail by it alone: kept without it), from one count
    of the distinct bit patterns (at most 2^rules rows)."""
    names = [n for n, _ in RULES if mask((n,)) & mask(policy)]
    seen = book.groupBy(book["fail_bits"].bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(mask((n,))).alias("bit")) for n in names]))
    each = seen.select("bits", "n", rule.alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )
