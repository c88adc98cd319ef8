"""Text functions as Column expressions: normalisation, trigrams, edit-distance scores, name cases."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Arabic letters and the Persian ones that stand for them; marks that are dropped; the elongation sign; blanks.
LETTERS = {"\u064a": "\u06cc", "\u0643": "\u06a9", "\u0624": "\u0648", "\u0625": "\u0627", "\u0623": "\u0627", "\u06c0": "\u0647"}
MARKS = range(0x64B, 0x660)
TATWEEL = "\u0640"
BLANKS = "[\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+"

_FROM, _TO = "".join(LETTERS), "".join(LETTERS.values())
_GONE = TATWEEL + "".join(map(chr, MARKS))


def normalize(c: Column) -> Column:
    """Persian letter forms, no marks or elongation, lower case, single blanks, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.translate(c, _FROM + _GONE, _TO)), BLANKS, " "), F.lit(" \u0085"))


def normalized(text: str) -> str:
    """normalize() of a literal."""
    plain = text.translate(str.maketrans(_FROM, _TO, _GONE)).lower()
    return re.sub(BLANKS, " ", plain).strip(" \u0085")


def trigrams(c: Column) -> Column:
    """Lower-case trigrams; a text of fewer than three characters is its own gram."""
    low = F.lower(c)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3)))


def trigram_hits(c: Column, text: str) -> Column:
    """Number of distinct trigrams that the text and the column have in common."""
    return F.size(F.array_intersect(trigrams(c), trigrams(F.lit(text))))


def shares_trigram(c: Column, text: str) -> Column:
    """Whether the text and the column have a trigram in common."""
    return F.arrays_overlap(trigrams(c), trigrams(F.lit(text)))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def window_score(c: Column, text: str) -> Column:
    """Best match of the normalised query with any window of its length in the normalised column: 1 - distance / length.

    An empty query scores 1 against any text; a shorter text is one window. Null stays null.
    """
    query = normalized(text)
    n = len(query)
    if not n:
        return F.when(c.isNotNull(), F.lit(1.0))
    t = normalize(c)
    starts = F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1)))
    best = F.array_min(F.transform(starts, lambda i: F.levenshtein(F.lit(query), F.substring(t, i, F.lit(n)))))
    return 1 - F.least(best, F.lit(n)) / F.lit(n)


def search(df: DataFrame, key: str, column: str, query: str, threshold: float = 0.3) -> DataFrame:
    """Ranked fuzzy search: key, text, score of the rows that share a trigram with the query, best first, ties by key."""
    c = F.col(column)
    score = similarity(F.lower(c), F.lit(query.lower()))
    found = df.where(shares_trigram(c, query)).select(F.col(key).alias("key"), c.alias("text"), score.alias("score"))
    return found.where(F.col("score") >= threshold).orderBy(F.desc("score"), F.col("key").cast("string"))


def studly(c: Column) -> Column:
    """snake_case to StudlyCase; letters after the first keep their case."""
    return F.array_join(F.transform(F.split(c, "_"), lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, F.lit(2), F.length(x)))), "")
