"""Which short words occur inside which texts, as an equi join.

A text contains a word only where a window of the text starts with the word. Every window's first
`k` characters are joined with the words' first `k` characters, and the rest of the word is compared
inside the window. Nothing is compared pairwise, and the text itself is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def longest(words: DataFrame, word: str) -> int:
    """Length of the longest word: one aggregated row."""
    return words.agg(F.max(F.length(word))).first()[0] or 1


def containment_join(texts: DataFrame, text: str, words: DataFrame, word: str, k: int, reach: int,
                     keep: list[str]) -> DataFrame:
    """Pairs (keep columns of `texts`, all columns of `words`) where `word` occurs in `text`.

    `k`: key length; shorter words are keyed by their whole length. `reach`: length of the longest
    word. A word found at several places of a text gives one row per place.
    """
    window = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{1,{max(reach, k)}}}))"), F.lit(1)))
    windows = texts.select(*keep, window.alias("_window"))
    keys = F.filter(F.array(*[F.substring("_window", 1, n) for n in range(1, k)] + [F.substring("_window", 1, k)]),
                    lambda x: F.length(x) > 0)
    # Words shorter than k need a key of their own length; otherwise one key per window is enough.
    short = words.filter(F.length(word) < k).isEmpty() if k > 1 else True
    if short:
        windows = windows.filter(F.length("_window") >= k).withColumn("_key", F.substring("_window", 1, k))
    else:
        windows = windows.withColumn("_key", F.explode(F.array_distinct(keys)))
    keyed = words.filter(F.length(word) > 0).withColumn("_key", F.substring(F.col(word), 1, k))
    hit = windows.join(keyed, "_key").filter(F.col("_window").startswith(F.col(word)))
    return hit.drop("_key", "_window")


def prefix_join(texts: DataFrame, text: str, words: DataFrame, word: str, k: int) -> DataFrame:
    """Rows of both sides where `text` starts with `word` (at least `k` characters), joined on the first `k`."""
    a = texts.withColumn("_key", F.substring(F.col(text), 1, k))
    b = words.filter(F.length(word) >= k).withColumn("_key", F.substring(F.col(word), 1, k))
    return a.join(b, "_key").filter(F.col(text).startswith(F.col(word))).drop("_key")


def prefixes(c: Column, k: int) -> Column:
    """All prefixes of at least `k` characters."""
    return F.when(F.length(c) >= k, F.transform(
        F.sequence(F.lit(k), F.length(c)), lambda n: F.substring(c, F.lit(1), n))) \
        .otherwise(F.array().cast("array<string>"))
