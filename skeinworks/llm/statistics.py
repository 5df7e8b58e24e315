"""Text statistics in built-in functions: one pass over a document, no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.llm.text import SYMBOLS, count_chars, let, words

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
STOPS = ".,;:?"
BLANKS = " \t\n\x0b\x0c\r"

#: The statistics that learned rules may test; all are ratios or counts of the text alone.
FEATURES = (
    "n_words",
    "mean_word",
    "symbol_ratio",
    "upper_ratio",
    "digit_ratio",
    "stop_ratio",
    "bang_ratio",
    "distinct_ratio",
    "repeat_ratio",
    "dup_line_ratio",
    "words_per_line",
)


def repeated_words(tokens: Column, window: int = 3) -> Column:
    """Words inside windows of ``window`` words that the list has twice or more, the first included.

    Window hashes are sorted with their places. Those with an equal neighbour are repeats; sorted
    again by place, each covers the words up to the next one's start, at most ``window``.
    """
    n = F.size(tokens)
    starts = F.sequence(F.lit(0), n - window)

    def hashed(w: Column) -> Column:
        return F.transform(starts, lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(window)]).alias("h"), i.alias("i")))

    def places(s: Column) -> Column:
        def place(x: Column, k: Column) -> Column:
            same = (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
            return F.when(same, x["i"]).otherwise(F.lit(-1))

        return F.sort_array(F.array_remove(F.transform(s, place), -1))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(window)), F.lit(window)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    found = let(let(F.sort_array(hashed(tokens)), places), covered)
    return F.when(n < window + 1, F.lit(0).cast("long")).otherwise(found)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with counts and the ratios of ``FEATURES``; a null text is empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    rest = [c for c in docs.columns if c != text]
    # Three projections, each using the arrays of the one before, so that none is built twice.
    split = docs.select(
        *rest,
        t.alias("_t"),
        words(t).alias("_w"),
        F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0).alias("_l"),
    )
    counts = split.select(
        *rest,
        F.length("_t").cast("long").alias("n_chars"),
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", BLANKS, "")).cast("long").alias("word_chars"),
        count_chars(F.col("_t"), SYMBOLS).alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_w")).alias("n_repeat_words"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct_words"),
        count_chars(F.col("_t"), UPPER).alias("n_upper"),
        count_chars(F.col("_t"), DIGITS).alias("n_digits"),
        count_chars(F.col("_t"), STOPS).alias("n_stops"),
        count_chars(F.col("_t"), "!").alias("n_bangs"),
    )
    per = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double")
    return counts.withColumns(
        {
            "mean_word": per("word_chars", "n_words"),
            "symbol_ratio": per("n_symbols", "word_chars"),
            "upper_ratio": per("n_upper", "word_chars"),
            "digit_ratio": per("n_digits", "word_chars"),
            "stop_ratio": per("n_stops", "n_words"),
            "bang_ratio": per("n_bangs", "n_words"),
            "distinct_ratio": per("n_distinct_words", "n_words"),
            "repeat_ratio": per("n_repeat_words", "n_words"),
            "dup_line_ratio": per("n_dup_lines", "n_lines"),
            "words_per_line": per("n_words", "n_lines"),
        }
    )
