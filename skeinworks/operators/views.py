"""What a reader of the catalogue asks for: cards, details, one episode, chapters with their files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.functions.numbers import is_valid_cut
from skeinworks.operators.metrics import children_per_parent

CARD = ("slug", "feed_id", "title", "author")


def cards(books: DataFrame) -> DataFrame:
    """One card a book; it has a cover if a path is known, whatever the path."""
    return books.select(*CARD, F.col("cover_path").isNotNull().alias("has_cover"))


def details(books: DataFrame, episodes: DataFrame, base_url: str) -> DataFrame:
    """Cards with the addresses of feed and subscription, and the number of episodes, 0 included."""
    counts = children_per_parent(books, episodes, "id", "book_id", "episode_count")
    feed_url = F.concat(F.lit(f"{base_url}/feed/"), "feed_id", F.lit(".xml"))
    subscribe_url = F.concat(F.lit(f"{base_url}/subscribe/"), "feed_id")
    found = books.join(counts, "id")
    return found.select(*CARD, F.col("cover_path").isNotNull().alias("has_cover"), feed_url.alias("feed_url"), subscribe_url.alias("subscribe_url"), "episode_count")


def episodes_by_number(requests: DataFrame, episodes: DataFrame, key: str, number: str = "number") -> DataFrame:
    """The episodes that ``requests`` (``key`` and a number from 1) ask for; numbers below 1 give none."""
    wanted = requests.where(F.col(number) >= 1).withColumn("idx", F.col(number) - 1)
    return wanted.join(episodes, [key, "idx"])


def with_overrides(books: DataFrame, overrides: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``columns`` of ``books`` as the record of ``overrides`` has them, where it has them; one record a key."""
    named = overrides.select(key, *[F.col(c).alias(f"_over_{c}") for c in columns])
    found = books.join(named, key, "left")
    return found.select(*[F.coalesce(f"_over_{c}", c).alias(c) if c in columns else F.col(c) for c in books.columns])


def cut_outcomes(chapters: DataFrame, key: str) -> DataFrame:
    """``key``, ``ok`` (every chapter can be cut) and ``first_error``, the least ``idx`` of those that cannot.

    ``chapters``: ``key``, ``idx``, ``start`` and ``end``; a missing time cannot be cut. One bad chapter fails the whole book.
    """
    bad = ~F.coalesce(is_valid_cut(F.col("start"), F.col("end")), F.lit(False))
    return chapters.groupBy(key).agg(F.every(~bad).alias("ok"), F.min(F.when(bad, F.col("idx"))).alias("first_error"))


def chapters_with_files(chapters: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Chapters of books that can be cut beside the file of the same place; those without one are left."""
    good = cut_outcomes(chapters, key).where("ok").select(key)
    return chapters.join(good, key, "left_semi").join(files, [key, "idx"])
