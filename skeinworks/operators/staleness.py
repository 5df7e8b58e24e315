"""Which sources need not be read again: one condition over a book and its episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.functions.media import expected_transcode
from skeinworks.runtime import materialize


def every(c: Column) -> Column:
    """True of a group without rows, unlike the aggregate alone."""
    return F.coalesce(F.bool_and(c), F.lit(True))


def episode_state(episodes: DataFrame, files: DataFrame, remux: Column) -> DataFrame:
    """By ``book_id``: number of episodes, and whether starts, serving mode and files are in order.

    ``files`` has the ``file_path`` of every file that exists. Starts and files are given twice: for
    a book whose chapters are kept (full) and one whose are made on demand (saver). The files are written first: if they
    are few the planner sees it, and no episode is moved and sorted by its file.
    """
    there = materialize(files.select("file_path").distinct(), "files-there").withColumn("_there", F.lit(True))
    e = episodes.join(there, "file_path", "left")
    present = F.coalesce(F.col("_there"), F.lit(False))
    remuxed = (F.col("source_path") != "") & (F.col("file_path") != F.col("source_path"))
    return e.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("n_episodes"),
        every((F.col("idx") <= 0) | (F.col("start_sec") > 0)).alias("starts_known"),
        every(~F.col("needs_faststart") | (F.col("source_path") == "") | ((F.col("file_path") != F.col("source_path")) == remux)).alias("faststart_consistent"),
        every(remuxed | present).alias("full_present"),
        every(remuxed | (F.col("source_path") == "") | present).alias("saver_present"),
        every((F.col("source_path") != "") & present).alias("in_place"),
    )


def is_transcode_consistent(path: Column, stored: Column, mode: Column) -> Column:
    expected = expected_transcode(path, mode)
    return expected.isNull() | (F.coalesce(F.nullif(stored, F.lit("")), F.lit("off")) == expected)


def same_metadata(names: tuple[str, ...]) -> Column:
    """Null-safe equality of each column with the one that is wanted, ``want_`` before its name."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).eqNullSafe(F.col(f"want_{n}"))
    return out


def _beside(wanted: DataFrame, books: DataFrame, state: DataFrame) -> DataFrame:
    """Each wanted source with its book and the state of its episodes, at most one row of either; none of them is sorted."""
    known = state.withColumnRenamed("book_id", "id")
    return wanted.join(books.hint("shuffle_hash"), "id", "left").join(known.hint("shuffle_hash"), "id", "left")


def fresh_books(wanted: DataFrame, books: DataFrame, state: DataFrame) -> DataFrame:
    """``id`` and ``fresh`` of every wanted source.

    ``wanted``: id and, with ``want_`` before them, source_mtime, title, author, storage_mode,
    default_cover_url and force_embedded; path, mode (of transcoding) and force.
    """
    saver = F.col("want_storage_mode") == "saver"
    both = _beside(wanted, books, state)
    fresh = (
        ~F.col("force")
        & (F.col("source_mtime") == F.col("want_source_mtime"))
        & same_metadata(("title", "author", "storage_mode", "default_cover_url", "force_embedded"))
        & (F.coalesce("n_episodes", F.lit(0)) > 0)
        & (~saver | F.col("starts_known"))
        & F.col("faststart_consistent")
        & is_transcode_consistent(F.col("path"), F.col("transcode"), F.col("mode"))
        & F.when(saver, F.col("saver_present")).otherwise(F.col("full_present"))
    )
    return both.select("id", F.coalesce(fresh, F.lit(False)).alias("fresh"))


def fresh_folders(wanted: DataFrame, books: DataFrame, state: DataFrame) -> DataFrame:
    """As ``fresh_books``, for folders of tracks: fewer fields count, and all files are in place."""
    both = _beside(wanted, books, state)
    fresh = ~F.col("force") & (F.col("source_mtime") == F.col("want_source_mtime")) & same_metadata(("title", "author", "default_cover_url")) & (F.col("n_episodes") > 0) & F.col("in_place")
    return both.select("id", F.coalesce(fresh, F.lit(False)).alias("fresh"))
