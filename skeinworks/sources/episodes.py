"""Episode files of books: a book's files appear together or not at all.

Tasks write each file into a staged folder under its chapter's name. Books of which every chapter
was produced are then named in one new version of the table of files; of the others nothing is
published, and what was published before stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinworks.functions.text import episode_file_name
from skeinworks.runtime import materialize
from skeinworks.sources import files, tables

#: The published files: by book and chapter, the path below the table's folder, and the length.
FILES = T.StructType().add("book_id", "string").add("idx", "long").add("file", "string").add("length", "long")


def _staged(produced: DataFrame, path: str, folder: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"], strict=True):
                if content is not None:
                    files.write(f"{path.rstrip('/')}/{file}", bytes(content))
            yield batch.assign(length=batch["content"].map(lambda c: None if c is None else len(c)).astype("Int64")).drop(columns="content")

    file = F.concat_ws("/", F.lit(folder), F.sha2(F.col("book_id"), 256), episode_file_name(F.col("idx"), F.col("ext")))
    given = produced.select("book_id", F.col("idx").cast("long").alias("idx"), "error", file.alias("file"), "content")
    return given.mapInPandas(run, "book_id string, idx long, error string, file string, length long")


def publish_episodes(produced: DataFrame, path: str) -> DataFrame:
    """Publish the files of ``produced``; one row (``book_id``, ``published``, ``first_error``, ``error``) a book.

    ``produced``: book_id, idx, ext, content (null: not produced) and error, all chapters of a book. Of a book
    with a failed chapter nothing is published; the lowest chapter's error is told. A book that is
    published again loses the files it had, for readers of the new version. A file that a
    task writes twice, since it was repeated, is the same file.
    """
    spark = produced.sparkSession
    staged = materialize(_staged(produced, path, f"files-{uuid.uuid4().hex}"), "episodes-staged")
    failed = F.col("error").isNotNull() | F.col("length").isNull()
    told = F.coalesce("error", F.lit("not produced"))
    first = F.min(F.when(failed, F.struct(F.col("idx").alias("idx"), told.alias("error"))))
    doubled = F.count(F.lit(1)) > F.count_distinct("idx")
    books = staged.groupBy("book_id").agg(first.alias("first"), doubled.alias("doubled"))
    error = F.when(F.col("first").isNotNull(), F.col("first.error")).when(F.col("doubled"), "a chapter is there twice")
    books = materialize(books.select("book_id", error.isNull().alias("published"), F.col("first.idx").alias("first_error"), error.alias("error")), "episodes-books")
    whole = books.where("published").select("book_id")
    fresh = staged.join(whole, "book_id", "left_semi").select(*FILES.names)

    def change(now: dict[str, DataFrame]) -> dict[str, DataFrame]:
        kept = now[tables.ONLY].join(whole, "book_id", "left_anti").select(*FILES.names)
        return {tables.ONLY: kept.unionByName(fresh)}

    if not whole.isEmpty():
        tables.update(spark, path, {tables.ONLY: FILES}, change)
    return books


def published_files(spark, path: str) -> DataFrame:
    """The files of the newest version, with their full path, in each book's order (``row``)."""
    found = tables.read_or_empty(spark, path, FILES)
    row = F.row_number().over(Window.partitionBy("book_id").orderBy("idx"))
    return found.withColumns({"file": F.concat(F.lit(path.rstrip("/") + "/"), "file"), "row": row})
