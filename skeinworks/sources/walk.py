"""The walk of a folder tree, breadth first: each round lists a table of folders in tasks.

A round's frontier are the folders that were reached, or reached by an earlier path, in the round
before. Folders that are new are listed, each once by its real path; links are followed, and what
leads out of the root or nowhere goes. A folder has the first path, by component, that leads to it;
where a later round finds an earlier one it is sent on under that path without being listed again.
The driver sees how many folders a frontier has, and no name.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.functions.text import extension
from skeinworks.runtime import materialize
from skeinworks.sources.listing import AUDIO, MAX_DEPTH, classify, eligible, folder_rules, is_ignored, is_inside, path_order

ENTRY = "folder string, name string, is_dir boolean, real_path string, length long, mtime long"
#: Folders that one task lists, and entries that it hands over at once.
FOLDERS, ROWS = 256, 10_000

#: Entries (name, is_dir, real_path, length, mtime) of a folder that is given by its real path.
Lister = Callable[[str], Iterable[tuple[str, bool, str, int, int]]]


def local_entries(folder: str) -> Iterator[tuple[str, bool, str, int, int]]:
    """Of a mounted file system that all executors share. Links that lead nowhere, what is neither file
    nor folder, and names that are not UTF-8 are passed over; a folder that can't be read has no entries."""
    try:
        found = os.scandir(folder)
    except OSError:
        return
    with found:
        for e in found:
            try:
                e.name.encode()
                about = e.stat()
                real = os.path.realpath(e.path, strict=True) if e.is_symlink() else e.path
                real.encode()
            except (OSError, UnicodeEncodeError):
                continue
            if stat.S_ISDIR(about.st_mode) or stat.S_ISREG(about.st_mode):
                yield e.name, stat.S_ISDIR(about.st_mode), real, about.st_size, max(0, int(about.st_mtime))


def store_entries(folder: str) -> Iterator[tuple[str, bool, str, int, int]]:
    """Of an object store or HDFS, by its URI; it has no links, so each path is real."""
    from pyarrow import fs

    try:
        store, base = fs.FileSystem.from_uri(folder)
        found = store.get_file_info(fs.FileSelector(base))
    except OSError:
        return
    for e in found:
        at = e.mtime.timestamp() if e.mtime else 0
        yield e.base_name, e.type == fs.FileType.Directory, f"{folder.rstrip('/')}/{e.base_name}", e.size or 0, max(0, int(at))


def real_root(root: str) -> str:
    """The root as every path below it starts."""
    path = root.removeprefix("file://")
    return root.rstrip("/") if "://" in path else os.path.realpath(path)


def _listed(folders: DataFrame, n: int, entries: Lister) -> DataFrame:
    """The entries of ``n`` folders (``real``), a row each."""
    tasks = max(folders.sparkSession.sparkContext.defaultParallelism, n // FOLDERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ENTRY.split(", ")]
        for batch in batches:
            held = []
            for folder in batch["real"]:
                for e in entries(folder):
                    held.append((folder, *e))
                    if len(held) == ROWS:
                        yield pd.DataFrame(held, columns=names)
                        held = []
            if held:
                yield pd.DataFrame(held, columns=names)

    return folders.select("real").repartition(min(tasks, max(n, 1)), "real").mapInPandas(run, ENTRY)


def _below(path: Column, name: Column) -> Column:
    return F.when(path == "", name).otherwise(F.concat(path, F.lit("/"), name))


def _before(a: Column, b: Column) -> Column:
    return path_order(a) < path_order(b)


def walk(spark: SparkSession, root: str, data_dir: str | None = None, *, max_depth: int = MAX_DEPTH, stop_at_books: bool = True, entries: Lister | None = None) -> DataFrame:
    """Every file that the walk reaches: ``path`` (below ``root``), ``length``, ``mtime``, ``real_path``, ``real_folder``.

    Folders with an ignored name, deeper than ``max_depth``, outside the root or under ``data_dir``
    are not entered, nor, with ``stop_at_books``, those below a folder that is a book (the root is none). Files keep
    any name, and those that are links out of the root stay here, for they count when a folder
    is classified. A root that can't be read gives no rows. A folder whose first path would be too deep
    for what lies below keeps it; what lies below keeps the path it was found by.
    """
    base = real_root(root)
    entries = entries or (store_entries if "://" in base else local_entries)
    data = None if data_dir is None else real_root(data_dir)
    frontier = spark.createDataFrame([(base, "", False)], "real string, path string, known boolean")
    names = frontier.select("real", "path")
    rounds: list[DataFrame] = []
    folders: list[DataFrame] = []
    fresh, reached = 1, 1
    for depth in range(max_depth + 1):
        if fresh:
            found = materialize(_listed(frontier.where("NOT known"), fresh, entries), "walk-entries")
            rounds.append(found)
            real = F.col("real_path")
            inside = is_inside(real, base) if data is None else is_inside(real, base) & ~is_inside(real, data)
            below = found.where(F.col("is_dir") & ~is_ignored(F.col("name")) & inside).select("folder", "name", "real_path")
            if stop_at_books:
                files = found.where("NOT is_dir").withColumns({"ext": extension(F.col("name")), "inside": is_inside(real, base)})
                books = folder_rules(files.where(F.col("ext").isin(*AUDIO) & (F.col("folder") != base))).select("folder")
                below = below.join(books, "folder", "left_anti")
            folders.append(below)
        if depth == max_depth:
            break
        # Those of earlier rounds are needed only where a folder is sent on again.
        every = folders[-1] if fresh == reached else reduce(DataFrame.unionByName, folders)
        paths = frontier.join(every, frontier["real"] == every["folder"]).select(F.col("real_path").alias("real"), _below(F.col("path"), F.col("name")).alias("path"))
        first = paths.groupBy("real").agg(F.min_by("path", path_order(F.col("path"))).alias("path"))
        old = names.withColumnRenamed("path", "old")
        better = first.join(old, "real", "left").where(F.col("old").isNull() | _before(F.col("path"), F.col("old")))
        frontier = materialize(better.select("real", "path", F.col("old").isNotNull().alias("known")), "walk-frontier")
        reached, fresh = frontier.agg(F.count(F.lit(1)), F.count_if(~F.col("known"))).first()
        if not reached:
            break
        if fresh < reached:
            names = materialize(names.join(frontier.select("real"), "real", "left_anti"), "walk-names")
        names = names.unionByName(frontier.select("real", "path"))
    every = reduce(DataFrame.unionByName, rounds).where("NOT is_dir")
    at = names.withColumnsRenamed({"real": "folder", "path": "_at"})
    return every.join(at, "folder").select(_below(F.col("_at"), F.col("name")).alias("path"), "length", "mtime", "real_path", F.col("folder").alias("real_folder"))


def discover(spark: SparkSession, root: str, data_dir: str | None = None, **settings) -> DataFrame:
    """The books below ``root``: as ``classify``, with ``source_path``, the real path of the file or folder."""
    return books_of(walk(spark, root, data_dir, **settings), root)


def books_of(walked: DataFrame, root: str) -> DataFrame:
    """The books among the files of a walk. A file that is a link out of the root is none."""
    files = eligible(walked).withColumn("inside", is_inside(F.col("real_path"), real_root(root)))
    real = files.select(F.lit("file").alias("kind"), "path", F.col("real_path").alias("source_path"))
    real = real.unionByName(files.select(F.lit("folder").alias("kind"), F.col("folder").alias("path"), F.col("real_folder").alias("source_path")).distinct())
    return classify(files).join(real, ["kind", "path"])
