"""Changes of keyed tables: each takes tables and gives the tables after the change."""

from __future__ import annotations

from functools import reduce

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.runtime import materialize


def last_per_key(df: DataFrame, keys: Sequence[str], arrival: Sequence[Column | str]) -> DataFrame:
    """Of rows with one key the last by ``arrival``."""
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c.desc() for c in arrival]))
    return df.withColumn("_at", latest).where("_at = 1").drop("_at")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], preserve: Sequence[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; ``preserve`` keeps old values where a row was.

    Keys are unique in each table (see ``last_per_key``). One shuffle of either table by key.
    """
    columns = [c for c in old.columns]
    left = old.select(F.struct(*columns).alias("_old"), *[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)])
    right = new.select(F.struct(*columns).alias("_new"), *[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)])
    both = left.join(right, [f"_k{n}" for n in range(len(keys))], "full")

    def value(c: str) -> Column:
        newer, older = F.col("_new")[c], F.col("_old")[c]
        if c in preserve:
            return F.when(F.col("_old").isNotNull(), older).otherwise(newer).alias(c)
        return F.when(F.col("_new").isNotNull(), newer).otherwise(older).alias(c)

    return both.select(*[value(c) for c in columns])


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the parents whose ``key`` is in ``gone``, and without their children.

    Only the ids that are gone are held in memory, those of one partition in each task; neither table is sorted.
    """
    ids = gone.select(key).distinct().hint("shuffle_hash")
    return parents.join(ids, key, "left_anti"), children.join(ids.withColumnRenamed(key, foreign), foreign, "left_anti")


def replace_children(children: DataFrame, fresh: DataFrame, foreign: str) -> DataFrame:
    """``children`` in which those of every parent in ``fresh`` are replaced as a whole; as in ``delete_cascade``, no table is sorted."""
    return children.join(fresh.select(foreign).distinct().hint("shuffle_hash"), foreign, "left_anti").unionByName(fresh)


def orphans(books: DataFrame, sources: DataFrame, path: str = "source_path") -> DataFrame:
    """Rows whose source is no more; none if no source was found at all."""
    if sources.isEmpty():
        return books.limit(0)
    return books.join(sources.select(path).distinct(), path, "left_anti")


def collapse_duplicates(books: DataFrame, sources: DataFrame, path: str = "source_path", order: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """One row per existing source, the first in ``order``; rows whose source is gone are exempt."""
    found = books.join(sources.select(path, F.lit(True).alias("_found")).distinct(), path, "left")
    kept = found.where("_found").withColumn("_at", F.row_number().over(Window.partitionBy(path).orderBy(*order))).where("_at = 1").drop("_at")
    return kept.unionByName(found.where("_found IS NULL")).drop("_found").select(*books.columns)


def rotate(df: DataFrame, key: str, value: object, column: str, fresh: str) -> DataFrame:
    """``column`` set anew for the row with that key; without one nothing changes."""
    return df.withColumn(column, F.when(F.col(key) == F.lit(value), F.lit(fresh)).otherwise(F.col(column)))


def stale_files(listing: DataFrame, current: DataFrame, path: str = "path") -> DataFrame:
    """Listed files that no row of ``current`` names: what a sweep removes."""
    return listing.join(current.select(path).distinct(), path, "left_anti")


def reconcile(
    books: DataFrame, episodes: DataFrame, sources: DataFrame, scanned_books: DataFrame, scanned_episodes: DataFrame, disabled: DataFrame | None = None, failed: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Books, episodes and counts after a scan: duplicates go first, orphans last.

    ``scanned_books`` and ``scanned_episodes`` are the sources that were read anew, with their ids;
    ``disabled`` are ids to take out, with their ``source_path`` where the catalogue may not know it; ``failed`` are
    sources that could not be read. A second call with the same scan changes nothing. Counts: skipped
    (sources found that are disabled or failed), indexed (all others found, up to date ones too), pruned.
    """
    kept = materialize(collapse_duplicates(books, sources), "reconcile-kept")
    gone = books.join(kept, "id", "left_anti").select("id")
    passed = [] if failed is None else [failed.select("source_path")]
    if disabled is not None:
        known = books.select("id", "source_path").unionByName(scanned_books.select("id", "source_path"))
        passed.append(disabled.select("source_path") if "source_path" in disabled.columns else known.join(disabled, "id", "left_semi").select("source_path"))
        gone = gone.unionByName(disabled.select("id"))
        kept, scanned_books = kept.join(disabled, "id", "left_anti"), scanned_books.join(disabled, "id", "left_anti")
    merged = materialize(upsert(kept, scanned_books, ["id"], preserve=["feed_id", "created_at"]), "reconcile-merged")
    lost = materialize(orphans(merged, sources).select("id"), "reconcile-lost")
    after = merged.join(lost, "id", "left_anti")
    new_children = replace_children(episodes, scanned_episodes, "book_id")
    _, children = delete_cascade(after, new_children, gone.unionByName(lost), "id", "book_id")
    named = lambda df, name: df.select(F.lit(name).alias("what"))
    events = named(lost, "pruned").unionByName(named(sources, "found"))
    if passed:
        skipped = sources.join(reduce(DataFrame.unionByName, passed), "source_path", "left_semi")
        events = events.unionByName(named(skipped, "skipped"))
    n = lambda what: F.count_if(F.col("what") == what)
    counts = events.agg((n("found") - n("skipped")).alias("indexed"), n("skipped").alias("skipped"), n("pruned").alias("pruned"))
    return after, children, counts
