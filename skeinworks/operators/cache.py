"""What a cache of produced files may drop: by age, by size, and only what can be made again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.operators.ranges import crowded, running, totals
from skeinworks.runtime import materialize


def is_regenerable(saver: Column, transcoded: Column, is_file: Column) -> Column:
    return saver & ~transcoded & is_file


def expired(files: DataFrame, now: Column, ttl: int | None, keep: Column, mtime: str = "mtime") -> DataFrame:
    """Files older than ``ttl`` seconds, strictly, that are not kept; files of the future never are."""
    if ttl is None:
        return files.limit(0)
    return files.where(~keep & (now - F.col(mtime) > ttl))


def over_cap(files: DataFrame, cap: int | None, keep: Column, *, length: str = "length", order: Sequence[str] = ("mtime", "path"), within: Sequence[str] = ()) -> DataFrame:
    """Files to drop, oldest first, until what is left is at most ``cap``; kept ones are passed over.

    ``within`` gives each group of files a cap of its own; a group may have any number of files. Without it the
    sums are taken in ranges of ``order``, whose totals alone meet in one task.
    """
    if cap is None:
        return files.limit(0)
    drops = F.when(keep, 0).otherwise(F.col(length))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    if within:
        hot = crowded(files, within)
        told = totals(files.withColumns({"_drops": drops, "_keep": keep}), within, {"_total": F.col(length)}, hot)
        told = running(told, within, order, {"_through": F.col("_drops")}, hot)
        before = F.col("_through") - F.coalesce("_drops", F.lit(0))
        return told.where(~F.col("_keep") & (F.col("_total") - before > cap)).select(*files.columns)
    ranged = materialize(files.withColumns({"_drops": drops, "_keep": keep}).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "cache-ranges")
    sums = ranged.groupBy("_range").agg(F.sum("_drops").alias("_in"), F.sum(length).alias("_all"))
    base = sums.select("_range", F.coalesce(F.sum("_in").over(earlier(Window.orderBy("_range"))), F.lit(0)).alias("_base"), F.sum("_all").over(Window.partitionBy()).alias("_total"))
    own = F.coalesce(F.sum("_drops").over(earlier(Window.partitionBy("_range").orderBy(*order))), F.lit(0))
    placed = ranged.withColumn("_own", own).join(base, "_range")
    return placed.where(~F.col("_keep") & (F.col("_total") - F.col("_base") - F.col("_own") > cap)).select(*files.columns)


def eviction_plan(files: DataFrame, owners: DataFrame, now: Column, *, cap: int | None, ttl: int | None, keep: Column, owner: str = "book_dir") -> DataFrame:
    """Files to delete, with the ``reason``: those expired, then of the rest those over the cap.

    Only files of ``owners`` (what can be made again) count; no limits: nothing.
    """
    mine = files.join(owners.select(owner).distinct(), owner, "left_semi")
    old = expired(mine, now, ttl, keep)
    rest = mine if ttl is None else mine.where(keep | ~(now - F.col("mtime") > ttl) | F.col("mtime").isNull())
    return old.withColumn("reason", F.lit("ttl")).unionByName(over_cap(rest, cap, keep).withColumn("reason", F.lit("cap")))
