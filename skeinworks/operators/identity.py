"""Stable identities: reuse of ids by source, and slugs without collisions."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.operators.ranges import crowded, running
from skeinworks.runtime import materialize


def reuse_ids(sources: DataFrame, books: DataFrame, path: str = "source_path") -> DataFrame:
    """``sources`` with the ``id`` that the catalogue has for their path, else null.

    Of several rows with one path the last by title, then id, counts.
    """
    last = F.row_number().over(Window.partitionBy(path).orderBy(F.desc("title"), F.desc("id")))
    known = books.withColumn("_at", last).where("_at = 1").select(path, "id")
    return sources.join(known, path, "left")


#: A slug as the base before it and a number from 2, as generated slugs have it.
NUMBERED = "(?s)\\A(.+)-([1-9][0-9]{0,17})\\z"


def _numbered(slug: Column) -> Column:
    """``base`` and ``num`` of a slug that may have been made from a shorter one, else null."""
    num = F.regexp_extract(slug, NUMBERED, 2)
    return F.when((num != "") & (num != "1"), F.struct(F.regexp_extract(slug, NUMBERED, 1).alias("base"), num.cast("long").alias("num")))


def assign_slugs(candidates: DataFrame, owned: DataFrame | None = None, *, base: str = "base", path: str = "source_path", order: str = "position") -> DataFrame:
    """``candidates`` with ``slug``: the base, or the base with the first free of -2, -3, and so on.

    In ``order``, then by path, a slug is free if no earlier candidate has it and no row of ``owned`` (``slug``
    and the path) has it for another source. Paths are unique.

    A base's numbers that are not to be had are its gaps: those owned, and those that are the name of
    another base (x-2 of x) whose first candidate comes before the one that would reach it. The k-th
    candidate gets the k-th number that is no gap, by running sums over gaps. A candidate that owns a
    number has that one if all free ones below are taken when its turn comes. Which of two bases gets a shared
    slug, and who keeps its own, hangs on the places of earlier candidates only; so it is settled in
    rounds, each of which places all rows at once, until a round changes nothing. Bases without owned or
    shared slugs need no round. Rows of one base may be in any number of tasks.
    """
    keys = candidates.select(F.col(path).alias("path"), F.col(base).alias("base"), F.col(order).alias("at"))
    ranked = materialize(running(keys, ["base"], ["at", "path"], {"rank": F.lit(1)}), "slugs-ranked")
    firsts = ranked.groupBy("base").agg(F.min(F.struct("at", "path")).alias("first"), F.max("rank").alias("n"))
    slots = materialize(_slots(firsts, owned, path), "slugs-slots")
    hard = slots.select("base").distinct()
    slug = lambda n: F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), n.cast("string")))
    named = ranked.join(hard, "base", "left_anti").select("path", slug(F.col("rank")).alias("slug"))
    if not slots.isEmpty():
        placed = _numbers(ranked.join(hard, "base", "left_semi"), slots)
        named = named.unionByName(placed.select("path", slug(F.col("num")).alias("slug")))
    return candidates.join(named.withColumnRenamed("path", path), path)


def _slots(firsts: DataFrame, owned: DataFrame | None, path: str) -> DataFrame:
    """The numbers of bases that are owned (``sole``: by this source alone), and those shared with the base
    ``child``, of which a row is ``side`` parent or child. Numbers that no candidate can reach are left out."""
    if owned is None:
        theirs = firsts.sparkSession.createDataFrame([], "slug string, sole string")
    else:
        least, most = F.min(path), F.max(path)
        theirs = owned.groupBy("slug").agg(F.when(least.eqNullSafe(most), least).alias("sole"))
    none = F.lit(None).cast("string")
    split = firsts.select(F.col("base").alias("child"), "first", _numbered(F.col("base")).alias("of")).where("of IS NOT NULL")
    shared = split.join(theirs.select(F.col("slug").alias("child")), "child", "left_anti")
    shared = shared.select("of.*", none.alias("sole"), "child", F.lit("parent").alias("side"), "first")
    named = theirs.select(F.col("slug").alias("base"), F.lit(1).cast("long").alias("num"), "sole")
    numbered = theirs.select(_numbered(F.col("slug")).alias("of"), "sole").where("of IS NOT NULL").select("of.*", "sole")
    nobody = F.lit(None).cast(firsts.schema["first"].dataType)
    taken = named.unionByName(numbered).select("base", "num", "sole", none.alias("child"), none.alias("side"), nobody.alias("first"))
    # A base's n candidates and its slots together reach no number beyond their sum.
    every = taken.unionByName(shared).join(firsts.select("base", "n"), "base")
    counts = every.groupBy("base").agg(F.count(F.lit(1)).alias("m"))
    near = every.join(counts, "base").where("num <= n + m").drop("n", "m")
    child = near.where("side = 'parent'").select(F.col("child").alias("base"), F.lit(1).cast("long").alias("num"), "sole", "child", F.lit("child").alias("side"), "first")
    return near.unionByName(child).withColumn("owned", F.col("child").isNull())


def _numbers(ranked: DataFrame, slots: DataFrame) -> DataFrame:
    """``base``, ``path`` and ``num`` of candidates of bases that have slots."""
    hot, gapped = crowded(ranked, ["base"]), crowded(slots, ["base"])
    own = slots.where("sole IS NOT NULL").groupBy("base", F.col("sole").alias("path")).agg(F.min("num").alias("mine"))
    rows = ranked.join(own, ["base", "path"], "left").withColumn("keeps", F.col("mine").isNotNull())
    wins = slots.where("side = 'parent'").select("child", F.lit(True).alias("child_wins"))
    while True:
        # Gaps, and of each slot how many free numbers lie below it.
        gap = F.col("owned") | (F.col("child_wins") == (F.col("side") == "parent"))
        counted = running(slots.join(wins, "child", "left").withColumn("gap", gap.cast("int")), ["base"], ["num"], {"gaps": F.col("gap")}, gapped)
        marked = counted.withColumn("free_below", F.col("num") - 1 - (F.col("gaps") - F.col("gap")))
        mine = marked.where("owned").select("base", F.col("num").alias("mine"), F.col("free_below").alias("below_mine"))
        seen = running(rows.drop("below_mine").join(mine, ["base", "mine"], "left"), ["base"], ["rank"], {"kept": F.col("keeps").cast("int")}, hot)
        earlier = F.col("rank") - 1 - (F.col("kept") - F.col("keeps").cast("int"))
        seen = materialize(seen.withColumns({"nth": F.col("rank") - F.col("kept"), "again": F.coalesce(F.col("below_mine") <= earlier, F.lit(False))}), "slugs-seen")
        # Who reaches a shared slug: the first candidate of its name, or the parent's for whom it is the next free number.
        reach = seen.where("NOT keeps").select("base", F.col("nth").alias("turn"), F.struct("at", "path").alias("reached"))
        shared = marked.where("side = 'parent'").select("base", "child", "first", "child_wins", (F.col("free_below") + 1).alias("turn")).join(reach, ["base", "turn"], "left")
        shared = materialize(shared.withColumn("now", F.coalesce(F.col("first") < F.col("reached"), F.lit(True))), "slugs-shared")
        changed = seen.where("again <> keeps").select("base").unionByName(shared.where("now <> child_wins").select("base"))
        if changed.isEmpty():
            break
        rows = seen.drop("kept", "nth", "keeps").withColumnRenamed("again", "keeps")
        wins = shared.select("child", F.col("now").alias("child_wins"))
    kind = lambda n: F.lit(n).alias("kind")
    places = seen.where("NOT keeps").select("base", "path", F.col("nth").alias("place"), kind(0), F.lit(0).cast("long").alias("num"))
    gaps = marked.where("gap = 1").select("base", F.lit(None).cast("string").alias("path"), F.col("free_below").alias("place"), kind(1), "num")
    # The gaps before a candidate are those with fewer free numbers below them than its own place.
    shifted = running(places.unionByName(gaps), ["base"], ["place", "kind", "num"], {"over": F.col("kind")}).where("kind = 0")
    found = shifted.select("base", "path", (F.col("place") + F.col("over")).alias("num"))
    return found.unionByName(seen.where("keeps").select("base", "path", F.col("mine").alias("num")))


def capability_ids(n: int) -> list[str]:
    """Fresh ids of 16 random bytes; made once, on the driver, and then stored."""
    return [secrets.token_urlsafe(16) for _ in range(n)]
