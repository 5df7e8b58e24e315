"""Ordered feeds of parents and children, and the checks they pass before release."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.functions.numbers import clock, parse_rfc2822, rfc2822, trimmed, whole
from skeinworks.functions.text import ascii_lower, guid
from skeinworks.operators.metrics import all_distinct
from skeinworks.operators.ranges import crowded, following, last_before, running, totals

#: Seconds between the dates of neighbouring items.
STEP = 60


def renumber(df: DataFrame, parent: Sequence[str], order: Sequence[str | Column], idx: str = "idx", hot: DataFrame | None = None) -> DataFrame:
    """``idx`` from 0 in ``order`` within each parent, which may have any number of rows.

    ``hot`` here and below: the parents of very many rows, where the caller has counted them (``ranges.crowded``).
    """
    return running(df, parent, order, {idx: F.lit(1)}, hot).withColumn(idx, F.col(idx) - 1)


def close_intervals(df: DataFrame, parent: Sequence[str], start: str, total: str, order: Sequence[str] = (), end: str = "end_sec", hot: DataFrame | None = None) -> DataFrame:
    """``end``: the next start within the parent; of the last, ``total`` or its own start if later."""
    followed = following(df, parent, [start, *order], F.col(start), "_next_start", hot)
    return followed.withColumn(end, F.coalesce("_next_start", F.greatest(total, start))).drop("_next_start")


def item_dates(df: DataFrame, parent: Sequence[str], anchor: str, idx: str = "idx", out: str = "pubdate_epoch", hot: DataFrame | None = None) -> DataFrame:
    """The last item at ``anchor``, each earlier one ``STEP`` seconds before the next."""
    n = totals(df, parent, {"_items": F.lit(1)}, hot)
    return n.withColumn(out, F.col(anchor) - (F.col("_items") - 1 - F.col(idx)) * STEP).drop("_items")


def track_order(df: DataFrame, parent: Sequence[str], track: str, name: str, out: str = "idx") -> DataFrame:
    """``out`` from 0: by track where all rows of the parent have one and no two the same, else by name.

    Whether tracks can be used is counted once for each parent, which may have any number of rows.
    """
    usable = all_distinct(df, parent, track, "_usable").withColumnsRenamed({c: f"_of_{c}" for c in parent})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in parent])
    told = df.join(usable, same).drop(*[f"_of_{c}" for c in parent])
    order = [F.when(F.col("_usable"), F.col(track)), F.when(~F.col("_usable"), ascii_lower(F.col(name))), name]
    return running(told, parent, order, {out: F.lit(1)}, crowded(df, parent)).withColumn(out, F.col(out) - 1).drop("_usable")


def feed_items(books: DataFrame, episodes: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """One row per episode with its guid, date and duration in text; books without episodes have a
    row of nulls. Guid and date are made anew from the book's ``source_mtime``."""
    hot = crowded(episodes, ["book_id"]) if hot is None else hot
    rows = books.join(episodes.withColumnRenamed("book_id", "id").drop("guid", "pubdate_epoch", "source_path").withColumnRenamed("title", "episode_title"), "id", "left")
    dated = item_dates(rows, ["id"], "source_mtime", hot=hot)
    texts = _item_texts(F.col("idx"), F.col("pubdate_epoch"), F.col("duration_sec"))
    return dated.withColumns({name: F.when(F.col("idx").isNotNull(), c) for name, c in texts.items()})


def _item_texts(idx: Column, date: Column, seconds: Column) -> dict[str, Column]:
    """What a feed says of an episode, beside the columns ``id`` and ``source_mtime`` of its book."""
    return {
        "guid": guid(F.col("id").cast("string"), idx.cast("string"), F.col("source_mtime").cast("string")),
        "pub_date": rfc2822(date),
        "duration": clock(seconds),
        "episode": (idx + 1).cast("string"),
    }


def nested_feed_items(books: DataFrame, episodes: DataFrame, out: str = "items") -> DataFrame:
    """One row per book with the items of ``feed_items`` as an array in order; an empty array without episodes.

    What the episodes hold is gathered, and the texts, some five times as long, are made of it after the last shuffle.
    """
    fields = [c for c in episodes.columns if c not in ("book_id", "guid", "pubdate_epoch", "source_path", "title")]
    lists = nested(episodes.withColumnsRenamed({"book_id": "id", "title": "episode_title"}), ["id"], "idx", ["episode_title", *fields], out)

    def item(x: Column) -> Column:
        date = F.col("source_mtime") - (F.size(out) - 1 - x["idx"]) * STEP
        kept = [x[c].alias(c) for c in ("episode_title", *fields)]
        return F.struct(*kept, *[c.alias(name) for name, c in _item_texts(x["idx"], date, x["duration_sec"]).items()])

    return books.join(lists, "id", "left").withColumn(out, F.transform(F.coalesce(out, F.array().cast(lists.schema[out].dataType)), item))


def nested(items: DataFrame, parent: Sequence[str], idx: str, fields: Sequence[str], out: str = "items") -> DataFrame:
    """One row per parent with its items as an array in order; an empty array without items."""
    entry = F.when(F.col(idx).isNotNull(), F.struct(idx, *[f for f in fields if f != idx]))
    return items.groupBy(*parent).agg(F.sort_array(F.collect_list(entry)).alias(out))


def item_problems(url: Column, length: Column, has_enclosure: Column, episode: Column, duration: Column, pub_date: Column) -> Column:
    """The names of an item's own problems, in a fixed order."""
    blank = lambda c: F.coalesce(trimmed(c), F.lit("")) == ""
    checks = [
        F.when(~has_enclosure, "missing_enclosure"),
        F.when(has_enclosure & (blank(length) | (trimmed(length) == "0")), "missing_length"),
        F.when(has_enclosure & blank(url), "missing_url"),
        F.when(whole(trimmed(episode)).isNull(), "missing_episode"),
        F.when(blank(duration), "missing_duration"),
        F.when(parse_rfc2822(pub_date).isNull(), "bad_date"),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def feed_problems(feeds: DataFrame, items: DataFrame, feed: str = "feed", hot: DataFrame | None = None) -> DataFrame:
    """Every problem (``feed``, ``pos``, ``episode``, ``problem``) of every feed.

    ``items``: feed, pos, enclosure_url, enclosure_length, episode, duration, pub_date, all but the
    first two text. No URL and no length means no enclosure. A feed without items has that problem
    alone. Dates must grow strictly by episode, then place, among items that have both.
    """
    some = items.select(feed).distinct()
    empty = feeds.select(feed).distinct().join(some, feed, "left_anti")
    nothing = empty.select(feed, F.lit(None).cast("int").alias("pos"), F.lit(None).cast("long").alias("episode"), F.lit("no_items").alias("problem"))
    has = F.col("enclosure_url").isNotNull() | F.col("enclosure_length").isNotNull()
    number = whole(trimmed(F.col("episode")))
    own = item_problems(F.col("enclosure_url"), F.col("enclosure_length"), has, F.col("episode"), F.col("duration"), F.col("pub_date"))
    at = F.when(number.isNotNull(), parse_rfc2822(F.col("pub_date")))
    rows = items.select(feed, F.col("pos").cast("int").alias("pos"), number.alias("episode"), own.alias("own"), at.alias("at"))
    rows = last_before(rows, [feed], ["episode", "pos"], F.col("at"), "before", hot)
    late = F.when(F.col("at") <= F.col("before"), F.array(F.lit("not_later"))).otherwise(F.array().cast("array<string>"))
    return nothing.unionByName(rows.select(feed, "pos", "episode", F.explode(F.concat("own", late)).alias("problem")))


def released(feeds: DataFrame, problems: DataFrame, feed: str = "feed") -> DataFrame:
    """The feeds without a problem; one problem holds back a whole feed."""
    return feeds.join(problems.select(feed).distinct(), feed, "left_anti")


def has_exact_length(actual: Column, recorded: Column) -> Column:
    """Whether a file is as long as was recorded: the guard before it is served."""
    return actual.eqNullSafe(recorded)


def is_in_place(source_path: Column, file_path: Column) -> Column:
    """Whether an episode is a whole source file, served where it lies; without source it is an extracted file."""
    return (F.coalesce(source_path, F.lit("")) != "") & file_path.eqNullSafe(source_path)


def may_serve_in_place(source_path: Column, file_path: Column, actual: Column, recorded: Column) -> Column:
    """In place, and as long as recorded; a source that is not there (``actual`` null) may not."""
    return is_in_place(source_path, file_path) & actual.isNotNull() & has_exact_length(actual, recorded)
