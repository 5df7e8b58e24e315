"""Queries that apply the catalogue operators to the driver's tables, and the same in SQL.

Orders stand for books, line items for episodes, events for changes and chapters, documents for
sources, parts for cached files and titles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks import schema
from skeinworks.functions import media, numbers, parsers, text
from skeinworks.operators import cache, feed, identity, metrics, mutations, ranges, staleness, views
from skeinworks.runtime import table
from skeinworks.sources import listing
from skeinworks.streaming import changes

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def registered(sql: str | None = None):
    """Register a query by its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
LINE_SQL = ", ".join(LINE_ORDER)


def _books(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", numbers.seconds(F.col("o_orderdate")).alias("anchor"), "o_orderstatus", "o_totalprice")


def _lines(spark, d):
    return table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")


def _items(spark, d) -> tuple[DataFrame, DataFrame]:
    """The items, and the orders of very many lines."""
    lines = _lines(spark, d)
    hot = ranges.crowded(lines, ["o_orderkey"])
    rows = _books(spark, d).join(lines, "o_orderkey")
    return feed.item_dates(feed.renumber(rows, ["o_orderkey"], LINE_ORDER, hot=hot), ["o_orderkey"], "anchor", hot=hot), hot


ITEMS_SQL = f"""
items AS (SELECT o_orderkey, anchor, l_quantity, l_extendedprice, l_partkey, idx, anchor - (n - 1 - idx) * 60 AS pubdate_epoch FROM (
  SELECT o.o_orderkey, epoch(o.o_orderdate)::BIGINT AS anchor, l.*, row_number() OVER (PARTITION BY o_orderkey ORDER BY {LINE_SQL}) - 1 AS idx,
         count(*) OVER (PARTITION BY o_orderkey) AS n FROM orders o JOIN lineitem l ON l_orderkey = o_orderkey))
"""


@registered(f"""WITH {ITEMS_SQL}
SELECT o_orderkey, idx::BIGINT AS idx, pubdate_epoch::BIGINT AS pubdate_epoch,
  printf('%02d:%02d:%02d', (round(l_quantity * 60.5)::BIGINT // 3600)::INT, (round(l_quantity * 60.5)::BIGINT % 3600 // 60)::INT, (round(l_quantity * 60.5)::BIGINT % 60)::INT) AS duration,
  sha256(o_orderkey || ':' || idx || ':' || anchor) AS guid,
  (pubdate_epoch > coalesce(lag(pubdate_epoch) OVER (PARTITION BY o_orderkey ORDER BY idx), -1)) AS later FROM items""")
def ordered_feed(spark, d) -> DataFrame:
    """Items in order, with dates a minute apart, durations, ids, and the check of their order."""
    items, hot = _items(spark, d)
    rows = ranges.last_before(items, ["o_orderkey"], ["idx"], F.col("pubdate_epoch"), "before", hot)
    return rows.select(
        "o_orderkey",
        "idx",
        "pubdate_epoch",
        numbers.clock(F.col("l_quantity") * 60.5).alias("duration"),
        text.guid(*[F.col(c).cast("string") for c in ("o_orderkey", "idx", "anchor")]).alias("guid"),
        (F.col("pubdate_epoch") > F.coalesce("before", F.lit(-1))).alias("later"),
    )


@registered("""
WITH i AS (SELECT l_orderkey AS feed, (row_number() OVER (PARTITION BY l_orderkey ORDER BY %s) - 1)::INT AS pos, l_linenumber::BIGINT AS episode,
  CASE WHEN l_quantity < 3 THEN NULL ELSE 'http://x/' || l_partkey END AS url, CASE WHEN l_quantity < 3 THEN NULL WHEN l_quantity < 6 THEN '0' ELSE l_quantity::BIGINT::VARCHAR END AS len,
  CASE WHEN l_discount = 0 THEN ' ' ELSE '00:01:00' END AS duration, epoch(l_shipdate)::BIGINT AS due FROM lineitem),
e AS (SELECT o_orderkey AS feed, NULL::INT AS pos, NULL::BIGINT AS episode, 'no_items' AS problem FROM orders WHERE o_orderkey NOT IN (SELECT feed FROM i)
  UNION ALL SELECT feed, pos, episode, 'missing_enclosure' FROM i WHERE url IS NULL UNION ALL SELECT feed, pos, episode, 'missing_length' FROM i WHERE len = '0'
  UNION ALL SELECT feed, pos, episode, 'missing_duration' FROM i WHERE trim(duration) = ''
  UNION ALL SELECT feed, pos, episode, 'not_later' FROM (SELECT *, lag(due) OVER (PARTITION BY feed ORDER BY episode, pos) AS b FROM i) WHERE due <= b)
SELECT * FROM e""" % LINE_SQL)
def feed_violations(spark, d) -> DataFrame:
    """Every problem of every feed: one check an item, and the order of the dates."""
    lines = table(spark, d, "lineitem")
    hot = ranges.crowded(lines, ["l_orderkey"])
    i = feed.renumber(lines, ["l_orderkey"], LINE_ORDER, "pos", hot)
    q = F.col("l_quantity")
    items = i.select(
        F.col("l_orderkey").alias("feed"),
        "pos",
        F.col("l_linenumber").cast("string").alias("episode"),
        F.when(q >= 3, F.concat(F.lit("http://x/"), F.col("l_partkey").cast("string"))).alias("enclosure_url"),
        F.when(q < 3, None).when(q < 6, "0").otherwise(q.cast("long").cast("string")).alias("enclosure_length"),
        F.when(F.col("l_discount") == 0, " ").otherwise("00:01:00").alias("duration"),
        numbers.rfc2822(numbers.seconds(F.col("l_shipdate"))).alias("pub_date"),
    )
    return feed.feed_problems(table(spark, d, "orders").select(F.col("o_orderkey").alias("feed")), items, hot=hot)


@registered("""SELECT o_orderkey AS feed FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity < 3)
  AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def released_feeds(spark, d) -> DataFrame:
    """Feeds are released whole or not at all."""
    feeds = table(spark, d, "orders").select(F.col("o_orderkey").alias("feed"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("feed"), "l_quantity")
    empty = feeds.join(lines, "feed", "left_anti")
    return feed.released(feeds, lines.where("l_quantity < 3").select("feed").unionByName(empty))


@registered("""SELECT o_orderkey, strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S +0000') AS pub_date, epoch(date_trunc('second', o_orderdate))::BIGINT AS parsed FROM orders""")
def feed_dates(spark, d) -> DataFrame:
    """Dates in the form of mail headers, and read back."""
    out = _books(spark, d).select("o_orderkey", numbers.rfc2822(F.col("anchor")).alias("pub_date"))
    return out.withColumn("parsed", numbers.parse_rfc2822(F.col("pub_date")))


@registered(f"""WITH {ITEMS_SQL}
SELECT o_orderkey, list(idx || ':' || l_partkey ORDER BY idx) AS items FROM (
  SELECT o.o_orderkey, i.idx, i.l_partkey FROM orders o LEFT JOIN items i ON i.o_orderkey = o.o_orderkey) WHERE idx IS NOT NULL GROUP BY 1
UNION ALL SELECT o_orderkey, [] FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def nested_feeds(spark, d) -> DataFrame:
    """Parents with their items as an ordered array, empty where there are none."""
    rows = _books(spark, d).select("o_orderkey").join(_items(spark, d)[0].select("o_orderkey", "idx", "l_partkey"), "o_orderkey", "left")
    out = feed.nested(rows, ["o_orderkey"], "idx", ["l_partkey"])
    return out.select("o_orderkey", F.transform("items", lambda x: F.concat_ws(":", x["idx"].cast("string"), x["l_partkey"].cast("string"))).alias("items"))


@registered("""SELECT o_orderkey, count(l_orderkey)::BIGINT AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def children_counts(spark, d) -> DataFrame:
    return metrics.children_per_parent(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey")


@registered("""
WITH old AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0),
new AS (SELECT o_orderkey, o_orderstatus || '2' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0)
SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(o.o_totalprice, n.o_totalprice) AS o_totalprice
FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey""")
def keyed_upsert_preserve(spark, d) -> DataFrame:
    """An upsert that keeps one column of the rows that were there; every order is in the old rows, the new ones, or both."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 2 = 0 OR o_orderkey % 3 = 0").withColumns({"o_orderstatus": F.concat("o_orderstatus", F.lit("2")), "o_totalprice": F.col("o_totalprice") + 1})
    return mutations.upsert(o.where("o_orderkey % 3 <> 0"), new, ["o_orderkey"], preserve=["o_totalprice"])


@registered("""
SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 2 DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def keyed_upsert(spark, d) -> DataFrame:
    """Put in batch by batch: the last arrival of a key within its batch, and the later batch, wins."""
    e = table(spark, d, "events").select("user_id", "event_type", "value", "event_id")
    keys = ["user_id", "event_type"]
    first, second = (mutations.last_per_key(e.where(f"event_id % 2 = {k}"), keys, ["event_id"]) for k in (0, 1))
    return mutations.upsert(first, second, keys)


@registered("""SELECT o_orderkey, NULL::BIGINT AS l_linenumber FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT l_orderkey, l_linenumber::BIGINT FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def cascade_delete(spark, d) -> DataFrame:
    """Parents go, and their children with them: the keys that are left in either table."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    left, children = mutations.delete_cascade(o, l, o.where("o_orderstatus = 'F'"), "o_orderkey", "l_orderkey")
    parents = left.select("o_orderkey", F.lit(None).cast("long").alias("l_linenumber"))
    return parents.unionByName(children.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber")))


@registered("""SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 400000)""")
def orphan_prune(spark, d) -> DataFrame:
    """Rows whose source is gone, unless no source was found at all."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("source_path"), "c_name")
    o = table(spark, d, "orders").where("o_orderstatus = 'P' OR o_totalprice > 400000")
    found = mutations.orphans(c, o.select(F.col("o_custkey").alias("source_path")))
    return found.select(F.col("source_path").alias("c_custkey"), "c_name")


@registered("""SELECT doc_id, source, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY n_chars, doc_id) AS k FROM documents) WHERE k = 1 OR text NOT IN (SELECT text FROM documents WHERE doc_id % 5 < 4)""")
def duplicate_collapse(spark, d) -> DataFrame:
    """One row a source, the first by order; sources that are gone are exempt."""
    docs = table(spark, d, "documents")
    out = mutations.collapse_duplicates(docs, docs.where("doc_id % 5 < 4"), path="text", order=("n_chars", "doc_id"))
    return out.select("doc_id", "source", F.md5("text").alias("digest"))


@registered("""SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def unique_violations(spark, d) -> DataFrame:
    """Keys that are not unique."""
    found = schema.violations(table(spark, d, "lineitem"), unique=[["l_orderkey", "l_linenumber"]], required=["l_partkey"], references=(["l_orderkey"], table(spark, d, "orders"), ["o_orderkey"]))
    parts = F.split("value", "\\|")
    return found.select(F.get(parts, 0).cast("long").alias("l_orderkey"), F.get(parts, 1).cast("int").alias("l_linenumber"), "n")


@registered("""WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 50 <> 0 THEN l_partkey END AS l_partkey FROM lineitem)
SELECT 'unique l_orderkey, l_linenumber' AS rule, l_orderkey || '|' || l_linenumber AS value, count(*)::BIGINT AS n FROM l GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'not null l_partkey', NULL, count(*) FROM l WHERE l_partkey IS NULL HAVING count(*) > 0
UNION ALL SELECT 'references l_orderkey', l_orderkey::VARCHAR, count(*) FROM l WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY l_orderkey""")
def broken_constraints(spark, d) -> DataFrame:
    """Doubled keys, missing values and lost parents, all of which are there: parents in progress do not count."""
    part = F.when(F.col("l_partkey") % 50 != 0, F.col("l_partkey"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", part.alias("l_partkey"))
    parents = table(spark, d, "orders").where("o_orderstatus <> 'P'")
    found = schema.violations(rows, unique=[["l_orderkey", "l_linenumber"]], required=["l_partkey"], references=(["l_orderkey"], parents, ["o_orderkey"]))
    return found.withColumnRenamed("constraint", "rule")


@registered("""SELECT o_orderkey, CASE WHEN o_orderkey = 7 THEN 'fresh' ELSE o_orderpriority END AS feed_id FROM orders""")
def rotate_capability(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("feed_id"))
    return mutations.rotate(o, "o_orderkey", 7, "feed_id", "fresh")


FRESH_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + 100 AS l_quantity FROM lineitem WHERE l_linenumber <= 2 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')"""


@registered(f"""{FRESH_SQL} UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM ({FRESH_SQL}))""")
def replaced_children(spark, d) -> DataFrame:
    """The children of parents read anew are replaced as a whole: by fewer, and with other values."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    opened = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    fresh = l.where("l_linenumber <= 2").join(opened.hint("shuffle_hash"), "l_orderkey", "left_semi").withColumn("l_quantity", F.col("l_quantity") + 100)
    return mutations.replace_children(l, fresh, "l_orderkey")


@registered("""SELECT user_id, event_id, ts_sec AS start_sec, coalesce(lead(ts_sec) OVER (PARTITION BY user_id ORDER BY ts_sec, event_id), greatest(1706659200.0::DOUBLE, ts_sec)) AS end_sec,
  greatest(coalesce(lead(ts_sec) OVER (PARTITION BY user_id ORDER BY ts_sec, event_id), greatest(1706659200.0::DOUBLE, ts_sec)) - ts_sec, 0) AS duration_sec
  FROM (SELECT *, epoch(date_trunc('second', ts))::DOUBLE AS ts_sec FROM events)""")
def chapter_intervals(spark, d) -> DataFrame:
    """Each interval up to the next start, the last to the end."""
    e = table(spark, d, "events").select("user_id", "event_id", numbers.seconds(F.col("ts")).cast("double").alias("start_sec"), F.lit(1706659200.0).alias("total"))
    out = feed.close_intervals(e, ["user_id"], "start_sec", "total", ["event_id"])
    return out.select("user_id", "event_id", "start_sec", "end_sec", numbers.chapter_seconds(F.col("start_sec"), F.col("end_sec")).alias("duration_sec"))


@registered("""
WITH u AS (SELECT *, count(*) OVER p = count(l_linenumber) OVER p AND count(DISTINCT l_linenumber) OVER (PARTITION BY l_orderkey) = count(*) OVER p AS usable,
  's' || l_suppkey || '-' || l_partkey || '-' || l_extendedprice AS name FROM lineitem WINDOW p AS (PARTITION BY l_orderkey))
SELECT l_orderkey, name, (row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN usable THEN l_linenumber END NULLS FIRST, CASE WHEN NOT usable THEN name END NULLS FIRST, name) - 1)::BIGINT AS idx FROM u""".replace("'s' || l_suppkey || '-' || l_partkey || '-' || l_extendedprice", "'s' || l_suppkey || '-' || l_partkey || '-' || (l_extendedprice * 100)::BIGINT"))
def track_order_fallback(spark, d) -> DataFrame:
    """By number where all have one and no two the same, else by name."""
    l = table(spark, d, "lineitem")
    name = F.concat(F.lit("s"), F.concat_ws("-", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"), F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")))
    return feed.track_order(l.select("l_orderkey", "l_linenumber", name.alias("name")), ["l_orderkey"], "l_linenumber", "name").select("l_orderkey", "name", "idx")


@registered("""
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS end, count(*)::BIGINT AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, g""")
def debounce_sessions(spark, d) -> DataFrame:
    """Bursts of events: apart by no more than the gap."""
    return changes.bursts(table(spark, d, "events"), "6 hours", ("user_id",))


@registered("""SELECT event_id, kind, path FROM (SELECT event_id, CASE WHEN event_type = 'view' THEN 'access' ELSE event_type END AS kind,
  CASE WHEN user_id % 5 = 0 THEN '/lib/.cache/' || user_id WHEN user_id % 5 = 1 THEN '/lib/data/' || user_id WHEN user_id % 5 = 2 THEN '' ELSE '/lib/a/' || user_id END AS path, user_id FROM events)
  WHERE kind <> 'access' AND user_id % 5 NOT IN (0, 1)""")
def event_filter(spark, d) -> DataFrame:
    """Events that matter: no access, no ignored or own folder; one without paths does."""
    u = F.col("user_id")
    path = F.when(u % 5 == 0, F.concat(F.lit("/lib/.cache/"), u.cast("string"))).when(u % 5 == 1, F.concat(F.lit("/lib/data/"), u.cast("string"))).when(u % 5 == 2, "").otherwise(F.concat(F.lit("/lib/a/"), u.cast("string")))
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "view", "access").otherwise(F.col("event_type")).alias("kind"), path.alias("path"))
    e = e.withColumn("paths", F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.array("path")))
    return changes.relevant_events(e, "/lib", "/lib/data").select("event_id", "kind", "path")


FILES_SQL = """files AS (SELECT l_partkey AS book_dir, l_orderkey || '/' || l_linenumber || '/' || row_number() OVER (PARTITION BY l_orderkey ORDER BY %s) AS path, l_quantity::BIGINT AS length, epoch(l_shipdate)::BIGINT AS mtime FROM lineitem)""" % LINE_SQL


def _files(spark, d):
    l = feed.renumber(table(spark, d, "lineitem"), ["l_orderkey"], LINE_ORDER, "k")
    path = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), (F.col("k") + 1).cast("string"))
    return l.select(F.col("l_partkey").alias("book_dir"), path.alias("path"), F.col("l_quantity").cast("long").alias("length"), numbers.seconds(F.col("l_shipdate")).alias("mtime"))


@registered(f"""WITH {FILES_SQL}, mine AS (SELECT * FROM files WHERE book_dir IN (SELECT p_partkey FROM part WHERE p_size > 10)),
rest AS (SELECT * FROM mine WHERE 946684800 - mtime <= 31536000 OR length = 50),
ranked AS (SELECT *, sum(length) OVER () - coalesce(sum(CASE WHEN length = 50 THEN 0 ELSE length END) OVER (ORDER BY mtime, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over FROM rest)
SELECT path, 'ttl' AS reason FROM mine WHERE 946684800 - mtime > 31536000 AND length <> 50
UNION ALL SELECT path, 'cap' FROM ranked WHERE length <> 50 AND left_over > 100000""")
def evict_plan(spark, d) -> DataFrame:
    """Files to drop: the old ones, then of the rest the oldest over the cap."""
    owners = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("book_dir"))
    plan = cache.eviction_plan(_files(spark, d), owners, F.lit(946684800), cap=100_000, ttl=31_536_000, keep=F.col("length") == 50)
    return plan.select("path", "reason")


@registered(f"""WITH {FILES_SQL}, ranked AS (SELECT *, sum(length) OVER (PARTITION BY book_dir) - coalesce(sum(length) OVER (PARTITION BY book_dir ORDER BY mtime, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over FROM files)
SELECT book_dir, path FROM ranked WHERE left_over > 300""")
def evict_within(spark, d) -> DataFrame:
    """A cap for each group of files."""
    return cache.over_cap(_files(spark, d), 300, F.lit(False), within=["book_dir"]).select("book_dir", "path")


@registered("""SELECT le, n::BIGINT AS n FROM (SELECT unnest([0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0]::DOUBLE[]) AS le), LATERAL (SELECT count(*) AS n FROM events WHERE value <= le)
UNION ALL SELECT NULL, count(value)::BIGINT FROM events""")
def histogram_le(spark, d) -> DataFrame:
    return metrics.cumulative_histogram(table(spark, d, "events"), "value")


@registered("""WITH s AS (SELECT o_orderstatus, list(o_totalprice ORDER BY o_totalprice) AS x FROM orders GROUP BY 1)
SELECT o_orderstatus, x[floor((len(x) - 1) * 0.5)::BIGINT + 1] AS p50, x[floor((len(x) - 1) * 0.95)::BIGINT + 1] AS p95, x[floor((len(x) - 1) * 0.99)::BIGINT + 1] AS p99, x[len(x)] AS max, len(x)::BIGINT AS n FROM s""")
def index_percentiles(spark, d) -> DataFrame:
    return metrics.place_percentiles(table(spark, d, "orders"), "o_totalprice", (0.5, 0.95, 0.99), ("o_orderstatus",))


@registered("""SELECT k AS event_type, count(event_id)::BIGINT AS n FROM (SELECT unnest(['click', 'purchase', 'forbidden']) AS k) LEFT JOIN events ON event_type = k GROUP BY 1""")
def errors_by_kind_zero_filled(spark, d) -> DataFrame:
    return metrics.count_by_kind(table(spark, d, "events"), "event_type", ("click", "purchase", "forbidden"))


@registered("""SELECT count(*) FILTER (o_orderstatus = 'O')::BIGINT AS "O", count(*) FILTER (o_orderstatus = 'F')::BIGINT AS "F", count(*) FILTER (o_orderstatus = 'X')::BIGINT AS "X" FROM orders""")
def outcome_counts(spark, d) -> DataFrame:
    return metrics.outcomes(table(spark, d, "orders"), "o_orderstatus", ("O", "F", "X"))


@registered("""SELECT l_orderkey, count(DISTINCT l_linenumber) = count(*) AS usable FROM lineitem GROUP BY 1""")
def distinct_tracks(spark, d) -> DataFrame:
    return metrics.all_distinct(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")


@registered("""SELECT p_partkey, CASE WHEN s = '' THEN 'book' ELSE s END AS slug, regexp_replace(s, '(-[0-9]+)*$', '') AS root FROM (
  SELECT p_partkey, lower(regexp_replace(regexp_replace(p_name || ' #' || p_size, '[^A-Za-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) AS s FROM part)""")
def slugify(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    slug = text.slugify(F.concat("p_name", F.lit(" #"), F.col("p_size").cast("string")))
    return p.select("p_partkey", slug.alias("slug"), text.slug_root(slug).alias("root"))


# Candidates of one root in order, one a round; a slug is free if the root's list does not have it yet.
SLUGS_SQL = """
WITH RECURSIVE keyed AS (
  SELECT source_path, base, regexp_replace(base, '(-[0-9]+)*$', '') AS root, position FROM candidates),
ranked AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY position) AS i FROM keyed),
folded AS (
  SELECT root, 0::BIGINT AS i, NULL::VARCHAR AS source_path, NULL::VARCHAR AS base, []::VARCHAR[] AS seen FROM ranked GROUP BY root
  UNION ALL
  SELECT f.root, r.i, r.source_path, r.base,
         list_append(f.seen, [c FOR c IN list_concat([r.base], [r.base || '-' || k FOR k IN range(2, len(f.seen) + 3)]) IF NOT list_contains(f.seen, c)][1])
  FROM folded f JOIN ranked r ON r.root = f.root AND r.i = f.i + 1)
SELECT source_path, base, seen[-1] AS slug FROM folded WHERE i > 0"""


@registered(SLUGS_SQL.replace("WITH RECURSIVE keyed", """WITH RECURSIVE candidates AS (
  SELECT p_partkey::VARCHAR AS source_path, coalesce(nullif(lower(regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g'), '^-|-$', '', 'g')), ''), 'book') AS base, p_partkey AS position FROM part),
keyed"""))
def slug_assign(spark, d) -> DataFrame:
    """Slugs without collisions, in order."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("source_path"), text.slugify(F.col("p_name")).alias("base"), F.col("p_partkey").alias("position"))
    return identity.assign_slugs(p).select("source_path", "base", "slug")


@registered("""SELECT page_id, url_encode(url) AS encoded, regexp_replace(url, '^https?://', '') AS bare FROM pages""")
def url_encode_rfc3986(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.percent_encode(F.col("url")).alias("encoded"), text.strip_scheme(F.col("url")).alias("bare"))


@registered("""SELECT page_id, app, CASE WHEN app = 'Overcast' THEN pre || url_encode(url) ELSE pre || regexp_replace(url, '^https?://', '') END AS link FROM pages,
 (VALUES ('Apple Podcasts', 'podcast://'), ('Overcast', 'overcast://x-callback-url/add?url='), ('Pocket Casts', 'pktc://subscribe/'), ('Castro', 'castros://subscribe/'),
 ('AntennaPod', 'antennapod-subscribe://'), ('Podcast Addict', 'podcastaddict://')) v(app, pre)""")
def subscribe_links(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(text.subscribe_links(F.col("url"))).alias("x")).select("page_id", "x.app", "x.link")


@registered("""SELECT p_partkey, (p_size::BIGINT * CASE p_size % 5 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 WHEN 3 THEN 1073741824 END)::BIGINT AS bytes, CASE WHEN p_size % 5 = 4 THEN 'unit' END AS size_error,
  (p_size * CASE p_size % 5 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 WHEN 3 THEN 86400 END)::BIGINT AS seconds, CASE WHEN p_size % 5 = 4 THEN 'unit' END AS duration_error FROM part""")
def size_and_duration_parse(spark, d) -> DataFrame:
    n, s = F.col("p_size") % 5, F.col("p_size").cast("string")
    unit = lambda *u: F.concat(F.lit(" "), s, F.lit(" "), F.get(F.array(*[F.lit(x) for x in u]), n))
    size, duration = numbers.parse_size(unit("B", "KiB", "mb", "G", "x")), numbers.parse_duration(unit("s", "Min", "h", "days", "x"))
    out = table(spark, d, "part").select("p_partkey", size.alias("a"), duration.alias("b"))
    return out.select("p_partkey", "a.bytes", F.col("a.error").alias("size_error"), "b.seconds", F.col("b.error").alias("duration_error"))


@registered("""SELECT event_id, 'aac' AS codec, (json_extract_string(props, '$.k')::DOUBLE) AS duration_sec, NULL::VARCHAR AS error FROM events""")
def json_extract(spark, d) -> DataFrame:
    """A probe document made of an event's properties, read by its schema."""
    k = F.get_json_object("props", "$.k")
    doc = F.concat(F.lit('{"streams":[{"codec_type":"audio","codec_name":"aac"}],"chapters":[],"format":{"duration":"'), k, F.lit('"}}'))
    out = table(spark, d, "events").select("event_id", parsers.parse_probe(doc).alias("p"))
    return out.select("event_id", "p.codec", "p.duration_sec", "p.error")


@registered("""
WITH f AS (SELECT o_orderkey, c, m FROM (SELECT o_orderkey, ['mp3', 'aac', 'flac', 'vorbis', 'opus', 'alac', NULL][(o_orderkey % 7 + 1)::INT] AS c, ['off', 'aac', 'mp3'][(o_orderkey % 3 + 1)::INT] AS m FROM orders))
SELECT o_orderkey, c IS NULL OR c IN ('mp3', 'aac') AS safe, CASE WHEN c IS NULL OR c IN ('mp3', 'aac') OR m = 'off' THEN 'copy' ELSE m END AS encoding,
  CASE WHEN NOT (c IS NULL OR c IN ('mp3', 'aac') OR m = 'off') THEN CASE m WHEN 'aac' THEN 'm4a' ELSE 'mp3' END
       ELSE CASE c WHEN 'mp3' THEN 'mp3' WHEN 'flac' THEN 'flac' WHEN 'vorbis' THEN 'ogg' WHEN 'opus' THEN 'opus' ELSE 'm4a' END END AS ext FROM f""")
def encoding_decisions(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey")
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("o_orderkey") % len(values)).cast("int"))
    o = o.withColumns({"c": pick(["mp3", "aac", "flac", "vorbis", "opus", "alac", None]), "m": pick(["off", "aac", "mp3"])})
    c, m = F.col("c"), F.col("m")
    return o.select("o_orderkey", media.is_podcast_safe(c).alias("safe"), media.encoding(c, m).alias("encoding"), media.episode_extension(c, m).alias("ext"))


HOSTS_SQL = """split_part(regexp_replace(url, '^https?://', ''), '/', 1)"""


@registered(f"""WITH f AS (SELECT page_id, {HOSTS_SQL} AS folder, CASE page_id % 11 WHEN 0 THEN 'm4b' WHEN 1 THEN 'flac' ELSE 'mp3' END AS ext FROM pages),
c AS (SELECT folder, count(*) FILTER (ext = 'm4b') AS m4x, count(*) FILTER (ext = 'mp3') AS mp3, count(*) AS n FROM f GROUP BY 1)
SELECT 'file' AS kind, f.folder || '/' || page_id || '.' || ext AS path FROM f JOIN c USING (folder) WHERE (m4x > 0 AND ext = 'm4b') OR (m4x = 0 AND mp3 = 1 AND ext = 'mp3') OR (m4x = 0 AND mp3 = 0 AND n = 1)
UNION ALL SELECT 'folder', folder FROM c WHERE m4x = 0 AND mp3 > 1""")
def folder_books(spark, d) -> DataFrame:
    """Folders (hosts) classified by what files they hold."""
    p = table(spark, d, "pages")
    n = F.col("page_id") % 11
    ext = F.when(n == 0, "m4b").when(n == 1, "flac").otherwise("mp3")
    host = F.substring_index(text.strip_scheme(F.col("url")), "/", 1)
    files = p.select(F.concat(host, F.lit("/"), F.col("page_id").cast("string"), F.lit("."), ext).alias("path"), F.lit(1).cast("long").alias("length"), F.lit(1).cast("long").alias("mtime"))
    return listing.classify(listing.eligible(files)).select("kind", "path")


@registered("""SELECT o_orderkey AS id, (o_orderstatus = 'O' AND o_totalprice > 50000 AND n IS NOT NULL AND ok) AS fresh FROM orders LEFT JOIN (
  SELECT l_orderkey, count(*) AS n, bool_and(l_returnflag <> 'R') AS ok FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""".replace("AND n IS NOT NULL AND ok)", "AND coalesce(n, 0) > 0 AND coalesce(ok, false))"))
def fresh_sources(spark, d) -> DataFrame:
    """Sources that need not be read again."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    books = o.select(key.alias("id"), F.lit(1).alias("source_mtime"), F.col("o_orderstatus").alias("title"), F.lit(None).cast("string").alias("author"), F.lit("full").alias("storage_mode"), F.lit(None).cast("string").alias("default_cover_url"), F.lit(False).alias("force_embedded"), F.lit("").alias("transcode"))
    wanted = o.select(key.alias("id"), F.lit(1).alias("want_source_mtime"), F.lit("O").alias("want_title"), F.lit(None).cast("string").alias("want_author"), F.lit("full").alias("want_storage_mode"), F.lit(None).cast("string").alias("want_default_cover_url"), F.lit(False).alias("want_force_embedded"), F.lit("x.m4b").alias("path"), F.lit("off").alias("mode"), (F.col("o_totalprice") <= 50000).alias("force"))
    l = table(spark, d, "lineitem")
    file = F.concat(F.lit("f"), F.col("l_returnflag"))
    episodes = l.select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").cast("long").alias("idx"), file.alias("file_path"), F.lit(1.0).alias("start_sec"), F.lit("").alias("source_path"), F.lit(False).alias("needs_faststart"))
    files = spark.createDataFrame([("fA",), ("fN",)], "file_path string")
    out = staleness.fresh_books(wanted, books, staleness.episode_state(episodes, files, F.lit(False)))
    return out.select(F.col("id").cast("long").alias("id"), "fresh")


@registered("""SELECT o_custkey AS c_custkey, id FROM (SELECT o_custkey, o_orderkey::VARCHAR AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_orderkey::VARCHAR DESC) AS k FROM orders) WHERE k = 1
UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def id_reuse(spark, d) -> DataFrame:
    """The id that the catalogue has for a source, the last by title."""
    books = table(spark, d, "orders").select(F.col("o_custkey").alias("source_path"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("title"))
    sources = table(spark, d, "customer").select(F.col("c_custkey").alias("source_path"))
    return identity.reuse_ids(sources, books).select(F.col("source_path").alias("c_custkey"), "id")


@registered("""SELECT o_orderkey, o_custkey, 0.0::DOUBLE AS start_sec, '' AS source_path FROM orders""")
def evolved_schema(spark, d) -> DataFrame:
    """Missing columns at their defaults, retired ones gone."""
    from pyspark.sql import types as T

    fields = [T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()), T.StructField("start_sec", T.DoubleType()), T.StructField("source_path", T.StringType())]
    o = table(spark, d, "orders").drop("o_orderstatus", "o_totalprice", "o_orderdate")
    return schema.evolve(o, T.StructType(fields), schema.EPISODE_DEFAULTS, retired=("o_orderpriority",))


@registered("""SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey)::BIGINT AS created_at FROM orders""")
def backfilled_order(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return schema.backfill_order(o, "created_at", ["o_orderdate", "o_orderkey"])


@registered("""SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000007' OR c_custkey = 7""")
def point_lookup(spark, d) -> DataFrame:
    """One row by key; the filter reaches the scan."""
    return table(spark, d, "customer").where(F.col("c_custkey") == 7).select("c_custkey", "c_name")


@registered("""SELECT page_id, regexp_matches(slug, '^[a-z0-9-]+$') AS is_slug, upper(left(url, 1)) AS initial FROM (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN 'a-' || page_id ELSE 'A ' || page_id END AS slug FROM pages)""")
def allow_lists(spark, d) -> DataFrame:
    slug = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("a-"), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("A "), F.col("page_id").cast("string")))
    return table(spark, d, "pages").select("page_id", text.is_slug(slug).alias("is_slug"), text.initial(F.col("url")).alias("initial"))


def _catalogue(spark, d):
    """Customers as books: one in some has no cover."""
    c = table(spark, d, "customer")
    name = F.lower("c_name")
    cover = F.when(F.col("c_acctbal") >= 0, F.concat(name, F.lit(".jpg")))
    return c.select(F.col("c_custkey").alias("id"), text.slugify(name).alias("slug"), F.sha2("c_name", 256).alias("feed_id"), F.col("c_name").alias("title"), F.lit(None).cast("string").alias("author"), cover.alias("cover_path"))


CARD_SQL = "regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g') AS slug, sha256(c_name) AS feed_id, c_name AS title, NULL::VARCHAR AS author, c_acctbal >= 0 AS has_cover"


@registered(f"SELECT {CARD_SQL} FROM customer")
def book_cards(spark, d) -> DataFrame:
    return views.cards(_catalogue(spark, d))


@registered(f"""SELECT {CARD_SQL}, 'https://host/feed/' || sha256(c_name) || '.xml' AS feed_url, 'https://host/subscribe/' || sha256(c_name) AS subscribe_url,
  (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS episode_count FROM customer""")
def book_details(spark, d) -> DataFrame:
    """Addresses and counts; books without episodes have 0."""
    return views.details(_catalogue(spark, d), table(spark, d, "orders").select(F.col("o_custkey").alias("book_id")), "https://host")


@registered(f"""WITH {ITEMS_SQL} SELECT o_orderkey, idx::BIGINT AS idx, l_partkey FROM items WHERE idx = o_orderkey % 8 - 1""")
def episode_by_number(spark, d) -> DataFrame:
    """Each order asks for one of its items by a number from 0, which gives none, to 7."""
    requests = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 8).alias("number"))
    return views.episodes_by_number(requests, _items(spark, d)[0], "o_orderkey").select("o_orderkey", "idx", "l_partkey")


@registered("""SELECT c_custkey, coalesce(CASE WHEN s_acctbal > 0 THEN s_name END, c_name) AS title, coalesce(s_address, c_mktsegment) AS author FROM (SELECT c_custkey, c_name, c_mktsegment FROM customer)
LEFT JOIN (SELECT s_suppkey, s_acctbal, s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'author ' || s_suppkey END AS s_address FROM supplier) ON s_suppkey = c_custkey""")
def overridden_books(spark, d) -> DataFrame:
    """Fields of an override record win where it has them."""
    books = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("title"), F.col("c_mktsegment").alias("author"))
    key = F.col("s_suppkey")
    author = F.when(key % 2 == 0, F.concat(F.lit("author "), key.cast("string")))
    records = table(spark, d, "supplier").select(key.alias("c_custkey"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("title"), author.alias("author"))
    return views.with_overrides(books, records, "c_custkey", ["title", "author"])


def _chapters(spark, d):
    return _items(spark, d)[0].select("o_orderkey", "idx", F.lit(3.0).alias("start"), F.col("l_quantity").cast("double").alias("end"))


@registered(f"""WITH {ITEMS_SQL} SELECT o_orderkey, bool_and(l_quantity > 3) AS ok, (min(idx) FILTER (l_quantity <= 3))::BIGINT AS first_error FROM items GROUP BY 1""")
def cut_checks(spark, d) -> DataFrame:
    """One chapter that cannot be cut fails the book; the first such is its error."""
    return views.cut_outcomes(_chapters(spark, d), "o_orderkey").select("o_orderkey", "ok", F.col("first_error").cast("long").alias("first_error"))


@registered(f"""WITH {ITEMS_SQL} SELECT o_orderkey, idx::BIGINT AS idx, o_orderkey || '/' || idx || '.m4a' AS file FROM items
WHERE idx <> 4 AND o_orderkey IN (SELECT o_orderkey FROM items GROUP BY 1 HAVING bool_and(l_quantity > 3))""")
def chapter_files(spark, d) -> DataFrame:
    """Chapters and files by place; the fifth file of a book is missing."""
    chapters = _chapters(spark, d)
    files = chapters.where("idx <> 4").select("o_orderkey", "idx", F.concat_ws("", F.col("o_orderkey").cast("string"), F.lit("/"), F.col("idx").cast("string"), F.lit(".m4a")).alias("file"))
    return views.chapters_with_files(chapters, files, "o_orderkey").select("o_orderkey", F.col("idx").cast("long").alias("idx"), "file")


LINKED_SQL = """SELECT 'lib/' || (page_id % 7) || '/' || page_id AS path,
  CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'library/' || page_id ELSE 'lib/real/' || (page_id // 3) END AS real_path FROM pages"""


@registered(f"""SELECT real_path, arg_min(path, string_split(path, '/')) AS path FROM ({LINKED_SQL}) WHERE starts_with(real_path, 'lib/') GROUP BY 1""")
def real_paths(spark, d) -> DataFrame:
    """Links that lead out of the root or nowhere go, and each real path is there once."""
    n = F.col("page_id")
    real = F.when(n % 5 == 0, None).when(n % 5 == 1, F.concat(F.lit("library/"), n.cast("string"))).otherwise(F.concat(F.lit("lib/real/"), F.floor(n / 3).cast("string")))
    path = F.concat(F.lit("lib/"), (n % 7).cast("string"), F.lit("/"), n.cast("string"))
    linked = table(spark, d, "pages").select(path.alias("path"), real.alias("real_path"))
    return listing.one_per_real_path(listing.contained(linked, "real_path", "lib"), "real_path")


BOUNDS_SQL = " UNION ALL ".join(f"SELECT 'le=\"{b}\"', count(*) FILTER (l_quantity <= {b}) FROM lineitem" for b in metrics.BOUNDS)


@registered(f"""SELECT 'books_indexed' AS metric, '' AS labels, count(*)::DOUBLE AS value FROM customer
UNION ALL SELECT 'errors_total', 'kind="not_found"', count(*) FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT 'errors_total', 'kind="forbidden"', count(*) FROM orders WHERE o_orderpriority = '2-HIGH'
UNION ALL SELECT 'errors_total', 'kind="internal"', 0
UNION ALL SELECT 'duration_seconds_bucket', * FROM ({BOUNDS_SQL} UNION ALL SELECT 'le="+Inf"', count(l_quantity) FROM lineitem)
UNION ALL SELECT 'duration_seconds_sum', '', sum(l_quantity) FROM lineitem
UNION ALL SELECT 'duration_seconds_count', '', count(l_quantity) FROM lineitem""")
def metrics_scrape(spark, d) -> DataFrame:
    """All metrics as one table; kinds without an error are 0."""
    priority = F.col("o_orderpriority")
    kind = F.when(priority == "1-URGENT", "not_found").when(priority == "2-HIGH", "forbidden").otherwise("other")
    errors = table(spark, d, "orders").select(kind.alias("kind"))
    return metrics.metrics_table(table(spark, d, "customer"), errors, table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("seconds")))
