"""More queries over the driver's tables: listings, sidecars, chapters, feeds, scans and settings.

Pages stand for files of a library, parts for books with sidecars, orders for books and line items
for their episodes. Remainders only make the values differ; every row of a table takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.functions import media, numbers, parsers, text
from skeinworks.operators import feed, identity, metrics, mutations, staleness
from skeinworks.plans.catalog_queries import HOSTS_SQL, LINE_ORDER, LINE_SQL, SLUGS_SQL, registered
from skeinworks.runtime import table
from skeinworks.sources import listing, tables


def _text(c: Column) -> Column:
    return c.cast("string")


def _joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _of(key: Column, *values: str | None) -> Column:
    """The value at the key's remainder."""
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


# --- listings -----------------------------------------------------------------------------------

TREE_SQL = f"""tree AS (
  SELECT page_id, repeat('d/', (page_id % 11)::INT) || [{HOSTS_SQL}, '.cache', '@eaDir', 'own', 'lost+found', 'a b'][(page_id % 6 + 1)::INT] AS folder,
         ['x.m4b', '.x.MP3', '_x.flac', 'x.aax', 'x.txt', 'noext'][(page_id // 6 % 6 + 1)::INT] AS name FROM pages)"""


def _tree(spark, d) -> DataFrame:
    n, host = F.col("page_id"), F.substring_index(text.strip_scheme(F.col("url")), "/", 1)
    last = F.get(F.array(host, *[F.lit(x) for x in (".cache", "@eaDir", "own", "lost+found", "a b")]), (n % 6).cast("int"))
    folder = F.concat(F.repeat(F.lit("d/"), (n % 11).cast("int")), last)
    name = _of(F.floor(n / 6), "x.m4b", ".x.MP3", "_x.flac", "x.aax", "x.txt", "noext")
    return table(spark, d, "pages").select("page_id", _joined(folder, "/", name).alias("path"), F.lit(1).cast("long").alias("length"), n.alias("mtime"))


@registered(f"""WITH {TREE_SQL}, parts AS (SELECT *, string_split(folder, '/') AS f FROM tree)
SELECT page_id, folder, len(f) AS depth, CASE WHEN name = '.x.MP3' THEN 'mp3' ELSE split_part(name, '.', 2) END AS ext FROM parts
WHERE name IN ('x.m4b', '.x.MP3', '_x.flac') AND len(f) <= 8 AND f[-1] NOT IN ('.cache', '@eaDir', 'lost+found') AND NOT folder = 'own'""")
def eligible_files(spark, d) -> DataFrame:
    """What a walk reaches: depth, ignored folders, own output, audio; files keep any name."""
    return listing.eligible(_tree(spark, d), "own").select("page_id", "folder", F.col("depth").cast("long").alias("depth"), "ext")


@registered(f"""WITH f AS (SELECT page_id, {HOSTS_SQL} AS folder, CASE page_id % 11 WHEN 0 THEN 'm4a' WHEN 1 THEN 'opus' ELSE 'mp3' END AS ext FROM pages),
c AS (SELECT folder FROM f GROUP BY 1 HAVING count(*) FILTER (ext = 'm4a') = 0 AND count(*) FILTER (ext = 'mp3') > 1)
SELECT page_id FROM f JOIN c USING (folder) WHERE ext = 'mp3'""")
def tracks_of_folders(spark, d) -> DataFrame:
    """The tracks of the folders that are books."""
    n, host = F.col("page_id"), F.substring_index(text.strip_scheme(F.col("url")), "/", 1)
    ext = F.when(n % 11 == 0, "m4a").when(n % 11 == 1, "opus").otherwise("mp3")
    one = F.lit(1).cast("long")
    files = listing.eligible(table(spark, d, "pages").select("page_id", _joined(host, "/", _text(n), ".", ext).alias("path"), one.alias("length"), one.alias("mtime")))
    return listing.folder_tracks(files, listing.classify(files)).select("page_id")


@registered("""WITH b AS (SELECT p_partkey, 'lib/' || p_brand || '/' || p_partkey AS stem, 'lib/' || p_brand AS folder FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN stem || '.cue' WHEN 1 THEN stem || '.CUE' WHEN 2 THEN stem || '.cue' END AS cue,
  CASE WHEN p_partkey % 3 = 0 THEN stem || '.toml' WHEN folder IN (SELECT folder FROM b GROUP BY 1 HAVING count(*) > 100) THEN folder || '/book.toml' END AS override FROM b""")
def sidecar_files(spark, d) -> DataFrame:
    """Sidecars beside a book: lower case before upper, no other; override files beside it or in its folder."""
    p = table(spark, d, "part")
    folder, n = F.concat(F.lit("lib/"), F.col("p_brand")), F.col("p_partkey")
    stem = _joined(folder, "/", _text(n))
    cues = F.array(F.array(F.lit(".cue")), F.array(F.lit(".CUE")), F.array(F.lit(".CUE"), F.lit(".cue")), F.array(F.lit(".Cue")))
    names = F.concat(F.get(cues, (n % 4).cast("int")), F.when(n % 3 == 0, F.array(F.lit(".toml"))).otherwise(F.array().cast("array<string>")))
    files = p.select(stem.alias("stem"), F.explode(names).alias("end")).select(F.concat("stem", "end").alias("path"))
    whole = p.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n")).where("n > 100").select(_joined(F.col("folder"), "/book.toml").alias("path"))
    books = p.select(n, F.lit("file").alias("kind"), F.concat(stem, F.lit(".m4b")).alias("path"), folder.alias("folder"))
    found = listing.with_override_file(listing.with_sidecar(books, files, ("cue",), "cue"), files.unionByName(whole), "book.toml", ".toml")
    return found.select("p_partkey", "cue", "override")


# --- chapters -----------------------------------------------------------------------------------


def _sheet(lines: DataFrame, line: Column) -> DataFrame:
    """Each order's lines as one text, in order of their number."""
    entry = F.struct(*LINE_ORDER, line.alias("line"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["line"]), "\n")
    return lines.groupBy("l_orderkey").agg(joined.alias("sheet"))


def _chapter_rows(sheets: DataFrame, parsed: Column) -> DataFrame:
    return sheets.select("l_orderkey", F.explode(parsed).alias("c")).select("l_orderkey", "c.*")


@registered(f"""WITH t AS (SELECT l_orderkey, {LINE_SQL}, l_linenumber * 600 + (l_quantity::BIGINT % 60) + (l_suppkey % 75) / 75.0::DOUBLE AS start,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_SQL}) AS place FROM lineitem WHERE l_returnflag <> 'R'),
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY start, place) - 1 AS idx, lead(start) OVER (PARTITION BY l_orderkey ORDER BY start, place) AS after FROM t)
SELECT l_orderkey, idx::BIGINT AS idx, round(start, 6) AS start_sec, round(coalesce(after, greatest(3000, start)), 6) AS end_sec, nullif(l_shipdate::DATE::VARCHAR, '') AS title FROM o""")
def cue_chapters(spark, d) -> DataFrame:
    """Chapters of cue sheets that are made of an order's lines; tracks without an index are none."""
    l = table(spark, d, "lineitem")
    two = lambda c: F.lpad(_text(c.cast("long")), 2, "0")
    at = _joined(_text(F.col("l_linenumber") * 10), ":", two(F.col("l_quantity") % 60), ":", two(F.col("l_suppkey") % 75))
    index = F.when(F.col("l_returnflag") != "R", _joined("    index 01 ", at, "\r")).otherwise(_joined("    INDEX 00 ", at))
    line = _joined("  TRACK ", _text(F.col("l_linenumber")), " AUDIO\r\n    Title \"", F.date_format("l_shipdate", "yyyy-MM-dd"), "\"\n", index)
    rows = _chapter_rows(_sheet(l, line), parsers.parse_cue(F.concat(F.lit("TITLE none\nFILE x\n"), F.col("sheet")), F.lit(3000.0)))
    return rows.select("l_orderkey", "idx", F.round("start_sec", 6).alias("start_sec"), F.round("end_sec", 6).alias("end_sec"), "title")


@registered(f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_SQL}) - 1 AS idx FROM lineitem)
SELECT l_orderkey, idx::BIGINT AS idx, CASE WHEN l_returnflag = 'R' THEN l_linenumber * 100 * 3 / 2.0::DOUBLE ELSE l_linenumber * 100 / 1000.0::DOUBLE END AS start_sec,
  CASE WHEN l_returnflag = 'R' THEN l_quantity * 3 / 2.0::DOUBLE ELSE l_quantity / 1000 END AS end_sec, CASE WHEN l_linestatus = 'F' THEN 'part ' || l_linenumber END AS title FROM t""")
def ffmeta_chapters(spark, d) -> DataFrame:
    """Chapters of ffmetadata blocks, some with a time base after their start, some without title."""
    l = table(spark, d, "lineitem")
    base = F.when(F.col("l_returnflag") == "R", "\nTIMEBASE=3/2").otherwise("\nTIMEBASE=5/0")
    title = F.when(F.col("l_linestatus") == "F", _joined("\ntitle=part ", _text(F.col("l_linenumber")))).otherwise("\ntitle=")
    line = _joined("[chapter]\nSTART=", _text(F.col("l_linenumber") * 100), base, "\nEND = ", _text(F.col("l_quantity").cast("long")), title, "\n[STREAM]\ntitle=other")
    return _chapter_rows(_sheet(l, line), parsers.parse_ffmeta(F.concat(F.lit(";FFMETADATA1\n"), F.col("sheet"))))


# --- feeds --------------------------------------------------------------------------------------


def _books_and_episodes(spark, d) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders")
    books = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("title"), numbers.seconds(F.col("o_orderdate")).alias("source_mtime"))
    l = feed.renumber(table(spark, d, "lineitem"), ["l_orderkey"], LINE_ORDER)
    episodes = l.select(
        F.lit("").alias("guid"), F.col("l_orderkey").alias("book_id"), "idx", _joined("E&", F.col("l_returnflag")).alias("title"), (F.col("l_quantity") * 100).alias("duration_sec"),
        F.lit(0).cast("long").alias("pubdate_epoch"), F.lit("").alias("source_path"), F.col("l_partkey").alias("byte_length"),
    )
    return books, episodes


EPISODES_SQL = f"""e AS (SELECT l_orderkey, l_returnflag, l_quantity, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_SQL}) - 1 AS idx, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
x AS (SELECT o_orderkey, o_orderstatus, epoch(o_orderdate)::BIGINT AS mtime, e.*, make_timestamp((epoch(o_orderdate)::BIGINT - (n - 1 - idx) * 60) * 1000000) AS published, (l_quantity * 100)::BIGINT AS s FROM orders LEFT JOIN e ON l_orderkey = o_orderkey),
items AS (SELECT *, sha256(o_orderkey || ':' || idx || ':' || mtime) AS guid, strftime(published, '%a, %d %b %Y %H:%M:%S +0000') AS pub_date,
  printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS duration FROM x)"""


@registered(f"""WITH {EPISODES_SQL} SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS title, 'E&' || l_returnflag AS episode_title, idx::BIGINT AS idx, guid, pub_date, CASE WHEN idx IS NOT NULL THEN duration END AS duration, (idx + 1)::VARCHAR AS episode FROM items""")
def feed_item_rows(spark, d) -> DataFrame:
    """Every episode with its guid, date and duration; a book without episodes has a row of nulls."""
    return feed.feed_items(*_books_and_episodes(spark, d)).select(_text(F.col("id")).alias("id"), "title", "episode_title", "idx", "guid", "pub_date", "duration", "episode")


@registered(f"""WITH {EPISODES_SQL}, tags AS (SELECT o_orderkey, idx, '<item><title>E&amp;' || l_returnflag || '</title><guid isPermaLink="false">' || guid || '</guid><pubDate>' || pub_date || '</pubDate><enclosure url="http://h/f/' || o_orderkey || '?a=1&amp;e=' || idx
  || '" length="' || l_partkey || '" type="audio/mp4"/><itunes:duration>' || duration || '</itunes:duration><itunes:episode>' || (idx + 1) || '</itunes:episode></item>' AS t FROM items)
SELECT o_orderkey::VARCHAR AS feed, '<?xml version="1.0" encoding="utf-8"?><rss version="2.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel><title>&lt;' || any_value(o_orderstatus) || '&gt;</title>'
  || coalesce(string_agg(t, '' ORDER BY idx), '') || '</channel></rss>' AS xml FROM tags JOIN orders USING (o_orderkey) GROUP BY 1""")
def feed_texts(spark, d) -> DataFrame:
    """Each book's feed as text, escaped."""
    whole = feed.nested_feed_items(*_books_and_episodes(spark, d))

    def named(x: Column) -> Column:
        url = _joined("http://h/f/", _text(F.col("id")), "?a=1&e=", _text(x["idx"]))
        return F.struct(x["episode_title"].alias("title"), x["guid"], x["pub_date"], url.alias("url"), _text(x["byte_length"]).alias("length"), F.lit("audio/mp4").alias("type"), x["duration"], x["episode"])

    return tables.feed_documents(whole.select(_text(F.col("id")).alias("feed"), _joined("<", F.col("title"), ">").alias("title"), F.transform("items", named).alias("items")))


@registered("""WITH e AS (SELECT event_id, user_id::VARCHAR AS feed, event_id % 4 AS k FROM events),
p AS (SELECT event_id, feed, unnest(CASE k WHEN 0 THEN ['missing_episode'] WHEN 1 THEN ['missing_length', 'missing_duration'] WHEN 2 THEN ['missing_url', 'bad_date'] ELSE ['missing_enclosure', 'missing_episode', 'missing_duration'] END) AS problem, k FROM e)
SELECT feed, event_id::INT AS pos, CASE WHEN k IN (1, 2) THEN 1::BIGINT END AS episode, problem FROM p
UNION ALL SELECT feed, event_id::INT, 1, 'not_later' FROM (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY event_id) AS i FROM e WHERE k = 1) WHERE i > 1""")
def broken_feed_items(spark, d) -> DataFrame:
    """Items each of which breaks one or more rules."""
    n = F.col("event_id")
    e = table(spark, d, "events").select(_text(F.col("user_id")).alias("feed"), n.cast("int").alias("pos"), (n % 4).alias("k"))
    pick = lambda *v: F.get(F.array(*[F.lit(x) for x in v]), F.col("k").cast("int"))
    date = "Thu, 01 Jan 1970 00:00:00 +0000"
    items = e.select(
        "feed", "pos", pick("first", " 1 ", "+1", None).alias("episode"), pick("u", "u", " \t", None).alias("enclosure_url"), pick("1", "0", "1", None).alias("enclosure_length"),
        pick("1", " ", "1", None).alias("duration"), pick(date, date, "soon", date).alias("pub_date"),
    )
    return feed.feed_problems(items.select("feed"), items)


@registered("""SELECT l_orderkey, l_linenumber, l_partkey, bool_or(src <> '' AND src = file AND actual IS NOT NULL AND actual = l_partkey) AS served FROM (
  SELECT *, CASE WHEN l_returnflag = 'R' THEN '' ELSE '/lib/' || l_suppkey END AS src, CASE WHEN l_linestatus = 'F' THEN '/lib/' || l_suppkey ELSE '/out/' || l_linenumber END AS file,
  CASE l_suppkey % 3 WHEN 0 THEN l_partkey WHEN 1 THEN l_partkey + 1 END AS actual FROM lineitem) GROUP BY 1, 2, 3""")
def served_in_place(spark, d) -> DataFrame:
    """Episodes that are whole source files of the recorded length."""
    n, source = F.col("l_suppkey"), _joined("/lib/", _text(F.col("l_suppkey")))
    given = F.when(F.col("l_returnflag") == "R", "").otherwise(source)
    file = F.when(F.col("l_linestatus") == "F", source).otherwise(_joined("/out/", _text(F.col("l_linenumber"))))
    actual = F.when(n % 3 == 0, F.col("l_partkey")).when(n % 3 == 1, F.col("l_partkey") + 1)
    served = feed.may_serve_in_place(given, file, actual, F.col("l_partkey"))
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.bool_or(served).alias("served"))


# --- scans --------------------------------------------------------------------------------------

RESCAN_SQL = """WITH RECURSIVE slugs AS (SELECT p_partkey, coalesce(nullif(lower(regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g'), '^-|-$', '', 'g')), ''), 'book') AS base FROM part),
candidates AS (SELECT p_partkey::VARCHAR AS source_path, base, p_partkey AS position FROM slugs),
owned AS (SELECT DISTINCT base || '-' || (s_nationkey + 2) AS slug, s_suppkey::VARCHAR AS owner, regexp_replace(base, '(-[0-9]+)*$', '') AS root FROM supplier JOIN slugs ON p_partkey = s_suppkey),
held AS (SELECT root, list({'slug': slug, 'owner': owner}) AS held FROM owned GROUP BY root),
"""


@registered(
    SLUGS_SQL.replace("WITH RECURSIVE ", RESCAN_SQL)
    .replace("[]::VARCHAR[] AS seen FROM ranked GROUP BY root", "[]::VARCHAR[] AS seen, any_value(held) AS held FROM ranked LEFT JOIN held USING (root) GROUP BY root")
    .replace("range(2, len(f.seen) + 3)", "range(2, len(f.seen) + coalesce(len(f.held), 0) + 3)")
    .replace("IF NOT list_contains(f.seen, c)][1])", "IF NOT list_contains(f.seen, c) AND len([h FOR h IN coalesce(f.held, []) IF h.slug = c AND h.owner <> r.source_path]) = 0][1]), f.held")
)
def slug_rescan(spark, d) -> DataFrame:
    """Slugs where earlier scans own some: an owner may have its own, others not."""
    p = table(spark, d, "part").select(_text(F.col("p_partkey")).alias("source_path"), text.slugify(F.col("p_name")).alias("base"), F.col("p_partkey").alias("position"))
    owners = table(spark, d, "supplier").select(_text(F.col("s_suppkey")).alias("source_path"), (F.col("s_nationkey") + 2).alias("n"))
    owned = owners.join(p, "source_path").select(_joined(F.col("base"), "-", _text(F.col("n"))).alias("slug"), "source_path")
    return identity.assign_slugs(p, owned).select("source_path", "base", "slug")


RECONCILED_SQL = """found AS (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'),
kept AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, o_custkey IN (SELECT c_custkey FROM found) AS there FROM orders) WHERE k = 1 AND there),
fresh AS (SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)),
after AS (
  SELECT o_orderkey::BIGINT AS id, o_custkey AS source_path, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE o_orderstatus END AS title FROM kept WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
  UNION ALL SELECT -c_custkey - 1, c_custkey, 'new' FROM fresh JOIN found USING (c_custkey))"""


def _reconciled(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as books of the catalogue, customers as sources; one segment's are gone, urgent orders are disabled."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    books = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_path"), F.col("o_orderstatus").alias("title"), _text(F.col("o_orderkey")).alias("feed_id"), numbers.seconds(F.col("o_orderdate")).alias("created_at"))
    sources = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("source_path"))
    first = books.withColumn("k", F.row_number().over(Window.partitionBy("source_path").orderBy("created_at", "id"))).where("k = 1").drop("k")
    again = first.join(sources, "source_path", "left_semi").where("title = 'F'").select(*books.columns)
    new = sources.join(books, "source_path", "left_anti").select((-F.col("source_path") - 1).alias("id"), "source_path", F.lit("x").alias("title"), F.lit("new").alias("feed_id"), F.lit(1).cast("long").alias("created_at"))
    scanned = again.unionByName(new).withColumn("title", F.lit("new"))
    episodes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("idx"))
    children = scanned.select(F.col("id").alias("book_id"), F.lit(99).alias("idx"))
    disabled = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    return mutations.reconcile(books, episodes, sources, scanned, children, disabled)


@registered(f"WITH {RECONCILED_SQL} SELECT * FROM after")
def reconciled_books(spark, d) -> DataFrame:
    """The catalogue after a scan: duplicates collapsed, sources read anew, disabled and lost ones gone."""
    return _reconciled(spark, d)[0].select("id", "source_path", "title")


@registered(f"""WITH {RECONCILED_SQL} SELECT id AS book_id, count(*)::BIGINT AS n, max(idx)::INT AS last FROM (
  SELECT id, 99 AS idx FROM after WHERE title = 'new' UNION ALL SELECT id, l_linenumber FROM after JOIN lineitem ON l_orderkey = id WHERE title <> 'new') GROUP BY 1""")
def reconciled_children(spark, d) -> DataFrame:
    """Children after the scan: those of a book that was read anew are replaced as a whole."""
    return _reconciled(spark, d)[1].groupBy("book_id").agg(F.count(F.lit(1)).alias("n"), F.max("idx").alias("last"))


@registered("""SELECT o_orderkey::VARCHAR AS id, o_orderstatus = 'O' AND o_totalprice > 50000 AND coalesce(n, 0) > 0 AND coalesce(ok, false) AS fresh FROM orders LEFT JOIN (
  SELECT l_orderkey, count(*) AS n, bool_and(l_returnflag <> 'R' AND l_linestatus = 'F') AS ok FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def fresh_track_folders(spark, d) -> DataFrame:
    """Folders of tracks that need not be read again: all files are in place."""
    o, null = table(spark, d, "orders"), F.lit(None).cast("string")
    id_ = _text(F.col("o_orderkey")).alias("id")
    books = o.select(id_, F.lit(1).alias("source_mtime"), F.col("o_orderstatus").alias("title"), null.alias("author"), null.alias("default_cover_url"))
    wanted = o.select(id_, F.lit(1).alias("want_source_mtime"), F.lit("O").alias("want_title"), null.alias("want_author"), null.alias("want_default_cover_url"), (F.col("o_totalprice") <= 50000).alias("force"))
    l = table(spark, d, "lineitem")
    source = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("f"), F.col("l_returnflag"))).otherwise("")
    episodes = l.select(
        _text(F.col("l_orderkey")).alias("book_id"), F.col("l_linenumber").cast("long").alias("idx"), F.concat(F.lit("f"), F.col("l_returnflag")).alias("file_path"), F.lit(0.0).alias("start_sec"),
        source.alias("source_path"), F.lit(False).alias("needs_faststart"),
    )
    files = l.where("l_returnflag <> 'R'").select(F.concat(F.lit("f"), F.col("l_returnflag")).alias("file_path"))
    return staleness.fresh_folders(wanted, books, staleness.episode_state(episodes, files, F.lit(False)))


@registered("""SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)""")
def swept_files(spark, d) -> DataFrame:
    """Files that no row names."""
    current = table(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("path"))
    return mutations.stale_files(table(spark, d, "part").select(F.col("p_partkey").alias("path")), current).select(F.col("path").alias("p_partkey"))


# --- numbers and settings -----------------------------------------------------------------------


@registered("""WITH s AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) AS i, count(*) OVER () AS n FROM lineitem)
SELECT max(v) FILTER (i = floor((n - 1) * 0.5::DOUBLE) + 1) AS p50, max(v) FILTER (i = floor((n - 1) * 0.95::DOUBLE) + 1) AS p95, max(v) FILTER (i = floor((n - 1) * 0.99::DOUBLE) + 1) AS p99, max(v) AS max, count(*)::BIGINT AS n FROM s""")
def price_percentiles(spark, d) -> DataFrame:
    """Places in one group of all rows."""
    return metrics.place_percentiles(table(spark, d, "lineitem"), "l_extendedprice", (0.5, 0.95, 0.99))


@registered("""SELECT c_custkey, coalesce(max(epoch(o_orderdate)::BIGINT), 0) AS mtime, coalesce(max(o_totalprice) * 36000 / 300, 0) AS estimate FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def latest_and_estimate(spark, d) -> DataFrame:
    """A folder's time is its newest file's; a measured time carried on to ten hours."""
    rows = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("at", numbers.seconds(F.col("o_orderdate")))
    most = rows.groupBy("c_custkey").agg(F.max("o_totalprice").alias("most"))
    estimate = F.coalesce(metrics.extrapolate(F.col("most"), F.lit(300)), F.lit(0.0))
    return metrics.latest(rows, ["c_custkey"], "at").join(most, "c_custkey").select("c_custkey", "mtime", estimate.alias("estimate"))


@registered("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, greatest(l_quantity - l_linenumber * 10, 0) AS seconds, l_quantity - l_linenumber * 10 > 0 AS valid,
  l_partkey % 100 * 60 + l_suppkey % 60 + l_linenumber / 75.0::DOUBLE AS cue, CASE WHEN l_suppkey % 4 = 0 THEN l_partkey / 1000.0::DOUBLE ELSE l_partkey * 3::DOUBLE / (l_suppkey % 4) END AS based, l_linenumber::BIGINT AS track,
  printf('%.6f', l_quantity) AS text, greatest(epoch(l_shipdate - INTERVAL 30 YEAR)::BIGINT, 0) AS epoch, greatest(epoch_ms(l_shipdate - INTERVAL 30 YEAR), 0) AS millis FROM lineitem""")
def number_columns(spark, d) -> DataFrame:
    """Lengths, cue times, time bases, track tags, six decimals and times before the epoch."""
    q, k = F.col("l_quantity"), F.col("l_linenumber")
    at = _joined(_text(F.col("l_partkey") % 100), ":", _text(F.col("l_suppkey") % 60), ":", _text(k))
    den = (F.col("l_suppkey") % 4).cast("double")
    early = F.col("l_shipdate") - F.expr("INTERVAL 30 YEAR")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        numbers.chapter_seconds((k * 10).cast("double"), q).alias("seconds"), numbers.is_valid_cut((k * 10).cast("double"), q).alias("valid"),
        numbers.cue_seconds(at).alias("cue"), numbers.timebase_seconds(F.col("l_partkey").cast("double"), F.lit(3.0), den).alias("based"),
        numbers.track_number(_joined(" 0", _text(k), "/12")).alias("track"), numbers.six_decimals(q).alias("text"),
        numbers.epoch_seconds(early).alias("epoch"), numbers.epoch_millis(early).alias("millis"),
    )


@registered("""WITH p AS (SELECT page_id, page_id % 6 AS k, ['a.b.MP3', '.hidden', 'plain', '12.part.ogg', 'x.opus', '007.m4a'][(page_id % 6 + 1)::INT] AS name FROM pages)
SELECT page_id, name, 'lib/' || page_id % 5 AS folder, ['a.b', '.hidden', 'plain', '12.part', 'x', '007'][k + 1] AS stem, ['mp3', NULL, NULL, 'ogg', 'opus', 'm4a'][k + 1] AS ext, 'lib - ' || page_id % 5 AS prefix,
  ['audio/mpeg', 'audio/mp4', 'audio/mp4', 'audio/ogg', 'audio/ogg', 'audio/mp4'][k + 1] AS type, k IN (3, 5) AS is_episode, ['a.b.part.MP3', '.hidden.part', 'plain.part', '12.part.part.ogg', 'x.part.opus', '007.part.m4a'][k + 1] AS part,
  printf('%03d', page_id + 1) || '.m4a' AS file, CASE WHEN k = 0 THEN 'Chapter ' || page_id + 1 ELSE name END AS title, 'http://h' AS base, CASE WHEN k = 2 THEN 'saver' END AS mode, 'it''s "' || name || '"' AS argument, page_id % 2 = 0 AS capability FROM p""")
def path_columns(spark, d) -> DataFrame:
    """Names, folders, stems, extensions, media types and labels of paths."""
    n = F.col("page_id")
    name = _of(n, "a.b.MP3", ".hidden", "plain", "12.part.ogg", "x.opus", "007.m4a")
    p = table(spark, d, "pages").select("page_id", name.alias("given"), _joined("lib/", _text(n % 5), "/", name).alias("path"))
    mode, path = F.when(n % 6 == 2, "saver").when(n % 6 == 1, "").otherwise("other"), F.col("path")
    token = F.when(n % 2 == 0, F.repeat(F.lit("aZ_9-"), 12)).otherwise(F.repeat(F.lit("aZ_9-"), 13))
    return p.select(
        "page_id", text.file_name(path).alias("name"), text.parent(path).alias("folder"), text.file_stem(path).alias("stem"), text.extension(path).alias("ext"), text.nested_prefix(text.parent(path)).alias("prefix"),
        text.media_type(path).alias("type"), text.is_episode_stem(text.file_stem(path)).alias("is_episode"), text.file_name(text.part_path(path)).alias("part"), text.episode_file_name(n, F.lit("m4a")).alias("file"),
        text.chapter_title(F.when(n % 6 == 0, "").otherwise(F.col("given")), n).alias("title"), text.base_url(F.when(n % 2 == 0, "http://h//"), "http://h/").alias("base"),
        text.known_label(mode, media.STORAGE_MODES).alias("mode"), text.unquoted_argument(_joined("TITLE  \"it's \"", F.col("given"), "\"\" ")).alias("argument"), text.is_capability(token).alias("capability"),
    )


@registered("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 3 = 0 THEN 'book' END, 'server') AS level, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'own' END, CASE WHEN c_custkey % 2 = 0 THEN 'per' END, 'srv') AS cover,
  CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'f' || c_custkey END AS base, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN 'nested' ELSE 'f' || c_custkey END AS title,
  CASE c_custkey % 6 WHEN 0 THEN 'a,b' WHEN 3 THEN 'b' WHEN 1 THEN '' WHEN 5 THEN '' ELSE 'a' END AS ignored, CASE c_custkey % 3 WHEN 0 THEN 'png' ELSE 'jpg' END AS art FROM customer""")
def setting_levels(spark, d) -> DataFrame:
    """The nearest level that has a setting, titles by override, nested folder or file, ignored overrides."""
    n = F.col("c_custkey")
    even, third = n % 2 == 0, n % 3 == 0
    path = _joined("x/f", _text(n), ".m4b")
    ignored = media.ignored_overrides({"a": F.when(even, F.lit(1)), "b": F.when(third, F.lit("y"))})
    return table(spark, d, "customer").select(
        "c_custkey", media.effective(F.when(even, F.col("c_mktsegment")), F.when(third, "book"), F.lit("server")).alias("level"), media.cover_url(F.when(third, "own"), F.when(even, "per"), F.lit("srv")).alias("cover"),
        media.base_name(F.when(even, F.col("c_name")), path).alias("base"), media.book_title(F.when(third, F.col("c_name")).otherwise(""), F.when(n % 3 == 1, "nested"), path).alias("title"),
        F.array_join(ignored, ",").alias("ignored"), media.cover_extension(F.when(third, "png").otherwise("mjpeg")).alias("art"),
    )
