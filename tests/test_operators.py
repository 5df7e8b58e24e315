import random

import pytest
from pyspark.sql import functions as F

from skeinworks import schema
from skeinworks.operators import cache, feed, identity, metrics, mutations, staleness, views
from skeinworks.sources import listing

BOOKS = "id string, slug string, feed_id string, title string, source_path string, created_at long"
EPISODES = "guid string, book_id string, idx long"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_upsert_keeps_what_is_preserved_and_is_idempotent(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, feed_id string, v int")
    new = spark.createDataFrame([("a", "z", 5), ("c", "w", 6)], "id string, feed_id string, v int")
    once = mutations.upsert(old, new, ["id"], preserve=["feed_id"])
    assert rows(once, "id", "feed_id", "v") == [("a", "x", 5), ("b", "y", 2), ("c", "w", 6)]
    assert rows(mutations.upsert(once, new, ["id"], preserve=["feed_id"]), "id", "feed_id", "v") == rows(once, "id", "feed_id", "v")


def test_upsert_can_set_null(spark):
    old = spark.createDataFrame([("a", "x")], "id string, v string")
    new = spark.createDataFrame([("a", None)], "id string, v string")
    assert rows(mutations.upsert(old, new, ["id"]), "id", "v") == [("a", None)]


def test_reconcile_twice_changes_nothing(spark):
    books = spark.createDataFrame([("a", "a", "f1", "A", "/a", 5), ("a2", "a2", "f2", "A", "/a", 3), ("g", "g", "f3", "G", "/gone", 1), ("d", "d", "f4", "D", "/d", 2)], BOOKS)
    episodes = spark.createDataFrame([("e1", "a", 0), ("e2", "a2", 0), ("e3", "g", 0), ("e4", "d", 0)], EPISODES)
    sources = spark.createDataFrame([("/a",), ("/b",), ("/d",)], "source_path string")
    scanned = spark.createDataFrame([("a2", "a2", "new", "A!", "/a", 99), ("b", "b", "f5", "B", "/b", 9)], BOOKS)
    fresh = spark.createDataFrame([("e2", "a2", 0), ("e5", "b", 0)], EPISODES)
    disabled = spark.createDataFrame([("d",)], "id string")
    b, e, counts = mutations.reconcile(books, episodes, sources, scanned, fresh, disabled)
    assert rows(b, "id", "feed_id", "title", "created_at") == [("a2", "f2", "A!", 3), ("b", "f5", "B", 9)]
    assert rows(e, "guid") == [("e2",), ("e5",)]
    assert tuple(counts.first()) == (2, 1, 1)
    b2, e2, counts2 = mutations.reconcile(b, e, sources, scanned, fresh, disabled)
    assert rows(b2, *b.columns) == rows(b, *b.columns) and rows(e2, "guid") == rows(e, "guid")
    assert counts2.first()["pruned"] == 0


def test_reconcile_counts_books_that_are_up_to_date_as_indexed(spark):
    books = spark.createDataFrame([("a", "a", "f1", "A", "/a", 5)], BOOKS)
    none = spark.createDataFrame([], EPISODES)
    sources = spark.createDataFrame([("/a",), ("/b",), ("/c",), ("/d",)], "source_path string")
    scanned = spark.createDataFrame([("b", "b", "f2", "B", "/b", 9)], BOOKS)
    disabled = spark.createDataFrame([("c", "/c")], "id string, source_path string")
    failed = spark.createDataFrame([("/d",), ("/elsewhere",)], "source_path string")
    counts = lambda *out: tuple(mutations.reconcile(books, none, sources, scanned, none, *out)[2].first())
    assert counts() == (4, 0, 0)
    assert counts(disabled) == (3, 1, 0)
    assert counts(disabled, failed) == (2, 2, 0)
    assert counts(disabled, sources) == (0, 4, 0)


def test_overrides_win_where_they_have_a_value(spark):
    books = spark.createDataFrame([("a", "A", None), ("b", "B", "x")], "id string, title string, author string")
    records = spark.createDataFrame([("a", "T", "y"), ("c", "C", "z")], "id string, title string, author string")
    assert rows(views.with_overrides(books, records, "id", ["author"]), "id", "title", "author") == [("a", "A", "y"), ("b", "B", "x")]


def test_one_bad_cut_fails_the_book(spark):
    cuts = [("a", 0, 0.0, 2.0), ("a", 1, 2.0, 3.0), ("b", 0, 0.0, 1.0), ("b", 2, 5.0, 4.0), ("b", 1, 1.0, 1.0), ("c", 0, 0.0, None)]
    chapters = spark.createDataFrame(cuts, "book string, idx long, start double, end double")
    assert rows(views.cut_outcomes(chapters, "book"), "book", "ok", "first_error") == [("a", True, None), ("b", False, 1), ("c", False, 0)]
    files = spark.createDataFrame([("a", 1, "f1"), ("b", 0, "g0"), ("a", 2, "f2")], "book string, idx long, file string")
    assert rows(views.chapters_with_files(chapters, files, "book"), "book", "idx", "file") == [("a", 1, "f1")]


def test_episodes_are_numbered_from_one(spark):
    episodes = spark.createDataFrame([("a", 0, "e0"), ("a", 1, "e1")], "book string, idx long, guid string")
    asked = spark.createDataFrame([("a", 0), ("a", 1), ("a", 3), ("a", -1)], "book string, number long")
    assert rows(views.episodes_by_number(asked, episodes, "book"), "number", "guid") == [(1, "e0")]


def test_links_are_followed_once_and_only_inside(spark):
    found = spark.createDataFrame([("r/b", "r/x"), ("r/a", "r/x"), ("r/c", "rr/y"), ("r/d", None), ("r/a b", "r")], "path string, real string")
    inside = listing.contained(found, "real", "r/")
    assert rows(listing.one_per_real_path(inside, "real"), "real", "path") == [("r", "r/a b"), ("r/x", "r/a")]


def test_metrics_of_nothing(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    found = metrics.metrics_table(none("id string"), none("kind string"), none("seconds double"))
    assert {r["value"] for r in found.collect()} == {0.0} and found.count() == 1 + len(metrics.ERROR_KINDS) + len(metrics.BOUNDS) + 1 + 2


def test_an_empty_library_prunes_nothing(spark):
    books = spark.createDataFrame([("a", "/a")], "id string, source_path string")
    assert mutations.orphans(books, spark.createDataFrame([], "source_path string")).count() == 0
    assert mutations.orphans(books, spark.createDataFrame([("/b",)], "source_path string")).count() == 1


def test_children_of_a_shorter_book_are_replaced(spark):
    old = spark.createDataFrame([("1", "a", 0), ("2", "a", 1), ("3", "b", 0)], EPISODES)
    new = spark.createDataFrame([("9", "a", 0)], EPISODES)
    assert rows(mutations.replace_children(old, new, "book_id"), "guid") == [("3",), ("9",)]


def test_violations(spark):
    df = spark.createDataFrame([("a", "s", None), ("a", "t", 1), ("b", "t", 2)], "id string, slug string, v int")
    parents = spark.createDataFrame([("a",)], "key string")
    found = schema.violations(df, unique=[["id"], ["slug"]], required=["v"], references=(["id"], parents, ["key"]))
    assert rows(found, "constraint", "value", "n") == [("not null v", None, 1), ("references id", "b", 1), ("unique id", "a", 2), ("unique slug", "t", 2)]


def test_evolve_is_idempotent(spark):
    old = spark.createDataFrame([("g", "b", 0, "t", "f", 1, 2.0, 3, "x")], "guid string, book_id string, idx long, title string, file_path string, byte_length long, duration_sec double, pubdate_epoch long, status string")
    once = schema.evolve(old, schema.EPISODE, schema.EPISODE_DEFAULTS, retired=("status",))
    assert once.columns == schema.EPISODE.fieldNames()
    assert once.collect() == schema.evolve(once, schema.EPISODE, schema.EPISODE_DEFAULTS, retired=("status",)).collect()
    with pytest.raises(ValueError):
        schema.evolve(old.drop("guid"), schema.EPISODE, schema.EPISODE_DEFAULTS)
    ordered = schema.backfill_order(old.select("guid", "idx"), "created_at", ["idx"])
    assert ordered.first()["created_at"] == 1 and schema.backfill_order(ordered, "created_at", ["idx"]) is ordered


def plain_slugs(items, owned):
    seen, out = set(), []
    for base, source in items:
        n = 1
        while True:
            slug = base if n == 1 else f"{base}-{n}"
            if slug not in seen and owned.get(slug, source) == source:
                break
            n += 1
        seen.add(slug)
        out.append(slug)
    return out


def test_slugs_match_a_plain_loop(spark):
    rng = random.Random(4)
    for _ in range(6):
        items = [(rng.choice(["x", "x-2", "x-2-3", "y", "x-3", "y-2"]), f"/s{k}") for k in range(40)]
        owned = {rng.choice(["x", "x-2", "x-4", "y-2", "y-3"]): f"/s{rng.randrange(40)}" for _ in range(4)}
        df = spark.createDataFrame([(b, s, k) for k, (b, s) in enumerate(items)], "base string, source_path string, position int")
        held = spark.createDataFrame(list(owned.items()), "slug string, source_path string")
        got = {r["source_path"]: r["slug"] for r in identity.assign_slugs(df, held).collect()}
        assert [got[s] for _, s in items] == plain_slugs(items, owned)


def test_a_common_slug_is_numbered_without_gathering_it(spark, monkeypatch):
    placed, numbers = [], identity._numbers

    def watched(ranked, slots):
        placed.append({r["base"] for r in ranked.collect()})
        return numbers(ranked, slots)

    monkeypatch.setattr(identity, "_numbers", watched)
    rng = random.Random(5)
    # x and x-2 share a slug; what x then gets is x-4, which is shared too.
    items = [(b, f"/s{k}") for k, b in enumerate(["x", "x-2", "x", "x", "x-4", *["book"] * 300, "book-400", "book-x"])]
    rng.shuffle(items)
    df = spark.createDataFrame([(b, s, k) for k, (b, s) in enumerate(items)], "base string, source_path string, position int")
    got = {r["source_path"]: r["slug"] for r in identity.assign_slugs(df).collect()}
    assert [got[s] for _, s in items] == plain_slugs(items, {})
    assert placed == [{"x", "x-2", "x-4"}]


def test_tracks_by_number_or_by_name(spark):
    df = spark.createDataFrame([("a", 2, "A.mp3"), ("a", 1, "b.mp3"), ("b", 1, "Z.mp3"), ("b", 1, "a.mp3"), ("c", None, "B.mp3"), ("c", 1, "a.mp3")], "dir string, track int, name string")
    got = rows(feed.track_order(df, ["dir"], "track", "name"), "dir", "idx", "name")
    assert got == [("a", 0, "b.mp3"), ("a", 1, "A.mp3"), ("b", 0, "a.mp3"), ("b", 1, "Z.mp3"), ("c", 0, "a.mp3"), ("c", 1, "B.mp3")]


GOOD = ("f", 0, "1", "u", "10", "00:01:00", "Thu, 01 Jan 1970 00:00:00 +0000")
ITEM = "feed string, pos int, episode string, enclosure_url string, enclosure_length string, duration string, pub_date string"


@pytest.mark.parametrize(
    ("change", "problem"),
    [({3: None, 4: None}, "missing_enclosure"), ({4: " 0 "}, "missing_length"), ({4: ""}, "missing_length"), ({3: "\t"}, "missing_url"), ({2: "x"}, "missing_episode"), ({2: None}, "missing_episode"), ({5: " "}, "missing_duration"), ({6: "soon"}, "bad_date")],
)
def test_each_problem_is_found(spark, change, problem):
    item = tuple(change.get(k, v) for k, v in enumerate(GOOD))
    found = feed.feed_problems(spark.createDataFrame([("f",)], "feed string"), spark.createDataFrame([item], ITEM))
    assert [r["problem"] for r in found.collect()] == [problem]


def test_clean_empty_and_unordered_feeds(spark):
    later = ("f", 1, "2", "u", "00", "1", "Thu, 01 Jan 1970 00:01:00 +0000")
    same = ("g", 0, "1", "u", "1", "1", "Thu, 01 Jan 1970 00:01:00 +0000")
    items = spark.createDataFrame([GOOD, later, same, ("g", 1, "2", *same[3:])], ITEM)
    feeds = spark.createDataFrame([("f",), ("g",), ("h",)], "feed string")
    found = feed.feed_problems(feeds, items)
    assert rows(found, "feed", "episode", "problem") == [("g", 2, "not_later"), ("h", None, "no_items")]
    assert rows(feed.released(feeds, found), "feed") == [("f",)]


def test_a_cap_drops_the_oldest_like_a_plain_loop(spark):
    rng = random.Random(2)
    for trial in range(4):
        files = [(f"p{k:02}", rng.randrange(1, 9), rng.randrange(6)) for k in range(30)]
        cap, kept = rng.randrange(20, 120), {f"p{rng.randrange(30):02}"}
        total, gone = sum(f[1] for f in files), set()
        for path, length, _ in sorted(files, key=lambda f: (f[2], f[0])):
            if total > cap and path not in kept:
                gone.add(path)
                total -= length
        df = spark.createDataFrame(files, "path string, length long, mtime long")
        assert {r["path"] for r in cache.over_cap(df, cap, F.col("path").isin(*kept)).collect()} == gone, trial


def test_expiry_is_strict_and_spares_the_future(spark):
    df = spark.createDataFrame([("a", 90), ("b", 89), ("c", 500), ("k", 0)], "path string, mtime long")
    assert rows(cache.expired(df, F.lit(100), 10, F.col("path") == "k"), "path") == [("b",)]
    assert cache.expired(df, F.lit(100), None, F.lit(False)).count() == 0


def test_metrics(spark):
    df = spark.createDataFrame([(float(k), "a" if k % 2 else "b") for k in range(1, 11)], "v double, kind string")
    assert metrics.place_percentiles(df, "v", (0.5, 0.95)).first()["p95"] == 9.0
    assert rows(metrics.count_by_kind(df, "kind", ("a", "z")), "kind", "n") == [("a", 5), ("z", 0)]
    assert [r["n"] for r in metrics.cumulative_histogram(df, "v", (1.0, 5.0)).collect()] == [1, 5, 10]
    assert metrics.all_distinct(df, ["kind"], "v").where("NOT usable").count() == 0


def test_a_source_is_fresh_only_if_all_holds(spark):
    base = {"id": "a", "source_mtime": 1, "title": "T", "author": None, "storage_mode": "full", "default_cover_url": None, "force_embedded": False, "transcode": ""}
    want = {"id": "a", **{f"want_{k}": base[k] for k in ("source_mtime", "title", "author", "storage_mode", "default_cover_url", "force_embedded")}, "path": "x.mp3", "mode": "off", "force": False}
    types = {"id": "string", "source_mtime": "long", "title": "string", "author": "string", "storage_mode": "string", "default_cover_url": "string", "force_embedded": "boolean", "transcode": "string", "path": "string", "mode": "string", "force": "boolean"}
    table = lambda row: spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {types[k.removeprefix('want_')]}" for k in row))
    episodes = spark.createDataFrame([("a", 0, "f0", 0.0, "", False), ("a", 1, "f1", 5.0, "", False)], "book_id string, idx long, file_path string, start_sec double, source_path string, needs_faststart boolean")
    files = spark.createDataFrame([("f0",), ("f1",)], "file_path string")
    state = staleness.episode_state(episodes, files, F.lit(False))
    fresh = lambda w, s=state, b=base: staleness.fresh_books(table(w), table(b), s).first()["fresh"]
    assert fresh(want)
    for change in ({"want_title": "U"}, {"want_author": "x"}, {"want_source_mtime": 2}, {"force": True}, {"path": "x.flac", "mode": "mp3"}):
        assert not fresh(want | change), change
    assert not fresh(want, staleness.episode_state(episodes, files.limit(1), F.lit(False)))
    assert not fresh(want, staleness.episode_state(episodes.limit(0), files, F.lit(False)))


def plan_of_large(spark, df):
    """The physical plan where no side is small enough to be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_children_are_not_sorted_to_lose_their_parents(spark):
    parents, children = spark.range(20), spark.range(60).select((F.col("id") % 20).alias("parent"), F.col("id").alias("n"))
    left, rest = mutations.delete_cascade(parents, children, parents.where("id < 5").union(parents.where("id < 3")), "id", "parent")
    fresh = children.where("parent >= 15 AND n < 20").withColumn("n", -F.col("n"))
    replaced = mutations.replace_children(children, fresh, "parent")
    for df in (left, rest, replaced):
        assert "ShuffledHashJoin" in (plan := plan_of_large(spark, df)) and "SortMergeJoin" not in plan
    assert (left.count(), rest.count(), rest.where("parent < 5").count()) == (15, 45, 0)
    assert sorted(r["n"] for r in replaced.where("parent >= 15").collect()) == [-19, -18, -17, -16, -15] and replaced.count() == 50


def test_freshness_sorts_nothing_and_keeps_few_files_in_place(spark):
    ids = spark.range(8).select(F.col("id").cast("string").alias("id"))
    named = {"source_mtime": F.lit(1), "title": F.col("id"), "author": F.lit(None).cast("string"), "storage_mode": F.lit("full"), "default_cover_url": F.lit(""), "force_embedded": F.lit(False)}
    books = ids.withColumns(named | {"transcode": F.lit("off")})
    wanted = ids.withColumns({f"want_{k}": v for k, v in named.items()} | {"path": F.lit("x.m4b"), "mode": F.lit("off"), "force": F.col("id") == "3"})
    episodes = spark.range(24).select((F.col("id") % 6).cast("string").alias("book_id"), F.col("id").alias("idx"), F.concat(F.lit("f"), (F.col("id") % 4).cast("string")).alias("file_path"), F.lit(1.0).alias("start_sec"), F.lit("").alias("source_path"), F.lit(False).alias("needs_faststart"))
    state = staleness.episode_state(episodes, spark.createDataFrame([("f0",), ("f2",), ("f2",)], "file_path string"), F.lit(False))
    assert "BroadcastHashJoin" in state._jdf.queryExecution().executedPlan().toString()
    out = staleness.fresh_books(wanted, books, state)
    assert "SortMergeJoin" not in plan_of_large(spark, staleness.fresh_books(wanted, books, spark.createDataFrame([], state.schema)))
    assert {r["id"]: r["fresh"] for r in out.collect()} == {str(k): k in (0, 2, 4) for k in range(8)}


def test_items_are_gathered_without_their_texts(spark):
    books = spark.createDataFrame([(k, f"b{k}", 1_000_000 + k) for k in range(4)], "id long, title string, source_mtime long")
    episodes = spark.createDataFrame([("", k % 3, k // 3, f"e<{k}", 60.0 * k, 0, "", k) for k in range(14)], "guid string, book_id long, idx long, title string, duration_sec double, pubdate_epoch long, source_path string, byte_length long")
    fields = ["episode_title", "duration_sec", "byte_length", "guid", "pub_date", "duration", "episode"]
    plain = feed.nested(feed.feed_items(books, episodes), ["id", "title"], "idx", fields)
    got = feed.nested_feed_items(books, episodes)
    texts = lambda df: {(r["id"], r["title"]): [tuple(x[f] for f in fields) for x in r["items"]] for r in df.collect()}
    assert texts(got) == texts(plain) and texts(got)[3, "b3"] == []
    gathered = [line for line in got._jdf.queryExecution().executedPlan().toString().split("\n") if "collect_list" in line]
    assert gathered and not any("sha2" in line or "date_format" in line or "guid" in line for line in gathered)
