import os
import random
import time

from pyspark.sql import functions as F

from skeinworks.functions.text import slugify
from skeinworks.operators import feed
from skeinworks.sources import snapshots, tables, walk
from skeinworks.streaming import source, watch


def touch(path, text="x", at=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    if at:
        os.utime(path, (at, at))


def test_differences_of_two_listings():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ({f"p{rng.randrange(30)}": (rng.randrange(2), rng.randrange(2)) for _ in range(rng.randrange(15))} for _ in range(2))
        side = lambda x: iter(sorted((k, *v) for k, v in x.items()))
        got = {e[0]: (kind, e[1:]) for kind, e in snapshots.differences(side(a), side(b))}
        want = {k: ("create", b[k]) for k in b.keys() - a.keys()} | {k: ("remove", a[k]) for k in a.keys() - b.keys()}
        want |= {k: ("modify", b[k]) for k in a.keys() & b.keys() if a[k] != b[k]}
        assert got == want


def run(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_changes_come_once_over_restarts(spark, tmp_path):
    root, log, out, check = tmp_path / "lib", str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "check")
    touch(root / "a/1.mp3")
    touch(root / "b/_2.m4b")
    assert snapshots.take_snapshot(spark, str(root), log, buckets=3) == 1
    assert snapshots.take_snapshot(spark, str(root), log) == 1  # nothing changed

    def follow():
        stream = source.folder_changes(spark, log, start=1)
        run(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start())
        return sorted((r["version"], r["kind"], r["path"]) for r in spark.read.parquet(out).collect()) if os.listdir(out) != ["_spark_metadata"] else []

    assert follow() == []
    touch(root / "c/3.mp3")
    touch(root / "a/1.mp3", "longer")
    assert snapshots.take_snapshot(spark, str(root), log) == 2
    first = [(2, "create", "c/3.mp3"), (2, "modify", "a/1.mp3")]
    assert follow() == first and follow() == first
    (root / "b/_2.m4b").unlink()
    assert snapshots.take_snapshot(spark, str(root), log) == 3
    touch(root / "b/_2.m4b")
    touch(root / "c/3.mp3", "also longer")
    assert snapshots.take_snapshot(spark, str(root), log) == 4
    # Both snapshots in one batch: what differs between their ends. The file's time may be that of before.
    assert [x for x in follow() if x[2] != "b/_2.m4b"] == sorted([*first, (4, "modify", "c/3.mp3")])
    everything = spark.read.parquet(out).count()
    # A new query from the start sees what is there now.
    stream = source.folder_changes(spark, log)
    run(stream.writeStream.format("memory").queryName("all_changes").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start())
    assert sorted((r["kind"], r["path"]) for r in spark.table("all_changes").collect()) == [("create", "a/1.mp3"), ("create", "b/_2.m4b"), ("create", "c/3.mp3")]
    follow()
    assert spark.read.parquet(out).count() == everything


def test_a_burst_settles_once(tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    reader = source.ChangesReader({"log": log, "quiet": "2", "startingVersion": "0"})
    now = [1000.0]
    monkeypatch.setattr(time, "time", lambda: now[0])
    assert reader.latestOffset() == reader.initialOffset() == {"version": 0}
    seen = []
    for at in (1000, 1001, 1002.5, 1006, 1007):
        now[0] = at
        seen.append(reader.latestOffset()["version"])
        base = tables.newest(log)
        tables.commit(log, {}, base, note={"buckets": 1})
    assert seen == [0, 0, 0, 3, 3]
    now[0] = 1008.9
    assert reader.latestOffset() == {"version": 3}
    now[0] = 1009
    assert reader.latestOffset() == {"version": 5} and len(reader.partitions({"version": 3}, {"version": 5})) == 1
    assert reader.partitions({"version": 5}, {"version": 5}) == []


def make_scan(root, seen, meanwhile=lambda: None):
    """Each source a book with one episode; ``seen`` gets the sources of each scan."""

    def scan(listing, books):
        found = walk.books_of(listing, str(root))
        seen.append(sorted(os.path.relpath(r["source_path"], os.path.realpath(root)) for r in found.collect()))
        meanwhile()
        null = F.lit(None).cast("string")
        made = found.select(
            F.sha2("source_path", 256).alias("id"), slugify(F.col("path")).alias("slug"), F.expr("uuid()").alias("feed_id"), F.col("path").alias("title"), null.alias("author"), null.alias("cover_path"),
            "source_path", F.lit(1).cast("long").alias("source_mtime"), F.lit("saver").alias("storage_mode"), null.alias("default_cover_url"), F.lit(False).alias("force_embedded"),
            F.lit("").alias("transcode"), F.lit(len(seen)).cast("long").alias("created_at"),
        )
        zero = F.lit(0).cast("long")
        children = made.select(
            F.concat("id", F.lit("-0")).alias("guid"), F.col("id").alias("book_id"), zero.alias("idx"), "title", F.col("source_path").alias("file_path"), zero.alias("byte_length"), F.lit(1.0).alias("duration_sec"),
            F.lit(0.0).alias("start_sec"), zero.alias("pubdate_epoch"), "source_path", F.lit(False).alias("needs_faststart"),
        )
        return found.select("source_path"), made, children

    return scan


def state(spark, home):
    books, episodes = watch.catalogue(spark, home)
    return sorted((r["title"], r["feed_id"], r["created_at"]) for r in books.collect()), sorted(r["title"] for r in episodes.collect())


def test_what_changes_during_the_first_scan_is_indexed_once(spark, tmp_path):
    root, home, seen, ready = tmp_path / "lib", str(tmp_path / "home"), [], []
    touch(root / "A/a.m4b")
    touch(root / "B/b.m4b")

    def meanwhile():
        if len(seen) == 1:
            touch(root / "C/c.m4b")
            (root / "B/b.m4b").unlink()
            snapshots.take_snapshot(spark, str(root), f"{home}/snapshots")

    scan = make_scan(root, seen, meanwhile)
    run(watch.watch_library(spark, str(root), home, scan, quiet=0, once=True, on_ready=lambda: ready.append(len(seen))))
    assert seen == [["A/a.m4b", "B/b.m4b"], ["A/a.m4b", "C/c.m4b"]] and ready == [1]
    books, episodes = state(spark, home)
    assert [(t, c) for t, _, c in books] == [("A/a.m4b", 1), ("C/c.m4b", 2)] and episodes == ["A/a.m4b", "C/c.m4b"]

    # A restart over the same folder: nothing to do, ids and feeds stay.
    run(watch.watch_library(spark, str(root), home, scan, quiet=0, once=True))
    assert len(seen) == 2 and state(spark, home) == (books, episodes)

    # A batch that is run again, as after a crash between the commit and the checkpoint, changes nothing.
    assert watch.take_in(spark, f"{home}/snapshots", f"{home}/catalog", 2, scan) is None
    assert watch.take_in(spark, f"{home}/snapshots", f"{home}/catalog", 1, scan) is None
    assert tables.versions(f"{home}/catalog") == [1, 2]

    # A change that does not matter starts no scan; one that does starts one, also after a pause.
    touch(root / "A/._junk.m4b")
    snapshots.take_snapshot(spark, str(root), f"{home}/snapshots")
    (root / "A/._junk.m4b").unlink()
    snapshots.take_snapshot(spark, str(root), f"{home}/snapshots")
    touch(root / "D/d.mp3")
    run(watch.watch_library(spark, str(root), home, scan, quiet=0, once=True))
    assert [t for t, _, _ in state(spark, home)[0]] == ["A/a.m4b", "C/c.m4b", "D/d.mp3"]


def test_a_live_watch_indexes_a_book_added_after_startup(spark, tmp_path):
    import threading

    root, home, seen, stop = tmp_path / "lib", str(tmp_path / "home"), [], threading.Event()
    root.mkdir()
    query = watch.watch_library(spark, str(root), home, make_scan(root, seen), quiet=0.5)
    poller = threading.Thread(target=watch.keep_polling, args=(spark, str(root), home, stop), kwargs={"every": 0.2})
    poller.start()
    try:
        touch(root / "New/n.m4b")
        until = time.time() + 120
        while time.time() < until and not state(spark, home)[0]:
            time.sleep(1)
        assert [t for t, _, _ in state(spark, home)[0]] == ["New/n.m4b"]
    finally:
        stop.set()
        poller.join(60)
        query.stop()


def test_serving_in_place(spark):
    cases = [("/s", "/s", 5, 5, True), ("/s", "/s", 4, 5, False), ("/s", "/s", None, None, False), ("", "", 5, 5, False), ("/s", "/f", 5, 5, False), (None, "/f", 5, 5, False), (None, None, 5, 5, False)]
    df = spark.createDataFrame(cases, "s string, f string, actual long, recorded long, want boolean")
    got = df.select(feed.may_serve_in_place(*(F.col(c) for c in ("s", "f", "actual", "recorded"))).alias("got"), "want").collect()
    assert all(r["got"] is r["want"] for r in got)
