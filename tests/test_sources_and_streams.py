import datetime

from pyspark.sql import functions as F

from skeinworks.plans import catalog_queries
from skeinworks.sources import listing, tables
from skeinworks.streaming import changes


def files(spark, *paths):
    return spark.createDataFrame([(p, 1, 1) for p in paths], listing.LISTING)


def books(spark, *paths, data_dir=None):
    found = listing.classify(listing.eligible(files(spark, *paths), data_dir))
    return sorted((r["kind"], r["path"]) for r in found.collect())


def test_classification(spark):
    assert books(spark, "a.mp3", "b.mp3", "c.txt") == [("file", "a.mp3"), ("file", "b.mp3")]
    assert books(spark, "x/1.mp3", "x/2.mp3") == [("folder", "x")]
    assert books(spark, "x/1.mp3", "x/2.M4B", "x/3.m4a") == [("file", "x/2.M4B"), ("file", "x/3.m4a")]
    assert books(spark, "x/1.mp3", "x/2.flac") == [("file", "x/1.mp3")]
    assert books(spark, "x/1.flac", "x/2.ogg") == []
    assert books(spark, "x/1.flac") == [("file", "x/1.flac")]
    assert books(spark, "x/1.aax", "x/2.txt") == []


def test_a_book_folder_hides_what_is_below(spark):
    assert books(spark, "a/b.m4b", "a/c/d.m4b", "a/c/e/f.m4b", "g/h/i.mp3") == [("file", "a/b.m4b"), ("file", "g/h/i.mp3")]


def test_folders_passed_over(spark):
    assert books(spark, ".x/a.m4b", "y/@eaDir/a.m4b", "lost+found/b.mp3", "z/._c.m4b") == [("file", "z/._c.m4b")]
    deep = "/".join("abcdefgh")
    assert books(spark, f"{deep}/k.mp3", f"{deep}/i/k.m4b") == [("file", f"{deep}/k.mp3")]
    assert books(spark, "data/a.m4b", "database/b.m4b", data_dir="data") == [("file", "database/b.m4b")]


def test_names_and_sidecars(spark):
    listed = files(spark, "s/t/b.m4b", "s/t/b.CUE", "s/t/b.toml", "u/1.mp3", "u/2.mp3", "u/o.toml", "r.m4b", "o.toml", "s/t/b.Cue")
    found = listing.with_names(listing.classify(listing.eligible(listed)))
    found = listing.with_override_file(listing.with_sidecar(found, listed, ("cue",), "cue"), listed, "o.toml", ".toml")
    got = {r["path"]: (r["base"], r["nested_title"], r["cue"], r["override"]) for r in found.collect()}
    assert got == {"s/t/b.m4b": ("s - t", "t", "s/t/b.CUE", "s/t/b.toml"), "u": ("u", None, None, "u/o.toml"), "r.m4b": ("r", None, None, None)}


def test_paths_sort_by_component(spark):
    df = files(spark, "a b/x", "a/y", "a-b/z")
    assert [r["path"] for r in df.orderBy(listing.path_order(F.col("path"))).collect()] == ["a/y", "a b/x", "a-b/z"]


def box(name, body=b"", size=None):
    return (8 + len(body) if size is None else size).to_bytes(4, "big") + name + body


def test_faststart(spark):
    assert listing.needs_faststart(box(b"ftyp", b"1234") + box(b"mdat", b"x") + box(b"moov"))
    assert not listing.needs_faststart(box(b"ftyp") + box(b"moov") + box(b"mdat"))
    assert not listing.needs_faststart(box(b"mdat") + box(b"moov"))
    assert listing.needs_faststart(box(b"ftyp") + box(b"free", (20).to_bytes(8, "big") + b"abcd", size=1) + box(b"mdat"))
    for bad in (b"", b"\0\0", box(b"ftyp", size=4), box(b"ftyp", size=99), None, box(b"ftyp") * 300 + box(b"mdat")):
        assert not listing.needs_faststart(bad)
    for cut in (box(b"mdat", size=4), box(b"mdat", b"\0\0", size=1), box(b"mdat", (7).to_bytes(8, "big"), size=1)):
        assert not listing.needs_faststart(box(b"ftyp") + cut)
    assert listing.needs_faststart(box(b"ftyp") + box(b"mdat", size=0))
    df = spark.createDataFrame([(bytearray(box(b"ftyp") + box(b"mdat")),)], "content binary")
    assert listing.with_faststart(df).first()["needs_faststart"] is True


def test_tables_are_published_whole(spark, tmp_path):
    where = str(tmp_path / "t")
    df = spark.createDataFrame([("a",)], "x string")
    assert tables.read_or_empty(spark, where, df.schema).count() == 0
    assert tables.publish(df, where) == 1
    (tmp_path / "t" / "v2").mkdir()  # a version whose job was lost
    assert tables.read_or_empty(spark, where, df.schema).count() == 1
    tables.publish(df.union(df), where)
    assert tables.read_or_empty(spark, where, df.schema).count() == 2


def test_listing_reads_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "b.mp3").write_bytes(b"123")
    assert [(r["path"], r["length"]) for r in listing.read_listing(spark, str(tmp_path)).collect()] == [("a/b.mp3", 3)]


def test_event_relevance(spark):
    events = [("access", ["/lib/a"]), ("modify", []), ("modify", ["/lib/.git/x"]), ("modify", ["/lib/.git/x", "/lib/b"]), ("create", ["/data/x"]), ("create", ["/lib/._x.m4b"])]
    df = spark.createDataFrame(events, "kind string, paths array<string>")
    assert [list(r["paths"]) for r in changes.relevant_events(df, "/lib", "/data").collect()] == [[], ["/lib/.git/x", "/lib/b"]]


def test_bursts_on_a_table_and_on_a_stream(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    df = spark.createDataFrame([(at(s),) for s in (0, 1, 3, 6, 20, 100)], "ts timestamp")
    assert sorted(r["n"] for r in changes.bursts(df).collect()) == [1, 1, 1, 3]
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp").parquet(str(tmp_path / "in"))
    seen = []
    query = changes.on_each_burst(changes.bursts(stream, late="1 second"), lambda b, n: seen.extend(r["n"] for r in b.collect()), str(tmp_path / "check"), once=True)
    query.awaitTermination(120)
    assert sorted(seen) == [1, 1, 3]  # the last burst is still open


def test_bursts_of_a_stream_match_those_of_a_table(spark, tmp_path):
    """Without a key: events come in several batches, and bursts run across them."""
    import random

    rng, now, batches = random.Random(3), 0.0, []
    for _ in range(3):
        rows = []
        for _ in range(60):
            now += rng.choice([0.0, 0.3, 0.3, 1.0, 2.0, 2.001, 5.0])
            rows.append(now)
        batches.append(rng.sample(rows, len(rows)))
    batches.append([now + 100])
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=round(1000 * s))
    seen = []
    for rows in batches:
        spark.createDataFrame([(at(s),) for s in rows], "ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("ts timestamp").parquet(str(tmp_path / "in"))
        query = changes.on_each_burst(changes.bursts(stream, late="10 seconds"), lambda b, n: seen.extend(map(tuple, b.collect())), str(tmp_path / "check"), once=True)
        query.awaitTermination(120)
        assert query.exception() is None
    table = spark.read.parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, changes.bursts(table).collect()))
    assert len(want) > 10 and sorted(seen) == want[:-1]  # the last is still open


def test_feed_documents(spark):
    df = spark.createDataFrame([("f", "A & B", [("t<", "g", "d", "u", "1", "audio/mp4", "00:00:01", "1")])], "feed string, title string, items array<struct<title:string,guid:string,pub_date:string,url:string,length:string,type:string,duration:string,episode:string>>")
    xml = tables.feed_documents(df).first()["xml"]
    assert "A &amp; B" in xml and "<title>t&lt;</title>" in xml and xml.count("<item>") == 1


def test_every_query_with_sql_is_registered():
    assert set(catalog_queries.ORACLE) <= set(catalog_queries.QUERIES)
    assert len(catalog_queries.QUERIES) >= 35
