import pytest
from pyspark.sql import functions as F

from skeinworks.functions import media, numbers, parsers, text


def one(spark, column, **values):
    """The value of a column expression over one row of literals."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "expected"),
    [("Hello, World!", "hello-world"), ("--A  b--", "a-b"), ("", "book"), ("日本", "book"), ("İx", "x"), ("Été 2", "t-2"), ("a-2", "a-2")],
)
def test_slugify(spark, given, expected):
    assert one(spark, text.slugify(F.lit(given))) == expected


@pytest.mark.parametrize(
    ("path", "stem", "ext"),
    [("a/b.c.MP3", "b.c", "mp3"), (".hidden", ".hidden", None), ("noext", "noext", None), ("x/.y.m4b", ".y", "m4b"), ("d.e/f", "f", None)],
)
def test_paths(spark, path, stem, ext):
    assert one(spark, F.struct(text.file_stem(F.lit(path)), text.extension(F.lit(path)))) == (stem, ext)


def test_names(spark):
    assert one(spark, text.nested_prefix(F.lit("a/b"))) == "a - b"
    assert one(spark, text.nested_prefix(F.lit("a"))) is None
    assert one(spark, text.episode_file_name(F.lit(0), F.lit("mp3"))) == "001.mp3"
    assert one(spark, text.episode_file_name(F.lit(1233), F.lit("mp3"))) == "1234.mp3"
    assert one(spark, text.part_path(F.lit("a.b/c.mp3"))) == "a.b/c.part.mp3"
    assert one(spark, text.part_path(F.lit("a.b/c"))) == "a.b/c.part"
    assert one(spark, text.is_episode_stem(F.lit("001.part"))) is True
    assert one(spark, text.is_episode_stem(F.lit("a1"))) is False
    assert one(spark, text.chapter_title(F.lit(""), F.lit(2))) == "Chapter 3"
    assert one(spark, text.initial(F.lit(""))) == "?"
    assert one(spark, text.initial(F.lit("éa"))) == "É"


def test_urls(spark):
    assert one(spark, text.percent_encode(F.lit("a b~*é/:+"))) == "a%20b~%2A%C3%A9%2F%3A%2B"
    assert one(spark, text.strip_scheme(F.lit("https://http://x"))) == "http://x"
    assert one(spark, text.strip_scheme(F.lit("HTTP://x"))) == "HTTP://x"
    assert one(spark, text.base_url(F.lit("http://x///"), "d")) == "http://x"
    links = one(spark, text.subscribe_links(F.lit("http://h/f.xml")))
    assert len(links) == 6
    assert links[1]["link"] == "overcast://x-callback-url/add?url=http%3A%2F%2Fh%2Ff.xml"
    assert one(spark, text.media_type(F.lit("x.OGA"))) == "audio/ogg"
    assert one(spark, text.media_type(F.lit("x"), image=True)) == "image/jpeg"


def test_allow_lists(spark):
    assert one(spark, text.is_slug(F.lit("a-1"))) and not one(spark, text.is_slug(F.lit("a\n")))
    assert one(spark, text.is_capability(F.lit("x" * 64))) and not one(spark, text.is_capability(F.lit("x" * 65)))


@pytest.mark.parametrize(
    ("seconds", "expected"),
    [(0.0, "00:00:00"), (59.5, "00:01:00"), (3661.4, "01:01:01"), (360000.0, "100:00:00"), (-5.0, "00:00:00"), (float("nan"), "00:00:00"), (float("inf"), "00:00:00")],
)
def test_clock(spark, seconds, expected):
    assert one(spark, numbers.clock(F.lit(seconds))) == expected


def test_dates_round_trip(spark):
    for epoch in (0, 1_700_000_000, 951_782_400):
        written = one(spark, numbers.rfc2822(F.lit(epoch)))
        assert written.endswith("+0000")
        assert one(spark, numbers.parse_rfc2822(F.lit(written))) == epoch
    assert one(spark, numbers.parse_rfc2822(F.lit("yesterday"))) is None


@pytest.mark.parametrize(
    ("given", "size", "error"),
    [("1k", 1024, None), (" 1.5 MiB ", 1572864, None), ("off", None, None), ("", None, None), ("0", None, None), ("0.2", None, None), ("-1k", None, "negative"), ("5x", None, "unit"), ("1e3", None, "unit"), ("abc", None, "number"), ("2tb", 2 << 40, None)],
)
def test_sizes(spark, given, size, error):
    assert one(spark, numbers.parse_size(F.lit(given))) == (size, error)


@pytest.mark.parametrize(
    ("given", "seconds", "error"),
    [("30d", 2_592_000, None), ("90", 90, None), ("2 weeks", 1_209_600, None), ("never", None, None), ("1.5h", None, "number"), ("3y", None, "unit"), ("9999999999999999999w", (1 << 63) - 1, None)],
)
def test_durations(spark, given, seconds, error):
    assert one(spark, numbers.parse_duration(F.lit(given))) == (seconds, error)


def test_numbers_in_text(spark):
    assert one(spark, numbers.whole(F.lit(" 5"))) is None
    assert one(spark, numbers.decimal(F.lit("5d"))) is None
    assert one(spark, numbers.track_number(F.lit(" 07/12"))) == 7
    assert one(spark, numbers.track_number(F.lit("4294967296"))) is None
    assert one(spark, numbers.track_number(F.lit("x"))) is None
    assert one(spark, numbers.cue_seconds(F.lit("01:02:75"))) == 63.0
    assert one(spark, numbers.cue_seconds(F.lit("01:02"))) is None
    assert one(spark, numbers.cue_seconds(F.lit("00:10.5:00"))) == 10.5
    assert one(spark, numbers.cue_seconds(F.lit("1:2:3:4"))) == 62.04
    assert one(spark, numbers.cue_seconds(F.lit("1: 2:3"))) is None


def chapters(found):
    return [(c["idx"], c["start_sec"], c["end_sec"], c["title"]) for c in found]


def test_cue(spark):
    sheet = 'TITLE "Album"\r\nTRACK 01 AUDIO\r\n  title "One"\r\n  INDEX 00 00:00:00\r\n  INDEX 01 00:10:00\r\nTRACK 02 AUDIO\r\n TITLE Two\r\n INDEX 01 00:05:00\r\n INDEX 01 00:04:00\r\nTRACK 03 AUDIO\r\n INDEX 01 bad\r\nTRACK 04 AUDIO\r\n INDEX 01 00:10:00\r\n'
    found = chapters(one(spark, parsers.parse_cue(F.lit(sheet), F.lit(7.0))))
    assert found == [(0, 4.0, 10.0, "Two"), (1, 10.0, 10.0, "One"), (2, 10.0, 10.0, None)]
    assert one(spark, parsers.parse_cue(F.lit("nothing"), F.lit(7.0))) == []


def test_ffmeta(spark):
    doc = ";FFMETADATA1\ntitle=x\n[CHAPTER]\nSTART=0\nTIMEBASE=1/10\nEND=50\ntitle=One\n[chapter]\nSTART=5000\nEND=9000\n[STREAM]\ntitle=no\n[CHAPTER]\nTIMEBASE=1/0\nSTART=9000\nEND=9500\ntitle=\n"
    assert chapters(one(spark, parsers.parse_ffmeta(F.lit(doc)))) == [(0, 0.0, 5.0, "One"), (1, 5.0, 9.0, None), (2, 9.0, 9.5, None)]


def test_ffmeta_title_of_a_dropped_block_stays_for_the_next(spark):
    doc = "[CHAPTER]\nSTART=0\ntitle=lost\n[CHAPTER]\nSTART=1000\nEND=2000\n"
    assert chapters(one(spark, parsers.parse_ffmeta(F.lit(doc)))) == [(0, 1.0, 2.0, "lost")]


def test_probe(spark):
    doc = '{"streams":[{"codec_type":"video","codec_name":"png","disposition":{"attached_pic":1}},{"codec_type":"audio","codec_name":"aac","duration":"9.5"}],"chapters":[{"start_time":"0","end_time":"4","tags":{"title":""}},{"start_time":"4","end_time":"9"}],"format":{"duration":"x","tags":{"track":"3/9","title":"T"}},"more":1}'
    p = one(spark, parsers.parse_probe(F.lit(doc)))
    assert (p["codec"], p["cover_codec"], p["duration_sec"], p["track"], p["title"], p["error"]) == ("aac", "png", 9.5, 3, "T", None)
    assert chapters(p["chapters"]) == [(0, 0.0, 4.0, None), (1, 4.0, 9.0, None)]
    errors = {"{": "json", "[]": "json", '{"streams":[]}': "no_audio", '{"streams":[{"codec_type":"audio"}],"chapters":[{"start_time":"a","end_time":"1"}]}': "chapter_time", '{"streams":[{"codec_type":"audio"}]}': "duration"}
    for bad, error in errors.items():
        assert one(spark, parsers.parse_probe(F.lit(bad)))["error"] == error


def test_chapter_priority(spark):
    some = F.lit([]).cast(parsers.CHAPTERS)
    cue = parsers.parse_cue(F.lit("TRACK 1\nINDEX 01 00:00:00"), F.lit(5.0))
    meta = parsers.parse_ffmeta(F.lit("[CHAPTER]\nSTART=0\nEND=1\n"))
    source = lambda a, b, force: one(spark, parsers.resolve_chapters(a, b, some, F.lit(force)))["source"]
    assert source(cue, meta, False) == "cue"
    assert source(some, meta, False) == "ffmeta"
    assert source(some, some, False) == "embedded"
    assert source(cue, meta, True) == "embedded"


def test_parsers_never_raise(spark):
    junk = ["", "\x00", "[CHAPTER]", "TRACK \nINDEX 01 \n", "=\n=", "[CHAPTER]\nTIMEBASE=/\nSTART==", '{"streams":null}', "INDEX 01 1:2:3", "TRACK 1\nTITLE \nINDEX 01 99999999999999999999:1:1"]
    df = spark.createDataFrame([(j,) for j in junk], "t string")
    t = F.col("t")
    assert len(df.select(parsers.parse_cue(t, F.lit(1.0)), parsers.parse_ffmeta(t), parsers.parse_probe(t)).collect()) == len(junk)


def test_media_decisions(spark):
    assert one(spark, media.encoding(F.lit("flac"), F.lit("aac"))) == "aac"
    assert one(spark, media.encoding(F.lit("mp3"), F.lit("aac"))) == "copy"
    assert one(spark, media.episode_extension(F.lit("vorbis"), F.lit("off"))) == "ogg"
    assert one(spark, media.expected_transcode(F.lit("x.m4b"), F.lit("mp3"))) is None
    assert one(spark, media.expected_transcode(F.lit("x.flac"), F.lit("mp3"))) == "mp3"
    assert one(spark, media.expected_transcode(F.lit("x.m4b"), F.lit("off"))) == "off"
    assert one(spark, media.ignored_overrides({"a": F.lit(None), "b": F.lit(1)})) == ["b"]


def test_sizes_and_durations_compile(spark):
    # Code that is too large for the compiler runs interpreted, some ten times slower.
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        c = F.concat(F.col("id").cast("string"), F.lit(" KiB"))
        rows = spark.range(3).select(numbers.parse_size(c).alias("a"), numbers.parse_duration(F.concat(F.col("id").cast("string"), F.lit(" Min "))).alias("b")).select("a.*", "b.seconds").collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert [tuple(r) for r in rows] == [(None, None, None), (1024, None, 60), (2048, None, 120)]
