"""Parsers of chapter sidecars and probe documents, as column expressions over the sections of their lines.

Bad input gives nulls, an empty array or an error's name, never an exception.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinworks.functions.numbers import EDGES, cue_seconds, decimal, let, timebase_seconds, track_number, trimmed, whole
from skeinworks.functions.text import unquoted_argument

CHAPTER = "struct<idx:long,start_sec:double,end_sec:double,title:string>"
CHAPTERS = f"array<{CHAPTER}>"
PROBE = (
    "struct<streams:array<struct<codec_type:string,codec_name:string,duration:string,disposition:struct<attached_pic:int>>>,"
    "chapters:array<struct<start_time:string,end_time:string,tags:struct<title:string>>>,"
    "format:struct<duration:string,tags:struct<track:string,title:string>>,_broken:string>"
)


def _chapter(idx: Column, start: Column, end: Column, title: Column) -> Column:
    return F.struct(idx.cast("long").alias("idx"), start.cast("double").alias("start_sec"), end.cast("double").alias("end_sec"), title.cast("string").alias("title"))


#: White space that does not end a line, as in ``trimmed``.
_BLANK = "\\t\\x0B\\f\\r \\x{85}\\x{a0}\\x{2028}\\x{2029}"
_BLANKS = f"[{_BLANK}]*"


def _sections(text: Column, head: str) -> Column:
    """Pieces of a text, each from a line that matches ``head`` up to the next; before the first is what stands before all."""
    return F.split(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), f"\\n(?={_BLANKS}{head})")


def _of_last_line(section: Column, line: str) -> Column:
    """The group of a section's last line, its head aside, that matches; empty if none does."""
    return F.regexp_extract(section, f"(?is)\\A.*\\n{_BLANKS}{line}", 1)


def _last(values: Column) -> Column:
    """The last that is not null."""
    return F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(-1))


def parse_cue(text: Column, duration: Column) -> Column:
    """Chapters of a cue sheet: tracks with an ``INDEX 01``, by start, each up to the next one's.

    The last goes up to ``duration``, or nowhere if it starts later. Keywords are caseless and
    followed by a blank; of several indexes in a track the last that parses counts, as does the last of several
    titles; a title before the first track does not.
    """
    more = f"[^\\n]*[^\\n{_BLANK}]"

    def seconds(rest: Column) -> Column:
        return cue_seconds(F.get(F.split(F.rtrim(rest, F.lit(EDGES)), "\\s+"), 0))

    def track(section: Column) -> Column:
        times = F.transform(F.regexp_extract_all(section, F.lit(f"(?i)\\n{_BLANKS}INDEX 01 [\\t\\x0B\\f\\r ]*([^\\n]*)"), 1), seconds)
        title = F.nullif(_of_last_line(section, f"(TITLE {more})"), F.lit(""))
        return F.struct(_last(times).alias("start"), unquoted_argument(title).alias("title"))

    def chapters(starts: Column) -> Column:
        end = lambda t, k: F.coalesce(F.get(starts, k + 1)["start"], F.greatest(duration, t["start"]))
        return F.transform(starts, lambda t, k: _chapter(k, t["start"], end(t, k), F.nullif(t["title"], F.lit(""))))

    tracks = let(_sections(text, f"(?i:TRACK ){more}"), lambda found: F.transform(F.slice(found, 2, F.size(found)), track))
    placed = F.transform(tracks, lambda t, k: F.struct(t["start"].alias("start"), k.alias("k"), t["title"].alias("title")))
    return let(F.sort_array(F.filter(placed, lambda t: t["start"].isNotNull())), chapters).cast(CHAPTERS)


def parse_ffmeta(text: Column) -> Column:
    """Chapters of an ffmetadata file, in order, as its blocks give them.

    A block's time base, 1/1000 unless given, holds for all of it whatever the order of its keys. A
    block without start or end is dropped, but its title stays for the next block without one.
    """

    def base(value: Column) -> Column:
        parts = F.struct(let(F.regexp_extract(value, "\\A([^/]*)/", 1), decimal).alias("num"), let(F.regexp_extract(value, "\\A[^/]*/(.*)\\z", 1), decimal).alias("den"))
        return let(parts, lambda p: F.when(p["num"].isNotNull() & (p["den"] != 0), p))

    def block(section: Column) -> Column:
        last = lambda key: let(_of_last_line(section, f"{key}{_BLANKS}(=[^\\n]*)"), lambda x: F.when(x != "", trimmed(F.substring(x, F.lit(2), F.length(x)))))
        number = lambda key: let(last(key), whole).cast("double")
        bases = F.regexp_extract_all(section, F.lit(f"(?i)\\n{_BLANKS}timebase{_BLANKS}=([^\\n]*)"), 1)
        unit = _last(F.transform(bases, lambda x: let(trimmed(x), base)))
        times = F.struct(number("start").alias("start"), number("end").alias("end"), unit.alias("unit"), last("title").alias("title"))
        at = lambda t, key: timebase_seconds(t[key], t["unit"]["num"], t["unit"]["den"])
        return let(times, lambda t: F.struct(at(t, "start").alias("start"), at(t, "end").alias("end"), t["title"].alias("title")))

    def chapters(blocks: Column) -> Column:
        done = F.transform(blocks, lambda b, i: F.when(b["start"].isNotNull() & b["end"].isNotNull(), i).otherwise(-1))

        def made(ends: Column) -> Column:
            def chapter(i: Column, k: Column) -> Column:
                # The last title since the chapter before.
                first = F.coalesce(F.get(ends, k - 1), F.lit(-1)) + 1
                title = _last(F.transform(F.slice(blocks, first + 1, i - first + 1), lambda b: b["title"]))
                return _chapter(k, F.get(blocks, i)["start"], F.get(blocks, i)["end"], F.nullif(title, F.lit("")))

            return F.transform(ends, chapter)

        return let(F.array_remove(done, -1), made)

    own = F.filter(_sections(text, "\\["), lambda s: s.rlike(f"(?i)\\A{_BLANKS}\\[CHAPTER\\]{_BLANKS}(\\n|\\z)"))
    return let(F.transform(own, block), chapters).cast(CHAPTERS)


def resolve_chapters(cue: Column, ffmeta: Column, embedded: Column, force_embedded: Column) -> Column:
    """The chapters that count and where they are from: a cue sheet, ffmetadata, or the file itself."""
    some = lambda c: (F.size(F.coalesce(c, F.array().cast(CHAPTERS))) > 0) & ~F.coalesce(force_embedded, F.lit(False))
    return (
        F.when(some(cue), F.struct(F.lit("cue").alias("source"), cue.alias("chapters")))
        .when(some(ffmeta), F.struct(F.lit("ffmeta").alias("source"), ffmeta.alias("chapters")))
        .otherwise(F.struct(F.lit("embedded").alias("source"), F.coalesce(embedded, F.array().cast(CHAPTERS)).alias("chapters")))
    )


def parse_probe(text: Column) -> Column:
    """A probe document as a struct: codec, cover codec, duration, track, title, chapters and error.

    ``error`` names the first that holds: json, no_audio, chapter_time, duration. The duration is the
    format's, else the audio stream's, else the last chapter's end.
    """
    doc = F.from_json(text, PROBE, {"columnNameOfCorruptRecord": "_broken"})
    audio = F.get(F.filter(doc["streams"], lambda s: s["codec_type"] == "audio"), 0)
    cover = F.get(F.filter(doc["streams"], lambda s: (s["codec_type"] == "video") & (s["disposition"]["attached_pic"] == 1)), 0)
    listed = F.coalesce(doc["chapters"], F.array().cast("array<struct<start_time:string,end_time:string,tags:struct<title:string>>>"))
    chapters = F.transform(listed, lambda c, k: _chapter(k, decimal(c["start_time"]), decimal(c["end_time"]), F.nullif(c["tags"]["title"], F.lit(""))))
    bad_time = F.exists(chapters, lambda c: c["start_sec"].isNull() | c["end_sec"].isNull())
    duration = F.coalesce(decimal(doc["format"]["duration"]), decimal(audio["duration"]), F.try_element_at(F.filter(chapters, lambda c: c["end_sec"].isNotNull()), F.lit(-1))["end_sec"])
    error = F.when(doc.isNull() | doc["_broken"].isNotNull() | ~F.coalesce(F.trim(text), F.lit("")).startswith("{"), "json").when(audio.isNull(), "no_audio").when(bad_time, "chapter_time").when(duration.isNull(), "duration")
    return F.struct(
        audio["codec_name"].alias("codec"),
        cover["codec_name"].alias("cover_codec"),
        duration.alias("duration_sec"),
        track_number(doc["format"]["tags"]["track"]).alias("track"),
        F.nullif(doc["format"]["tags"]["title"], F.lit("")).alias("title"),
        chapters.cast(CHAPTERS).alias("chapters"),
        error.alias("error"),
    )
