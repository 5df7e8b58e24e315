"""Decisions about codecs, containers and settings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinworks.functions.text import extension, file_stem, title_or_default

#: Labels, and containers by codec.
STORAGE_MODES = ("full", "saver")
TRANSCODES = ("off", "aac", "mp3")
CONTAINERS = {"mp3": "mp3", "flac": "flac", "vorbis": "ogg", "opus": "opus"}
REENCODED = {"aac": "m4a", "mp3": "mp3"}
TIER_TWO = ("flac", "ogg", "oga", "opus")


def _mapped(c: Column, known: dict[str, str], default: Column) -> Column:
    out = default
    for k, v in known.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def container(codec: Column) -> Column:
    return _mapped(codec, CONTAINERS, F.lit("m4a"))


def is_podcast_safe(codec: Column) -> Column:
    """An unknown codec counts as safe."""
    return codec.isNull() | codec.isin("mp3", "aac")


def encoding(codec: Column, mode: Column) -> Column:
    return F.when(is_podcast_safe(codec) | (mode == "off"), "copy").otherwise(mode)


def episode_extension(codec: Column, mode: Column) -> Column:
    return _mapped(encoding(codec, mode), REENCODED, container(codec))


def expected_transcode(path: Column, mode: Column) -> Column:
    """What a source should have been made with, judged by its extension; null: cannot be known."""
    ext = extension(path)
    return F.when(mode == "off", "off").when(ext.isin(*TIER_TWO), mode).when(ext == "mp3", "off")


def cover_extension(codec: Column) -> Column:
    return F.when(codec == "png", "png").otherwise("jpg")


def effective(*levels: Column) -> Column:
    """The setting of the nearest level that has one."""
    return F.coalesce(*levels)


def cover_url(own: Column, per_book: Column, server: Column) -> Column:
    return F.coalesce(own, per_book, server)


def base_name(nested: Column, path: Column) -> Column:
    return F.coalesce(nested, file_stem(path))


def book_title(override: Column, nested: Column, path: Column) -> Column:
    return title_or_default(override, nested, file_stem(path))


def ignored_overrides(settings: dict[str, Column]) -> Column:
    """The names of the settings that are given, in order."""
    named = [F.when(c.isNotNull(), F.lit(name)) for name, c in settings.items()]
    return F.filter(F.array(*named), lambda x: x.isNotNull())
