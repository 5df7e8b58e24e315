"""String functions of the catalogue as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The player links of a feed: name, what stands before the feed's address, its form.
PLAYERS = (
    ("Apple Podcasts", "podcast://", "bare"),
    ("Overcast", "overcast://x-callback-url/add?url=", "encoded"),
    ("Pocket Casts", "pktc://subscribe/", "bare"),
    ("Castro", "castros://subscribe/", "bare"),
    ("AntennaPod", "antennapod-subscribe://", "bare"),
    ("Podcast Addict", "podcastaddict://", "bare"),
)
#: Media types by extension.
AUDIO_TYPES = {"mp3": "audio/mpeg", "flac": "audio/flac", "ogg": "audio/ogg", "oga": "audio/ogg", "opus": "audio/ogg"}
IMAGE_TYPES = {"png": "image/png", "webp": "image/webp"}


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_upper(c: Column) -> Column:
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def slugify(c: Column, empty: str = "book") -> Column:
    """ASCII letters and digits in lower case, every other run one hyphen, none at the ends."""
    hyphened = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "-"), "\\A-|-\\z", "")
    return F.when(hyphened == "", empty).otherwise(F.lower(hyphened))


def slug_root(slug: Column) -> Column:
    """A slug without its numbers at the end: candidates of one root alone can collide."""
    return F.regexp_replace(slug, "(-[0-9]+)*\\z", "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """The folder of a path; empty for a bare name."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*\\z", "")).otherwise("")


def file_stem(path: Column, empty: str = "book") -> Column:
    """The file name without its last extension; a leading dot starts no extension."""
    stem = F.regexp_replace(file_name(path), "(?<!\\A)\\.[^.]*\\z", "")
    return F.when(stem == "", empty).otherwise(stem)


def extension(path: Column) -> Column:
    """The last extension in ASCII lower case; null without one."""
    found = F.regexp_extract(file_name(path), "\\A.+\\.([^.]*)\\z", 1)
    return F.when(file_name(path).rlike("\\A.+\\.[^.]*\\z"), ascii_lower(found))


def nested_prefix(relative: Column) -> Column:
    """The components of a relative folder joined by ' - ' if there are several, else null."""
    parts = F.split(relative, "/")
    return F.when(F.size(parts) > 1, F.array_join(parts, " - "))


def title_or_default(title: Column, *others: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (title, *others)])


def chapter_title(title: Column, idx: Column) -> Column:
    return title_or_default(title, F.concat(F.lit("Chapter "), (idx + 1).cast("string")))


def episode_file_name(idx: Column, ext: Column) -> Column:
    """Counted from 1, three digits at least."""
    return F.format_string("%03d.%s", (idx + 1).cast("long"), ext)


def part_path(path: Column) -> Column:
    """``.part`` before the extension, or at the end without one."""
    with_ext = file_name(path).rlike("\\A.+\\.[^.]*\\z")
    return F.when(with_ext, F.regexp_replace(path, "(\\.[^./]*)\\z", ".part$1")).otherwise(F.concat(path, F.lit(".part")))


def is_episode_stem(stem: Column) -> Column:
    """All digits, apart from a ``.part`` at the end."""
    return F.regexp_replace(stem, "\\.part\\z", "").rlike("\\A[0-9]+\\z")


def percent_encode(c: Column) -> Column:
    """RFC 3986: unreserved characters stay, every other byte is escaped."""
    form = F.url_encode(c)
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        form = F.replace(form, F.lit(a), F.lit(b))
    return form


def strip_scheme(url: Column) -> Column:
    return F.regexp_replace(url, "\\Ahttps?://", "")


def base_url(configured: Column, default: str) -> Column:
    return F.regexp_replace(F.coalesce(configured, F.lit(default)), "/+\\z", "")


def join_url(base: Column, *parts: Column) -> Column:
    return F.concat_ws("/", base, *parts)


def subscribe_link(feed_url: Column, scheme: str, form: str) -> Column:
    return F.concat(F.lit(scheme), percent_encode(feed_url) if form == "encoded" else strip_scheme(feed_url))


def subscribe_links(feed_url: Column) -> Column:
    """An array of (app, link) for a feed, in a fixed order."""
    return F.array(*[F.struct(F.lit(n).alias("app"), subscribe_link(feed_url, s, f).alias("link")) for n, s, f in PLAYERS])


def initial(title: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) == "", "?").otherwise(F.upper(F.left(title, F.lit(1))))


def media_type(path: Column, image: bool = False) -> Column:
    known, default = (IMAGE_TYPES, "image/jpeg") if image else (AUDIO_TYPES, "audio/mp4")
    out, ext = F.lit(default), extension(path)
    for k, v in known.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def known_label(c: Column, labels: tuple[str, ...]) -> Column:
    """The label, or null if it is empty or unknown."""
    return F.when(c.isin(*labels), c)


def unquoted_argument(line: Column) -> Column:
    """What follows the first white space of a line, trimmed, and unquoted if quoted on both sides."""
    rest = F.regexp_replace(F.regexp_extract(line, "\\A\\S*\\s+(?s:(.*))\\z", 1), "\\A\\s+|\\s+\\z", "")
    return F.regexp_replace(rest, '\\A"(?s:(.*))"\\z', "$1")


def is_slug(c: Column) -> Column:
    return c.rlike("\\A[a-z0-9-]+\\z")


def is_capability(c: Column) -> Column:
    return c.rlike("\\A[A-Za-z0-9_-]{1,64}\\z")


def guid(*parts: Column) -> Column:
    """A stable id: the SHA-256 of the parts joined by colons."""
    return F.sha2(F.concat_ws(":", *parts), 256)
