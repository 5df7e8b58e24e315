"""Tables that are published whole: staged folders and a log of manifests, each put in place once.

A version is a manifest ``_log/<number>.json`` that names a staged Parquet folder for every table. Data
is written first, under a name of its own; the manifest makes it visible, all tables together. Of
two writers of one number one gets it, and the other starts again from what that one wrote. Readers
keep the version they began with.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinworks.sources import files

LOG = "_log"
#: Name of the table where there is one alone.
ONLY = "table"


class Conflict(Exception):
    """Another writer has published in the meantime."""


@dataclass(frozen=True)
class Version:
    """What one manifest says. ``steps``: of each named sequence the last number that was taken in."""

    number: int
    folders: dict[str, str]
    at: float
    steps: dict[str, int] = field(default_factory=dict)
    note: dict = field(default_factory=dict)


def _manifest(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/{LOG}/{number:020d}.json"


def versions(path: str) -> list[int]:
    """The numbers of all published versions, in order."""
    found = [n.removesuffix(".json") for n in files.names(f"{path.rstrip('/')}/{LOG}") if n.endswith(".json")]
    return sorted(int(n) for n in found if n.isdigit())


def version(path: str, number: int) -> Version:
    return Version(**json.loads(files.read(_manifest(path, number))))


def newest(path: str) -> Version | None:
    found = versions(path)
    return version(path, found[-1]) if found else None


def read_version(spark: SparkSession, path: str, of: Version | None, schema: T.StructType, name: str = ONLY) -> DataFrame:
    """A table of a version; without version, or without that table, no rows."""
    if of is None or name not in of.folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{of.folders[name]}").select(*schema.names)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, name: str = ONLY) -> DataFrame:
    """The newest published version, or no rows."""
    return read_version(spark, path, newest(path), schema, name)


def stage(tables: dict[str, DataFrame], path: str, by: tuple[str, ...] = ()) -> dict[str, str]:
    """Write tables beside the published ones, where no reader looks; their folders."""
    folders = {name: f"{name}-{uuid.uuid4().hex}" for name in tables}
    for name, df in tables.items():
        df.write.partitionBy(*by).parquet(f"{path.rstrip('/')}/{folders[name]}")
    return folders


def commit(path: str, folders: dict[str, str], base: Version | None, *, steps: dict[str, int] | None = None, note: dict | None = None) -> int:
    """Make staged folders the version after ``base``; ``Conflict`` if there is one already."""
    kept = base.steps if base else {}
    made = Version((base.number if base else 0) + 1, folders, time.time(), kept | (steps or {}), note or {})
    if not files.create_new(_manifest(path, made.number), json.dumps(asdict(made)).encode()):
        raise Conflict(f"{path}: version {made.number} is there")
    return made.number


def publish(df: DataFrame, path: str, *, note: dict | None = None, by: tuple[str, ...] = ()) -> int:
    """Make ``df`` the next version, whatever the one before was; its number."""
    folders = stage({ONLY: df}, path, by)
    while True:
        try:
            return commit(path, folders, newest(path), note=note)
        except Conflict:
            continue


def update(
    spark: SparkSession,
    path: str,
    schemas: dict[str, T.StructType],
    change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]],
    *,
    step: tuple[str, int] | None = None,
    tries: int = 20,
) -> int | None:
    """Publish what ``change`` makes of the newest version's tables; the new version's number.

    A table that it does not return stays as it is. If another writer was faster, it is called again with what that
    one wrote. With ``step`` (a sequence's name, a number) nothing is done if that number or a later one
    was taken in before, and None returned: a repeated call changes nothing.
    """
    for _ in range(tries):
        base = newest(path)
        if step and base and base.steps.get(step[0], step[1] - 1) >= step[1]:
            return None
        after = change({name: read_version(spark, path, base, schema, name) for name, schema in schemas.items()})
        folders = (base.folders if base else {}) | stage(after, path)
        try:
            return commit(path, folders, base, steps={step[0]: step[1]} if step else None)
        except Conflict:
            continue
    raise Conflict(f"{path}: {tries} other writers were faster")


def feed_documents(feeds: DataFrame, items: str = "items") -> DataFrame:
    """``feed`` and ``xml``: each feed's channel with its items, as text.

    ``feeds``: feed, title and an array of (title, guid, pub_date, url, length, type, duration, episode).
    """
    escaped = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))

    def item(x):
        tag = lambda name, c, attrs="": F.concat(F.lit(f"<{name}{attrs}>"), escaped(c), F.lit(f"</{name}>"))
        enclosure = F.concat(F.lit('<enclosure url="'), escaped(x["url"]), F.lit('" length="'), escaped(x["length"]), F.lit('" type="'), escaped(x["type"]), F.lit('"/>'))
        return F.concat(F.lit("<item>"), tag("title", x["title"]), tag("guid", x["guid"], ' isPermaLink="false"'), tag("pubDate", x["pub_date"]), enclosure, tag("itunes:duration", x["duration"]), tag("itunes:episode", x["episode"]), F.lit("</item>"))

    head = '<?xml version="1.0" encoding="utf-8"?><rss version="2.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel><title>'
    xml = F.concat(F.lit(head), escaped(F.col("title")), F.lit("</title>"), F.array_join(F.transform(items, item), ""), F.lit("</channel></rss>"))
    return feeds.select("feed", xml.alias("xml"))
