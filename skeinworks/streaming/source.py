"""A stream of the changes of a folder tree, read from the log of its snapshots.

An offset is the number of a snapshot; a batch is what differs between two of them, read part by
part in tasks. Snapshots never change, so a batch that is read again is the same, and a restarted
query goes on where its checkpoint says: no change is lost, none comes twice.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from skeinworks.sources import snapshots, tables

NAME = "folder_changes"
SCHEMA = "kind string, path string, length long, mtime long, ts timestamp, version long"


@dataclass
class Part(InputPartition):
    start: int
    end: int
    bucket: int


class ChangesReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.log = options["log"]
        self.first = int(options.get("startingVersion", "0"))
        self.quiet = float(options.get("quiet", "0"))

    def initialOffset(self) -> dict:
        return {"version": self.first}

    def latestOffset(self) -> dict:
        """The last snapshot that no other followed within ``quiet`` seconds: a burst is one batch.

        What was settled once stays so, whatever comes later; so offsets never go back.
        """
        found, after = tables.versions(self.log), time.time()
        for n in reversed([n for n in found if n > self.first]):
            at = tables.version(self.log, n).at
            if after - at >= self.quiet:
                return {"version": n}
            after = at
        return {"version": self.first}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        if end["version"] <= start["version"]:
            return []
        buckets = tables.version(self.log, end["version"]).note["buckets"]
        return [Part(start["version"], end["version"], k) for k in range(buckets)]

    def read(self, part: Part) -> Iterator[tuple]:
        old, new = (tables.version(self.log, n) if n else None for n in (part.start, part.end))
        at = datetime.fromtimestamp(new.at, UTC)
        sides = (snapshots.bucket_entries(self.log, v, part.bucket) for v in (old, new))
        for kind, entry in snapshots.differences(*sides):
            yield kind, *entry, at, part.end

    def commit(self, end: dict) -> None:
        pass


class FolderChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ChangesReader:
        return ChangesReader(self.options)


def folder_changes(spark: SparkSession, log: str, *, start: int = 0, quiet: float = 0) -> DataFrame:
    """The changes after snapshot ``start`` as a stream, with ``paths`` as events have them."""
    spark.dataSource.register(FolderChanges)
    found = spark.readStream.format(NAME).option("log", log).option("startingVersion", start).option("quiet", quiet).load()
    return found.withColumn("paths", F.array("path"))
