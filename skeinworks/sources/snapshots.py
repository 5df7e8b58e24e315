"""Snapshots of a folder tree: versions of its listing, and what differs between two of them."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import merge

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinworks.runtime import materialize
from skeinworks.sources import files, tables
from skeinworks.sources.walk import walk

#: Parts of a snapshot; fixed when a log begins.
BUCKETS = 16
LISTED = T.StructType().add("path", "string").add("length", "long").add("mtime", "long").add("real_path", "string").add("real_folder", "string")


def take_snapshot(spark: SparkSession, root: str, log: str, data_dir: str | None = None, *, buckets: int = BUCKETS, **settings) -> int:
    """Walk ``root`` and publish its listing as the next version of ``log``; the number of the version that shows it.

    A listing equal to the newest one is not published again. Parts are dealt by a hash of the path
    and ordered by it, so that two snapshots are compared part by part, each read once. A file whose length and
    time (in seconds) stay the same counts as unchanged.
    """
    found = materialize(walk(spark, root, data_dir, stop_at_books=False, **settings).select(*LISTED.names), "snapshot")
    row = F.xxhash64(*LISTED.names)
    n, total, mixed = found.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(row))).first()
    digest = f"{n}:{total}:{mixed}"
    last = tables.newest(log)
    if last and last.note["digest"] == digest:
        return last.number
    buckets = last.note["buckets"] if last else buckets
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int"))
    dealt = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "path")
    return tables.publish(dealt, log, note={"digest": digest, "buckets": buckets}, by=("bucket",))


def read_snapshot(spark: SparkSession, log: str, number: int) -> DataFrame:
    """The listing of a version; version 0 has no files."""
    of = tables.version(log, number) if number else None
    return tables.read_version(spark, log, of, LISTED)


Entry = tuple[str, int, int]


def bucket_entries(log: str, of: tables.Version | None, bucket: int) -> Iterator[Entry]:
    """Path, length and time of a part's files, in order of the path; a batch is held at a time."""
    from pyarrow import parquet

    if of is None:
        return
    folder = f"{log.rstrip('/')}/{of.folders[tables.ONLY]}/bucket={bucket}"

    def entries(name: str) -> Iterator[Entry]:
        store, base = files.store_of(f"{folder}/{name}")
        with store.open_input_file(base) as f:
            for batch in parquet.ParquetFile(f).iter_batches(columns=["path", "length", "mtime"]):
                yield from zip(*(batch.column(c).to_pylist() for c in ("path", "length", "mtime")), strict=True)

    yield from merge(*[entries(n) for n in sorted(files.names(folder)) if n.endswith(".parquet")])


def differences(old: Iterator[Entry], new: Iterator[Entry]) -> Iterator[tuple[str, Entry]]:
    """``create``, ``modify`` and ``remove`` with the entry, from two listings in order of the path."""
    a, b = next(old, None), next(new, None)
    while a or b:
        if b is None or (a and a[0] < b[0]):
            yield "remove", a
            a = next(old, None)
        elif a is None or b[0] < a[0]:
            yield "create", b
            b = next(new, None)
        else:
            if a != b:
                yield "modify", b
            a, b = next(old, None), next(new, None)
