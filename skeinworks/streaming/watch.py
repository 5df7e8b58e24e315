"""A library that is watched: a first scan, then one reconcile for every burst of changes.

The offset from which the stream reads is the snapshot that the first scan works on, so it is fixed before the
scan begins; what changes meanwhile is in a later snapshot, and comes with the stream. Each scan
works on one snapshot and is one commit of both tables, which says what snapshot it took in: a batch that
is run again, or a scan that a restart repeats, changes nothing.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skeinworks.operators.mutations import reconcile
from skeinworks.schema import BOOK, EPISODE
from skeinworks.sources import snapshots, tables
from skeinworks.streaming.changes import QUIET, on_each_burst, relevant_events
from skeinworks.streaming.source import folder_changes

TABLES = {"books": BOOK, "episodes": EPISODE}
STEP = "snapshot"

#: From a listing and the books known so far to the sources found, and the books and episodes read anew.
Scan = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame, DataFrame]]


def take_in(spark: SparkSession, log: str, catalog: str, number: int, scan: Scan) -> int | None:
    """Reconcile the catalogue with snapshot ``number``; None if it was taken in before."""
    listing = snapshots.read_snapshot(spark, log, number)

    def change(now: dict[str, DataFrame]) -> dict[str, DataFrame]:
        sources, books, episodes = scan(listing, now["books"])
        after, children, _ = reconcile(now["books"], now["episodes"], sources, books, episodes)
        return {"books": after, "episodes": children}

    return tables.update(spark, catalog, TABLES, change, step=(STEP, number))


def watch_library(
    spark: SparkSession,
    root: str,
    home: str,
    scan: Scan,
    *,
    data_dir: str | None = None,
    quiet: float = QUIET,
    once: bool = False,
    on_ready: Callable[[], None] = lambda: None,
) -> StreamingQuery:
    """Scan ``root``, call ``on_ready``, then follow its changes; log, catalogue and checkpoint are in ``home``.

    The query sees a change when a snapshot shows it (see ``keep_polling``). Only changes that matter
    start a scan; a scan covers all there is in its snapshot.
    """
    log, catalog = f"{home}/snapshots", f"{home}/catalog"
    first = snapshots.take_snapshot(spark, root, log, data_dir)
    take_in(spark, log, catalog, first, scan)
    on_ready()

    def job(batch: DataFrame, _: int) -> None:
        take_in(batch.sparkSession, log, catalog, batch.agg(F.max("version")).first()[0], scan)

    changes = relevant_events(folder_changes(spark, log, start=first, quiet=quiet), "", data_dir or "/")
    return on_each_burst(changes, job, f"{home}/checkpoint", once)


def keep_polling(spark: SparkSession, root: str, home: str, stop: threading.Event, *, data_dir: str | None = None, every: float = 1.0) -> None:
    """Take a snapshot again and again, ``every`` seconds apart, until ``stop`` is set."""
    while not stop.is_set():
        snapshots.take_snapshot(spark, root, f"{home}/snapshots", data_dir)
        stop.wait(every)


def catalogue(spark: SparkSession, home: str) -> tuple[DataFrame, DataFrame]:
    """Books and episodes as the newest commit has them."""
    of = tables.newest(f"{home}/catalog")
    return tuple(tables.read_version(spark, f"{home}/catalog", of, schema, name) for name, schema in TABLES.items())
