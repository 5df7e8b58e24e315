"""Expiry of cached files as state: each file has a timer, so it fires without a listing.

State is kept by path: a file's length and time, and one timer for the moment from which it is too
old. A file that is written again gets a new timer, one that goes loses it; kept files have none. What
fires is what ``cache.expired`` finds in a listing of that moment.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EXPIRED = "path string, length long, mtime long, expired_at timestamp"


class Expiry(StatefulProcessor):
    """``ttl`` in seconds; rows: path, kind (remove, or any other), length, mtime, keep, ts."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", "length long, mtime long")

    def _forget(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.file.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for frame in rows:
            # Of events at one moment a file that is there counts.
            newest = frame.assign(there=frame["kind"] != "remove").sort_values(["ts", "there", "mtime"]).iloc[-1]
            if last is None or (newest["ts"], newest["there"], newest["mtime"]) >= (last["ts"], last["there"], last["mtime"]):
                last = newest
        self._forget()
        if last is not None and last["there"] and not last["keep"]:
            self.file.update((int(last["length"]), int(last["mtime"])))
            # Strictly older than the limit: a millisecond after.
            self.handle.registerTimer((int(last["mtime"]) + self.ttl) * 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.file.exists():
            length, mtime = self.file.get()
            at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
            self.file.clear()
            yield pd.DataFrame({"path": [key[0]], "length": [length], "mtime": [mtime], "expired_at": [at]})

    def close(self) -> None:
        pass


def expiries(changes: DataFrame, ttl: int | None, owners: DataFrame | None = None, *, owner: str = "book_dir", late: str = "0 seconds", clock: str = "EventTime") -> DataFrame:
    """Files to delete as a stream, each when it becomes older than ``ttl`` seconds by the stream's clock.

    ``changes``: path, kind, length, mtime, keep, ts and, with ``owners`` (a table of what can be made
    again), ``owner``; other files never expire. The clock is the watermark of ``ts``, ``late`` behind it, or with
    ``ProcessingTime`` the wall clock. Without limit nothing expires. The session
    needs the state store of ``runtime.session``.
    """
    if owners is not None:
        changes = changes.join(owners.select(owner).distinct(), owner, "left_semi")
    rows = changes.select("path", "kind", "length", "mtime", F.coalesce("keep", F.lit(False)).alias("keep"), "ts")
    if clock == "EventTime":
        rows = rows.withWatermark("ts", late)
    if ttl is None:
        return rows.where(F.lit(False)).select("path", "length", "mtime", F.col("ts").alias("expired_at"))
    return rows.groupBy("path").transformWithStateInPandas(Expiry(ttl), EXPIRED, "Append", clock)
