"""Streams of change events: which matter, bursts of them, and a job for each burst."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from skeinworks.sources.listing import is_ignored, is_inside

#: Seconds without an event that end a burst.
QUIET = 2


def is_relevant(kind: Column, paths: Column, root: str, data_dir: str) -> Column:
    """Access does not matter; an event without paths does, as one with any path that does: not
    under ``data_dir``, and with no ignored name below the root."""
    base = root.rstrip("/") + "/"

    def matters(p: Column) -> Column:
        relative = F.when(p.startswith(base), F.substring(p, F.lit(len(base) + 1), F.length(p))).otherwise(p)
        return ~is_inside(p, data_dir) & ~F.exists(F.split(relative, "/"), lambda n: is_ignored(n))

    return (kind != "access") & ((F.size(paths) == 0) | F.exists(paths, matters))


def relevant_events(events: DataFrame, root: str, data_dir: str) -> DataFrame:
    return events.where(is_relevant(F.col("kind"), F.col("paths"), root, data_dir))


def bursts(events: DataFrame, gap: str = f"{QUIET} seconds", by: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    """One row a burst: events no further apart than ``gap``; its first, its end and their number.

    Works on a table and on a stream; a stream needs ``late``, how long a burst stays open for late
    events.
    """
    marked = events.withWatermark("ts", late) if late else events
    if late and not by:
        return _merged(marked, pd.Timedelta(gap))
    found = marked.groupBy(*by, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _merged(events: DataFrame, gap: pd.Timedelta) -> DataFrame:
    """Bursts of all events of a stream, in two levels.

    Windows as long as the gap are counted first, in as many tasks as there are: what lies in one is
    of one burst. Only their first and last events then meet, a row for each ``gap`` of time however many events it
    has, and are joined where they are no further apart. The session needs the state store of ``runtime.session``.
    """
    step = gap // pd.Timedelta("1us")
    counted = events.groupBy(F.window("ts", f"{step} microseconds").alias("w")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    rows = counted.select("w", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "n", F.lit(0).alias("all"))
    return rows.groupBy("all").transformWithStateInPandas(Joined(step), "start timestamp, end timestamp, n long", "Append", "EventTime")


class Joined(StatefulProcessor):
    """Bursts that are still open: first and last event in microseconds, and how many."""

    def __init__(self, step: int):
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "firsts array<long>, lasts array<long>, counts array<long>")

    def _settled(self, more: list[tuple[int, int, int]], now: int) -> Iterator[pd.DataFrame]:
        """Join ``more`` to what is open; bursts that nothing can go on with leave."""
        held = list(zip(*self.open.get(), strict=True)) if self.open.exists() else []
        joined: list[list[int]] = []
        for first, last, n in sorted([*held, *more]):
            if joined and first <= joined[-1][1] + self.step:
                joined[-1] = [joined[-1][0], max(joined[-1][1], last), joined[-1][2] + n]
            else:
                joined.append([first, last, n])
        # A window that could go on with a burst ends two gaps after its last event at the latest.
        done = [x for x in joined if x[1] + 2 * self.step <= now * 1000]
        left = joined[len(done) :]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if left:
            self.open.update(tuple([int(x[k]) for x in left] for k in range(3)))
            self.handle.registerTimer(int(left[0][1] + 2 * self.step) // 1000 + 1)
        else:
            self.open.clear()
        if done:
            times = lambda values: pd.to_datetime(values, unit="us")
            yield pd.DataFrame({"start": times([x[0] for x in done]), "end": times([x[1] + self.step for x in done]), "n": [x[2] for x in done]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        more = [x for frame in rows for x in zip(frame["first"].tolist(), frame["last"].tolist(), frame["n"].tolist(), strict=True)]
        yield from self._settled(more, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settled([], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def on_each_burst(found: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Run ``job`` for every micro-batch that has bursts; it must be safe to run twice."""

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            job(batch, number)

    writer = found.writeStream.foreachBatch(run).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def first_of_each(events: DataFrame, key: str, late: str) -> DataFrame:
    """The first event of a key while its window is open: one job at a time for a key."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
