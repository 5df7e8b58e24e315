"""Running sums, neighbours and totals within keys of any size.

A window over a key gathers its rows in one task. Keys of up to ``LARGE`` rows go that way: one shuffle, no
more. The rows of larger keys are dealt in ranges of key and order, so a key that holds a third of all
rows lies in a third of the ranges. Each range does its own part, and adds what the ranges before it hold of
the key: of all keys and ranges only one number each, and only for keys that more than one range has.

Which keys are large comes from a count that is combined before its shuffle (``crowded``). A caller who takes
several steps over the same keys counts them once and gives each step the result as ``hot``. Either way
gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.runtime import materialize

#: Rows of one key that a task may sort.
LARGE = 1_000_000


def crowded(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The keys (``k0``, ``k1``, ...) of more than ``LARGE`` rows: at most one for so many rows of ``df``.

    Give it a table as it is read rather than one that is computed: a table of no more than ``LARGE`` rows has
    no such key, and of Parquet files the number of rows is known without reading them.
    """
    keys = [F.col(c).alias(f"k{n}") for n, c in enumerate(by)]
    if df.count() <= LARGE:
        return df.select(*keys).limit(0)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return materialize(counts.where(F.col("rows") > LARGE).drop("rows"), "crowded")


def _of(df: DataFrame, by: Sequence[str], hot: DataFrame) -> Column:
    return reduce(and_, [df[f"`{c}`"].eqNullSafe(hot[f"k{n}"]) for n, c in enumerate(by)])


def _by_size(df: DataFrame, by: Sequence[str], hot: DataFrame | None, window: Callable, dealt: Callable) -> DataFrame:
    """``window`` of the rows of keys that a task may sort, ``dealt`` of the others; both give the same columns."""
    if not by:
        return dealt(df)
    hot = crowded(df, by) if hot is None else hot
    if hot.isEmpty():
        return window(df)
    same = _of(df, by, hot)
    return window(df.join(hot, same, "left_anti")).unionByName(dealt(df.join(hot, same, "left_semi")))


def _ranged(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], given: dict[str, Column]) -> tuple[DataFrame, list[str], list[str]]:
    """``df`` in one column, dealt in ranges: ``row``, keys, order and ``given``."""
    keys, orders = [f"k{n}" for n in range(len(by))], [f"o{n}" for n in range(len(order))]
    columns = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]]
    columns += [(F.col(c) if isinstance(c, str) else c).alias(o) for c, o in zip(order, orders, strict=True)]
    columns += [c.alias(name) for name, c in given.items()]
    dealt = df.select(*columns).repartitionByRange(*keys, *orders)
    return materialize(dealt.withColumn("range", F.spark_partition_id()), "ranges"), keys, orders


def _with_carried(ranged: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Beside each row what ``carried`` has for its key and range: at most one key a range has any."""
    there = carried.withColumnsRenamed({k: f"carried_{k}" for k in keys} | {"range": "carried_range"})
    same = F.col("range") == F.col("carried_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"carried_{k}"))
    return ranged.join(there, same, "left")


def _back(df: DataFrame, columns: Sequence[str], added: dict[str, Column]) -> DataFrame:
    old = [F.col("row").getField(c).alias(c) for c in columns if c not in added]
    return df.select(*old, *[c.alias(name) for name, c in added.items()])


def running(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], sums: dict[str, Column], hot: DataFrame | None = None) -> DataFrame:
    """``df`` with, for each name, the sum of its column over the rows of the key up to this one in ``order``.

    ``order`` should tell the rows of a key apart: rows that are equal in it are in one range, summed in any order.
    """
    numbers = {name: F.coalesce(c, F.lit(0)).cast("long") for name, c in sums.items()}

    def window(rows: DataFrame) -> DataFrame:
        up_to = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({name: F.sum(c).over(up_to) for name, c in numbers.items()})

    return _by_size(df, by, hot, window, lambda rows: _running_dealt(rows, by, order, numbers))


def _running_dealt(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], numbers: dict[str, Column]) -> DataFrame:
    inputs = {f"s{n}": c for n, c in enumerate(numbers.values())}
    ranged, keys, orders = _ranged(df, by, order, inputs)
    totals = ranged.groupBy(*keys, "range").agg(*[F.sum(s).alias(f"all_{s}") for s in inputs])
    earlier = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "range", *[F.sum(f"all_{s}").over(earlier).alias(f"before_{s}") for s in inputs])
    carried = carried.where(F.greatest(F.lit(None).cast("long"), *[F.col(f"before_{s}") for s in inputs]).isNotNull())
    own = Window.partitionBy("range", *keys).orderBy(*orders).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumns({f"own_{s}": F.sum(s).over(own) for s in inputs})
    value = lambda s: F.col(f"own_{s}") + F.coalesce(F.col(f"before_{s}"), F.lit(0))
    return _back(_with_carried(summed, carried, keys), df.columns, {name: value(s) for name, s in zip(numbers, inputs, strict=True)})


def following(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], value: Column, out: str, hot: DataFrame | None = None) -> DataFrame:
    """``df`` with ``out``: ``value`` of the key's next row in ``order``; null for the last."""

    def dealt(rows: DataFrame) -> DataFrame:
        ranged, keys, orders = _ranged(rows, by, order, {"value": value})
        first = F.min_by(F.struct("value"), F.struct(*orders)).alias("first")
        later = Window.partitionBy(*keys).orderBy("range")
        carried = ranged.groupBy(*keys, "range").agg(first).select(*keys, "range", F.lead("first").over(later).alias("after")).where("after IS NOT NULL")
        own = Window.partitionBy("range", *keys).orderBy(*orders)
        led = ranged.withColumn("led", F.lead(F.struct("value")).over(own))
        return _back(_with_carried(led, carried, keys), rows.columns, {out: F.coalesce("led", "after")["value"]})

    return _by_size(df, by, hot, lambda rows: rows.withColumn(out, F.lead(value).over(Window.partitionBy(*by).orderBy(*order))), dealt)


def last_before(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], value: Column, out: str, hot: DataFrame | None = None) -> DataFrame:
    """``df`` with ``out``: the last ``value`` that is not null of the key's rows before this one in ``order``."""

    def window(rows: DataFrame) -> DataFrame:
        earlier = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(out, F.last(value, ignorenulls=True).over(earlier))

    def dealt(rows: DataFrame) -> DataFrame:
        ranged, keys, orders = _ranged(rows, by, order, {"value": value})
        there = F.col("value").isNotNull()
        latest = F.max_by("value", F.when(there, F.struct(*orders))).alias("latest")
        before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        carried = ranged.groupBy(*keys, "range").agg(latest).select(*keys, "range", F.last("latest", ignorenulls=True).over(before).alias("carried"))
        own = Window.partitionBy("range", *keys).orderBy(*orders).rowsBetween(Window.unboundedPreceding, -1)
        seen = ranged.withColumn("seen", F.last("value", ignorenulls=True).over(own))
        return _back(_with_carried(seen, carried.where("carried IS NOT NULL"), keys), rows.columns, {out: F.coalesce("seen", "carried")})

    return _by_size(df, by, hot, window, dealt)


def totals(df: DataFrame, by: Sequence[str], sums: dict[str, Column], hot: DataFrame | None = None) -> DataFrame:
    """``df`` with, for each name, the sum of its column over all rows of the key; rows of a large key get it by a join and stay where they are."""
    numbers = {name: F.coalesce(c, F.lit(0)).cast("long") for name, c in sums.items()}

    def dealt(rows: DataFrame) -> DataFrame:
        keys = [F.col(c).alias(f"k{n}") for n, c in enumerate(by)]
        found = materialize(rows.groupBy(*keys).agg(*[F.sum(c).alias(f"s{n}") for n, c in enumerate(numbers.values())]), "totals")
        joined = rows.join(found, _of(rows, by, found)) if by else rows.crossJoin(found)
        return joined.select(*[rows[f"`{c}`"] for c in rows.columns if c not in numbers], *[found[f"s{n}"].alias(name) for n, name in enumerate(numbers)])

    return _by_size(df, by, hot, lambda rows: rows.withColumns({name: F.sum(c).over(Window.partitionBy(*by)) for name, c in numbers.items()}), dealt)
