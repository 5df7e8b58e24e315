"""Summaries: counts by outcome and kind, cumulative histograms, percentiles by place."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.runtime import materialize

#: Upper bounds of the duration histogram, and kinds of errors.
BOUNDS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0)
ERROR_KINDS = ("not_found", "forbidden", "internal")
#: Buckets of a round of selection, and rows that are sorted rather than counted again.
BUCKETS, FEW = 1024, 4096


def children_per_parent(parents: DataFrame, children: DataFrame, key: str, foreign: str, out: str = "n") -> DataFrame:
    """Every parent's ``key`` with its number of children, 0 included."""
    counts = children.groupBy(F.col(foreign).alias(key)).agg(F.count(F.lit(1)).alias(out))
    return parents.select(key).join(counts, key, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def count_by_kind(df: DataFrame, kind: str, kinds: Sequence[str]) -> DataFrame:
    """One row for each of ``kinds``, 0 included; other kinds do not count."""
    dimension = df.sparkSession.createDataFrame([(k,) for k in kinds], f"{kind} string")
    counts = df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    return dimension.join(counts, kind, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def outcomes(df: DataFrame, outcome: str, names: Sequence[str]) -> DataFrame:
    """One row with the number of each outcome."""
    return df.agg(*[F.count_if(F.col(outcome) == n).alias(n) for n in names])


def cumulative_histogram(df: DataFrame, value: str, bounds: Sequence[float] = BOUNDS) -> DataFrame:
    """``le`` (null: no bound) and the number of values up to it, with ``total`` of the values."""
    counts = [F.count_if(F.col(value) <= b).alias(f"c{k}") for k, b in enumerate(bounds)]
    row = df.agg(*counts, F.count(value).alias("call"))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"c{k}").alias("n")) for k, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("call").alias("n")))
    return row.select(F.explode(F.array(*pairs)).alias("x")).select("x.le", "x.n")


def place_percentiles(df: DataFrame, value: str, ps: Sequence[float], within: Sequence[str] = (), *, buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """The element at place floor((n - 1) * p) + 1 of the sorted values, for each p, with ``max`` and ``n``.

    Values stay where they are. Each round counts those that may still be meant in ``buckets`` of equal width,
    finds the bucket that holds the place and goes on between its least and greatest value, until there
    is one value or at most ``few`` rows, which are then sorted; so are values that no bucket tells apart, such as
    texts. Nulls do not count, and a null of ``within`` is a group.
    """
    keys = ["g", *[f"g{n}" for n in range(len(within))]]
    named = [F.lit(0).alias("g"), *[F.col(c).alias(k) for c, k in zip(within, keys[1:], strict=True)]]
    values = df.where(F.col(value).isNotNull()).select(*named, F.col(value).alias("v"))
    groups = materialize(values.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n")), "places-groups")
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("p"), F.lit(float(p)).alias("at")) for k, p in enumerate(ps)])).alias("x")
    place = (F.floor((F.col("n") - 1) * F.col("x.at")) + 1).cast("long").alias("place")
    targets = groups.select("*", asked).select(*keys, F.col("x.p").alias("p"), "low", "high", F.col("n").alias("rows"), place, F.lit(False).alias("stuck"))
    wide = (F.col("rows") > few) & (F.col("low") < F.col("high")) & ~F.col("stuck")
    ends = [*keys, "low", "high"]

    def inside(ranges: DataFrame) -> DataFrame:
        """The values between the ends of each range, beside it."""
        there = ranges.select(*[F.col(k).alias(f"of_{k}") for k in keys], "low", "high")
        same = (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
        return values.join(there, same).drop(*[f"of_{k}" for k in keys])

    def placed(counts: DataFrame, by: str) -> DataFrame:
        """Of each target the row of ``counts`` in its range that holds its place, and the rows ``before`` that."""
        before = F.coalesce(F.sum("m").over(Window.partitionBy(*ends).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = counts.withColumn("before", before).withColumnsRenamed({c: f"in_{c}" for c in ends})
        hit = (F.col("place") > F.col("before")) & (F.col("place") <= F.col("before") + F.col("m"))
        for c in ends:
            hit = hit & F.col(c).eqNullSafe(F.col(f"in_{c}"))
        return targets.join(parts, hit)

    while targets.agg(F.count_if(wide)).first()[0]:
        number = lambda c: F.col(c).try_cast("double")
        at = F.floor(F.try_divide(number("v") - number("low"), number("high") - number("low")) * buckets)
        bucket = F.coalesce(F.least(F.greatest(at, F.lit(0)), F.lit(buckets - 1)), F.lit(0)).alias("bucket")
        counts = inside(targets.where(wide).select(*ends).distinct()).groupBy(*ends, bucket).agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("least"), F.max("v").alias("most"))
        on = placed(counts, "bucket")
        closer = on.select(*keys, "p", F.col("least").alias("low"), F.col("most").alias("high"), F.col("m").alias("rows"), (F.col("place") - F.col("before")).alias("place"), (F.col("m") == F.col("rows")).alias("stuck"))
        targets = materialize(targets.where(~wide).unionByName(closer), "places-targets")
    one = targets.where("low = high").select(*keys, "p", F.col("low").alias("found"))
    rest = targets.where("low < high")
    counts = inside(rest.select(*ends).distinct()).groupBy(*ends, "v").agg(F.count(F.lit(1)).alias("m"))
    found = one.unionByName(placed(counts, "v").select(*keys, "p", F.col("v").alias("found")))
    columns = [F.max(F.when(F.col("p") == k, F.col("found"))).alias(f"p{round(p * 100)}") for k, p in enumerate(ps)]
    answers = found.groupBy(*keys).agg(*columns).withColumnsRenamed({k: f"of_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys])
    back = [F.col(k).alias(c) for c, k in zip(within, keys[1:], strict=True)]
    return groups.join(answers, same).select(*back, *[f"p{round(p * 100)}" for p in ps], F.col("high").alias("max"), "n")


def extrapolate(seconds: Column, measured: Column, target: float = 36_000.0) -> Column:
    return seconds * target / measured


def latest(df: DataFrame, within: Sequence[str], mtime: str, out: str = "mtime") -> DataFrame:
    """The greatest time of each group, 0 if none has one."""
    return df.groupBy(*within).agg(F.coalesce(F.max(mtime), F.lit(0)).alias(out))


def all_distinct(df: DataFrame, within: Sequence[str], value: str, out: str = "usable") -> DataFrame:
    """Whether every row of a group has a value and no two the same."""
    return df.groupBy(*within).agg(((F.count(value) == F.count(F.lit(1))) & (F.count_distinct(value) == F.count(F.lit(1)))).alias(out))


def samples(df: DataFrame, metric: str, value: str, label: str | None = None) -> DataFrame:
    """``metric``, ``labels`` and ``value`` of each row of ``df``, as a scrape shows them; a bound ``le`` of null is +Inf."""
    text = F.lit("") if label is None else F.concat(F.lit(f'{label}="'), F.coalesce(F.col(label).cast("string"), F.lit("+Inf")), F.lit('"'))
    return df.select(F.lit(metric).alias("metric"), text.alias("labels"), F.col(value).cast("double").alias("value"))


def metrics_table(books: DataFrame, errors: DataFrame, durations: DataFrame) -> DataFrame:
    """All metrics as one table: books indexed, errors by ``kind``, and the histogram of ``seconds``."""
    indexed = samples(books.agg(F.count(F.lit(1)).alias("n")), "books_indexed", "n")
    failures = samples(count_by_kind(errors, "kind", ERROR_KINDS), "errors_total", "n", "kind")
    buckets = samples(cumulative_histogram(durations, "seconds"), "duration_seconds_bucket", "n", "le")
    total = durations.agg(F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("s"), F.count("seconds").alias("n"))
    return indexed.unionByName(failures).unionByName(buckets).unionByName(samples(total, "duration_seconds_sum", "s")).unionByName(samples(total, "duration_seconds_count", "n"))
