"""Schemas of the two catalogue tables, their constraints and their evolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinworks.runtime import materialize

BOOK = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("slug", T.StringType(), False),
        T.StructField("feed_id", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("author", T.StringType()),
        T.StructField("cover_path", T.StringType()),
        T.StructField("source_path", T.StringType(), False),
        T.StructField("source_mtime", T.LongType(), False),
        T.StructField("storage_mode", T.StringType(), False),
        T.StructField("default_cover_url", T.StringType()),
        T.StructField("force_embedded", T.BooleanType(), False),
        T.StructField("transcode", T.StringType(), False),
        T.StructField("created_at", T.LongType(), False),
    ]
)
EPISODE = T.StructType(
    [
        T.StructField("guid", T.StringType(), False),
        T.StructField("book_id", T.StringType(), False),
        T.StructField("idx", T.LongType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("file_path", T.StringType(), False),
        T.StructField("byte_length", T.LongType(), False),
        T.StructField("duration_sec", T.DoubleType(), False),
        T.StructField("start_sec", T.DoubleType(), False),
        T.StructField("pubdate_epoch", T.LongType(), False),
        T.StructField("source_path", T.StringType(), False),
        T.StructField("needs_faststart", T.BooleanType(), False),
    ]
)
#: Columns that an earlier table may lack, and their values there; columns that are retired.
BOOK_DEFAULTS = {"storage_mode": "", "default_cover_url": None, "force_embedded": False, "transcode": ""}
EPISODE_DEFAULTS = {"start_sec": 0.0, "source_path": "", "needs_faststart": False}
BOOK_RETIRED = ("status",)


def evolve(df: DataFrame, schema: T.StructType, defaults: dict[str, object], retired: Sequence[str] = ()) -> DataFrame:
    """``df`` with missing columns at their defaults, retired ones dropped, in the schema's order.

    A second call changes nothing. A column that is neither there nor in ``defaults`` is an error.
    """
    out = df.drop(*[c for c in retired if c in df.columns])
    for f in schema.fields:
        if f.name not in out.columns:
            if f.name not in defaults:
                raise ValueError(f"no default for the missing column {f.name}")
            out = out.withColumn(f.name, F.lit(defaults[f.name]).cast(f.dataType))
    return out.select(*schema.fieldNames())


def backfill_order(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """``df`` with ``column`` counted from 1 in ``order``, if the column is missing; once only.

    Rows are counted in ranges: each range numbers its own, and adds the size of those before.
    """
    if column in df.columns:
        return df
    ranged = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "backfill-ranges")
    sizes = ranged.groupBy("_range").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_own", own).join(sizes.select("_range", before.alias("_before")), "_range").withColumn(column, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def violations(
    df: DataFrame,
    *,
    unique: Sequence[Sequence[str]] = (),
    required: Sequence[str] = (),
    references: tuple[Sequence[str], DataFrame, Sequence[str]] | None = None,
) -> DataFrame:
    """Rows (``constraint``, ``value``, ``n``) for every broken constraint; none if all hold."""
    shown = lambda cols: F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
    out = []
    for cols in unique:
        doubled = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out.append(doubled.select(F.lit(f"unique {', '.join(cols)}").alias("constraint"), shown(cols).alias("value"), "n"))
    if required:
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
        pairs = F.explode(F.array(*[F.struct(F.lit(f"not null {c}").alias("constraint"), F.col(c).alias("n")) for c in required])).alias("x")
        out.append(counts.select(pairs).where("x.n > 0").select("x.constraint", F.lit(None).cast("string").alias("value"), "x.n"))
    if references:
        cols, parents, keys = references
        there = parents.select(*[F.col(k).alias(c) for k, c in zip(keys, cols, strict=True)])
        lost = df.join(there, list(cols), "left_anti").groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
        out.append(lost.select(F.lit(f"references {', '.join(cols)}").alias("constraint"), shown(cols).alias("value"), "n"))
    first, *rest = out
    for more in rest:
        first = first.unionByName(more)
    return first


def known_or_null(c: Column, labels: Sequence[str]) -> Column:
    return F.when(c.isin(*labels), c)
