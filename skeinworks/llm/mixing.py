"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations.

Every document draws an exponential key ``-ln(u) / weight``, with ``u`` from a hash of its id, so
reruns agree. In a source the documents with the smallest keys come first: taking them until their
sizes reach a token budget is weighted sampling without replacement.

A source's target is met by complete epochs first (each takes every document once), then by one
fractional epoch, whose budget is what remains. A prefix sum over a source of any size is taken in
three steps that no task does alone: sizes are summed in cells of the key's range, cells are summed
up in two levels of 256, and only inside one cell are documents sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.llm.text import boxed, SYMBOLS, count_chars, n_words
from skeinworks.runtime import materialize

CYCLE = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "mix-1"
CELLS = 256


def quality_weight(text: Column) -> Column:
    """A sampling weight in [0.05, 1] that falls with the share of symbols; 1 for null or empty."""
    t = F.coalesce(text, F.lit(""))
    share = count_chars(t, SYMBOLS).cast("double") / F.greatest(F.length(t), F.lit(1))
    return F.greatest(F.lit(0.05), F.lit(1.0) - share * 4)


def exponential_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """``-ln(u) / weight``; u in (0, 1) has 52 bits of the MD5 of seed and id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, cycle: Sequence[int] = CYCLE, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row per source, with ``target``, the complete ``epochs`` and the ``rest`` to sample.

    ``sizes`` has one row per source: ``source`` and ``source_size``. Weights repeat ``cycle`` over
    the sources by code point, null last. Targets share ``share`` of all sizes by weight; one that
    would pass ``cap`` times its source's size stops there, and the excess goes to the others by
    weight. With sources by the level at which they stop, those that do are a prefix, so one
    running sum finds the level of the rest.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in cycle])
    ranked = sizes.withColumn("sid", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(weights, ((F.col("sid") - 1) % len(cycle) + 1).cast("int")).cast("long")
    )
    ranked = ranked.withColumn("most", F.col("source_size") * cap).withColumn(
        "stop", F.col("most").cast("double") / F.col("weight")
    )
    order = Window.orderBy("stop", "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    levels = ranked.withColumn("level", level).withColumn("stops", F.col("level") > F.col("stop"))
    levels = levels.withColumn("final", F.min_by(F.when(~F.col("stops"), F.col("level")), F.when(~F.col("stops"), F.struct("stop", "sid"))).over(everything))
    target = F.when(F.col("stops"), F.col("most").cast("double")).otherwise(F.col("final") * F.col("weight"))
    out = levels.withColumn("target", F.coalesce(F.least(target, F.col("most").cast("double")), F.lit(0.0)))
    size = F.col("source_size")
    epochs = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("long")
    return out.withColumn("epochs", epochs).select(
        "source", "sid", "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * size).alias("rest")
    )


def mix_sources(
    docs: DataFrame,
    *,
    weight: Column | None = None,
    cycle: Sequence[int] = CYCLE,
    share: float = SHARE,
    cap: int = CAP,
    seed: str = SEED,
) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``, ``source``): how often the mix takes it.

    Returns doc_id, size (words), source_size, target (its source's), copies (0 to ``cap``), taken
    (size times copies), weight. Each source's taken words differ from its target by half a
    document at most: the document on the budget's edge is taken if that comes nearer.

    Null text: size 0. Null source: a source of its own, last. Null doc_id: the hash of an empty
    id. Repeated rows are taken as documents of their own; rows of equal key are ordered by id,
    then size, and equal ones can be exchanged without a change of the result. Very long texts: whole, and one on the budget's edge may
    part taken and target by half its size. No rows: no rows.
    Other columns of ``docs`` are not read.
    """
    w = quality_weight(F.col("text")) if weight is None else weight
    base = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), w.cast("double").alias("weight"))
    base = base.withColumn("key", exponential_key(F.col("doc_id"), F.col("weight"), seed))
    place = F.col("key") / (F.col("key") + 1)
    base = base.withColumn("cell", F.least(F.floor(place * CELLS * CELLS), F.lit(CELLS * CELLS - 1)).cast("int"))
    base = materialize(base, "mix-base")

    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = materialize(source_targets(sizes, cycle, share, cap), "mix-sources")
    named = lambda df: df.withColumn("source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    base = named(base).join(named(sources), "source").drop("source")

    cells = base.groupBy("sid", (F.col("cell") / CELLS).cast("int").alias("upper"), "cell").agg(F.sum("size").alias("inside"))
    earlier = lambda part, by: Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    uppers = cells.groupBy("sid", "upper").agg(F.sum("inside").alias("inside"))
    uppers = uppers.select("sid", "upper", F.coalesce(F.sum("inside").over(earlier(["sid"], "upper")), F.lit(0)).alias("before_upper"))
    cells = cells.withColumn("before_cell", F.coalesce(F.sum("inside").over(earlier(["sid", "upper"], "cell")), F.lit(0)))
    cells = cells.join(uppers, ["sid", "upper"]).select("sid", "cell", (F.col("before_upper") + F.col("before_cell")).alias("offset"))

    within = Window.partitionBy("sid", "cell").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = base.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(cells, ["sid", "cell"])
    before = F.col("offset") + F.col("before")
    chosen = (2 * before + F.col("size")).cast("double") <= 2 * F.col("rest")
    copies = F.col("epochs") + F.when(chosen & (F.col("epochs") < cap), 1).otherwise(0)
    return ordered.withColumn("copies", copies.cast("long")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "weight"
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` as the mix takes them: rows that it leaves out go, and those it takes twice come twice.

    Rows of one doc_id are taken equally often. Else as ``mix_sources``; all columns are returned.
    """
    copies = mix_sources(docs, **settings).groupBy(F.col("doc_id").alias("mix_id")).agg(F.max("copies").alias("copies"))
    taken = boxed(docs, own_id=F.col("doc_id")).join(copies, F.col("own_id").eqNullSafe(F.col("mix_id"))).where("copies > 0")
    again = taken.select("boxed", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return again.select(*[F.col("boxed").getField(c).alias(c) for c in docs.columns])


SQL = """
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         greatest(0.05::DOUBLE, 1.0::DOUBLE - (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')))::DOUBLE
                  / greatest(length(coalesce(text, '')), 1) * 4) AS weight,
         (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sizes),
weighed AS (SELECT *, [5, 2, 1][((sid - 1) % 3 + 1)::INT] AS w, source_size * 2 AS most FROM ranked),
levels AS (
  SELECT *, most::DOUBLE / w AS stop,
         ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER before, 0)::DOUBLE)
         / ((sum(w) OVER ()) - coalesce(sum(w) OVER before, 0))::DOUBLE AS level
  FROM weighed WINDOW before AS (ORDER BY most::DOUBLE / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT *, min_by(level, struct_pack(a := stop, b := sid)) FILTER (level <= stop) OVER () AS common FROM levels),
targets AS (
  SELECT source, source_size,
         coalesce(least(CASE WHEN level > stop THEN most::DOUBLE ELSE common * w END, most::DOUBLE), 0) AS target FROM final),
ordered AS (
  SELECT b.doc_id, b.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
         coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY -ln(b.u) / b.weight, b.doc_id, b.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source),
taken AS (
  SELECT *, epochs + CASE WHEN epochs < 2 AND (2 * before + size)::DOUBLE <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END AS copies
  FROM ordered)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * copies)::BIGINT AS taken FROM taken
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
