"""How filters act on each other: what each removes in every order in which they can be applied.

Direct relational replay: each document's flags are crossed with the orders (120 for five filters, a
table of fixed size that is broadcast), each pair's first failure is computed, its steps are exploded
and counted under conditions. Rows of one part, order and step are combined in the task that made
them, so what is shuffled are at most ``tasks * parts * 600`` counts, whatever a part holds.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.llm.statistics import UPPER
from skeinworks.llm.text import count_chars, words
from skeinworks.runtime import materialize

FILTERS = "ABCDE"
#: Words that a text has at least, distinct words and capitals in per cent, and symbols it may not hold.
LEAST_WORDS, DISTINCT, CAPITALS, SYMBOLS = 200, 50, 2, "[#$%&*|]"


def text_failures(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``part``, ``digest`` (SHA-256 of the text) and ``failed``, whose bits are the filters A
    to D that a text fails by itself. A null text is empty, a null source the empty part."""
    t = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), t.alias("t"), words(t).alias("w"))
    n = F.size("w").cast("long")
    fails = (
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct("w")).cast("long") < DISTINCT * n,
        100 * count_chars(F.col("t"), UPPER) > CAPITALS * F.length("t").cast("long"),
        F.col("t").rlike(SYMBOLS),
    )
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails)), F.lit(0))
    return split.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), bits.alias("failed"))


def document_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: ``part``, ``failed`` (a bit for each filter that it fails, A lowest), ``good`` and ``toxic``.

    E fails where a smaller doc_id has the same text anywhere in the table; a null doc_id is neither
    smaller nor larger, and rows of one id are no copies of each other. Of several label rows of a
    document one that says so is enough; without one it is neither good nor toxic. Empty tables give
    no rows; texts of any length are read whole; only the columns named here are used.
    """
    found = materialize(text_failures(docs), "audit-texts")
    # The first of each text is joined by text and id: no key holds more rows than one document has.
    firsts = found.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    good, toxic = F.max(F.col("quality") == 1), F.max(F.col("toxic") == 1)
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(good.alias("good"), toxic.alias("toxic"))
    flagged = found.join(firsts, ["digest", "doc_id"], "left")
    # Rows without id match nothing; dealt by their text as well, they don't meet in one task.
    flagged = flagged.withColumn("dealt", F.coalesce(F.col("doc_id").cast("string"), F.hex("digest")))
    known = known.withColumn("dealt", F.col("doc_id").cast("string"))
    flagged = flagged.join(known, ["doc_id", "dealt"], "left")
    copied = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    said = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return flagged.select("part", (F.col("failed") + copied).cast("int").alias("failed"), said("good"), said("toxic"))


def orders(spark, filters: str = FILTERS) -> DataFrame:
    """Every order of ``filters`` (at most six), and its steps: their number and their filter's bit."""
    if len(filters) > 6:
        raise ValueError("at most six filters: the orders are broadcast")
    rows = [("".join(p), [(k, 1 << filters.index(f)) for k, f in enumerate(p, 1)]) for p in permutations(filters)]
    return spark.createDataFrame(rows, "filter_order string, steps array<struct<step:int,bit:int>>")


def replay(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Counts for every part, order and step, zeros included.

    ``kept`` after the step, ``removed`` by it, ``redundant`` (its filter fails them, an earlier one took
    them), ``unique_fails`` (fail its filter alone), ``good_lost`` and ``toxic_lost`` of the removed, and
    ``shapley``: what its filter removes in all orders together. Ties can't arise: a document
    is removed once, at its first failure.
    """
    failed, step, bit = F.col("failed"), F.col("step"), F.col("bit")
    at = F.col("steps")
    first: Column = F.lit(len(filters) + 1)
    for k in reversed(range(len(filters))):
        first = F.when(failed.bitwiseAND(at[k]["bit"]) != 0, k + 1).otherwise(first)
    crossed = flags.crossJoin(F.broadcast(orders(flags.sparkSession, filters))).withColumn("first", first)
    each = crossed.select("part", "filter_order", "failed", "good", "toxic", "first", F.inline("steps"))
    here, fails = F.col("first") == step, failed.bitwiseAND(bit) != 0
    counts = each.groupBy("part", "filter_order", "step").agg(
        F.count_if(F.col("first") > step).alias("kept"),
        F.count_if(here).alias("removed"),
        F.count_if(fails & (F.col("first") < step)).alias("redundant"),
        F.count_if(failed == bit).alias("unique_fails"),
        F.count_if(here & F.col("good")).alias("good_lost"),
        F.count_if(here & F.col("toxic")).alias("toxic_lost"),
    )
    # Of each part and filter there are as many rows as orders.
    own = Window.partitionBy("part", F.substring("filter_order", step, F.lit(1)))
    return counts.withColumn("shapley", F.sum("removed").over(own))


SQL = r"""
WITH split AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
labelled AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {
    'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
    'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
    'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS f
  FROM split LEFT JOIN labelled USING (doc_id)),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
replayed AS (
  SELECT part, good, toxic, filter_order, [f[x] FOR x IN ['A', 'B', 'C', 'D', 'E']] AS every,
         [f[x] FOR x IN string_split(filter_order, '')] AS fails FROM (
    SELECT part, good, toxic, map {'A': f.A, 'B': f.B, 'C': f.C, 'D': f.D, 'E': f.E} AS f FROM flags), orders),
steps AS (
  SELECT *, coalesce(nullif(list_position(fails, true), 0), 6) AS first, unnest([1, 2, 3, 4, 5]) AS step FROM replayed),
counts AS (
  SELECT part, filter_order, step, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed,
         count(*) FILTER (fails[step] AND first < step) AS redundant,
         count(*) FILTER (fails[step] AND len([x FOR x IN every IF x]) = 1) AS unique_fails,
         count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost
  FROM steps GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM counts
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return replay(document_flags(docs, labels))
