"""Exact duplicates by a tree-merge of sorted digest runs.

Every partition of the documents makes a run: its digests in order, each with how many rows have it
and which of them stays. The runs are merged in binomial rounds. With 2^b nodes, a round settles
up to four bits of the node: a node sends the entries of its run to the 16 nodes that differ from it in
these bits alone, each entry to the one whose bits are those of its digest, and merges the 16 runs it
gets, entries of one digest into one. After the last round a digest is at the node that its bits name.
So an entry moves once a round, a digest that a third of all rows have is one entry a node from the
start, and no node ever holds more than about what a partition held.

Digests are SHA-256. Entries are one only if also their texts' length and a second hash agree: what a
level retains is verified at that level, without moving a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.runtime import materialize

#: Bits of the node that a round settles: runs of up to 2 ** BITS nodes are merged at once.
BITS = 4
#: What says that two texts are equal.
KEY = ["digest", "bytes", "second"]


def unchanged(text: Column) -> Column:
    return text


def digests(docs: DataFrame, normal: Callable[[Column], Column] = unchanged) -> DataFrame:
    """``doc_id``, the ``KEY`` of the normalised text, the row's ``row`` and the partition (``leaf``) it was read in."""
    t = normal(F.coalesce(F.col("text"), F.lit("")))
    given = docs.select("doc_id", t.alias("t"))
    return given.select(
        "doc_id",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.octet_length("t").cast("long").alias("bytes"),
        F.xxhash64("t").alias("second"),
        F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().alias("leaf"),
    )


def _merged(runs: DataFrame, node: str, nodes: int, pick: Callable[[str], Column]) -> DataFrame:
    """What each of ``nodes`` gets, in one sorted run: an entry for each key, with the row that stays.

    One exchange and one sort: the aggregate reads the node's entries in the order they lie in.
    """
    by = [node, *KEY]
    return runs.repartitionById(nodes, node).sortWithinPartitions(*by).groupBy(*by).agg(pick("stays").alias("stays"), F.sum("n").alias("n"))


def _bits(node: Column, shift: int, mask: int) -> Column:
    """``node`` with the bits of ``mask << shift`` taken from the digest."""
    named = F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("int")
    return node.bitwiseAND(F.lit(~(mask << shift))).bitwiseOR(named.bitwiseAND(F.lit(mask << shift)))


def tree_merge(runs: DataFrame, leaves: int, pick: Callable[[str], Column] = F.max, bits: int = BITS) -> DataFrame:
    """``runs`` (``leaf``, ``KEY``, ``stays``, ``n``) merged to one entry for each key of all leaves;
    of their ``stays`` the one that ``pick`` takes."""
    depth = max(leaves - 1, 0).bit_length()
    merged = runs.withColumn("node", F.col("leaf").cast("int"))
    for shift in range(0, depth, bits):
        mask = (1 << min(bits, depth - shift)) - 1
        sent = merged.withColumn("node", _bits(F.col("node"), shift, mask))
        merged = _merged(sent, "node", 1 << depth, pick)
    return merged.select(*KEY, "stays", "n")


def exact_duplicates(docs: DataFrame, *, largest: bool = True, normal: Callable[[Column], Column] = unchanged, bits: int = BITS) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``digest``.

    Of rows with equal texts the one with the largest doc_id stays (else the smallest). Null texts are
    empty texts. Rows without id stay only where no row of their text has one; of rows with one id and
    text any one stays. Texts of any length are hashed whole where they lie; an empty table gives no
    rows; only ``doc_id`` and ``text`` are read.
    """
    found = materialize(digests(docs, normal), "exact-digests")
    leaves = found.agg(F.max("leaf")).first()[0]
    leaves = 0 if leaves is None else leaves + 1
    # Rows with an id before others, then by id, then by place.
    pick = F.max if largest else F.min
    first = F.col("doc_id").isNotNull() if largest else F.col("doc_id").isNull()
    stays = F.struct(first.alias("first"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    entries = found.select("leaf", *KEY, stays.alias("stays"), F.lit(1).cast("long").alias("n"))
    runs = materialize(_merged(entries, "leaf", max(leaves, 1), pick), "exact-runs")
    groups = materialize(tree_merge(runs, leaves, pick, bits).where("n > 1"), "exact-groups")
    # Back the way they came: a leaf has one entry for a key, and only its own rows join that.
    answers = runs.select("leaf", *KEY).join(groups, KEY)
    rows = found.join(answers, ["leaf", *KEY], "left")
    alone = F.col("n").isNull()
    return rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("stays.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("stays.row"))).alias("kept"),
        "digest",
    )


def drop_duplicates(docs: DataFrame, *, normal: Callable[[Column], Column] = unchanged, **settings) -> DataFrame:
    """The rows of ``docs`` that stay, all columns. Of rows with one id and text one stays; else as ``exact_duplicates``."""
    kept = exact_duplicates(docs, normal=normal, **settings).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest"))
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("boxed")
    t = normal(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(every, F.col("doc_id").alias("own_id"), F.unhex(F.sha2(t, 256)).alias("own_digest"))
    same = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_digest") == F.col("kept_digest"))
    left = rows.join(kept, same, "left_semi").dropDuplicates(["own_id", "own_digest"])
    return left.select(*[F.col("boxed").getField(c).alias(c) for c in docs.columns])


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def query(spark, sf_dir: str) -> DataFrame:
    out = exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
