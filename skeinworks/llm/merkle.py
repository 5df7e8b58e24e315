"""Merkle fingerprints of documents over paragraphs and sections, in DataFrame operations.

A text is split into paragraphs (its lines). A paragraph's node is the SHA-256 of its text. A
section ends with an empty paragraph, or with one whose first label starts with 0 or 1, so that an
edit moves no other section's ends; its node is the SHA-256 of its paragraphs' nodes, and the root
that of the sections' nodes. Equal roots mean equal texts.

The fingerprint is the root, ``|``, and for every paragraph the labels of its leaves, closed by
``;`` or, at a section's end, ``/``. A leaf is a sentence, or at most 32 characters of one; its
label has 24 bits of its MD5. So two fingerprints alone show which paragraphs differ, and how much.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.llm.text import let
from skeinworks.runtime import materialize

LEAF = "[^\\n.!?]{1,32}[.!?]*|[.!?]+"
LABEL = 6


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null counts as empty."""

    def node(p: Column) -> Column:
        labels = F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.substring(F.md5(x), 1, LABEL))
        return F.struct(F.array_join(labels, "").alias("labels"), F.sha2(p, 256).alias("node"))

    def whole(nodes: Column) -> Column:
        end = lambda n: F.when(n["labels"].rlike("^([01]|$)"), "/").otherwise(";")
        body = F.array_join(F.transform(nodes, lambda n: F.concat(n["labels"], end(n))), "")
        tree = F.array_join(F.transform(nodes, lambda n: F.concat(n["node"], end(n))), "")
        root = F.sha2(F.array_join(F.transform(F.split(tree, "/"), lambda s: F.sha2(s, 256)), ""), 256)
        return F.concat(root, F.lit("|"), body)

    return let(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), node), whole)


def root(print_: Column) -> Column:
    return F.substring_index(print_, "|", 1)


def _labels(print_: Column) -> Column:
    body = F.substring_index(print_, "|", -1)
    return F.array_distinct(F.regexp_extract_all(body, F.lit("[0-9a-f]{%d}" % LABEL), F.lit(0)))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else the labels that two fingerprints share among all they have, the two
    roots included: less than 1 for different texts."""

    def shared(x: Column) -> Column:
        both = F.size(F.array_intersect(x["a"], x["b"]))
        return both / (F.size(x["a"]) + F.size(x["b"]) - both + 2)

    sets = F.struct(_labels(a).alias("a"), _labels(b).alias("b"))
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(let(sets, shared))


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Places (from 0) of the paragraphs of the first text that the second does not have at all.

    Sections whose labels are equal are passed over as wholes: only paragraphs of sections that
    differ are compared.
    """

    def changed(x: Column) -> Column:
        same = F.array_intersect(x["a"], x["b"])
        marked = F.transform(x["a"], lambda s: F.when(F.array_contains(same, s), F.regexp_replace(s, "[^;]+", "=")).otherwise(s))
        own = F.split(F.array_join(marked, ";"), ";")
        other = F.flatten(F.transform(x["b"], lambda s: F.split(s, ";")))
        places = F.transform(own, lambda p, k: F.when((p != "=") & (p != "") & ~F.array_contains(other, p), k))
        return F.filter(places, lambda k: k.isNotNull())

    sections = lambda p: F.split(F.regexp_replace(F.substring_index(p, "|", -1), "[;/]$", ""), "/")
    return let(F.struct(sections(a).alias("a"), sections(b).alias("b")), changed)


def next_ids(ids: DataFrame) -> DataFrame:
    """``doc_id`` and ``next_id``, the next smaller id, and for the least the greatest of all.

    ``ids`` has ``doc_id``, distinct, no nulls. Ids are put into ranges; each range looks back within
    itself, and its least id at the greatest of the range before: one row a range, never all ids,
    meets in one task.
    """
    ranged = materialize(ids.repartitionByRange("doc_id").withColumn("range", F.spark_partition_id()), "id-ranges")
    back = F.lag("doc_id").over(Window.partitionBy("range").orderBy("doc_id"))
    tops = ranged.groupBy("range").agg(F.max("doc_id").alias("top"))
    order = Window.orderBy("range")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.select("range", F.coalesce(F.lag("top").over(order), F.max("top").over(everything)).alias("below"))
    return ranged.withColumn("back", back).join(tops, "range").select("doc_id", F.coalesce("back", "below").alias("next_id"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs``, of its edited text, and how near they are.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many, or
    all, of the next document by descending doc_id, after the least the greatest. Returns doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    Null text: empty. Repeated ids: each row is edited with the next other id; of an id's rows, the
    one whose text begins least is what others are edited with. Very long texts: whole. Null doc_id: no place in the order, so
    edited with an empty text and near_next null. One id alone: next to itself. No rows: no rows.
    Other columns of ``docs`` are not read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    third = F.floor(F.length("text") / 3).cast("int")
    # Both joins take this table by doc_id alone, so that its texts are shuffled once for the two.
    placed, apart = rows.where("doc_id IS NOT NULL"), rows.where("doc_id IS NULL")
    chain = next_ids(placed.select("doc_id").distinct())
    # An id asks once, for the longest head that any of its rows takes.
    sizes = placed.groupBy("doc_id").agg(F.max(third).alias("third"))
    wanted = sizes.join(chain, "doc_id").select(F.col("doc_id").alias("for_id"), "third", F.col("next_id").alias("doc_id"))
    heads = placed.join(wanted, "doc_id").select("for_id", F.struct(F.left("text", "third").alias("head"), fingerprint(F.col("text")).alias("print")).alias("next"))
    heads = heads.groupBy("for_id").agg(F.min("next").alias("next"))
    paired = placed.join(heads, F.col("doc_id") == F.col("for_id"))
    alone = apart.select("doc_id", "text", F.lit("").alias("head"), F.lit(None).cast("string").alias("next_print"))
    both = paired.select("doc_id", "text", F.left(F.col("next.head"), third).alias("head"), F.col("next.print").alias("next_print")).unionByName(alone)
    edited = both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.concat(F.left("text", F.length("text") - third), F.col("head")).alias("edited"),
        fingerprint(F.col("text")).alias("fingerprint"),
        "next_print",
    )
    edited = edited.withColumns({"edited_sha256": F.sha2("edited", 256), "edited_fingerprint": fingerprint(F.col("edited"))})
    return edited.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"),
    )


SQL = """
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
chained AS (
  SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS following
  FROM rows),
edits AS (
  SELECT *, length(text)::BIGINT AS n_chars,
         left(text, length(text) - length(text) // 3) || left(following, length(text) // 3) AS edited FROM chained),
texts AS (
  SELECT doc_id, 'own' AS kind, text FROM edits
  UNION ALL SELECT doc_id, 'edited', edited FROM edits UNION ALL SELECT doc_id, 'next', following FROM edits),
nodes AS (
  SELECT doc_id, kind, [{'l': list_aggregate([x[:6] FOR x IN [md5(y) FOR y IN regexp_extract_all(p, '[^\\n.!?]{1,32}[.!?]*|[.!?]+')]], 'string_agg', ''),
                         'n': sha256(p)} FOR p IN string_split(text, chr(10))] AS m
  FROM texts),
ended AS (
  SELECT doc_id, kind, [{'l': coalesce(x.l, ''), 'n': x.n, 'e': CASE WHEN coalesce(x.l, '') = '' OR x.l[1] IN ('0', '1') THEN '/' ELSE ';' END} FOR x IN m] AS m
  FROM nodes),
prints AS (
  SELECT doc_id, kind, array_to_string([x.l || x.e FOR x IN m], '') AS body, array_to_string([x.n || x.e FOR x IN m], '') AS tree FROM ended),
trees AS (
  SELECT doc_id, kind, sha256(array_to_string([sha256(s) FOR s IN string_split(tree, '/')], '')) AS root, body,
         list_distinct(regexp_extract_all(body, '[0-9a-f]{6}')) AS labels FROM prints)
SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, o.root || '|' || o.body AS fingerprint, d.root || '|' || d.body AS edited_fingerprint,
       CASE WHEN o.root = d.root THEN 1.0::DOUBLE ELSE len(list_intersect(o.labels, d.labels))::DOUBLE
            / (len(o.labels) + len(d.labels) - len(list_intersect(o.labels, d.labels)) + 2) END AS near_edited,
       CASE WHEN o.root = n.root THEN 1.0::DOUBLE ELSE len(list_intersect(o.labels, n.labels))::DOUBLE
            / (len(o.labels) + len(n.labels) - len(list_intersect(o.labels, n.labels)) + 2) END AS near_next
FROM edits e JOIN trees o ON o.doc_id = e.doc_id AND o.kind = 'own' JOIN trees d ON d.doc_id = e.doc_id AND d.kind = 'edited'
JOIN trees n ON n.doc_id = e.doc_id AND n.kind = 'next'
"""


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
