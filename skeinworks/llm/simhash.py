"""SimHash near-duplicates: fingerprints of word shingles, compared in bit slices.

Documents with one fingerprint are one node. Distinct fingerprints within the radius share a
pigeonhole key; the members of a key are compared in cells of bounded size, and each cell gives
the edges of a spanning forest, never all pairs. Components of the edges are the groups.

A stage that is to catch copies with more edits than the radius covers (``wide``) adds links of its
own: fingerprints of words that have one of many samples of bits in common and are within a wider radius are
candidates, and those whose sets of shingles are alike enough, compared exactly, link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.llm.hashes import mixed, text_words
from skeinworks.llm.linking import CELL, Near, bucket_cells, connected_components, pigeonhole_keys, sampled_keys, tuned_blocks, verified_links
from skeinworks.llm.passages import runs
from skeinworks.llm.text import boxed, row_key
from skeinworks.runtime import materialize

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Copies with more edits: words of a shingle, and Jaccard similarity of the shingles of two that link.
WIDE_SHINGLE, SIMILARITY = 5, 0.8
#: Word fingerprints further apart are not compared; keys of each, and bits in a key. Of 9,005 pairs above
#: that similarity in 0.1 GB the distances are 4 in the median, 7 in 95 of 100, 9 in 99 and 12 at most.
WIDE_RADIUS, TABLES, SAMPLED = 12, 48, 22
#: Texts of one key that a task compares at once, about.
WIDE_CELL = 64
#: Shingle hashes whose bits are counted at once.
ROWS = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 without a word.

    A-Z are lower-cased. A bit is 1 if more than half the shingles' XXH64 have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    last = ends[min(shingle, len(words)) - 1 :] - 1
    shingles = map(joined.__getitem__, map(slice, starts[:n].tolist(), last.tolist()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, ROWS):
        part = hashes[k : k + ROWS].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in range(64) if 2 * ones[k] > n)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``bits``, the fingerprint as a signed 64-bit number, of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bits = np.array([fingerprint(t, shingle) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "bits": bits.view(np.int64)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, bits long")


def bit_sliced_forest(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the numbers of ``values`` that differ in ``radius`` bits or fewer.

    The values are stored as 64 planes, plane k holding bit k of all of them. A value is compared
    with all later ones at once: each plane gives a word of differences, which carry-save counters,
    one plane for each binary digit, add up. A lane leaves when its count exceeds the radius, and a
    block is abandoned once no lane is left.
    """
    n, full = len(values), (1 << len(values)) - 1
    rows = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = [int.from_bytes(row.tobytes(), "little") for row in np.packbits(rows.T, axis=1, bitorder="little")]
    own = [int(v) for v in values]
    digits = radius.bit_length()
    group, edges = [1 << k for k in range(n)], []
    root = list(range(n))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i in range(n - 1):
        alive = full & ~((1 << (i + 1)) - 1) & ~group[find(i)]
        if not alive:
            continue
        counter = [0] * digits
        for k in range(64):
            carry = (planes[k] ^ full if own[i] >> k & 1 else planes[k]) & alive
            for d in range(digits):
                counter[d], carry = counter[d] ^ carry, counter[d] & carry
            # Lanes that passed the counters' range, or whose count is above the radius.
            above, equal = carry, alive
            for d in reversed(range(digits)):
                if radius >> d & 1:
                    equal &= counter[d]
                else:
                    above |= equal & counter[d]
                    equal &= ~counter[d]
            alive &= ~above
            if not alive:
                break
        while alive:
            j = (alive & -alive).bit_length() - 1
            a, b = find(i), find(j)
            edges.append((i, j))
            alive &= ~group[b]
            root[b] = a
            group[a] |= group[b]
    return edges


def fingerprint_edges(nodes: DataFrame, *, radius: int = RADIUS, blocks: int | None = None, cell: int = CELL) -> DataFrame:
    """Edges (``a``, ``b``) that connect the ids of all fingerprints within ``radius`` of each other.

    ``nodes``: ``bits``, distinct, and ``id``. Any two such fingerprints share all but ``radius`` of
    ``blocks`` blocks: ``radius`` + 2 unless given, and more where there are more fingerprints.
    """
    blocks = blocks or tuned_blocks(nodes.count(), radius, radius + 2)
    keys = nodes.select(F.explode(pigeonhole_keys(F.col("bits"), blocks, blocks - radius)).alias("key"), "bits", "id")

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def forest(bits: pd.Series, ids: pd.Series) -> pd.Series:
        out = []
        for x, i in zip(bits, ids, strict=True):
            found = bit_sliced_forest(np.asarray(x, np.int64).view(np.uint64), radius)
            out.append([{"a": int(i[a]), "b": int(i[b])} for a, b in found])
        return pd.Series(out)

    cells = bucket_cells(keys, ["bits", "id"], cell)
    return cells.select(F.explode(forest("members.bits", "members.id")).alias("e")).select("e.a", "e.b")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row of ``docs``.

    Fingerprints that differ in ``radius`` bits or fewer link; component_id is the least doc_id that
    can be reached, the row's own included.

    Null or empty text: fingerprint zero, linked like any other. Very long texts: whole. Ties: a bit that is set in
    just half of the hashes is 0. Repeated rows: one row each. Rows
    with a null doc_id have the component of their fingerprint, null if no row with an id has that
    fingerprint. No rows: no rows. Other columns of ``docs`` are not read.
    """
    prints = materialize(fingerprints(docs, shingle), "simhash")
    nodes = materialize(prints.groupBy("bits").agg(F.min("doc_id").cast("long").alias("id")), "simhash-nodes")
    edges = fingerprint_edges(nodes.where("id IS NOT NULL"), radius=radius, cell=cell)
    groups = connected_components(edges).withColumnRenamed("node", "id")
    nodes = nodes.join(groups, "id", "left").select("bits", F.coalesce("component", "id").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint")
    return prints.join(nodes, "bits").select("doc_id", hexed, "component_id")


def word_fingerprint(words: np.ndarray) -> int:
    """The 64-bit SimHash of the distinct words of a text, given their hashes; 0 without a word."""
    if not len(words):
        return 0
    votes = mixed(np.unique(words))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(votes), ROWS):
        ones += np.unpackbits(votes[k : k + ROWS].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(votes))


def shingle_set(text: str | None, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``shingle`` words of a text in lower case; of fewer words, all of them in one."""
    words = text_words(text)[0]
    return np.unique(runs(words, min(shingle, len(words)))) if len(words) else words


def alike(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two sets, sorted, is ``least`` or more; two empty ones are equal."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def similar_text_edges(docs: DataFrame, texts: DataFrame, *, least: float = SIMILARITY, wide_radius: int = WIDE_RADIUS, wide_cell: int = WIDE_CELL) -> DataFrame:
    """Edges (``a``, ``b``) that connect the ``t`` of similar texts: ``t``, ``row`` (``row_key``) and ``wide`` (``word_fingerprint``) of ``texts``."""

    named = texts.select(F.col("t").alias("id"), "row", "wide")

    @F.pandas_udf("array<long>")
    def shingles(text: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t).view(np.int64) for t in text])

    def bodies(ids: DataFrame) -> DataFrame:
        wanted = materialize(ids.join(named, "id").select("id", "row"), "simhash-wanted")
        found = docs.select(row_key().alias("row"), "text").join(wanted, "row").dropDuplicates(["id"])
        return found.select("id", F.struct(shingles("text").alias("shingles")).alias("body"))

    def same(a: tuple, b: tuple) -> bool:
        x, y = (np.asarray(v[0], np.int64).view(np.uint64) for v in (a, b))
        return alike(x, y, least)

    entries = named.select(F.explode(sampled_keys(F.col("wide"), TABLES, SAMPLED)).alias("key"), "id", F.col("wide").alias("bits"))
    return verified_links(entries, bodies, same, "simhash-wide", wide_cell, Near(wide_radius))


def similar_documents(docs: DataFrame, *, shingle: int = SHINGLE, radius: int = RADIUS, cell: int = CELL, **wide) -> DataFrame:
    """``doc_id`` and ``component_id`` of every row: groups by the links of ``near_duplicates`` and of ``similar_text_edges`` together.

    Texts whose words are the same are one node, so that exact copies are compared with nothing. Rows as in
    ``near_duplicates``; texts without a word are equal to one another. Which similar pairs become candidates is a
    matter of chance (``sampled_keys``); no pair below ``least`` links but by the fingerprints of ``near_duplicates``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [text_words(t)[0] for t in b["text"]]
            columns = {
                "bits": [fingerprint(t, shingle) for t in b["text"]],
                "h": [xxhash.xxh64_intdigest(w.tobytes()) for w in words],
                "wide": [word_fingerprint(w) for w in words],
            }
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "row": b["row"], **{c: np.array(v, np.uint64).view(np.int64) for c, v in columns.items()}})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text")
    prints = materialize(rows.mapInPandas(run, "doc_id long, row long, bits long, h long, wide long"), "simhash")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row"))).alias("first")
    texts = prints.groupBy("h", "bits").agg(first, F.min("wide").alias("wide"))
    texts = materialize(texts.select(F.xxhash64("h", "bits").alias("t"), "h", "bits", "wide", F.col("first.doc_id").alias("id"), "first.row"), "simhash-texts")
    known = texts.where("id IS NOT NULL")
    # As in near_duplicates, a fingerprint goes by the least id that has it.
    nodes = materialize(known.groupBy("bits").agg(F.min("id").alias("id")), "simhash-nodes")
    equal = known.join(nodes.withColumnRenamed("id", "b"), "bits").where("id <> b").select(F.col("id").alias("a"), "b")
    close = fingerprint_edges(nodes, radius=radius, cell=cell)
    similar = materialize(similar_text_edges(docs, known, **wide).distinct(), "simhash-similar")
    ids = [known.select(F.col("t").alias(c), F.col("id").alias(f"id_{c}")) for c in ("a", "b")]
    similar = similar.join(ids[0], "a").join(ids[1], "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    groups = connected_components(equal.unionByName(close).unionByName(similar)).withColumnRenamed("node", "id")
    found = texts.join(groups, "id", "left").select("h", "bits", F.coalesce("component", "id").alias("component_id"))
    return prints.join(found, ["h", "bits"]).select("doc_id", "component_id")


def one_of_each_group(docs: DataFrame, *, wide: bool = False, **settings) -> DataFrame:
    """``docs`` less the documents whose component has a lesser doc_id; all columns are returned.

    Components are those of ``near_duplicates``, or with ``wide`` of ``similar_documents``. Rows with a null doc_id
    stay, and of repeated rows all or none. Else as those.
    """
    groups = similar_documents(docs, **settings) if wide else near_duplicates(docs, **settings)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    left = boxed(docs, own_id=F.col("doc_id")).join(gone, F.col("own_id") == F.col("gone_id"), "left_anti")
    return left.select(*[F.col("boxed").getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
