"""Repeated passages: MinHash banding of paragraphs, exact Jaccard similarity, and removal.

A document gives two kinds of units. Paragraphs are its lines of enough words, and runs of shorter
lines that together have as many. Windows are all runs of ``WORDS`` words that occur again, wherever
they stand. To find them, seeds of fewer words are taken at places the text itself picks, such that
every window holds one (winnowing); where a seed occurs again, all windows around it are compared.
Units with the same words are one form. Paragraphs whose shingle sets are alike meet in a MinHash
band, are compared exactly, and connected ones are a group.
Of each group the first occurrence stays, and the rest are cut. Windows are sought in what is left of
the paragraphs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.llm.hashes import STEP, mixed, text_words
from skeinworks.llm.linking import CELL, connected_components, verified_links
from skeinworks.llm.text import boxed, pieces, row_key
from skeinworks.runtime import materialize

SHINGLE = 5
SIMILARITY = 0.8
#: Words of a window, and of the shortest paragraph that counts.
WORDS = 20
#: Words of a seed; every window holds the one whose hash is least in it.
SEED = 10
#: Minima that are equal in a band, and the share of similar pairs that must meet in some band.
ROWS, RECALL = 3, 0.999

#: Paragraphs whose bands a task has given out already.
SEEN = 1_000_000

_SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def tune_bands(similarity: float = SIMILARITY, rows: int = ROWS, recall: float = RECALL) -> int:
    """The fewest bands in which ``recall`` of the pairs at ``similarity`` meet."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` words, in order."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = out * STEP + hashes[k : k + len(out)]
    return mixed(out)


def anchors(seeds: np.ndarray, window: int = WORDS - SEED + 1) -> np.ndarray:
    """Places of the least hash, the last if there are several, of each ``window`` in a row."""
    if len(seeds) < window:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(seeds[::-1], window)
    return np.unique(len(seeds) - 1 - np.arange(len(view)) - view.argmin(axis=1))


def paragraphs(lengths: list[int], words: int = WORDS) -> list[tuple[int, int]]:
    """Start and length, in words, of the lines of ``words`` or more, and of the runs of shorter
    lines between those and empty ones that have so many together."""
    out, start, short = [], 0, 0
    for n in [*lengths, 0]:
        if n == 0 or n >= words:
            if short >= words:
                out.append((start - short, short))
            if n:
                out.append((start, n))
            short = 0
        else:
            short += n
        start += n
    return out


def units(text: str | None, shingle: int = SHINGLE, words: int = WORDS) -> tuple[list[tuple[int, int, int, np.ndarray]], np.ndarray, np.ndarray]:
    """Start (in words), length, hash and shingle hashes of a text's paragraphs; places and hashes of its seeds."""
    hashes, lengths = text_words(text)
    small, out = runs(hashes, shingle), []
    for start, n in paragraphs(lengths, words):
        own = hashes[start : start + n]
        out.append((start, n, xxhash.xxh64_intdigest(own.tobytes()), small[start : start + n - shingle + 1]))
    seeds = runs(hashes, SEED)
    places = anchors(seeds)
    return out, places, seeds[places]


def bands(shingles: list[np.ndarray], n: int, rows: int = ROWS) -> np.ndarray:
    """For each set of shingle hashes, ``n`` band keys, each of ``rows`` minima."""
    if not shingles:
        return np.zeros((0, n), np.uint64)
    counts = np.fromiter(map(len, shingles), np.int64, len(shingles))
    flat, at = np.concatenate(shingles), np.cumsum(counts) - counts
    out = np.zeros((len(shingles), n), np.uint64)
    odd = np.random.default_rng(1).integers(0, 1 << 63, n * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for k in range(n * rows):
        least = np.minimum.reduceat(flat * odd[k], at)
        out[:, k // rows] = mixed(out[:, k // rows] + least + np.uint64(k))
    return out


def all_units(docs: DataFrame, n_bands: int) -> DataFrame:
    """``doc_id``, ``row`` (``row_key``), ``start``, ``n``, ``h`` and ``bands`` of every paragraph, with the ``seeds`` inside it.

    The seeds that are inside no paragraph are in a row without ``h``. A paragraph that comes again in a
    task has its bands but once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            for a, b in pieces(batch["text"].tolist()):
                rows, new = [], {}
                if len(seen) > SEEN:
                    seen.clear()
                for d, r, t in zip(batch["doc_id"][a:b], batch["row"][a:b], batch["text"][a:b], strict=True):
                    own, places, seeds = units(t)
                    free = np.ones(len(places), bool)
                    for start, n, h, shingles in own:
                        lo, hi = np.searchsorted(places, (start, start + n - SEED + 1))
                        free[lo:hi] = False
                        rows.append([d, r, start, n, h, places[lo:hi], seeds[lo:hi]])
                        if h not in seen:
                            seen.add(h)
                            new[h] = shingles
                    if free.any():
                        rows.append([d, r, 0, 0, None, places[free], seeds[free]])
                keys = dict(zip(new, bands(list(new.values()), n_bands).view(np.int64).tolist(), strict=True))
                signed = lambda h: None if h is None else h - (h >> 63 << 64)
                yield pd.DataFrame(
                    {
                        "doc_id": np.array([x[0] for x in rows], np.int64),
                        "row": np.array([x[1] for x in rows], np.int64),
                        "start": np.array([x[2] for x in rows], np.int32),
                        "n": np.array([x[3] for x in rows], np.int32),
                        "h": pd.Series([signed(x[4]) for x in rows], dtype="Int64"),
                        "bands": pd.Series([keys.pop(x[4], None) for x in rows], dtype=object),
                        "places": pd.Series([x[5].astype(np.int32) for x in rows], dtype=object),
                        "seeds": pd.Series([x[6].view(np.int64) for x in rows], dtype=object),
                    }
                )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text").where("doc_id IS NOT NULL")
    return chosen.mapInPandas(run, "doc_id long, row long, start int, n int, h long, bands array<long>, places array<int>, seeds array<long>")


def alike(a: tuple, b: tuple, least: float = SIMILARITY) -> bool:
    """Whether two sorted arrays of distinct shingle hashes have Jaccard similarity ``least`` or more."""
    small, large = sorted((len(a[0]), len(b[0])))
    if small < least * large:
        return False
    both = len(np.intersect1d(a[0], b[0], assume_unique=True))
    return both >= least * (small + large - both) - 1e-9


def paragraph_edges(docs: DataFrame, whole: DataFrame, forms: DataFrame, least: float = SIMILARITY, cell: int = CELL) -> DataFrame:
    """Edges (``a``, ``b``) between the hashes of similar paragraphs.

    ``whole``: of ``all_units``. ``forms``: ``h`` and ``first`` (struct of doc_id, row, start and n) of distinct paragraphs.
    """
    keys = whole.where("bands IS NOT NULL").select("h", F.posexplode("bands").alias("band", "least")).select(F.xxhash64("band", "least").alias("key"), F.col("h").alias("id"))

    @F.pandas_udf("array<struct<h:long,shingles:array<long>>>")
    def fetch(text: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for t, wanted in zip(text, places, strict=True):
            hashes, rows = text_words(t)[0], []
            for p in wanted:
                own = hashes[p["start"] : p["start"] + p["n"]]
                if xxhash.xxh64_intdigest(own.tobytes()) == p["h"] & (1 << 64) - 1:
                    rows.append({"h": p["h"], "shingles": np.unique(runs(own, SHINGLE)).view(np.int64)})
            out.append(rows)
        return pd.Series(out)

    def bodies(ids: DataFrame) -> DataFrame:
        wanted = forms.join(ids.withColumnRenamed("id", "h"), "h").groupBy("first.row").agg(F.collect_list(F.struct("first.start", "first.n", "h")).alias("places"))
        texts = docs.where("doc_id IS NOT NULL").select(row_key().alias("row"), "text").join(materialize(wanted, "passage-places"), "row")
        found = texts.select(F.explode(fetch("text", "places")).alias("x")).select("x.*").dropDuplicates(["h"])
        return found.select(F.col("h").alias("id"), F.struct("shingles").alias("body"))

    return verified_links(keys, bodies, lambda a, b: alike(a, b, least), "passages", cell)


def repeated_windows(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """``doc_id``, ``row``, ``start`` and ``h`` of all windows that hold a seed which occurs again.

    Two windows of the same words hold the same least seed, so all windows that occur again are among
    them. ``seeds``: ``row``, ``start`` and ``seed``.
    """
    again = seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("seed")
    places = materialize(seeds.join(materialize(again, "seeds-again"), "seed").select("row", "start"), "seed-places")
    places = materialize(places.groupBy("row").agg(F.collect_set("start").alias("places")), "seeds-by-row")

    @F.pandas_udf("array<struct<start:int,h:long>>")
    def around(text: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for t, wanted in zip(text, places, strict=True):
            large = runs(text_words(t)[0], WORDS)
            near = (np.asarray(wanted, np.int64)[:, None] - np.arange(WORDS - SEED + 1)).ravel()
            near = np.unique(near[(near >= 0) & (near < len(large))])
            out.append([{"start": a, "h": h} for a, h in zip(near.tolist(), large[near].view(np.int64).tolist(), strict=True)])
        return pd.Series(out)

    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text").join(places, "row")
    return texts.select("doc_id", "row", F.explode(around("text", "places")).alias("x")).select("doc_id", "row", "x.start", "x.h")


def beyond(found: DataFrame, keeper: str, n: Column) -> DataFrame:
    """``doc_id``, ``row``, ``start``, ``n`` and ``keeper`` (its doc_id) of the units ``found`` that do not overlap
    their first occurrence, a struct ``keeper`` of ``n`` words."""
    first = F.col(keeper)
    apart = (F.col("row") != first["row"]) | (F.col("start") >= first["start"] + n)
    return found.where(apart).select("doc_id", "row", "start", "n", first["doc_id"].alias("keeper"))


def repeated_passages(docs: DataFrame, *, least: float = SIMILARITY, recall: float = RECALL, cell: int = CELL) -> DataFrame:
    """``doc_id``, ``row`` (``row_key``), ``spans`` and ``keepers`` of every row that repeats a passage.

    ``spans``: disjoint runs of words (start, end) to cut, in order; ``keepers``: the documents where
    the first occurrences stay, sorted. A passage repeated inside its own document stays once.
    """
    whole = materialize(all_units(docs, tune_bands(least, ROWS, recall)), "units")
    lines = whole.where("h IS NOT NULL").select("doc_id", "row", "start", "n", "h")
    forms = materialize(lines.groupBy("h").agg(F.min(F.struct("doc_id", "row", "start", "n")).alias("first"), F.count(F.lit(1)).alias("n_units")), "passage-firsts")
    groups = materialize(connected_components(paragraph_edges(docs, whole, forms, least, cell)).withColumnRenamed("node", "h"), "passage-components")
    known = forms.join(groups, "h", "left").where("component IS NOT NULL OR n_units > 1")
    known = materialize(known.select("h", F.coalesce("component", "h").alias("g"), "first"), "passage-forms")
    keepers = materialize(known.groupBy("g").agg(F.min("first").alias("keeper")), "passage-keepers")
    again = materialize(known.join(keepers, "g").select("h", "keeper"), "passage-repeats")
    paragraphs_gone = materialize(beyond(lines.join(again, "h"), "keeper", F.col("keeper.n")), "paragraphs-gone")
    # Paragraphs that are cut tell nothing more: windows are sought in what is left.
    others = whole.select("row", "start", "n", "places", "seeds").join(paragraphs_gone.select("row", "start", "n"), ["row", "start", "n"], "left_anti")
    seeds = others.select("row", F.explode(F.arrays_zip("places", "seeds")).alias("s")).select("row", F.col("s.places").alias("start"), F.col("s.seeds").alias("seed"))
    windows = materialize(repeated_windows(docs, materialize(seeds, "seeds")), "windows")
    again = windows.groupBy("h").agg(F.min(F.struct("doc_id", "row", "start")).alias("first"), F.count(F.lit(1)).alias("n_units")).where("n_units > 1")
    again = materialize(again.select("h", "first"), "window-firsts")
    windows_gone = materialize(beyond(windows.withColumn("n", F.lit(WORDS)).join(again, "h"), "first", F.lit(WORDS)), "windows-gone")
    gone = paragraphs_gone.unionByName(windows_gone).withColumn("end", F.col("start") + F.col("n"))
    gone = gone.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "end")).alias("cuts"), F.array_sort(F.collect_set("keeper")).alias("keepers"))

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def joined(cuts: pd.Series) -> pd.Series:
        out = []
        for spans in cuts:
            done: list[dict[str, int]] = []
            for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
                if done and s["start"] <= done[-1]["end"]:
                    done[-1]["end"] = max(done[-1]["end"], s["end"])
                else:
                    done.append({"start": s["start"], "end": s["end"]})
            out.append(done)
        return pd.Series(out)

    return gone.select("doc_id", "row", joined("cuts").alias("spans"), "keepers")


def dedup_passages(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``; all their first occurrences stay.

    A passage is a paragraph (a line, or a run of lines that are shorter) of ``WORDS`` words or more
    whose 5-word shingles are alike (Jaccard similarity ``least`` or more, or connected by such), or
    any run of as many equal words or more, which is cut whole. First is by doc_id, then place.

    Null or empty text: unchanged. Null doc_id: takes no part, unchanged. Rows of one id and different
    texts are documents of their own, in an order that their texts give; equal rows lose the same spans.
    Ties of place: the shorter unit is first. Very long texts: whole. No rows: no rows. All columns of
    ``docs`` are returned, whatever their names.
    """

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, spans, strict=True):
            if t is None or s is None or not len(s):
                out.append(t)
                continue
            words = [m.span() for m in _SPACED.finditer(t)]
            pieces, done = [], 0
            for span in s:
                first, last = int(span["start"]), min(int(span["end"]), len(words)) - 1
                pieces.append(t[done : words[first][0]])
                done = words[last][1]
            out.append("".join([*pieces, t[done:]]))
        return pd.Series(out, dtype=object)

    gone = repeated_passages(docs, **settings).select("row", "spans")
    whole = boxed(docs, row=F.when(F.col("doc_id").isNotNull(), row_key())).join(gone, "row", "left")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut("text", "spans"))
    return whole.select(*[(text if c == "text" else F.col("boxed").getField(c)).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """One row per document: its class (the first document of a passage that it repeats, else
    itself), the documents that keep its passages, and the runs of words to cut."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = docs.select("doc_id", row_key().alias("row")).join(repeated_passages(docs).drop("doc_id"), "row", "left")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.least("doc_id", F.array_min("keepers")).alias("class_id"),
        F.coalesce("keepers", F.array().cast("array<long>")).alias("keepers"),
        F.coalesce(removed, F.lit(0).cast("long")).alias("removed_words"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )
