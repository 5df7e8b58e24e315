"""Shared parts of the near-duplicate operators: bounded cells of colliding items, and components."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from skeinworks.llm.hashes import mixed
from skeinworks.runtime import materialize

#: Items of one bucket that a task compares at once, about; larger buckets are dealt out.
CELL = 512
#: Pairs of a cell that are tried at once, about.
PAIRS = 1 << 17
#: Entries of keys, many in a row: 32 bits each of their keys, ids, fingerprints, sizes, all of one of ``PARTS`` parts of the keys.
PACKED = "part int, key binary, above binary, id binary, bits binary, size binary"
PARTS = 1024
#: The size of what may be near to ids of any size and fingerprint.
ANY = 255
#: Pairs that are verified at once where ``may_be`` alone tells, or bytes of their bodies.
TRIED, BYTES = 1 << 14, 1 << 25
#: Leaders of a key with more than two ids, at most; and ids of a key that a task compares by their fingerprints.
LEADERS, WIDE = 64, 4096


def pigeonhole_keys(bits: Column, blocks: int, intact: int, width: int = 64) -> Column:
    """Keys of a fingerprint such that any two within ``blocks - intact`` bits have one in common.

    The fingerprint is cut into ``blocks``; so few differing bits leave ``intact`` blocks equal. There
    is a key for every choice of ``intact`` blocks: their bits in place, and the number of the choice.
    """
    edges = [width * k // blocks for k in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    keys = []
    for k, chosen in enumerate(combinations(masks, intact)):
        mask = sum(chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.xxhash64(F.lit(k), bits.bitwiseAND(F.lit(signed))))
    return F.array(*keys)


def pigeonhole_hashes(bits: np.ndarray, blocks: int, intact: int, width: int = 64) -> np.ndarray:
    """Hashes of 32 bits, in a row for each choice of blocks, as ``pigeonhole_keys`` has keys."""
    edges = [width * k // blocks for k in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return np.stack([(mixed(bits & np.uint64(sum(chosen))) >> np.uint64(32)).astype(np.int64) for chosen in combinations(masks, intact)])


def sampled_keys(bits: Column, tables: int, sampled: int, seed: int = 6) -> Column:
    """``tables`` keys of a fingerprint, each the values of ``sampled`` bits, chosen at random once and for all.

    Two fingerprints that differ in d of 64 bits have a key in common with a chance of
    ``1 - (1 - C(64 - d, sampled) / C(64, sampled)) ** tables``, at any number of fingerprints.
    """
    draw = random.Random(seed)
    masks = [sum(1 << k for k in draw.sample(range(64), sampled)) for _ in range(tables)]
    return F.array(*[F.xxhash64(F.lit(k), bits.bitwiseAND(F.lit(m - (m >> 63 << 64)))) for k, m in enumerate(masks)])


def tuned_blocks(n: int, differing: int, least: int, width: int = 64) -> int:
    """Blocks into which to cut ``n`` distinct fingerprints, ``least`` or more.

    The intact ones hold so many bits that a fingerprint meets 1/16 of another one by chance under a
    key, whatever ``n`` is; pairs within ``differing`` bits meet with any number.
    """
    blocks = least
    while width * (blocks - differing) / blocks < math.log2(max(n, 1)) + 4 and blocks < width:
        blocks += 1
    return blocks


def bucket_cells(entries: DataFrame, item: list[str], cell: int = CELL) -> DataFrame:
    """Lists of the items that share a ``key``, so that any two of them are together in some list.

    ``entries``: ``key`` and the columns ``item``, distinct. Keys with one item give no list. A key
    with at most ``cell`` items gives one list. The items of a larger key are dealt into chunks of
    about ``cell`` by hash, and each two chunks give a list: no task holds more than about two
    chunks of a key, and no pair is lost. Returns one column, ``members``: an array of structs.
    """
    counts = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / cell).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(7), *item), F.col("chunks")).cast("int")
    others = F.array_remove(F.sequence(F.lit(0), F.col("chunks") - 1), F.col("mine"))
    pairs = F.transform(others, lambda d: F.struct(F.least(F.col("mine"), d).alias("a"), F.greatest(F.col("mine"), d).alias("b")))
    alone = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    dealt = entries.join(counts, "key").withColumn("chunks", chunks).withColumn("mine", mine)
    dealt = dealt.select("key", *item, F.explode(F.when(F.col("chunks") == 1, alone).otherwise(pairs)).alias("at"))
    return dealt.groupBy("key", "at").agg(F.collect_list(F.struct(*item)).alias("members")).where(F.size("members") > 1).select("members")


def colliding(entries: DataFrame) -> DataFrame:
    """``key``, ``id``, ``pivot`` and ``crowded`` of all ids that share a ``key`` with another one, but the pivot, its least id.

    ``entries``: ``key`` and ``id``, repeats allowed, nulls left out. ``crowded``: whether the key has more than two ids. Keys are
    shuffled once; a task holds those of its partition and their ids, 16 bytes an entry.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        key, item = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        # Most keys come once; those whose slot no other entry has need no sorting.
        slots = key & ((1 << (2 * len(key)).bit_length()) - 1)
        often = np.bincount(slots)[slots] > 1
        key, item = key[often], item[often]
        order = np.lexsort((item, key))
        key, item = key[order], item[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (item[1:] != item[:-1])
        key, item = key[new], item[new]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        begins = np.flatnonzero(first)
        n = np.diff(begins, append=len(key))
        pivot, crowded = np.repeat(item[begins], n)[~first], np.repeat(n > 2, n)[~first]
        found = pa.RecordBatch.from_arrays([pa.array(x) for x in (key[~first], item[~first], pivot, crowded)], ["key", "id", "pivot", "crowded"])
        for k in range(0, found.num_rows, 1 << 16):
            yield found.slice(k, 1 << 16)

    known = entries.select("key", "id").where("key IS NOT NULL AND id IS NOT NULL")
    return known.repartition("key").mapInArrow(run, "key long, id long, pivot long, crowded boolean")


def verified_links(
    entries: DataFrame,
    bodies: Callable[[DataFrame], DataFrame],
    same: Callable[[tuple, tuple], bool] | None,
    label: str,
    cell: int = CELL,
    near: Near | None = None,
    may_be: Callable[[list[tuple], np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """Edges (``a``, ``b``) that connect all ids that share a ``key`` and are the ``same``.

    ``entries``: ``key`` and ``id``, repeats allowed. ``bodies`` gives, for a table of ids, ``id`` and ``body``, a
    struct; ``same`` compares two bodies, each as a tuple. With ``may_be``, many pairs are tried at once before ``same``:
    it gets bodies and two arrays of places among them, and tells which of these pairs may be the same. With ``near``,
    entries have ``bits`` too, or are ``PACKED``, and pairs that it tells apart are not compared: see ``near_links``; without ``same``, what ``may_be`` tells is so.

    In each key all ids are first compared with its least one, the
    pivot. Those that match it are connected by it and need not be compared among themselves; only
    pairs with an id that does not match are, and of those in a cell that match, an odd one needs but one link. So a large group of copies costs one comparison a
    member, and no pair is lost. What remains to be compared is dealt out in cells of about ``cell`` ids on
    either side. What a join by a pivot makes is written before it is grouped, so that
    the planner can split a large key between tasks.
    """
    if near is not None:
        return near_links(entries, bodies, same, label, cell, near, may_be)
    inside = materialize(colliding(entries), f"{label}-colliding")
    crowded = inside.where("crowded").select("key", "id", "pivot")
    tried = materialize(inside.select("id", "pivot").distinct(), f"{label}-tried")
    both = [df.select(F.col(c).alias("id")) for df in (tried, crowded) for c in ("id", "pivot")]
    known = materialize(bodies(reduce(DataFrame.unionByName, both).distinct()), f"{label}-bodies")
    matched = materialize(_matching(tried.toDF("a", "b"), known, same, may_be).toDF("id", "pivot"), f"{label}-matched")

    tested = crowded.join(matched.withColumn("hit", F.lit(True)), ["id", "pivot"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    kinds = F.when(F.col("hit"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    members = materialize(tested.select("key", "id", "hit", F.explode(kinds).alias("odd")), f"{label}-members")
    cells = _crossing(members, cell).join(known, "id").groupBy("key", "a", "b").agg(F.collect_list(F.struct("id", "odd", "hit", "body")).alias("m"))

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def crossed(ids: pd.Series, odds: pd.Series, hits: pd.Series, held: pd.Series) -> pd.Series:
        cells = zip(ids, odds, hits, ([tuple(v.values()) for v in x] for x in held), strict=True)
        return pd.Series(_links_of_cells(cells, same, may_be))

    found = cells.select(F.explode(crossed("m.id", "m.odd", "m.hit", "m.body")).alias("e")).select("e.a", "e.b")
    return found.unionByName(matched.select(F.col("id").alias("a"), F.col("pivot").alias("b")))


def _matching(pairs: DataFrame, known: DataFrame, same: Callable | None, may_be: Callable | None) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose bodies in ``known`` are the ``same``."""

    @F.pandas_udf("boolean")
    def matches(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        items = [*a.itertuples(index=False, name=None), *b.itertuples(index=False, name=None)]
        n = len(a)
        out = np.ones(n, bool) if may_be is None else may_be(items, np.arange(n), np.arange(n, 2 * n))
        for k in np.flatnonzero(out).tolist():
            out[k] = same(items[k], items[n + k])
        return pd.Series(out, dtype=bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            n = sum(b.num_rows for b in held)
            if n and (batch is None or n >= TRIED or sum(b.nbytes for b in held) >= BYTES):
                items = [tuple(x.values()) for c in ("a_body", "b_body") for b in held for x in b.column(c).to_pylist()]
                found = pa.array(may_be(items, np.arange(n), np.arange(n, 2 * n)), pa.bool_())
                yield from pa.Table.from_batches(held).select(["a", "b"]).filter(found).to_batches()
                held = []

    one, other = (known.select(F.col("id").alias(c), F.col("body").alias(f"{c}_body")) for c in "ab")
    both = pairs.join(one, "a").join(other, "b").select("a", "b", "a_body", "b_body")
    return both.where(matches("a_body", "b_body")).select("a", "b") if same else both.mapInArrow(run, "a long, b long")


@dataclass(frozen=True)
class Near:
    """What tells ids apart without their bodies.

    Not compared are two ids whose ``bits`` differ in more than ``far`` places or whose sizes (0 to 254) differ by
    more than ``gap``; an id of size ``ANY`` is near to all. With ``sketch``, the table of bodies has a third column,
    ``sketch``, binary and of one length: of a matrix of them, two arrays of rows and the bytes' number it tells which pairs may be the same.
    """

    far: int
    gap: int = 0
    sketch: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None

    def __call__(self, bits: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray, far: int | np.ndarray | None = None) -> np.ndarray:
        a, b = size[x], size[y]
        apart = (np.bitwise_count(bits[x] ^ bits[y]) > (self.far if far is None else far)) | (np.abs(a - b) > self.gap)
        return ~apart | (a == ANY) | (b == ANY)


def packed(key: np.ndarray, id: np.ndarray, bits: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """Entries as rows of ``PACKED``: one for each of ``PARTS`` parts of the keys, by bits 22 to 31 of them."""
    part = ((key >> 22) & (PARTS - 1)).astype(np.uint16)
    order = np.argsort(part, kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=PARTS))
    found = np.flatnonzero(np.diff(ends, prepend=0))
    edges = np.concatenate(([0], ends[found]))
    columns = [pa.array(found.astype(np.int32))]
    for x, kind in ((key, "<u4"), (key >> 32, "<u4"), (id, "<i8"), (bits, "<u8"), (size, "u1")):
        x = np.ascontiguousarray(x[order].astype(kind))
        offsets = (edges * x.itemsize).astype(np.int32)
        columns.append(pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(offsets), pa.py_buffer(x)]))
    return pa.RecordBatch.from_arrays(columns, ["part", "key", "above", "id", "bits", "size"])


def near_colliding(entries: DataFrame, near: Near, cell: int = CELL) -> DataFrame:
    """What is to be compared of ids that share a key: stars (``id``, ``other``) and members of keys.

    ``entries``: ``PACKED``, repeats allowed. In each key the first id leads those within two thirds of ``far``, then the first that is
    left, up to ``LEADERS`` times; key: null. Ids that are near to one beside their star are members: ``key``, ``id``, ``bits``, ``size``, and in
    which of ``chunks`` of about ``cell`` ids they lie, ``own``. Keys are shuffled once; a task holds those of its partition.
    """
    kinds = ("<u4", "<u4", "<i8", "<u8", "u1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[np.frombuffer(v.as_buffer(), k) for v in c] for b in batches for row in [b.columns[1:]] for c, k in zip(row, kinds, strict=True)]
        if not parts:
            return
        low, above, item, bits, size = (np.concatenate([v for p in parts[k::5] for v in p]) for k in range(5))
        del parts
        # Most keys come once; those whose slot no other entry has need no sorting.
        slots = (low * np.uint32(2654435761)) >> np.uint32(32 - min((4 * len(low)).bit_length(), 32))
        slots = slots ^ (above & np.uint32(127))
        often = np.bincount(slots)[slots] > 1
        key, item, bits, size = (above[often].astype(np.int64) << 32) | low[often], item[often], bits[often], size[often].astype(np.int16)
        del low, above, slots, often
        order = np.lexsort((item, key))
        key, item, bits, size = (x[order] for x in (key, item, bits, size))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (item[1:] != item[:-1])
        key, item, bits, size = (x[new] for x in (key, item, bits, size))
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        begins = np.flatnonzero(first)
        n = np.diff(begins, append=len(key))
        kept = np.repeat(n > 1, n)
        key, item, bits, size, n = key[kept], item[kept], bits[kept], size[kept], n[n > 1]
        if not len(key):
            return
        group = np.repeat(np.arange(len(n)), n)
        leader = _leaders(bits, size, group, n, near)
        led = np.flatnonzero(leader >= 0)
        a, b = item[leader[led]], item[led]
        stars = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
        # Ids that are near to another one which they were not tried with; in very large keys, all.
        wide = np.repeat((n > WIDE) & (n > 2), n)
        beside = wide.copy()
        for i, j in _pairs(group, np.flatnonzero(~wide)):
            found = near(bits, size, i, j) & (leader[j] != i)
            beside[i[found]] = beside[j[found]] = True
        held = np.flatnonzero(beside)
        chunks = np.bincount(group[held], minlength=len(n))
        chunks = -(-chunks[group[held]] // cell)
        own = (mixed(item[held].view(np.uint64)) % chunks.astype(np.uint64)).astype(np.int32)
        none = lambda m, kind: pa.nulls(m, kind)
        m = len(stars)
        for found in (
            [none(m, pa.int64()), pa.array(stars[:, 0]), pa.array(stars[:, 1]), none(m, pa.int64()), none(m, pa.int16()), none(m, pa.int32()), none(m, pa.int32())],
            [
                *(pa.array(x) for x in (key[held], item[held])),
                none(len(held), pa.int64()),
                *(pa.array(x) for x in (bits[held].view(np.int64), size[held], own, chunks.astype(np.int32))),
            ],
        ):
            rows = pa.RecordBatch.from_arrays(found, ["key", "id", "other", "bits", "size", "own", "chunks"])
            for k in range(0, rows.num_rows, 1 << 16):
                yield rows.slice(k, 1 << 16)

    return entries.repartition("part").mapInArrow(run, "key long, id long, other long, bits long, size short, own int, chunks int")


def _leaders(bits: np.ndarray, size: np.ndarray, group: np.ndarray, n: np.ndarray, near: Near) -> np.ndarray:
    """The place of the item that leads each one, -1 for leaders and what is left; groups are runs of ``n`` items."""
    leader, free = np.full(len(bits), -1), np.arange(len(bits))
    tight = np.where(n == 2, near.far, near.far * 2 // 3)
    for _ in range(LEADERS):
        if not len(free):
            break
        first = np.concatenate(([True], group[free[1:]] != group[free[:-1]]))
        leads = free[first][np.cumsum(first) - 1]
        hit = near(bits, size, leads, free, tight[group[free]]) & ~first
        leader[free[hit]] = leads[hit]
        left = free[~hit & ~first]
        more = np.bincount(group[left], minlength=len(n)) > 1
        free = left[more[group[left]]]
    return leader


def _pairs(group: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of ``places`` in one group, each once, many at a time; ``group`` has a run for each."""
    step, i = 1, places
    last = len(group)
    while len(i):
        i = i[i + step < last]
        i = i[group[i + step] == group[i]]
        if len(i):
            yield i, i + step
        step += 1


def near_links(entries: DataFrame, bodies: Callable, same: Callable | None, label: str, cell: int, near: Near, may_be: Callable | None) -> DataFrame:
    """Edges that connect all ids that share a key, are ``near`` and the ``same``.

    Pairs with a leader of a key are compared first. What they connect is one component each, and of all other near pairs of a key only those
    between components are then compared, each once, whatever keys they share: copies that meet under many keys, and among
    others that they are unlike, are settled by then. Pairs that sketches tell apart are not brought together.
    """
    if not isinstance(entries.schema["key"].dataType, BinaryType):
        entries = entries.where("key IS NOT NULL AND id IS NOT NULL").select("key", "id", "bits").mapInArrow(_packed_rows, PACKED)
    inside = materialize(near_colliding(entries, near, cell), f"{label}-colliding")
    members = inside.where("key IS NOT NULL").drop("other")
    tried = materialize(inside.where("key IS NULL").select(F.col("id").alias("a"), F.col("other").alias("b")).distinct(), f"{label}-tried")
    ids = tried.select(F.col("a").alias("id")).unionByName(tried.select(F.col("b").alias("id"))).unionByName(members.select("id")).distinct()
    known = materialize(bodies(ids), f"{label}-bodies")
    matched = materialize(_matching(tried, known, same, may_be), f"{label}-matched")
    groups = materialize(connected_components(matched), f"{label}-groups")

    sketch = (F.col("sketch") if near.sketch else F.lit(b"")).alias("sketch")
    marked = known.select("id", sketch).join(groups.withColumnRenamed("node", "id"), "id", "left")
    marked = materialize(marked.select("id", "sketch", F.coalesce("component", "id").alias("component")), f"{label}-marked")
    chunks = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda d: F.struct(F.least("own", d).alias("a"), F.greatest("own", d).alias("b")))
    dealt = members.join(marked, "id").select("key", "id", "bits", "size", "own", "component", "sketch", F.explode(chunks).alias("at"))
    dealt = dealt.select("key", "at.a", "at.b", "own", "id", "bits", "size", "component", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), None) if (batches := [b for b in batches if b.num_rows]) else None
        if rows is None:
            return
        key, a, b, own, item, bits, size, component = (rows.column(k).to_numpy() for k in range(8))
        order = np.lexsort((item, b, a, key))
        key, a, b, own, item, bits, size, component = (x[order] for x in (key, a, b, own, item, bits.view(np.uint64), size, component))
        group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        sketches = rows.column(8).to_pylist()
        sketches = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(key), len(sketches[0]))[order]
        for i, j in _pairs(group, np.arange(len(group))):
            # Two chunks of a key meet in a cell of their own, as do the ids of one.
            chosen = (component[i] != component[j]) & ((own[i] != own[j]) | (a[i] == b[i]))
            i, j = i[chosen], j[chosen]
            chosen = near(bits, size, i, j)
            i, j = i[chosen], j[chosen]
            if near.sketch and len(i):
                chosen = near.sketch(sketches, i, j)
                i, j = i[chosen], j[chosen]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(item[i], item[j])), pa.array(np.maximum(item[i], item[j]))], ["a", "b"])

    across = dealt.repartition("key", "a", "b").mapInArrow(run, "a long, b long").distinct()
    across = materialize(across.join(tried, ["a", "b"], "left_anti"), f"{label}-across")
    more = materialize(_matching(across, known, same, may_be), f"{label}-more")
    return groups.where("node <> component").toDF("a", "b").unionByName(more)


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, item, bits = (c.to_numpy() for c in batch.columns)
        yield packed(key, item, bits.view(np.uint64), np.zeros(len(key), np.uint8))


def _links_of_cells(cells: Iterator[tuple], same: Callable, may_be: Callable | None) -> list[list[dict]]:
    """For each cell (ids, odd, hit, bodies) edges that connect its odd items with those beside them that are the ``same``.

    What the pivot matched, ``hit``, is connected by it already. Two ids without a hit are both odd and meet twice, maybe in
    another cell; only the lesser is then compared with the greater. About ``PAIRS`` pairs of many cells are tried at once.
    """
    out, waiting, items, pairs = [], [], [], 0

    def settle() -> None:
        x, y = (np.concatenate([c[k] for c in waiting]) for k in (2, 3))
        likely = may_be(items, x, y) if may_be else np.ones(len(x), bool)
        done = 0
        for names, hit, x, y, start in waiting:
            chosen = likely[done : done + len(x)]
            done += len(x)
            groups = {i: {i} for i in names} if chosen.any() else {}
            by_pivot = {i for i, h in zip(names, hit, strict=True) if h}
            groups.update(dict.fromkeys(by_pivot, by_pivot))
            edges = []
            for i, j in zip(x[chosen].tolist(), y[chosen].tolist(), strict=True):
                a, b = names[i - start], names[j - start]
                if groups[a] is not groups[b] and same(items[i], items[j]):
                    edges.append({"a": a, "b": b})
                    large, small = sorted((groups[a], groups[b]), key=len, reverse=True)
                    large |= small
                    groups.update(dict.fromkeys(small, large))
            out.append(edges)

    for ids, odd, hit, bodies in cells:
        ids, odd, hit = np.asarray(ids, np.int64), np.asarray(odd, bool), np.asarray(hit, bool)
        rows, columns = np.flatnonzero(odd), np.flatnonzero(~odd)
        mine, others = ids[rows][:, None], ids[columns]
        x, y = np.nonzero((mine < others) | (hit[columns] & (mine != others)))
        waiting.append((ids.tolist(), hit.tolist(), rows[x] + len(items), columns[y] + len(items), len(items)))
        items += bodies
        pairs += len(x)
        if pairs > PAIRS:
            settle()
            waiting, items, pairs = [], [], 0
    if waiting:
        settle()
    return out


def _crossing(members: DataFrame, cell: int) -> DataFrame:
    """``members`` (``key``, ``id``, ``odd``, ``hit``) dealt to cells (``a``, ``b``) of a key, so that each odd one meets all that
    are not marked odd, about ``cell`` on either side; keys without an odd one are left."""
    chunks = lambda odd: (F.floor(F.count(F.when(F.col("odd") == odd, 1)) / cell) + 1).cast("int")
    sizes = members.groupBy("key").agg(chunks(False).alias("chunks"), chunks(True).alias("odd_chunks"), F.max("odd").alias("any"))
    dealt = members.join(sizes.where("any").drop("any"), "key")
    own = F.pmod(F.xxhash64(F.lit(11), "id"), F.when(F.col("odd"), F.col("odd_chunks")).otherwise(F.col("chunks"))).cast("int")
    across = F.explode(F.sequence(F.lit(0), F.when(F.col("odd"), F.col("chunks")).otherwise(F.col("odd_chunks")) - 1))
    dealt = dealt.select("key", "id", "odd", "hit", own.alias("own"), across.alias("other"))
    a, b = (F.when(F.col("odd") == o, F.col("own")).otherwise(F.col("other")) for o in (False, True))
    return dealt.select("key", "id", "odd", "hit", a.alias("a"), b.alias("b"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node`` and ``component``, the least node that it reaches, of every node with an edge.

    ``edges`` joins 64-bit ids; nulls and loops do not count, direction and repetition do not
    matter. Alternates large-star and small-star steps until the edges are stars around their least
    nodes. A step takes minima, which are combined before the shuffle, and joins them back, so that
    a node of any degree is never gathered; the minima are written first, so that the planner can
    split the edges of one node between tasks. Each round is written to the shared folder, and only
    the number and a checksum of its edges reach the driver.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = materialize(edges.where(F.col(a) != F.col(b)).select(u, v).distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        # Large star: every larger neighbour of a node moves to the least node around it.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # Small star: the smaller neighbours of a node, and itself, move to the least of them.
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lower, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        then = materialize(moved.select("e.u", "e.v").where("u > v").distinct(), "edges")
        before, seen, now = seen, mark(then), then
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
