"""Hierarchical packing of documents into context windows of several lengths.

A document's whole long windows are sequences as they are. What remains is routed to the shortest
window that holds it. Windows are packed from the longest tier down: each is opened by a piece of
its own tier and its gap filled with pieces of shorter tiers, the longest that fit first; when none
fits whole, a piece is cut, and its remainder routed anew. A window that cannot be filled waits for
later documents of the task; at its end the last ones are cut into shorter tiers. Sequences are
then dealt to step groups so that the groups' tokens are even.

Tokens and packing take one pass over a partition, with no shuffle: a task holds the pieces of one
group of documents, none longer than a window, and emits sequences as they fill.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from skeinworks.llm.tokens import encoder

WINDOW = 1024
TIERS = (128, 256, 512, 1024)
#: Pieces that wait in a task before windows are packed, and tokens of a step group.
WAITING = 4096
STEP = 64 * WINDOW
#: Steps whose sequences a task gathers, about, before it deals them out.
STEPS = 8
END = 0
TOKENIZER = "byte_bpe_50k.json"

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, tier long, step_group long"
)

#: A piece: length, arrival, doc_id, start, ids, tokens of its document.
Piece = tuple[int, int, int | None, int, np.ndarray, int]


class Packer:
    """Pieces of one task on their way to sequences."""

    def __init__(self, window: int = WINDOW, tiers: tuple[int, ...] = TIERS, step: int = STEP, first: int = 0):
        self.window, self.tiers, self.step = window, tuple(sorted({*tiers, window})), step
        self.waiting: dict[int, list[Piece]] = {t: [] for t in self.tiers}
        self.count = self.arrived = 0
        self.next_sequence = self.next_step = first
        self.full: list[list[Piece]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, whole = len(ids), len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            self.full.append([self._piece(doc_id, start, ids[start : start + self.window], n)])
        if whole < n:
            self._route(self._piece(doc_id, whole, ids[whole:], n))

    def _piece(self, doc_id: int | None, start: int, ids: np.ndarray, n: int) -> Piece:
        self.arrived += 1
        return len(ids), self.arrived, doc_id, start, ids, n

    def _route(self, piece: Piece) -> None:
        insort(self.waiting[next(t for t in self.tiers if t >= piece[0])], piece, key=lambda p: p[:2])
        self.count += 1

    def _cut(self, piece: Piece, length: int) -> Piece:
        """The first ``length`` ids of a piece; the rest is routed."""
        _, _, doc_id, start, ids, n = piece
        self._route(self._piece(doc_id, start + length, ids[length:], n))
        return self._piece(doc_id, start, ids[:length], n)

    def _take(self, most: int) -> Piece | None:
        """The longest waiting piece of at most ``most`` ids."""
        for tier in reversed(self.tiers):
            if tier // 2 < most or tier == self.tiers[0]:
                pool = self.waiting[tier]
                k = bisect_right(pool, most, key=lambda p: p[0])
                if k:
                    self.count -= 1
                    return pool.pop(k - 1)
        return None

    def _shortest(self) -> Piece | None:
        """The longest piece of the shortest tier that has one: the one to cut."""
        for tier in self.tiers:
            if self.waiting[tier]:
                self.count -= 1
                return self.waiting[tier].pop()
        return None

    def pack(self, last: bool) -> None:
        """Fill windows, long tiers first; without ``last``, one that stays open waits again."""
        for tier in reversed(self.tiers):
            while self.waiting[tier]:
                self.count -= 1
                opened = self.waiting[tier].pop()
                inside, gap = [opened], tier - opened[0]
                while gap:
                    piece = self._take(gap)
                    if piece is None and (longer := self._shortest()):
                        piece = self._cut(longer, gap)
                    if piece is None:
                        break
                    inside.append(piece)
                    gap -= piece[0]
                if not gap:
                    self.full.append(inside)
                elif not last:
                    for piece in inside:
                        self._route(piece)
                    return
                else:
                    self._close(inside)

    def _close(self, inside: list[Piece]) -> None:
        """The last pieces of a task, cut into sequences of the tiers; what is shorter is padded."""
        inside = inside[::-1]
        total = sum(p[0] for p in inside)
        for tier in reversed(self.tiers):
            while total >= tier:
                sequence, room = [], tier
                while room:
                    piece = inside.pop()
                    if piece[0] > room:
                        _, _, doc_id, start, ids, n = piece
                        inside.append(self._piece(doc_id, start + room, ids[room:], n))
                        piece = self._piece(doc_id, start, ids[:room], n)
                    sequence.append(piece)
                    room -= piece[0]
                self.full.append(sequence)
                total -= tier
        if inside:
            self.full.append(inside[::-1])

    def sequences(self, last: bool = True) -> pa.RecordBatch:
        """The filled sequences as rows, dealt to even step groups: each to the lightest so far.

        Without ``last``, only as many as make full groups; the rest waits for more.
        """
        lengths = [sum(p[0] for p in s) for s in self.full]
        n = round(sum(lengths) / self.step) if last else sum(lengths) // self.step
        ends = list(accumulate(lengths))
        dealt = len(lengths) if last else bisect_right(ends, n * self.step)
        groups = [(0, self.next_step + k) for k in range(max(1, n) if dealt else 0)]
        rows: list[tuple] = []
        for k in sorted(range(dealt), key=lambda k: -lengths[k]):
            load, step = heapq.heappop(groups)
            heapq.heappush(groups, (load + lengths[k], step))
            offset = 0
            for length, _, doc_id, start, ids, n in self.full[k]:
                rows.append((doc_id, start, length, zlib.crc32(ids.astype("<u4").tobytes()), n, self.next_sequence, offset, lengths[k], step))
                offset += length
            self.next_sequence += 1
        self.next_step += len(groups)
        self.full = self.full[dealt:]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    *,
    window: int = WINDOW,
    tiers: tuple[int, ...] = TIERS,
    end: int = END,
    waiting: int = WAITING,
    step: int = STEP,
) -> DataFrame:
    """Pieces of all rows of ``docs`` (``doc_id``, ``text``) in sequences of at most ``window`` tokens.

    ``tokenizer`` is the path, known to all executors, of a ``tokenizers`` file. A document's ids are
    its text's and then ``end``; each lies in one piece. Returns one row per piece: doc_id, start (its
    document's ids before it), length, ids_crc32 (of the piece's ids as little-endian 32-bit
    numbers), doc_tokens, sequence_id, offset (in the sequence, gapless from 0), tier (the sequence's
    length, a power of two but for the last of a task) and step_group (sequences of ``step``
    tokens together, to within one sequence; the last of a task may have fewer or half as many again). ``tiers`` and ``window`` are powers of two.

    Null or empty text: ``end`` alone. Very long texts: cut into windows. Pieces of one length: the earlier
    is packed first. Repeated rows and null doc_ids: documents of their own. No rows: no rows. Other
    columns of ``docs`` are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        packer = Packer(window, tiers, step, first=TaskContext.get().partitionId() << 33)
        for batch in batches:
            ids = batch.column(0)
            for begin in range(0, batch.num_rows, 2000):
                texts = batch.column(1).slice(begin, 2000)
                for doc_id, x in zip(ids.slice(begin, 2000).to_pylist(), tokens.encode(texts), strict=True):
                    packer.add(doc_id, np.append(x, np.array([end], "<u4")))
                if packer.count >= waiting:
                    packer.pack(last=False)
                if len(packer.full) * window >= STEPS * step:
                    yield packer.sequences(last=False)
        packer.pack(last=True)
        yield packer.sequences()

    chosen = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, str(public_tokenizers.path(TOKENIZER)))
