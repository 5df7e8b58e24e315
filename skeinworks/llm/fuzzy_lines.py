"""Fuzzy line deduplication: SimHash of normalised lines, pigeonhole join, edit similarity, groups.

Lines are equal if their normal forms are; only distinct forms are compared. They meet under the
pigeonhole keys of their fingerprints, and, because edits that edit similarity allows move more bits than any
pigeonhole of 64 bits covers, also under MinHash bands of their longer words, short ones under
bands of character n-grams and under their words but one. The text of all that meet is fetched, and
every pair is verified by edit similarity. Of each connected group the first occurrence, by document and
place, stays.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.llm.hashes import STEP, line_words, mixed
from skeinworks.llm.linking import ANY, CELL, PACKED, Near, connected_components, packed, pigeonhole_hashes, verified_links
from skeinworks.llm.text import boxed, let, pieces, row_key
from skeinworks.runtime import materialize

#: Lines of fewer words are left alone.
MIN_WORDS = 3
SIMILARITY = 0.8
#: Fingerprints within ``SURE`` bits always meet: of ``BLOCKS`` blocks all but ``SURE`` stay intact.
BLOCKS, SURE = 4, 2
#: Two lines of ``MANY`` words or more whose fingerprints are further apart are not compared.
FAR, MANY = 24, 6
#: Lines above ``SHORT`` characters: bands, minima in each, and bytes of the words that count.
BANDS, MINIMA, LETTERS = 16, 4, 4
#: Lines of at most ``SHORT`` characters, and those as long as a line of more may be similar to: bands
#: of n-grams of so many characters, with as many minima each.
SHORT, SHORT_BANDS, GRAM = 60, 24, 3
#: Lines of at most so many words meet all that differ in one word.
FEW = 12
#: Lines whose keys a task has given out already.
SEEN = 1_000_000
#: Keys that a task packs at once, about.
ENTRIES = 1_000_000
#: Pairs whose tables are filled at once, of lines of at most ``LONG`` characters; fewer than ``ALONE`` are taken one by one.
TOGETHER, LONG, ALONE = 2048, 4096, 256

_ODD = np.random.default_rng(4).integers(0, 1 << 63, max(BANDS, SHORT_BANDS) * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Without these in it and spaces at its ends, a text has single plain spaces between words alone, as ``str.split`` has them.
_UNEVEN = ["  ", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]

_ZEROS = bytes.maketrans(b"123456789", b"000000000")


def normal_lines(text: str | None) -> list[str]:
    """Each line in lower case, its digits 0 to 9 all 0, its words joined by single spaces."""
    plain = (text or "").lower().encode("utf-8", "surrogatepass").translate(_ZEROS).decode("utf-8", "surrogatepass")
    if not any(x in plain for x in _UNEVEN):
        return plain.strip(" ").split("\n")
    return [" ".join(line.split()) for line in plain.split("\n")]


def line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))


def fingerprints_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The SimHash of each line's distinct words.

    Each word has one vote, so that one that comes again and again, such as a table's rule, does
    not decide the fingerprint alone. Sixteen times four bits are counted at once, in lanes of 16 bits.
    """
    line = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    keys = np.sort((line << np.uint64(40)) | (hashes >> np.uint64(24)))
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    votes = mixed((keys & np.uint64((1 << 40) - 1)) + np.uint64(1))
    line = (keys >> np.uint64(40)).astype(np.int64)
    n = np.bincount(line, minlength=len(counts))
    # Runs of fewer words than a lane can count.
    parts = np.unique(np.concatenate((np.cumsum(n) - n, np.arange(0, len(keys), 1 << 15))))
    owner = line[parts]
    begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    out = np.zeros(len(counts), np.uint64)
    for k in range(16):
        lanes = np.add.reduceat((votes >> np.uint64(k)) & np.uint64(0x0001000100010001), parts)
        for lane in range(4):
            ones = np.add.reduceat((lanes >> np.uint64(16 * lane)) & np.uint64(0xFFFF), begins)
            out |= (2 * ones > n.astype(np.uint64)).astype(np.uint64) << np.uint64(16 * lane + k)
    return out


def line_fingerprints(lines: list[str]) -> np.ndarray:
    """The fingerprint of each line; none is empty."""
    hashes, _, counts = line_words(lines)
    return fingerprints_of(hashes, counts)


def banded(features: np.ndarray, counts: np.ndarray, bands: int, scheme: int) -> np.ndarray:
    """``bands`` keys of each set of features: scheme and band above, a hash of the minima below."""
    at = np.cumsum(counts) - counts
    out = np.zeros((len(counts), bands), np.uint64)
    for k in range(bands * MINIMA):
        least = np.minimum.reduceat(features * _ODD[k], at)
        mixed = (out[:, k // MINIMA] ^ least) * STEP
        out[:, k // MINIMA] = mixed ^ (mixed >> np.uint64(31))
    return (out >> np.uint64(32)).astype(np.int64) + ((scheme * 64 + np.arange(bands)) << 32)


def longer_words(hashes: np.ndarray, size: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of ``LETTERS`` bytes or more of each line, all of a line that has fewer than three."""
    starts = np.cumsum(counts) - counts
    kept = size >= LETTERS
    enough = np.add.reduceat(kept, starts, dtype=np.int64) >= 3
    kept |= np.repeat(~enough, counts)
    return hashes[kept], np.add.reduceat(kept, starts, dtype=np.int64)


def letter_grams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``GRAM`` characters of each line; of a shorter line, itself."""
    codes = np.frombuffer(("\n".join(lines) + "\n" * GRAM).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    counts = np.maximum(length - GRAM + 1, 1)
    at = np.repeat(np.cumsum(length + 1) - length - 1 - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    out = np.zeros(len(at), np.uint64)
    for k in range(GRAM):
        out = out * STEP + codes[at + k]
    return mixed(out), counts


def but_one(line: str) -> list[int]:
    """Hashes of 32 bits of the line and of all but one of its words, such that lines of at most ``FEW`` words
    that differ in one word, or by one word, have one in common; none for longer lines."""
    words = line.split(" ")
    if len(words) > FEW + 1:
        return []
    kept = {line, *(" ".join(words[:k] + words[k + 1 :]) for k in range(len(words)))}
    return sorted({line_hash(x) >> 32 for x in kept})


def fingerprints_and_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The fingerprint of each line, and the keys of all lines, scheme by scheme, with the place of the line of each."""
    if not lines:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes, size, counts = line_words(lines)
    bits = fingerprints_of(hashes, counts)
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    every = pigeonhole_hashes(bits, BLOCKS, BLOCKS - SURE)
    keys = [(np.tile(np.arange(len(lines)), len(every)), (every + ((3 * 64 + np.arange(len(every))) << 32)[:, None]).ravel())]
    few = np.flatnonzero(counts <= FEW + 1)
    own = [but_one(lines[k]) for k in few.tolist()]
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    keys.append((np.repeat(few, sizes), np.fromiter((x for found in own for x in found), np.int64, sizes.sum())))
    long = np.flatnonzero(length > SIMILARITY * SHORT)
    if len(long):
        chosen = np.repeat(length > SIMILARITY * SHORT, counts)
        features = longer_words(hashes[chosen], size[chosen], counts[long])
        keys.append((np.tile(long, BANDS), banded(*features, BANDS, 1).T.ravel()))
    short = np.flatnonzero(length <= SHORT / SIMILARITY)
    if len(short):
        keys.append((np.tile(short, SHORT_BANDS), banded(*letter_grams([lines[k] for k in short.tolist()]), SHORT_BANDS, 2).T.ravel()))
    return bits, *(np.concatenate(x) for x in zip(*keys, strict=True))


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance, bit-parallel: a column of the table is a pair of bit vectors.

    With ``most``, a distance above it may be given too low, but not as low as ``most``: the columns end
    once the rest cannot bring it down so far, from whatever row of the column at some of them.
    """
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = sorted((a[start : len(a) - end], b[start : len(b) - end]), key=len, reverse=True)
    if not b:
        return len(a)
    has: dict[str, int] = {}
    for k, c in enumerate(a):
        has[c] = has.get(c, 0) | 1 << k
    full, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    limit = 2 * (len(a) + len(b)) if most is None else most + len(b)
    looks = set() if most is None or len(b) < 48 else {len(b) * part // 16 for part in (5, 6, 7, 8, 10, 12)}
    for k, c in enumerate(b, 1):
        match = has.get(c, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        rise, fall = down | (full & ~(diagonal | up)), up & diagonal
        score += bool(rise & top) - bool(fall & top)
        if score + k > limit:
            return score + k - len(b)
        rise, fall = (rise << 1 | 1) & full, (fall << 1) & full
        up, down = fall | (full & ~(diagonal | rise)), rise & diagonal
        if k in looks:
            steps = [np.unpackbits(np.frombuffer(x.to_bytes((len(a) + 7) // 8, "little"), np.uint8), count=len(a), bitorder="little").astype(np.int32) for x in (up, down)]
            rest = np.abs(np.arange(len(a), -1, -1) - (len(b) - k))
            rest[0] += k
            rest[1:] += k + np.cumsum(steps[0] - steps[1])
            if rest.min() > most:
                return most + 1
    return score


def within(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair of lines, none empty, is its ``most`` or less.

    The columns of ``edit_distance`` of all pairs are filled at once, 64 rows in a word; pairs that cannot come down to ``most`` are left on the way.
    """
    turned = [sorted(x, key=len) for x in zip(a, b, strict=True)]
    m, n = (np.fromiter((len(x[k]) for x in turned), np.int64, len(turned)) for k in (0, 1))
    out = np.zeros(len(turned), bool)
    order = np.argsort(n, kind="stable")
    start = 0
    while start < len(order):
        # Lines of about one length, so that few words of a table are idle.
        end = min(start + TOGETHER, int(np.searchsorted(n[order], max(64, 1.3 * n[order[start]]), side="right")))
        part = order[start:end]
        part = part[np.argsort(-m[part], kind="stable")]
        if len(part) < ALONE or n[part].max() > LONG:
            out[part] = [edit_distance(a[k], b[k], int(most[k])) <= most[k] for k in part.tolist()]
        else:
            out[part] = _within([turned[k][1] for k in part.tolist()], [turned[k][0] for k in part.tolist()], n[part], m[part], most[part])
        start = end
    return out


def _within(a: list[str], b: list[str], n: np.ndarray, m: np.ndarray, most: np.ndarray) -> np.ndarray:
    """``within`` of pairs by falling lengths ``m`` of ``b``; those of ``a`` are ``n``."""
    pairs, deep = len(a), int(n.max() + 63) >> 6
    codes = np.frombuffer("".join([*a, *b]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.zeros(int(codes.max()) + 1, np.int64)
    kinds[codes] = 1
    size, codes = int(kinds.sum()), (np.cumsum(kinds) - 1)[codes]
    y = codes[n.sum() :]
    at = np.arange(len(codes) - len(y)) - np.repeat(np.cumsum(n) - n, n)
    cells = ((at >> 6) * pairs + np.repeat(np.arange(pairs), n)) * size + codes[: len(at)]
    has = np.zeros(deep * pairs * size, np.uint64)
    by = np.argsort(cells, kind="stable")
    new = np.flatnonzero(np.diff(cells[by], prepend=-1))
    has[cells[by][new]] = np.bitwise_or.reduceat(np.uint64(1) << (at[by] & 63).astype(np.uint64), new)
    has = has.reshape(deep, -1)
    columns = np.zeros((int(m[0]), pairs), np.int64)
    columns[np.arange(len(y)) - np.repeat(np.cumsum(m) - m, m), np.repeat(np.arange(pairs), m)] = y
    columns += np.arange(pairs) * size
    left = np.arange(pairs)
    up, down = np.full((deep, pairs), ~np.uint64(0)), np.zeros((deep, pairs), np.uint64)
    buffers = np.zeros((6, pairs), np.uint64)
    one, top, look = np.uint64(1), np.uint64(63), max(16, len(columns) // 8)
    for k in range(len(columns)):
        q = int(np.searchsorted(-m[left], -k))
        if not q:
            break
        if k and k % look == 0:
            # Distances of every eighth row so far, and what the rest changes at least; between them it is less by 8 at most.
            steps, less = (np.bitwise_count(np.ascontiguousarray(x[:, :q]).view(np.uint8)).astype(np.int32) for x in (up, down))
            steps -= less
            sums = np.cumsum(steps.reshape(deep, q, 8).transpose(1, 0, 2).reshape(q, -1), axis=1)
            rows = np.arange(8, 64 * deep + 1, 8)
            rest = sums + np.where(rows < n[left[:q], None] + 8, np.abs((n - m)[left[:q], None] + k - rows), 1 << 20)
            least = np.minimum(rest.min(axis=1), np.abs((n - m)[left[:q]] + k)) + k - 8
            kept = np.concatenate((least <= most[left[:q]], np.ones(len(left) - q, bool)))
            if kept.sum() < 0.8 * len(left):
                left, (columns, up, down) = left[kept], (np.compress(kept, x, axis=1) for x in (columns, up, down))
                q = int(np.searchsorted(-m[left], -k))
                if not q:
                    break
        t = columns[k, :q]
        e, v, s, r, rise, fall = (x[:q] for x in buffers)
        rise[:], fall[:] = 1, 0
        for w in range(deep):
            p, d = up[w, :q], down[w, :q]
            has[w].take(t, out=e, mode="clip")
            np.bitwise_or(e, d, out=v)
            e |= fall
            np.bitwise_and(e, p, out=s)
            s += p
            s ^= p
            s |= e
            np.bitwise_or(s, p, out=r)
            np.invert(r, out=r)
            r |= d
            s &= p
            np.right_shift(r, top, out=e)
            r <<= one
            r |= rise
            rise[:] = e
            np.right_shift(s, top, out=e)
            s <<= one
            s |= fall
            fall[:] = e
            np.bitwise_and(r, v, out=d)
            r |= v
            np.invert(r, out=r)
            np.bitwise_or(s, r, out=p)
    rows = np.clip(n[left] - 64 * np.arange(deep)[:, None], 0, 64)
    mask = np.where(rows == 64, ~np.uint64(0), (one << np.minimum(rows, 63).astype(np.uint64)) - one)
    score = m[left] + np.bitwise_count(up & mask).sum(axis=0, dtype=np.int64) - np.bitwise_count(down & mask).sum(axis=0, dtype=np.int64)
    out = np.zeros(pairs, bool)
    out[left] = score <= most[left]
    return out


def distance_at_most(a: list[str], b: list[str]) -> int:
    """A bound from above on the edit distance of two lines of words: of one way to align them.

    Where words differ the next place at which two agree is sought, a few words on.
    """
    i = j = total = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        for x, y in _STEPS:
            if i + x < len(a) and j + y < len(b) and a[i + x] == b[j + y]:
                break
        else:
            x, y = len(a) - i, len(b) - j
        total += max(sum(map(len, a[i : i + x])) + x, sum(map(len, b[j : j + y])) + y)
        i, j = i + x, j + y
    return total + max(sum(map(len, a[i:])) + len(a) - i, sum(map(len, b[j:])) + len(b) - j)


_STEPS = sorted(((x, y) for x in range(4) for y in range(4) if x + y), key=lambda s: (sum(s), abs(s[0] - s[1])))


def too_unlike(a: str, b: str, most: int) -> bool:
    """Whether letters alone show that the distance is above ``most``: an edit changes one in either line."""
    x, y = Counter(a), Counter(b)
    return (x - y).total() > most or (y - x).total() > most


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    """Whether 1 - distance / length of the longer is ``least`` or more.

    The table of distances is filled only where neither letters nor words decide.
    """
    longer, shorter = max(len(a), len(b)), min(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    if longer - shorter > most:
        return False
    if distance_at_most(a.split(" "), b.split(" ")) <= most:
        return True
    return not too_unlike(a, b, most) and edit_distance(a, b, most) <= most


def similar_pairs(forms: list[str], x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """For pairs of places ``x`` and ``y`` among ``forms`` whether they are ``similar``, many at once."""
    found = may_be_similar([(form, 0, False) for form in forms], x, y, least)
    hard, limits = [], []
    for k in np.flatnonzero(found).tolist():
        a, b = forms[x[k]], forms[y[k]]
        most = int((1 - least) * max(len(a), len(b)) + 1e-9)
        if distance_at_most(a.split(" "), b.split(" ")) > most:
            hard.append(k)
            limits.append(most)
    if hard:
        found[hard] = within([forms[k] for k in x[hard].tolist()], [forms[k] for k in y[hard].tolist()], np.array(limits))
    return found


def counted(rows: np.ndarray, values: np.ndarray, n: int, kinds: int) -> np.ndarray:
    """How often each of ``n`` rows has each value, modulo ``kinds``."""
    return np.bincount(rows * kinds + values % kinds, minlength=n * kinds).reshape(n, kinds).astype(np.int32)


def may_be_similar(bodies: list[tuple], x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """For pairs of places ``x`` and ``y`` among ``bodies`` (form, bits, many) whether their lines may be ``similar``; it loses none that is.

    Their fingerprints, lengths, letters and pairs of letters are compared, many at once: an edit changes one letter and at
    most two pairs of letters in either line, and counts taken together differ no more.
    """
    forms, bits, many = zip(*bodies, strict=True) if bodies else ((), (), ())
    bits, many = np.array(bits, np.int64).view(np.uint64), np.array(many, bool)
    length = np.fromiter(map(len, forms), np.int64, len(forms))
    longer, shorter = np.maximum(length[x], length[y]), np.minimum(length[x], length[y])
    most = ((1 - least) * longer + 1e-9).astype(np.int64)
    found = (longer - shorter <= most) & ~((np.bitwise_count(bits[x] ^ bits[y]) > FAR) & many[x] & many[y])
    left = np.flatnonzero(found)
    if not len(left):
        return found
    # Only lines that are left are counted.
    used, place = np.unique(np.concatenate((x[left], y[left])), return_inverse=True)
    a, b = place[: len(left)], place[len(left) :]
    codes = np.frombuffer("".join([forms[k] for k in used.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    rows = np.repeat(np.arange(len(used)), length[used])
    inner = rows[1:] == rows[:-1]
    for edits, counts in ((1, counted(rows, codes, len(used), 32)), (2, counted(rows[1:][inner], (codes[:-1] * 31 + codes[1:])[inner], len(used), 128))):
        for k in range(0, len(left), 1 << 14):
            part = slice(k, k + (1 << 14))
            differ = np.abs(counts[a[part]] - counts[b[part]]).sum(axis=1)
            at = left[part]
            found[at] &= differ + longer[at] - shorter[at] <= 2 * edits * most[at]
        kept = found[left]
        left, a, b = left[kept], a[kept], b[kept]
    return found


def sketches_of(forms: list[str]) -> np.ndarray:
    """A row of bytes for each form: how often letters and pairs of letters come, at most 255 times, and its length."""
    length = np.fromiter(map(len, forms), np.int64, len(forms))
    codes = np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    rows = np.repeat(np.arange(len(forms)), length)
    inner = rows[1:] == rows[:-1]
    counts = counted(rows, codes, len(forms), 32), counted(rows[1:][inner], (codes[:-1] * 31 + codes[1:])[inner], len(forms), 128)
    return np.hstack([np.minimum(np.hstack(counts), 255).astype(np.uint8), length.astype("<u4")[:, None].view(np.uint8)])


def may_be_by_sketch(sketches: np.ndarray, x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """As ``may_be_similar``, of the ``sketches_of`` lines; it loses none that is similar either."""
    length = np.ascontiguousarray(sketches[:, 160:]).view("<u4")[:, 0].astype(np.int64)
    longer, shorter = np.maximum(length[x], length[y]), np.minimum(length[x], length[y])
    most = ((1 - least) * longer + 1e-9).astype(np.int64)
    found = longer - shorter <= most
    for edits, columns in ((1, slice(0, 32)), (2, slice(32, 160))):
        counts, left = sketches[:, columns], np.flatnonzero(found)
        for k in range(0, len(left), 1 << 14):
            at = left[k : k + (1 << 14)]
            a, b = counts[x[at]], counts[y[at]]
            differ = (np.maximum(a, b) - np.minimum(a, b)).sum(axis=1, dtype=np.int64)
            found[at] &= differ + longer[at] - shorter[at] <= 2 * edits * most[at]
    return found


def sizes_of(lines: list[str]) -> np.ndarray:
    """Twenty times the logarithm of each line's length, and ``ANY`` of lines of fewer than ``MANY`` words."""
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    many = np.fromiter((x.count(" ") >= MANY - 1 for x in lines), bool, len(lines))
    return np.where(many, np.minimum(20 * np.log(length), ANY - 1), ANY).astype(np.uint8)


def all_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """``doc_id``, ``row`` (``row_key``), ``line`` (place from 0) and ``h`` of every line of ``min_words`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in pieces(texts):
                rows = [(k, p, line_hash(x)) for k in range(a, b) for p, x in enumerate(normal_lines(texts[k])) if x.count(" ") >= min_words - 1 and x]
                owner, place, hashes = zip(*rows, strict=True) if rows else ((), (), ())
                found = batch.select(["doc_id", "row"]).take(pa.array(owner, pa.int64()))
                columns = [*found.columns, pa.array(place, pa.int32()), pa.array(np.array(hashes, np.uint64).view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "line", "h"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text")
    return chosen.mapInArrow(run, "doc_id long, row long, line int, h long")


def line_entries(docs: DataFrame, min_words: int) -> DataFrame:
    """The keys of all lines of ``min_words`` or more, ``PACKED``, with their hashes, fingerprints and ``sizes_of``.

    A line that comes again in a task has its keys but once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        waiting, held = [], 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in pieces(texts):
                new = {}
                for k in range(a, b):
                    for x in normal_lines(texts[k]):
                        if x.count(" ") >= min_words - 1 and x and (h := line_hash(x)) not in seen:
                            seen.add(h)
                            new[h] = x
                if len(seen) > SEEN:
                    seen.clear()
                lines = list(new.values())
                bits, line, keys = fingerprints_and_keys(lines)
                waiting.append((keys, np.array(list(new), np.uint64)[line], bits[line], sizes_of(lines)[line]))
                held += len(keys)
                if held > ENTRIES:
                    yield packed(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
                    waiting, held = [], 0
        if held:
            yield packed(*(np.concatenate(x) for x in zip(*waiting, strict=True)))

    return docs.select("text").mapInArrow(run, PACKED)


def similar_line_edges(docs: DataFrame, lines: DataFrame, forms: DataFrame, least: float = SIMILARITY, cell: int = CELL, min_words: int = MIN_WORDS) -> DataFrame:
    """Edges (``a``, ``b``) that connect the hashes of similar lines of ``docs``: ``lines`` of ``all_lines``, ``forms`` of ``distinct_forms``."""

    @F.pandas_udf("array<struct<id:long,form:string,sketch:binary>>")
    def fetch(text: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for t, wanted in zip(text, places, strict=True):
            lines = t.split("\n")
            found = [(p["h"], normal_lines(lines[p["line"]])[0]) for p in wanted if p["line"] < len(lines)]
            out.append([{"id": h, "form": x} for h, x in found if line_hash(x) == h & (1 << 64) - 1])
        every = [x for found in out for x in found]
        for a, b in pieces([x["form"] for x in every]):
            for x, sketch in zip(every[a:b], sketches_of([x["form"] for x in every[a:b]]), strict=True):
                x["sketch"] = sketch.tobytes()
        return pd.Series(out)

    def bodies(ids: DataFrame) -> DataFrame:
        found = forms.join(ids.withColumnRenamed("id", "h"), "h")
        wanted = materialize(found.groupBy("first.row").agg(F.collect_list(F.struct("first.line", "h")).alias("places")), "line-places")
        texts = docs.select(row_key().alias("row"), "text").join(wanted, "row").dropDuplicates(["row"])
        return texts.select(F.explode(fetch("text", "places")).alias("x")).select("x.id", F.struct("x.form").alias("body"), "x.sketch")

    near = Near(FAR, int(20 * math.log(1 / least)) + 1, lambda sketches, x, y: may_be_by_sketch(sketches, x, y, least))
    same = lambda bodies, x, y: similar_pairs([form for (form,) in bodies], x, y, least)
    return verified_links(line_entries(docs, min_words), bodies, None, "lines", cell, near, same)


def distinct_forms(lines: DataFrame) -> DataFrame:
    """One row for each ``h`` of ``all_lines``: its ``first`` place and ``n``."""
    return lines.groupBy("h").agg(F.min(F.struct("doc_id", "row", "line")).alias("first"), F.count(F.lit(1)).alias("n"))


def repeated_lines(docs: DataFrame, *, least: float = SIMILARITY, min_words: int = MIN_WORDS, cell: int = CELL) -> DataFrame:
    """``doc_id``, ``row`` (``row_key``), ``removed`` (places of lines, sorted) and ``keepers`` (sorted ids of the
    documents where the first occurrences stay) of every row that loses a line."""
    lines = materialize(all_lines(docs, min_words), "lines")
    forms = materialize(distinct_forms(lines), "line-forms")
    groups = materialize(connected_components(similar_line_edges(docs, lines, forms, least, cell, min_words)), "line-components")
    known = forms.join(groups.withColumnRenamed("node", "h"), "h", "left").where("component IS NOT NULL OR n > 1")
    known = known.withColumn("g", F.coalesce("component", "h"))
    firsts = materialize(known.groupBy("g").agg(F.min("first").alias("keeper"), F.sum("n").alias("all")).where("all > 1"), "line-firsts")
    again = materialize(known.join(firsts, "g").select("h", "keeper"), "line-repeats")
    here = F.struct("doc_id", "row", "line")
    gone = lines.select("doc_id", "row", "line", "h").join(again, "h").where(F.col("doc_id").isNotNull() & ~here.eqNullSafe(F.col("keeper")))
    gone = materialize(gone.select("doc_id", "row", "line", F.col("keeper.doc_id").alias("keeper")), "lines-gone")
    return gone.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("line")).alias("removed"), F.array_sort(F.collect_set("keeper")).alias("keepers"))


def dedup_lines(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with ``text`` rid of repeated lines; documents that lose every line go.

    A line repeats an earlier one, by doc_id and then place, if their normal forms are equal or
    connected by pairs of edit similarity ``least`` or more. Lines of fewer than ``min_words`` words
    stay, as do the first occurrences.

    Null or empty text: unchanged. Null doc_id: its lines count as the first occurrences, and
    nothing is removed from it. Rows of one id and different texts are documents of their own, in an order
    that their texts give; equal rows lose the same lines. Ties of place cannot be: a place is a row's.
    Very long texts and lines: whole; a line beside one that is too unlike is left at once. No rows: no rows. All columns of ``docs`` are
    returned, whatever their names.
    """
    gone = repeated_lines(docs, **settings).select("row", "removed")
    joined = boxed(docs, row=row_key()).join(gone, "row", "left")

    def remaining(lines):
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
        return F.transform(places, lambda i: F.get(lines, i))

    left = F.when(F.col("removed").isNotNull(), let(F.split("text", "\n"), remaining))
    kept = joined.withColumn("left", left).where(F.col("removed").isNull() | F.exists("left", lambda x: F.trim(x) != ""))
    text = F.coalesce(F.array_join("left", "\n"), F.col("text"))
    return kept.select(*[(text if c == "text" else F.col("boxed").getField(c)).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """One row per document: its lines, those that go, and where their first occurrences stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = docs.select("doc_id", row_key().alias("row"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    none = F.array().cast("array<long>")
    return sizes.join(repeated_lines(docs).drop("doc_id"), "row", "left").select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.col("removed").cast("array<long>"), none).alias("removed"),
        F.coalesce("keepers", none).alias("keepers"),
    )
