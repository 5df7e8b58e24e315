"""Token ids of Arrow columns of text: every distinct word of a batch is encoded once.

A byte-level BPE splits a text into runs before it merges, and never inside a run between white
space and the character before it. So a text without special tokens whose only white space is single spaces and newlines
can be cut before each of them, and the pieces' ids joined. Pieces come back again and again;
their ids are kept in a table of bounded size for the life of the worker; when it is full, its older
half, which has the more frequent pieces, stays. Other texts are encoded whole.
"""

from __future__ import annotations

import os
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces whose ids are kept, and characters handled at once.
KEEP = 600_000
CHARS = 4_000_000
#: Texts to encode whole: white space that is not single, last, or other than space and newline; or none.
ODD = r"[ \n][ \n]|[ \n]\z|[\x00-\x09\x0b-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\A[^ \n]*\z"


class Encoder:
    """Ids by the ``tokenizers`` file at ``path``; a special token in a text has its own id."""

    def __init__(self, path: str, keep: int = KEEP):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        named = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Texts that hold one of these are encoded whole: no cut runs through it.
        self.odd = "|".join([ODD, *(r"\Q" + t + r"\E" for t in named)])
        self.keep = keep
        self.place: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)
        (self.newline,) = self._ids("\n")

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        half = min(len(self.place), self.keep // 2)
        self.place = dict(islice(self.place.items(), half))
        self.ids, self.ends = self.ids[: self.ends[half]].copy(), self.ends[: half + 1].copy()

    def _learn(self, pieces: list[str]) -> None:
        """Add the ids of new pieces: one text with a piece in each line is encoded."""
        lines = "\n".join([p[1:] if p[:1] == "\n" else " " + p for p in pieces])
        got = np.array(self._ids(lines), "<u4")
        breaks = got == self.newline
        ids, counts = got[~breaks], np.diff(np.flatnonzero(np.concatenate(([True], breaks, [True])))) - 1
        # Pieces after a newline have its id in front.
        led = np.fromiter((p[:1] == "\n" for p in pieces), bool, len(pieces))
        ids = np.insert(ids, (np.cumsum(counts) - counts)[led], self.newline)
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(counts + led)))
        self.ids = np.concatenate((self.ids, ids.astype("<u4")))
        start = len(self.place)
        self.place.update(zip(pieces, range(start, start + len(pieces)), strict=True))

    def _regular(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of texts that begin with white space, in which it stands singly and never last."""
        spaced = pc.utf8_slice_codeunits(pc.replace_substring(texts, "\n", " \n"), 1)
        parts = pc.split_pattern(spaced, " ")
        coded = parts.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        new = [p for p in pieces if p not in self.place]
        if len(self.place) + len(new) > self.keep:
            self._forget()
            new = [p for p in pieces if p not in self.place]
        if new:
            self._learn(new)
        which = np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))[coded.indices.to_numpy()]
        begin, length = self.ends[which], self.ends[which + 1] - self.ends[which]
        ends = np.cumsum(length)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(begin - ends + length, length)]
        cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy())))]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, as little-endian 32-bit numbers; none for null."""
        if not len(texts):
            return []
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = np.asarray(pc.match_substring_regex(texts, self.odd))
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        for k in np.flatnonzero(odd).tolist():
            out[k] = np.array(self._ids(texts[k].as_py()), "<u4")
        even = np.flatnonzero(~odd)
        sizes = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64)[even]) // CHARS
        for group in np.split(even, np.flatnonzero(np.diff(sizes)) + 1) if len(even) else ():
            chosen = texts.take(pa.array(group))
            first = pc.replace_substring_regex(chosen, r"\A([^ \n]*)(?s:.*)\z", r"\1").to_pylist()
            rest = pc.replace_substring_regex(chosen, r"\A[^ \n]*", "")
            # The first word has no space before it: encoded by itself.
            heads = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(first, add_special_tokens=False)]
            for k, head, tail in zip(group.tolist(), heads, self._regular(rest), strict=True):
                out[k] = np.concatenate((head, tail))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for ``path``; made once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
