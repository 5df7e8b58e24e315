"""Column expressions for words and lines that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of characters other than space, tab, newline, VT, FF and CR.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Characters of texts that a task handles at once.
CHARS = 1_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def boxed(docs: DataFrame, **more: Column) -> DataFrame:
    """All columns of ``docs`` in one, ``boxed``, beside its ``text`` and the columns of ``more``.

    So names that an operator adds clash with none of the caller's, whatever those are.
    """
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(every.alias("boxed"), "text", *[c.alias(name) for name, c in more.items()])


def pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs (start, end) of texts of about ``CHARS`` characters together."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        if k > start and held + len(t or "") > CHARS:
            yield start, k
            start, held = k, 0
        held += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def row_key() -> Column:
    """Tells rows apart, those of one doc_id too: equal rows alone have one key."""
    return F.xxhash64(F.lit(3), "doc_id", "text")
