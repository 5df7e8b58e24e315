"""Fill-in-the-middle: texts cut at line ends into prefix, middle and suffix, and put in another order.

A Split pre-tokenizer, which needs no training, isolates the lines; its offsets in code points give
their number and, by rank, the places of the two cuts. Which lines are cut, and the form, hang on the
document's id alone, so reruns agree. One pass over the rows, no shuffle.
"""

from __future__ import annotations

from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = "<[PSM]>"
SEED = 7
#: In a hundred: documents that are cut, and those of them that have the suffix first.
CUT, SUFFIX_FIRST = 100, 50


@cache
def _splitter(unit: str):
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(unit), behavior="isolated")


def unit_ends(text: str, unit: str = UNIT) -> list[int]:
    """Where each unit ends, in code points."""
    return [end for _, (_, end) in _splitter(unit).pre_tokenize_str(text)]


def draw(doc_id: Column, k: int, seed: int = SEED) -> Column:
    """The k-th number of 32 bits that a document's id gives; a null id counts as an empty one."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(hexed, 8 * k - 7, 8), 16, 10).cast("long")


def form(text: Column, doc_id: Column, seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> Column:
    """``plain`` (empty texts, those with a mark, and those drawn to stay), ``spm`` or ``psm``."""
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (draw(doc_id, 3, seed) % 100 >= cut)
    return F.when(plain, "plain").when(draw(doc_id, 4, seed) % 100 < suffix_first, "spm").otherwise("psm")


def _cut(unit: str):
    @F.pandas_udf("n long, prefix_chars long, middle_chars long, output string")
    def cut(texts: pd.Series, forms: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
        rows = []
        for text, kind, a, b in zip(texts, forms, one, two, strict=True):
            ends = [0, *unit_ends(text, unit)]
            n = len(ends) - 1
            if kind == "plain":
                rows.append((n, None, None, text))
                continue
            low, high = sorted((ends[a % (n + 1)], ends[b % (n + 1)]))
            prefix, middle, suffix = text[:low], text[low:high], text[high:]
            head = (SUFFIX, suffix, PREFIX, prefix) if kind == "spm" else (PREFIX, prefix, SUFFIX, suffix)
            rows.append((n, low, high - low, "".join((*head, MIDDLE, middle))))
        return pd.DataFrame(rows, columns=["n", "prefix_chars", "middle_chars", "output"]).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return cut


def fill_in_middle(docs: DataFrame, *, unit: str = UNIT, seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` (all columns in ``boxed``), ``doc_id``, ``form``, and ``n``, ``prefix_chars``, ``middle_chars``, ``output``.

    Null texts count as empty and stay plain; null ids draw as the empty id; equal ids are cut by the
    same draws; rows come out once each, repeated ones too; long texts are held one at a time beside
    their batch. An empty table gives no rows. Names of other columns can't clash: they are in ``boxed``.
    """
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("boxed")
    t = F.coalesce(F.col("text"), F.lit(""))
    given = docs.select(every, "doc_id", t.alias("t"), form(t, F.col("doc_id"), seed, cut, suffix_first).alias("form"))
    pieces = _cut(unit)(F.col("t"), F.col("form"), draw(F.col("doc_id"), 1, seed), draw(F.col("doc_id"), 2, seed))
    return given.select("boxed", "doc_id", "form", pieces.alias("p")).select("boxed", "doc_id", "form", "p.*")


def restored(output: Column, kind: Column) -> Column:
    """The text that an output was made of."""
    part = F.split(output, MARKS)
    one, two, three = part[1], part[2], part[3]
    back = F.when(kind == "psm", F.concat(one, three, two)).when(kind == "spm", F.concat(two, three, one))
    return F.when(kind == "plain", output).otherwise(back)


def transformed(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with ``text`` in its new order; the other columns as they were. Else as ``fill_in_middle``."""
    out = fill_in_middle(docs, **settings)
    return out.select(*[(F.col("output") if c == "text" else F.col("boxed").getField(c)).alias(c) for c in docs.columns])


SQL = r"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3,
         ('0x' || h[25:32])::UBIGINT AS h4 FROM lines),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS low, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS high,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, array_to_string(u[1:low], '') AS p, array_to_string(u[low + 1:high], '') AS m, array_to_string(u[high + 1:], '') AS s FROM cut),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                 ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM parts),
back AS (SELECT *, string_split_regex(o, '<[PSM]>') AS b FROM made)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(o) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN o WHEN 'psm' THEN b[2] || b[4] || b[3] ELSE b[3] || b[4] || b[2] END) AS restored_sha256
FROM back
"""


def query(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    made, back = F.sha2("output", 256), F.sha2(restored(F.col("output"), F.col("form")), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", made.alias("output_sha256"), back.alias("restored_sha256"))
