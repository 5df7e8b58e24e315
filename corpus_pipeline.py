"""Five stages from raw documents to packed training sequences.

Quality rules, line deduplication, near-duplicate removal, mixing of sources, packing. Each stage
works on all that the one before kept, is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.llm import fuzzy_lines, mixing, packing, quality_rules, simhash
from skeinworks.runtime import materialize


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the learned decision list go."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat, exactly or nearly, stay in their first document alone."""
    return fuzzy_lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays: fingerprints within 2 bits, or 0.8 of the 5-word shingles."""
    return simhash.one_of_each_group(docs, wide=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is taken to its target; what is taken twice comes twice."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens and shorter tiers."""
    import public_tokenizers

    return packing.pack_documents(docs, str(public_tokenizers.path(packing.TOKENIZER)))


STAGES = [
    ("quality rules", filter_quality),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_documents),
    ("source mixing", mix_sources),
    ("packing", pack),
]

#: Edit similarity and packing are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain loop.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what the first four stages keep of ``documents``; each stage reads what the one before wrote.

    Null and empty texts fail the quality rules and go, as do all of fewer than 50 words. Null ids: kept if the
    text is good; their lines count as first occurrences, they are in no group, and all are mixed alike. Null
    sources are a source of their own. Very long texts: whole. Repeated rows: each is judged; they lose the
    same lines, and of a group the rows of the least id stay. Ties: as the operators break them. Columns
    besides those of ``documents`` are carried along, whatever their names. No labels: the base rules alone.
    No documents: no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
