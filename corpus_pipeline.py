"""A training corpus from the documents table: clean, deduplicate, mix and pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import exact_dedup, jaccard, mixing, packing, quality
from tidemill.llm._store import delete, passing_tables, written
from tidemill.llm.queries import vocabulary

#: Ids that are joined by broadcast at most; beyond, by shuffle.
BROADCAST_ROWS = 200_000


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.passing(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that of the largest id."""
    return exact_dedup.drop_duplicates(docs, broadcast_rows=BROADCAST_ROWS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (5 words, similarity 0.8): that of the smallest id. Rows without id stay."""
    linked = written(jaccard.ngram_jaccard_join(docs, links=False), "linked")
    gone = linked.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(_few(gone), "doc_id", "left_anti").select(docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as many times as the mix takes it, whatever its id: rows without id or of a repeated id count on their own."""
    return mixing.mixed_documents(docs, broadcast_rows=BROADCAST_ROWS)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 tokens: a row per piece of a document."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_stage), ("exact dedup", exact_stage), ("near dedup", near_stage), ("mixing", mix_stage), ("packing", pack_stage)]

#: No SQL expresses the mixing and packing stages; tests hold the others against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again as the next one's input.

    What a stage wrote on its way, and its input, is deleted when its output is written; the last stage's input stays.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with passing_tables(spark) as inner:
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            output = inner.pop()
        if last:
            delete(spark, last)
        last = output
    return STAGES[-1][1](spark, docs, sf_dir)
