"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, exact_dedup, html_text, jaccard, mixing, neighbours, packing, pii, ppm, quality, repair, token_counts, toxicity


def vocabulary(name: str) -> str:
    """Path of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_jaccard_join(_documents(spark, sf_dir), k=4, num=85, den=100)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality.quality_rules(_documents(spark, sf_dir))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    cut = packing.token_pieces(docs, vocabulary("byte_bpe_50k.json"))
    cut = cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.place_pieces(cut, docs.count(), ["doc_id", "deal"])


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(_documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


def op8_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = toxicity.held_out("doc_id", 10, 0)
    scored = ppm.ppm_scores(docs, ~held_out, order=6)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, before and after their personal data is masked."""
    found = pii.base_spans(F.coalesce("text", F.lit("")))
    # of spans of several kinds that overlap, the earliest is masked
    masked = lambda spans, mask: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(mask).alias("text")))
    edits = F.concat(*[masked(spans, f"[{kind}]") for kind, spans in found.items()])
    docs = _documents(spark, sf_dir).select("doc_id", "text", edits.alias("edits"))
    return token_counts.edited_token_counts(docs, vocabulary("byte_bpe_50k.json"), edits_col="edits")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.nearest_neighbours(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repair.audits(repair.repair_conversations(rows))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_ngram_jaccard_join, op2_toxicity, op3_mix_sources, op4_quality_rules, op5_pack_sequences, op6_personal_data, op7_exact_dedup, op8_ppm_scores, op9_main_text, op10_token_counts, op11_nearest_neighbours, op12_conversation_repair, op13_collocations]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality_rules": quality.oracle_sql(),
        "op7_exact_dedup": """
            select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
                   coalesce(doc_id is not distinct from max(doc_id) over g, false) as kept, sha256(coalesce(text, '')) as text_sha256
            from documents window g as (partition by coalesce(text, ''))""",
        "op13_collocations": collocations.oracle_sql(),
    }
