"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.llm import ann, chat, exact, html, jaccard, lexical, lm, merkle, near_vectors, packing, pieces, quality, repeats
from carelake.llm.common import importable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded to pieces and decoded again: ids' count and crc32, the hash of the text that comes back."""
    back = pieces.round_trip(_table(spark, sf_dir, "documents"))
    return back.select("doc_id", "n_ids", "ids_crc32", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of any 400-byte string that starts twice in the corpus."""
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), 400).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_kept")


def op3_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows by inner product of every embedding whose id is divisible by 20."""
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), 2048)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(_table(spark, sf_dir, "pages"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document by the counts of all others."""
    return lm.score(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_tokens", F.round("log_score", 4).alias("log_score"), F.round("mean_log", 6).alias("mean_log"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under shingle Jaccard of 0.75 or more."""
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.9 or more among all embeddings: counts, components, the kept ones."""
    return near_vectors.near_vectors(_table(spark, sf_dir, "embeddings"), 0.9)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored for quality; labels of the held-out fold are not used."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations plus conversation -1 formatted, then read back and digested."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.digest(chat.format_chat(rows.unionByName(extra)))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its group of equal texts."""
    return exact.exact_dedup(_table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents of the highest lexical score of every benchmark item."""
    return lexical.search(_table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 20)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle manifest of all documents and the proof of each, a fifth of them tampered with."""
    docs = _table(spark, sf_dir, "documents")
    return merkle.verified_proofs(*merkle.manifest(docs, merkle.lowered_fifth(docs)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_ann_search": op3_ann_search,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_html_extraction": op5_html_extraction,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_lexical_search": op12_lexical_search,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op6_lm_scoring": lm.ORACLE_SQL,
    "op10_chat_formatting": chat.ORACLE_SQL,
    "op11_exact_dedup": exact.ORACLE_SQL,
    "op12_lexical_search": lexical.ORACLE_SQL,
    "op13_merkle_manifest": merkle.ORACLE_SQL,
}
