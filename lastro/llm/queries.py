"""One query for each corpus operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, byte_bpe, clustering, hpylm, language, mixing, multiset_hash, near_dedup, neighbours, packing, sharding, token_counts, transcripts

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def match_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", near_dedup.hex_digits(F.col("simhash")).alias("fingerprint"), "component_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_path())


def op3_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


def op4_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.document_fingerprints(documents(spark, sf_dir))


def op5_chat_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.canonical_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op7_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(documents(spark, sf_dir))


def op8_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score_documents(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(documents(spark, sf_dir))


def op10_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(documents(spark, sf_dir))


def op11_owner_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digest(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_drake_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoding_digest(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.tiktoken"), match_pattern())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_simhash_near_dedup,
        op2_token_counts,
        op3_best_two_fit_packing,
        op4_multiset_fingerprints,
        op5_chat_transcripts,
        op6_nearest_vectors,
        op7_two_pass_shuffle,
        op8_pitman_yor_scores,
        op9_language_id,
        op10_fair_queue_mix,
        op11_owner_alignment,
        op12_drake_clusters,
        op13_prefix_bpe,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """The mix and the clusters: the other results depend on hashes, tokenizers, draws or learned models that DuckDB lacks; tests hold them against brute force."""
    return {"op10_fair_queue_mix": mixing.SQL, "op12_drake_clusters": clustering.clustering_sql()}
