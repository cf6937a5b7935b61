"""The registered queries of the operators, over whole tables with production parameters.

None has an oracle in SQL: each either gives digests that the oracle's SQL has no functions for
(CRC-32, token ids), trains or searches, or takes SQL a pass over all pairs. tests/llm holds
operators against brute force and the tokenizers library on small tables; the registered queries have no tests of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, embed_dedup, html_text, jaccard, line_dedup, packing, quality, shard, suffix_dedup

BYTE_VOCABULARY, WORD_VOCABULARY = "byte_bpe_50k.json", "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.dedup(_read(spark, sf_dir, "embeddings"), threshold=0.95)


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_read(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY))


def op4_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"), every=50, k=5)


def op5_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.assign(_read(spark, sf_dir, "documents"), shards=16)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_read(spark, sf_dir, "documents"), shingle=4, similarity=(85, 100))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(_read(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY)))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_read(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_read(spark, sf_dir, "documents"), length=400)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_quality_classifier, op2_embedding_near_dedup, op3_bpe_encode_decode, op4_permutation_ann, op5_hash_tree_sharding,
        op6_ngram_jaccard_join, op7_html_extraction, op8_best_fit_packing, op9_line_dedup, op10_suffix_array_dedup,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {}
