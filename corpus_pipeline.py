"""A training-corpus pipeline: classify, dedup lines, dedup documents, cut repeated passages, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each stage's
result as Parquet in the shared checkpoint folder and reads it back as the next one's docs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, line_dedup, packing, quality, suffix_dedup
from tessera.llm.common import prepare
from tessera.llm.queries import WORD_VOCABULARY, vocabulary

#: Bytes of a passage that counts as repeated: shorter than in the operator's own query, so
#: that passages of over 50 words are caught in any of the languages.
PASSAGE_BYTES = 200


def _again(docs: DataFrame, text: DataFrame) -> DataFrame:
    """Documents with changed texts, in the columns of ``docs``; n_chars follows the text where there is one."""
    if "n_chars" in docs.columns:
        text = text.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return text.select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(docs, quality.fit(docs, labels), out="_t_score")
    return scored.where("_t_score >= 0.5").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that came before."""
    return _again(docs, line_dedup.dedup(docs))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by five-word shingles at a similarity of 0.8: the one of smallest id.

    Documents without words, and rows without an id, are no group and stay.
    """
    groups = jaccard.join(docs).select(F.col("doc_id").alias("_t_id"), "component_id").where("_t_id != component_id").select("_t_id").distinct()
    return docs.join(groups, docs["doc_id"] == groups["_t_id"], "left_anti")


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand anywhere else too."""
    return _again(docs, suffix_dedup.strip(docs, length=PASSAGE_BYTES))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 4096 tokens."""
    return packing.pack(packing.pieces(docs, vocabulary(WORD_VOCABULARY)))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_quality),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", dedup_documents),
    ("suffix_array_dedup", cut_passages),
    ("best_fit_packing", pack_sequences),
]

#: SQL has no way to state the trained classifier or the token ids, so the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents."""
    prepare(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
