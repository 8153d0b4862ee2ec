"""From raw documents to sampled piece ids: the stages of a corpus, each an operator of asoflab.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from asoflab.llm import common, mixing, ngram_join, piece_sampling, quality, secrets
from asoflab.llm.queries import TARGETS, table, tokenizer

ORACLE_SQL = None  # a trained classifier and sampled segmentations are beyond SQL


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of docs that the ranking, learned from the labels of docs, does not reject."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.train(docs, labels)
    return quality.accepted(docs, model)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id."""
    return ngram_join.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets taken out of their texts."""
    return secrets.redacted(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target shares of sources, languages and topics, none more than 16 times; languages without a target keep theirs."""
    return mixing.sampled(docs, TARGETS, keep_other=True, most_copies=16)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, best, samples): the model's encoding of each document and sampled segmentations."""
    return piece_sampling.sampled(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing_sources),
    ("SentencePiece encoding and decoding", piece_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; each result is written and read again before the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
