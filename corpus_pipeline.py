"""From raw documents to token ids in five stages, each written as Parquet and read again by the next.

Toxicity drops rejected documents; the n-gram Jaccard join keeps one document of each group of near copies (five-word
shingles, similarity 0.8); decontamination drops documents that hold a benchmark item; PII replaces personal data and what
discloses it; BPE encodes what is left. Stages but the last return the columns of documents.

Defined results: empty tables give empty stages, and without labels of both kinds nothing is rejected as toxic; a null text
counts as empty in every stage and stays null until BPE gives it no tokens; rows without a doc_id are never near copies and
stay unless toxic or contaminated; rows that repeat an id are one document to the n-gram join, and to the others each its own;
of texts that tie as copies the smallest doc_id stays; extra columns travel along, whatever their names, up to BPE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphvec.llm import bpe, decontaminate, jaccard, pii, toxicity
from graphvec.llm.common import small_batches, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labelled ones of the learning fold, does not reject."""
    small_batches(spark)
    return toxicity.keep_clean(docs, toxicity.learn(docs, toxicity.learning_labels(table(spark, sf_dir, "labels"))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return jaccard.keep_one(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and disclosing terms replaced."""
    return pii.sanitise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of the ids and of the decoded text."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pii", hide_personal_data),
    ("bpe", encode),
]

#: SQL can express neither the models nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
