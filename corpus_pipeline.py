"""A training corpus from ``documents`` in five stages, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from acequia.llm.exact_dedup import distinct_documents
from acequia.llm.jaccard_join import near_distinct
from acequia.llm.mixing import mixed_documents
from acequia.llm.piece_encoding import encode_pieces
from acequia.llm.quality_rules import clean
from acequia.llm.queries import tokenizer
from acequia.llm.shared import saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality rules reject, and lines that too many documents share."""
    return clean(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts."""
    return distinct_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of near copies: five-word shingles, similarity 0.8 or more."""
    return near_distinct(docs, n=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or sample documents so that sources meet their weights."""
    return mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document: doc_id, ids, score and number of chunks."""
    return encode_pieces(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing", mixture),
    ("SentencePiece encoding", pieces),
]

#: Shingle hashes, seeded orders and piece scores have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents`` of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
