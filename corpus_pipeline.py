"""From raw documents to packed training sequences, stage by stage.

Each stage works on all that the one before it kept; every stage but the last returns the columns
of documents. A stage's result is written as Parquet to the shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heatloom.llm import lines, minhash, mixing, packing, quality
from heatloom.llm.common import cut, table
from heatloom.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and lines that too many documents of a source share."""
    return quality.apply_rules(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A repeated line stays only in its first document."""
    return lines.dedup_lines(docs).drop("n_lines", "n_dropped")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return minhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a second copy is a second row."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path(), capacity=2048, end_id=0)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Line dedup could be stated in SQL, probability sketches and packing can not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
