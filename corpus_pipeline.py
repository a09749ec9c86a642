"""A corpus from documents: five stages, each one of the operators over all that is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.llm import decontaminate, near_copies, piece_fst, substring_dedup, toxicity
from tablegauge.llm.common import table, written
from tablegauge.llm.queries import vocabulary


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half; the network learns from the labels outside the held-out fold.

    Null and wordless texts score 0 and stay; rows with a null or repeated id are judged by
    their own text. Labels that are null, contradict each other or have no document teach nothing.
    """
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near-duplicates: five-word shingles 0.8 alike or more.

    Operator 6's classes of fingerprints, and MinHash bands for copies further apart, name
    the texts to compare.

    Rows that share an id and differ in text stand for their own groups; rows that repeat an
    id and text are one. Rows with a null id stay; null and wordless texts are one group.
    """
    return near_copies.first_of_each(docs)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that also start earlier.

    All rows stay, those that lose all their words with an empty text. Rows that repeat an id
    and text are one document; rows with a null id and null texts are left alone.
    """
    return substring_dedup.clean(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null texts contain none; null and wordless items are contained in nothing. Rows with null
    or repeated ids are judged by their own text.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and whether decoding gives its text back.

    A null text is encoded as an empty one, and ``lossless`` is null for it. Every row comes back.
    """
    pieces = piece_fst.encoded(docs, vocabulary("piece_bpe_32k.model"), keep_text=True)
    return pieces.select("doc_id", "ids", F.size("ids").alias("n_pieces"), (F.col("decoded") == F.col("text")).alias("lossless"))


STAGES = [
    ("toxicity", toxic_out),
    ("near_duplicates", near_duplicates_out),
    ("substring_dedup", repeats_out),
    ("decontamination", benchmark_out),
    ("sentencepiece", encoded),
]

#: A trained network and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next; an empty table gives an empty one."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
