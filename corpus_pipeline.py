"""The corpus pipeline: five stages, each calling one training-data operator on all that its predecessor kept.

Every stage takes any table with the columns of documents and more, and keeps those. Null texts count as empty, are not
toxic and equal each other and empty ones, so one of them stays; they have no n-grams, no words for the mix (see
without_near_copies and to_target_weights) and no tokens. Null ids, sources and repeated rows are treated as said at each
stage. Texts of any length are taken whole. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from docweft.llm.queries import TOKENIZER, table, toxicity_machine
from docweft.session import discard, scratch
from docweft.session import written as stored


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; learned from the labelled rows of the input's own documents table. Each row is judged by its text alone, so repeated rows and null ids stay or go alike."""
    machine = toxicity_machine(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, machine)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts the one with the smallest doc_id; of rows that repeat it one; a null id only if the text has no other."""
    return exact_dedup.keep_first(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of n-gram Jaccard links, that with the smallest doc_id; texts without a word are classes of their own."""
    return jaccard_join.keep_one(docs)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, shard after shard: for each shard and pass that draws blocks of a document a row with these blocks. n_chars follows the text.

    A null source is a source. A text without words stays once if its source has a whole pass or no words at all.
    """
    return mixing.mixed(docs).withColumn("n_chars", F.length("text").cast("long"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, number of tokens, ids (little-endian unsigned 32-bit) and the SHA-256 of the decoded text of every row."""
    return bpe.encode_rows(docs, TOKENIZER)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing to target weights", to_target_weights),
    ("BPE encoding", to_tokens),
]

#: Scores, hashes and draws are not SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each is written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # what a stage writes for itself goes with it, and its input then too
            keep.append(stored(stage(spark, docs, sf_dir), name.replace(" ", "_")))
        discard(docs)
        docs = keep[0]
    return STAGES[-1][1](spark, docs, sf_dir)
