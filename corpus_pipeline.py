"""The corpus pipeline: five stages from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir), docs being all that the stage before
kept, and returns a DataFrame; all but the last return the columns of
``documents``. Null and empty texts, repeated rows, null ids and extra columns go through as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkvigil.llm import line_dedup, mixing, packing, quality, simhash
from sparkvigil.llm.common import cut, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents which the quality classifier rejects go.

    Null and empty texts are scored as empty; rows that repeat get the same score, so they stay or go together. Without labels, or where
    all of them are good, nothing is rejected. An empty table stays empty.
    """
    return quality.kept(docs, table(spark, sf_dir, "labels"), threshold=0.5)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose templates recur across documents go, but for the first text that has them.

    The first text is that of the least doc_id (null last), then of the least hash. Exact copies are one text and lose the same lines. Null and empty
    texts stay; documents that lose their last word go.
    """
    return line_dedup.without_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: that with the least doc_id (null last), of those the one whose text has the least hash.

    Groups go by row, so rows that share an id or have none stay or go with their own texts. All texts without words, null ones too, are one group.
    """
    return simhash.keep_one(docs, similar=0.8, words_each=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: what each epoch takes of a document is a row.

    Texts without words, null ones too, have nothing to take and go. A null source is a source; rows that repeat are drawn as rows of their own.
    """
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 4096 tokens.

    A null or empty text is its end token alone; rows that repeat and rows without an id are documents of their own; an empty table has no sequences.
    """
    return packing.pack_documents(docs, length=4096, end_id=1)


STAGES = [
    ("quality_filter", quality_filter),
    ("drop_repeated_lines", drop_repeated_lines),
    ("drop_near_duplicates", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL can't express the fitted classifier, the draws or the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
