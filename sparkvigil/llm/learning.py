"""The bounded sample of labelled rows that models are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import train_row

#: A model sees at most so many labelled documents, at any size of the corpus.
SAMPLE = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, limit: int = SAMPLE) -> DataFrame:
    """(doc_id, text, y) of at most ``limit`` labelled documents, chosen by a hash of the id.

    Only training rows take part, never held-out ones. Labels that repeat an id count
    once, the largest; null labels and ids not at all. The chosen labels are bounded
    by ``limit``, so that they are broadcast and no text moves.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & train_row())
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("_doc")).agg(F.max(column).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("_doc"), "_doc").limit(limit)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_doc")).select("doc_id", "text", "y")


def held_out(doc_id: str = "doc_id"):
    return ~F.coalesce(train_row(doc_id), F.lit(True))
