"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word, as the contracts define it.
WORD = r"[^\x20\x09-\x0D]+"
_COALESCE = "spark.sql.adaptive.coalescePartitions.parallelismFirst"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one on a single machine; on a cluster an error."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="spark-")
    return _own_dir


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: ends its lineage, survives lost executors.

    Small tables become few files: partitions are joined up to the advisory size, and there are at most eight files a core.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_COALESCE, "true")
    spark.conf.set(_COALESCE, "false")
    try:
        df.coalesce(8 * spark.sparkContext.defaultParallelism).write.parquet(path)
    finally:
        spark.conf.set(_COALESCE, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def unused(names: list[str], *wanted: str) -> list[str]:
    """Column names like those wanted that ``names`` lacks, without regard to case."""
    taken = {n.lower() for n in names}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def train_row(doc_id: str = "doc_id") -> Column:
    """Rows whose labels may be learned from: crc32 of the id's text, mod 3, is not 1."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1


def slices(batch: pa.RecordBatch, at: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes of the text in column ``at``, so that what Python holds is bounded by bytes and not by rows."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    for lo, hi in pairwise([0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), batch.num_rows]):
        yield batch.slice(lo, hi - lo)
