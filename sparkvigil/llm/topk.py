"""Exact top-k inner products: vectors in buckets of like length, pruned by local cosine thresholds, then verified."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

BLOCK, FOCUS, STEEP = 4096, 3, 0.6
#: A group of queries is broadcast; it holds at most so many, whatever their number.
GROUP = 16_384
_NO_ID = (1 << 63) - 1


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component, as longs; null for a vector that is null, empty, or holds a null or non-finite component."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(ok & (F.size(vector) > 0), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


_PACKED = "dim int, n int, longest double, uids binary, ids binary, data binary"


def _pack(uids: np.ndarray, ids: np.ndarray, m: np.ndarray) -> dict:
    longest = float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)).max())
    return {"dim": m.shape[1], "n": len(m), "longest": longest, "uids": uids.tobytes(), "ids": ids.tobytes(), "data": m.tobytes()}


def _pack_rows(batches):
    """Blocks of up to BLOCK vectors of one dimension, in the order they come."""
    held: dict[int, list] = {}
    for batch in batches:
        uid, vec, vectors = (batch.column(i) for i in range(3))
        dims = np.diff(vectors.offsets.to_numpy()) if len(batch) else np.empty(0, int)
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            part = pa.array(at)
            parts = held.setdefault(int(dim), [])
            parts.append((uid.take(part).to_numpy(), vec.take(part).to_numpy(), _matrix(vectors.take(part), int(dim))))
            if sum(len(p[0]) for p in parts) >= BLOCK:
                u, v, m = (np.concatenate(x) for x in zip(*parts, strict=True))
                whole = len(u) - len(u) % BLOCK
                for i in range(0, whole, BLOCK):
                    yield pa.RecordBatch.from_pylist([_pack(u[i : i + BLOCK], v[i : i + BLOCK], m[i : i + BLOCK])], _PACKED_ARROW)
                held[int(dim)] = [(u[whole:], v[whole:], m[whole:])] if whole < len(u) else []
    for parts in held.values():
        if parts:
            yield pa.RecordBatch.from_pylist([_pack(*(np.concatenate(x) for x in zip(*parts, strict=True)))], _PACKED_ARROW)


_PACKED_ARROW = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("longest", pa.float64()), ("uids", pa.binary()), ("ids", pa.binary()), ("data", pa.binary())])
_FOUND_ARROW = pa.schema([("quid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def search_block(uids: np.ndarray, ids: np.ndarray, c: np.ndarray, quids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int):
    """(query index, vec ids, scores) of each query's k best in one bucket, none below its floor.

    The local threshold of a query is the cosine that a vector as long as the
    bucket's longest needs to reach the floor. Above 1 the bucket is
    skipped. From STEEP on, coordinates prune: on the query's FOCUS largest, a
    vector must lie in the range which that cosine leaves. Below, length prunes: shorter
    vectors can't reach the floor. The products of what is left are computed exactly.
    """
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * c.shape[1] < 2**52
    cf, qf = c.astype(np.float64), q.astype(np.float64)
    cl, ql = np.sqrt((cf**2).sum(axis=1)), np.sqrt((qf**2).sum(axis=1))
    order = np.lexsort((ids, -cl))
    uids, ids, c, cf, cl = uids[order], ids[order], c[order], cf[order], cl[order]
    unit = cf / np.maximum(cl, 1e-300)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(np.isfinite(floor), floor / np.maximum(ql, 1e-300), -np.inf)
    need = np.where(need > 0, need * (1 - 1e-9), -np.inf)
    local = need / max(cl[0], 1e-300)
    reach = np.searchsorted(-cl, -need, "right")  # so many are long enough
    for lo in range(0, len(q), 256):
        at = np.arange(lo, min(lo + 256, len(q)))
        whole = at[local[at] < STEEP]
        longest = int(reach[whole].max(initial=0))
        products = cf[:longest] @ qf[whole].T if exact and len(whole) else None
        column = dict(zip(whole.tolist(), range(len(whole)), strict=True))
        for i in at[local[at] <= 1].tolist():
            if i in column:
                left = np.arange(reach[i])
                scores = products[: reach[i], column[i]].astype(np.int64) if exact else _exact(c[left], q[i])
            else:
                left = np.flatnonzero(_feasible(unit[: reach[i]], qf[i] / ql[i], local[i]))
                scores = (cf[left] @ qf[i]).astype(np.int64) if exact else _exact(c[left], q[i])
            ok = (scores >= floor[i]) & (uids[left] != quids[i])
            left, scores = left[ok], scores[ok]
            if len(left) > k:
                edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                near = scores >= edge
                left, scores = left[near], scores[near]
            best = np.lexsort((ids[left], -scores))[:k]
            if len(best):
                yield i, ids[left[best]], scores[best]


def _exact(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Products in whole numbers of any size; what a long can't hold becomes the nearest that it can."""
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([min(max(x, low), high) for x in c.astype(object) @ q.astype(object)], np.int64) if len(c) else np.empty(0, np.int64)


def _feasible(unit: np.ndarray, q: np.ndarray, t: float) -> np.ndarray:
    """Which unit vectors may have a cosine of t with q, by its FOCUS largest coordinates."""
    t = min(t, 1.0)
    ok = np.ones(len(unit), bool)
    for f in np.argsort(-np.abs(q))[:FOCUS]:
        slack = np.sqrt(max(0.0, (1 - t * t) * (1 - q[f] ** 2))) + 1e-9
        low = q[f] * t - slack if q[f] * t - slack > -1 else -np.inf
        high = q[f] * t + slack
        # the ranges hold for a cosine of at least t: past q's own coordinate the far edge opens
        ok &= (unit[:, f] >= (low if q[f] > 0 else -np.inf)) & (unit[:, f] <= (high if q[f] < 0 else np.inf))
    return ok


def _search(k: int):
    def each(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                c = np.frombuffer(row["data"], np.int64).reshape(-1, dim)
                q = np.frombuffer(row["qdata"], np.int64).reshape(-1, dim)
                quids, qids = np.frombuffer(row["quids"], np.int64), np.frombuffer(row["qids"], np.int64)
                floor = np.frombuffer(row["floor"], np.float64)
                a, b, v, s = [], [], [], []
                for i, ids, scores in search_block(np.frombuffer(row["uids"], np.int64), np.frombuffer(row["ids"], np.int64), c, quids, q, floor, k):
                    a.append(np.full(len(ids), quids[i]))
                    b.append(np.full(len(ids), qids[i]))
                    v.append(ids)
                    s.append(scores)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, v, s)], schema=_FOUND_ARROW)

    return each


def _groups(queries: DataFrame, k: int, parts: int) -> DataFrame:
    """Queries packed, one row for each part and dimension: quids, qids, qdata, floor."""

    def pack(pdf):
        import pandas as pd

        m = np.array(pdf["vector"].tolist(), np.int64)
        return pd.DataFrame([{"part": int(pdf["part"].iloc[0]), "dim": m.shape[1], "quids": pdf["uid"].to_numpy(np.int64).tobytes(), "qids": pdf["vec"].to_numpy(np.int64).tobytes(), "qdata": m.tobytes(), "floor": pdf["floor"].to_numpy(np.float64).tobytes()}])

    dealt = queries.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(parts))).withColumn("dim", F.size("vector"))
    return cut(dealt.groupBy("part", "dim").applyInPandas(pack, "part int, dim int, quids binary, qids binary, qdata binary, floor binary"), "queries")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k best rows by integer inner product, its own left out.

    Ties go to the smaller id. Rows whose vector is null, empty or not finite take no
    part; vectors meet those of their dimension only. Rows that repeat an id are rows of their own;
    a null id is never a query and comes last in ties. The vectors are ranged by length and packed in buckets; a first search, in the longest
    bucket of each dimension, gives every query a floor, the second searches all buckets with it. Queries go
    to the buckets in groups of at most GROUP, which are broadcast, one after the other; buckets never move.
    """
    vector = quantised(F.col(vector_col), scale)
    rows = cut(vectors.select(F.coalesce(F.col(id_col), F.lit(_NO_ID)).alias("vec"), vector.alias("vector"), (is_query & F.col(id_col).isNotNull()).alias("asked")).where("vector is not null").withColumn("uid", F.monotonically_increasing_id()), "vectors")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    ranged = rows.withColumn("length", length).repartitionByRange(max(1, -(-rows.count() // BLOCK)), F.col("length").desc()).sortWithinPartitions(F.col("length").desc(), "uid")
    blocks = cut(ranged.select("uid", "vec", "vector").mapInArrow(_pack_rows, _PACKED), "buckets")
    queries = rows.where("asked").select("uid", "vec", "vector")
    asked = queries.count()
    parts = max(1, -(-2 * asked // GROUP))
    while asked and queries.groupBy(F.pmod(F.xxhash64("uid"), F.lit(parts)).alias("p")).count().agg(F.max("count")).first()[0] > GROUP:
        parts *= 2

    def searched(groups: DataFrame, within: DataFrame) -> DataFrame:
        out = None
        for p in range(parts):
            part = groups.where(F.col("part") == p)
            met = within.join(F.broadcast(part), "dim").select("dim", "uids", "ids", "data", "quids", "qids", "qdata", "floor")
            found = met.mapInArrow(_search(k), "quid bigint, query_id bigint, vec_id bigint, score bigint")
            out = found if out is None else out.unionByName(found)
        return out

    best = W.partitionBy("quid").orderBy(F.col("score").desc(), "vec_id")
    longest = blocks.groupBy("dim").agg(F.max(F.struct("longest", "n", "uids", "ids", "data")).alias("b")).select("dim", "b.*")
    first = searched(_groups(queries.withColumn("floor", F.lit(float("-inf"))), k, parts), cut(longest, "longest"))
    floor = first.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("quid", F.col("score").cast("double").alias("floor"))
    floored = queries.join(cut(floor, "floor"), F.col("uid") == F.col("quid"), "left").select("uid", "vec", "vector", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    ranked = searched(_groups(floored, k, parts), blocks).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != _NO_ID, F.col("vec_id")).alias("vec_id"), "score")
