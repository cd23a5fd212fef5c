import random

import numpy as np
from pyspark.sql import functions as F

from sparkvigil.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, uid int, vec string"


def brute(rows, k, every):
    good = [(i, v, [int(np.floor(1024.0 * float(np.float32(x)))) for x in e]) for v, (i, e) in enumerate(rows) if e and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, v, q in good:
        if i is not None and i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j is None, j or 0) for j, w, c in good if w != v and len(c) == len(q))[:k]
            out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(found, 1)]
    return sorted(out, key=str)


def run(spark, rows, k=10, every=10):
    df = spark.createDataFrame([(i, e, 0, "") for i, e in rows], SCHEMA).repartition(3)
    got = topk.top_k(df, F.col("vec_id") % every == 0, k=k)
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()), key=str)


def test_all_kinds_of_vectors(spark):
    rng = random.Random(22)
    rows = []
    for i in range(400):
        size = rng.choice([0.01, 0.3, 1.0, 1.0, 5.0])
        rows.append((i, [size * rng.gauss(0, 1) for _ in range(8)]))
    base = [rng.gauss(0, 1) for _ in range(8)]
    rows += [(500 + i, [x + rng.gauss(0, 0.02) for x in base]) for i in range(100)]  # close together: steep thresholds
    rows += [(700 + i, base) for i in range(30)] + [(40, base)]  # copies, ties and a repeated id
    rows += [(800, None), (810, []), (820, [None] * 8), (830, [float("nan")] * 8), (840, [float("inf")] + [0.0] * 7), (850, [0.0] * 8), (None, base), (860, [1.0, 2.0]), (861, [2.0, 1.0]), (870, [3.0])]
    assert run(spark, rows) == brute(rows, 10, 10)


def test_floors_and_buckets_never_lose_a_result():
    rng = np.random.default_rng(23)
    for case in range(30):
        n, dim = 600, 6
        c = np.floor(1024 * rng.normal(size=(n, dim)) * rng.choice([0.1, 1, 3], (n, 1))).astype(np.int64)
        if case % 2:
            c = np.floor(1024 * (rng.normal(size=dim) + 0.05 * rng.normal(size=(n, dim)))).astype(np.int64)
        q = c[:20]
        scores = q @ c.T
        floor = np.sort(scores, axis=1)[:, -12].astype(float)
        ids = rng.permutation(n)
        got = {i: list(zip(s.tolist(), v.tolist(), strict=True)) for i, v, s in topk.search_block(np.arange(n), ids, c, np.arange(20), q, floor, 5)}
        for i in range(20):
            want = sorted((-int(s), int(v)) for j, (s, v) in enumerate(zip(scores[i], ids, strict=True)) if j != i and s >= floor[i])[:5]
            assert got.get(i, []) == [(-s, v) for s, v in want]


def test_large_components_stay_exact_and_small_tables(spark):
    rows = [(i, [3.0e9 * (i + 1), 1.0]) for i in range(12)]
    assert run(spark, [(i, [x / 1e5 for x in e]) for i, e in rows], k=3) == brute([(i, [x / 1e5 for x in e]) for i, e in rows], 3, 10)
    assert [r[1] for r in run(spark, rows, k=3)] == [1, 2, 3, 1, 2, 3]
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == []
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 1024 * 2048)]
