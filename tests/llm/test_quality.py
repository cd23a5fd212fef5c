import math
import random
import zlib

import numpy as np

from sparkvigil.llm import quality

SCHEMA = "doc_id bigint, text string, score string, y int"


def corpus(n=600, seed=16):
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        words = [rng.choice("the of and report city water plan result early seven".split()) for _ in range(rng.randrange(5, 80))]
        good = rng.random() < 0.7
        if not good:
            kind = rng.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + rng.choice(["***", "###"]) for w in words] if kind == 1 else [w for w in words for _ in range(9)]
        docs.append((i, " ".join(words), "s", 0))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_edge_cases(spark):
    docs, labels = corpus()
    docs += [(5000, None, "", 0), (5001, "", None, 0), (None, "no id", "", 0), (3, docs[3][1], "", 0), (5002, "long " * 30000, "", 0)]
    df, known = spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame(labels + [(None, 1, 0), (1, None, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.classify(df, known).collect()
    assert len(got) == len(docs)
    truth = {i: q for i, q, _ in labels}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in out) / len(out) > 0.97
    again = {(r.doc_id, round(r.score, 9)) for r in quality.classify(df.repartition(2), known).collect()}
    assert again == {(r.doc_id, round(r.score, 9)) for r in got}
    left = quality.kept(df, known)
    assert left.columns == df.columns and left.count() == sum(r.predicted for r in got)


def test_labels_of_held_out_rows_are_never_used(spark):
    docs, labels = corpus(200, 17)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels]
    df = spark.createDataFrame(docs, SCHEMA)
    a, b = (quality.classify(df, spark.createDataFrame(x, "doc_id bigint, quality int, toxic int")).collect() for x in (labels, flipped))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_tables_without_rows_or_with_one_class(spark):
    docs, _ = corpus(20)
    df, none = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality.classify(df, none).collect()} == {0.5}
    assert quality.classify(df.limit(0), none).count() == 0


def test_fit_finds_shapes_and_interactions():
    rng = np.random.default_rng(18)
    x = rng.random((6000, 3))
    y = ((np.abs(x[:, 0] - 0.5) < 0.25) ^ False).astype(float)
    model = quality.fit(x, y, cycles=60, pair_cycles=5)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.93  # a shape with two edges, on 32 bins
    y = ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = quality.fit(x, y, cycles=20, pair_cycles=80)
    assert (1, 2) in model.pairs and ((model.score(x) >= 0.5) == y).mean() > 0.95
    one = x[:1]
    want = model.intercept + sum(model.tables[f][int(np.searchsorted(model.edges[f], one[0, f], "right"))] for f in range(3))
    want += sum(c[int(np.searchsorted(model.grid[f], one[0, f], "right")), int(np.searchsorted(model.grid[g], one[0, g], "right"))] for (f, g), c in model.pairs.items())
    assert math.isclose(model.logit(one)[0], want)
