import random

from pyspark.sql import functions as F

from sparkvigil.llm import mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tie string, sid map<string,int>"


def rows(seed=12):
    rng, out = random.Random(seed), []
    for i in range(900):
        source = "hot" if i % 3 == 0 else rng.choice(["b", "c", "é", "A", None])
        out.append((i, " ".join(rng.choice("abc") for _ in range(rng.choice([1, 3, 40, 200])))) + ("xx", source))
    out += [(2000, "w " * 9000, "xx", "tiny"), (2001, None, "xx", "b"), (2002, "", "xx", "empty"), (3, "same row", None, "c"), (3, "same row", None, "c"), (None, "no id", None, None)]
    return [(i, t, la, s, len(t or ""), "t", {"a": 1}) for i, t, la, s in out]


def brute_targets(sizes, limit=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, total, free = {}, sum(sizes.values()), set(names)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > limit * sizes[s]}
        if not above:
            return target | {s: level * weight[s] for s in free}
        target |= {s: limit * sizes[s] for s in above}
        free -= above
    return target


def test_targets_and_taken(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = mixing.taken(docs, block=16).collect()
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((r[0] or -1, len((r[1] or "").split())) for r in data)
    sizes, took = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        took[r.source] = took.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    for s in sizes:
        assert abs(took[s] - want[s]) <= 16 + 0.002 * want[s], (s, took[s], want[s])
    again = mixing.taken(spark.createDataFrame(data[::-1], SCHEMA).repartition(2), block=16).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixed_documents_hold_what_is_taken(spark):
    data = rows(13)
    docs = spark.createDataFrame(data, SCHEMA)
    took = {}
    for r in mixing.taken(docs, block=16).collect():
        took[r.source] = took.get(r.source, 0) + r.taken
    out = mixing.mixed(docs, block=16)
    assert out.columns == docs.columns
    words, texts = {}, {}
    for r in data:
        texts.setdefault(r[0], []).append((r[1] or "").split())
    for r in out.collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
        assert len(r.text.split()) <= max(map(len, texts[r.doc_id]))
    assert words == {s: n for s, n in took.items() if n}


def test_permutation_and_shards(spark):
    for n in (1, 2, 7, 100, 1000):
        xs = [r.x for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(5), F.lit(0)).alias("x")).collect()]
        assert sorted(xs) == list(range(n))
    assert xs[:10] != list(range(10))


def test_empty_and_wordless_tables(spark):
    assert mixing.taken(spark.createDataFrame([], SCHEMA)).count() == 0
    none = spark.createDataFrame([(1, None, "", None, 0, "", None), (2, " ", "", "a", 1, "", None)], SCHEMA)
    assert [(r.size, r.taken, r.target) for r in mixing.taken(none).collect()] == [(0, 0, 0.0)] * 2
    assert mixing.mixed(none).count() == 0
