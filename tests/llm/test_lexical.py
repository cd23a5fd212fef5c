import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sparkvigil.llm import lexical

DOCS = "doc_id bigint, text string, lang string, rank int, score string, item bigint, uid string"
ITEMS = "item_id bigint, text string, doc_id string, terms int"
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return re.findall(lexical.TERM, (text or "").translate(LOWER))


def brute(docs, items, k=10):
    """{item row: [(doc_id, score)]}, every document scored."""
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    held = [h for h in held if h[2]]
    n_docs, length = len(held), sum(h[2] for h in held)
    df = Counter(w for _, c, _ in held for w in c)
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * v + 1))) for w, v in df.items()}
    out = []
    for item, text in items:
        found = []
        for i, c, n in held:
            m = 10 + (90 * n * n_docs) // length
            s = sum(weight[w] * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(terms(text)) if c[w])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def got(spark, docs, items, **how):
    found = lexical.search(
        spark.createDataFrame([(i, t, "en", 1, "s", 2, "u") for i, t in docs], DOCS).repartition(5),
        spark.createDataFrame([(i, t, "d", 3) for i, t in items], ITEMS).repartition(3), **how)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(13)
    words = [f"w{i}" for i in range(60)] + ["Über", "über", "ÀB", "naïve", "x\x80y", "日本語", "A1", "a1", "ab\x00cd"]
    weights = [1 / (1 + i) for i in range(len(words))]
    docs = [(i, rng.choice([" ", ", ", "\n", "--"]).join(rng.choices(words, weights, k=rng.choice([0, 1, 5, 40, 300])))) for i in range(400)]
    docs += [(1000 + i, "w3 w4 w5 w50 copy of one text") for i in range(120)]  # ties beyond k
    docs += [(None, None), (None, "w3 w4 w5 w50 copy of one text"), (None, "only nullid"), (7, "w1 repeated id"), (7, "w1 repeated id"), (5000, ""), (5001, "., ;"), (5002, "longest " + "w7 w8 " * 30_000)]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 12])))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "not met anywhere"), (93, "OVER über; a1 A1 ab CD"), (94, "w3 w4 w5 w50 copy of one text"), (95, "nullid repeated"), (None, "w9 w10")]
    return docs, items


@pytest.mark.parametrize("how", [{}, {"shard_postings": 300}, {"shard_postings": 900, "block_bytes": 200}])
def test_search_matches_brute_force(spark, made, how):
    assert got(spark, *made, **how) == brute(*made)


def test_rows_that_repeat_and_other_k(spark):
    docs = [(1, "a b"), (1, "a b"), (2, "a"), (3, "c c c")] + [(i, "filler") for i in range(10, 20)]
    items = [(5, "a b c"), (6, "c")]
    assert got(spark, docs, items, k=2) == brute(docs, items, 2)
    twice = got(spark, docs, [(5, "a"), (5, "c")])
    assert [r[:2] for r in twice] == [(5, 1), (5, 1), (5, 2), (5, 3)]
    assert got(spark, [], items) == got(spark, docs, []) == got(spark, [(1, ""), (2, None)], items) == []
    assert got(spark, [(1, "a")], [(1, "a")]) == brute([(1, "a")], [(1, "a")])


def test_sql_agrees(spark, made):
    import duckdb
    import pandas as pd

    docs, items = ([(i, t) for i, t in x if i is not None and "\x00" not in (t or "")] for x in made)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    assert sorted(con.execute(lexical.ORACLE).fetchall(), key=str) == brute(docs, items)


def test_treaps_are_search_trees_and_heaps():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 8 * 500, 1500))
    term, doc, impact = keys // 500, keys % 500, rng.integers(1, 6, len(keys))
    trees = lexical.Treaps(term, doc, impact, 9)
    none = len(keys)

    def walk(node, low, high, most):
        if node == none:
            return []
        assert low <= trees.doc[node] < high
        assert trees.impact[node] <= most
        d, i = int(trees.doc[node]), trees.impact[node]
        return [*walk(trees.left[node], low, d, i), int(node), *walk(trees.right[node], d + 1, high, i)]

    assert trees.roots[8] == none
    for t in range(8):
        assert walk(trees.roots[t], 0, 500, 10) == np.flatnonzero(term == t).tolist()
    for low, high in ((0, 500), (100, 101), (37, 220)):
        for t in range(8):
            node = trees.within(np.array([[trees.roots[t]]]), np.array([low]), np.array([high]))[0, 0]
            there = (term == t) & (doc >= low) & (doc < high)
            assert (trees.impact[node] == impact[there].max() and there[node]) if there.any() else node == none
