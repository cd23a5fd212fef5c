import random
import re

import pytest
import xxhash

from sparkvigil.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(rows, most):
    fps = {i: f for i, f in rows}
    comp = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= most and comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
    return comp


TEXTS = [None, "", " \t\n", "One", "one", "a b c d", "A  b\nc\x0bd", "a b c d e", "ÄÖ ß é\x85x y\x1cz w v", "x " * 5000]


def test_fingerprint_matches_the_definition():
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("ab bc Cd dé".split()) for _ in range(n)) for n in range(1, 40)]
    for t in texts:
        assert simhash.simhash64(t) == brute_fingerprint(t), t


def test_components_match_brute_force_with_copies_and_hot_groups(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(300)]
    rows = []
    for i in range(120):  # one large group of near copies
        t = list(base)
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(len(t))] = "changed"
        rows.append(" ".join(t))
    rows += [" ".join(base)] * 30 + TEXTS
    rows += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    rows = [(1000 - i, t, "extra") for i, t in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string").repartition(7)
    got = simhash.components(docs).collect()
    fps = {r.doc_id: r.fp & (2**64 - 1) for r in got}
    assert fps == {i: brute_fingerprint(t) for i, t, _ in rows}
    assert {r.doc_id: r.component_id for r in got} == brute_components(list(fps.items()), 4)


def test_random_fingerprints_link_exactly(spark):
    rng = random.Random(3)
    fps = {0, -1}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 70])):
            y = x
            for b in rng.sample(range(64), rng.randrange(0, 7)):
                y ^= 1 << b
            fps.add(y - (1 << 64) if y >> 63 else y)
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    roots = {r.node: r.root for r in simhash.connected_components(simhash.near_links(df, 4, bucket=8)).collect()}
    want = brute_components([(f, f) for f in fps], 4)
    assert {f: roots.get(f, f) for f in fps} == want


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id bigint, text string, lang string"
    assert simhash.components(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "q r s t u", None), (7, None, None), (8, "", None)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.components(docs).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, None), (7, 7), (8, 7)], key=str)
    assert sorted(r.text or "" for r in simhash.keep_one(docs).collect()) == ["", "a b c d e f", "q r s t u"]


def test_blocks_reach_every_pair():
    for blocks in (6, 7, 8):
        masks = simhash.block_masks(blocks, blocks - 4)
        rng = random.Random(blocks)
        for _ in range(200):
            flip = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(flip & m & (2**64 - 1) == 0 for m in masks)
    with pytest.raises(ValueError):
        simhash.near_links(None, 3)
