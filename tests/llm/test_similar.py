import random

from sparkvigil.llm import simhash


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_one_of_each_group_of_similarity_08_stays(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 400))]
        rows.append(" ".join(base))
        for _ in range(rng.randrange(0, 8)):
            t = list(base)
            for at in rng.sample(range(len(t)), rng.randrange(0, 1 + len(t) // 25)):
                t[at] = "changed"
            rows.append(" ".join(t))
    rng.shuffle(rows)
    sets = [shingles(t) for t in rows]
    near = {(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    far = sum((simhash.simhash64(rows[i]) ^ simhash.simhash64(rows[j])).bit_count() > 4 for i, j in near)
    assert far > 20  # 4 bits of one fingerprint don't find these
    comp = list(range(len(rows)))
    while any(comp[i] != comp[j] for i, j in near):
        for i, j in near:
            comp[i] = comp[j] = min(comp[i], comp[j])
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(5)
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(comp)


def brute_groups(texts, similar=0.8):
    """The group of each text, by all pairs of different sets."""
    sets = [frozenset(shingles(t or "")) if (t or "").split() else frozenset() for t in texts]
    different = list(dict.fromkeys(sets))
    comp = {x: i for i, x in enumerate(different)}
    near = [(x, y) for i, x in enumerate(different) for y in different[:i] if x and y and len(x & y) / len(x | y) >= similar]
    while any(comp[x] != comp[y] for x, y in near):
        for x, y in near:
            comp[x] = comp[y] = min(comp[x], comp[y])
    return [comp[x] for x in sets]


def stays(rows, similar=0.8):
    """How many rows of each least id stay, one a group."""
    groups = {}
    for (i, _), g in zip(rows, brute_groups([t for _, t in rows], similar), strict=True):
        groups.setdefault(g, []).append((i is None, i or 0))
    return sorted(min(ids) for ids in groups.values())


SCHEMA = "doc_id bigint, text string, root string, node int, set_hash string"


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "r", 1, "s") for i, t in rows], SCHEMA).repartition(3)
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    return [(r.doc_id, r.text) for r in out.collect()]


def test_rows_of_repeated_and_null_ids_go_with_their_own_group(spark):
    text, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, text), (5, other), (5, text + " more")]
    assert sorted(kept(spark, rows)) == [(3, text), (5, other)]
    rows = [(None, text), (None, text + " more"), (None, other), (7, other), (None, None), (None, ""), (2, " ")]
    got = kept(spark, rows)
    assert sorted((i is None, i or 0) for i, _ in got) == stays(rows) == [(False, 2), (False, 7), (True, 0)]
    assert kept(spark, []) == []
    # the id of one group's first row is also a row of another group, which has a smaller id
    rows = [(1, other), (4, text), (4, other + " more"), (9, text + " end")]
    assert sorted(kept(spark, rows)) == [(1, other), (4, text)]


def test_a_hot_group_of_near_copies_and_copies(spark):
    rng = random.Random(8)
    centre = [f"c{i}" for i in range(80)]
    rows = []
    for i in range(260):  # near copies on either side of 0.8 to each other, and copies
        t = list(centre)
        for at in rng.sample(range(80), rng.randrange(0, 7)):
            t[at] = rng.choice(["x", "y", f"n{i}"])
        rows.append((rng.choice([i, i, None]), " ".join(t)))
    rows += [(1000 + i, " ".join(centre)) for i in range(150)] + [(5000 + i, f"text {i} of its own " * 3) for i in range(30)] + [(6000, "word " * 60_000)]
    rng.shuffle(rows)
    got = kept(spark, rows)
    assert sorted((i is None, i or 0) for i, _ in got) == stays(rows)
    found = simhash.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string"))
    groups = brute_groups([t for _, t in rows])
    least = {}
    for (i, _), g in zip(rows, groups, strict=True):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    key = lambda r: str(tuple(r))
    assert sorted(found.collect(), key=key) == sorted([(i, least[g]) for (i, _), g in zip(rows, groups, strict=True)], key=key)


def test_rare_shingles_find_every_similar_pair(spark):
    rng = random.Random(6)
    centre = list(range(1000, 1100))
    sets, fresh = {}, iter(range(10**6, 10**7))
    for node in range(120):
        drop, add = rng.randrange(0, 30), rng.randrange(0, 30)
        sets[node] = rng.sample(centre, 100 - drop) + [next(fresh) for _ in range(add)]
    roots = {node: node // 2 * 2 for node in range(40)}  # some are linked already
    rows = spark.createDataFrame([(k, v) for k, v in sets.items()], "node bigint, items array<bigint>").repartition(3)
    linked = spark.createDataFrame(list(roots.items()), "node bigint, root bigint")
    prefixes = simhash._rooted(simhash._prefixes(rows, 0.8), linked)
    found = {(r.a, r.b) for r in simhash._unlinked(prefixes, 0.8).collect()}
    near = set()
    for a in sets:
        for b in range(a):
            shared = len(set(sets[a]) & set(sets[b]))
            if shared / (len(sets[a]) + len(sets[b]) - shared) >= 0.8 and roots.get(a, a) != roots.get(b, b):
                near.add((a, b))
    assert near and near <= found
    assert len(found) < 120 * 119 / 4
    central = {(r.a, r.b) for r in simhash._central(prefixes, 0.8).collect()}
    assert central and central <= {(a, b) for a in sets for b in range(a)}


def test_fingerprints_within_four_bits_give_candidates(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(8):
        base = [rng.choice(words) for _ in range(700)]
        texts += [" ".join(base), " ".join([*base, "tail"]), " ".join([*base[:300], "changed", *base[301:]])]
    prints = [simhash.simhash64(t, 5) for t in texts]
    close = {(j, i) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4}
    assert len(close) > 4
    # without any band, what the fingerprints link is still one group
    monkeypatch.setattr(simhash, "band_keys", lambda h: [])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in simhash.similar_components(docs).collect()}
    assert all(found[a] == found[b] for a, b in close)
    assert len(set(found.values())) < len(texts)
