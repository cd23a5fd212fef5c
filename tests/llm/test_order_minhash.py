import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from sparkvigil.llm import order_minhash as omh

SCHEMA = "doc_id bigint, text string, next string, number int"


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for at, (i, t) in enumerate(rows):
        h, after = len(t) // 2, rows[(at + 1) % len(rows)][1]
        out.append((i, len(t), hashlib.sha256((t[: len(t) - h] + after[:h]).encode()).hexdigest()))
    return out


def test_edited_texts_and_order(spark):
    rng = random.Random(7)
    rows = [(i * 7 % 101, " ".join(rng.choice("aé 😀b c dd".split(" ")) for _ in range(rng.randrange(0, 50)))) for i in range(60)]
    rows += [(None, "no id"), (500, None), (501, ""), (502, "one"), (503, "word " * 4000)]
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], SCHEMA).repartition(6)
    got = omh.against_edited(docs).collect()
    assert sorted(brute(rows), key=str) == sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str)
    by = {r.doc_id: r for r in got}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    order = sorted((i for i in by if i is not None), reverse=True) + [None]
    for a, b in zip(order, [*order[1:], order[0]], strict=True):
        if by[a].fingerprint == by[b].fingerprint:
            assert by[a].near_next == 1.0
    texts = {i: t or "" for i, t in rows}
    for i, t in texts.items():  # an odd single code point is its own edit
        if len(t) < 2:
            assert by[i].near_edited == 1.0


def test_repeated_rows_and_small_tables(spark):
    rows = [(3, "a b c d e f g h")] * 3 + [(2, "q r s t u v w x")]
    got = omh.against_edited(spark.createDataFrame([(i, t, "", 0) for i, t in rows], SCHEMA)).collect()
    assert sorted(brute(rows)) == sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got)
    assert sorted(r.near_next for r in got if r.doc_id == 3) == [0.0, 1.0, 1.0]
    one = omh.against_edited(spark.createDataFrame([(1, "ab cd ef", "", 0)], SCHEMA)).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(1, 1.0)]
    assert omh.against_edited(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_signature(text, k=3):
    """The sketch as defined, over XXH64, chained as Spark chains it over columns."""
    longs = lambda *xs: chained(*[(x & (2**64 - 1)).to_bytes(8, "little") for x in xs])

    def chained(*parts):
        h = 42
        for p in parts:
            h = xxhash.xxh64_intdigest(p, h)
        return h

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return []
    if len(words) < k:
        grams = [chained(" ".join(words).encode())]
    else:
        grams = [chained(*[w.encode() for w in words[i : i + k]]) for i in range(len(words) - k + 1)]
    before, entries = {}, []
    for place, h in enumerate(h >> 29 for h in grams):
        n = before[h] = before.get(h, -1) + 1
        entries.append((h if n == 0 else longs(h, n) >> 29, place))
    out = []
    for bucket in range(64):
        # its own, then those of the buckets after it, round and round
        least = [e for b in range(bucket, bucket + 64) for e in sorted(e for e in entries if e[0] >> 29 == b % 64)][:2]
        in_order = [h for h, _ in sorted(least, key=lambda e: e[1])]
        out.append(bucket << 57 | longs(*in_order) >> 7)
    return out


def test_signature_against_plain_python(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("a b c d e f g".split()) for _ in range(rng.randrange(0, 120))) for _ in range(30)]
    texts += [" ".join(f"w{rng.randrange(9000)}" for _ in range(500)) for _ in range(5)] + ["", "a", "a b", "x " * 4, "x " * 300, "x " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in omh.fingerprints(df).collect()}
    for i, t in enumerate(texts):
        assert got[i].signature == brute_signature(t), t[:50]
    # how often a k-mer occurs counts, and the order of k-mers does
    assert len({got[i].fingerprint for i in range(len(texts) - 3, len(texts))}) == 3


def test_order_of_kmers_counts(spark):
    parts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdefgh"]
    df = spark.createDataFrame([(0, " ".join(parts)), (1, " ".join(parts[::-1]))], "doc_id bigint, text string")
    a, b = (r.signature for r in omh.fingerprints(df).orderBy("doc_id").collect())
    # nearly the same set of k-mers in another order: buckets keep their k-mers but many tuples differ
    assert [x >> 57 for x in a] == [x >> 57 for x in b] and len(set(a) & set(b)) < 0.6 * len(a)


def test_order_counts_in_short_texts_too(spark):
    rng, rows = random.Random(10), []
    for n in (16, 24, 40, 120, 400):
        for _ in range(60):
            w = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            rows.append((n, " ".join(w), " ".join(w[n // 2 :] + w[: n // 2])))
    df = spark.createDataFrame(rows, "n int, a string, b string")
    mean = {r.n: r.x for r in df.select("n", omh.likeness(omh.signature(F.col("a")), omh.signature(F.col("b"))).alias("x")).groupBy("n").agg(F.avg("x").alias("x")).collect()}
    # never nearer than half; below that as far as the k-mers at the seams, which are others, weigh
    assert all(x < 0.54 for x in mean.values()), mean
    assert mean[400] > 0.44 and mean[120] > 0.40 and mean[40] > 0.32 and mean[16] > 0.15, mean


def test_closer_edits_are_likelier(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(600)]
    swapped = list(base)
    swapped[100:110] = ["edit"] * 10
    shuffled = base[300:] + base[:300]
    rng.shuffle(shuffled)
    df = spark.createDataFrame([(0, " ".join(base)), (1, " ".join(swapped)), (2, " ".join(shuffled))], "doc_id bigint, text string")
    sig = omh.fingerprints(df)
    a = sig.where("doc_id = 0").select(F.col("signature").alias("a"))
    near = {r.doc_id: r.x for r in sig.crossJoin(a).select("doc_id", omh.likeness(F.col("signature"), F.col("a")).alias("x")).collect()}
    assert near[0] == 1.0 and near[1] > 0.8 and near[2] < 0.1
