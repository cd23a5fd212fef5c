import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from sparkvigil.llm import packing

SCHEMA = "doc_id bigint, text string, uid string, part int"


def test_ids_equal_the_tokenizers_own():
    rng = random.Random(4)
    own = Tokenizer.from_file(packing.default_tokenizer())
    odd = ["the", "The,", "été", "é", "́x", "ΣΑΣ", "İ", "it's", "IT'S", "<|endoftext|>", "a<|startoftext|>b", "12345", "\x1c", "\x85", "\xa0", " ", "　", "ß", "日本語", "😀", "x" * 200, "a.b@c-d", "...!!", "ﬁ", "​"]
    texts = ["", " ", "\n\t"] + ["".join(rng.choice(odd) + rng.choice(["", " ", "\n", "\r\n", "\x0b\x0c", "  "]) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    got = packing.WordTokenizer(packing.default_tokenizer()).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode(text, add_special_tokens=False).ids, text


def test_bound_and_best_fit():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 50, 2000):
        lengths = rng.integers(1, 101, n)
        bins, offsets = packing.best_fit_decreasing(lengths, 100)
        fill = np.zeros(int(bins.max()) + 1 if n else 0, int)
        for i in np.lexsort((offsets, bins)):
            assert offsets[i] == fill[bins[i]]
            fill[bins[i]] += lengths[i]
        assert (fill <= 100).all()
        assert packing.lower_bound(lengths, 100) <= len(fill) <= packing.lower_bound(lengths, 100) * 1.1 + 1
    assert packing.lower_bound(np.array([51] * 7), 100) == 7
    assert packing.lower_bound(np.array([34] * 6), 100) == 3


def check(rows, got, length):
    own = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for doc, text in rows:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), length)):
            p = ids[s : s + length]
            want.append((doc, k, s, len(p), zlib.crc32(np.array(p, "<u4").tobytes())))
    assert sorted(want, key=str) == sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str)
    at: dict[int, int] = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert all(v <= length for v in at.values())
    return len(at), -(-sum(at.values()) // length)


def test_packing_round_trip(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "Gamma,", "x1"]) for _ in range(rng.choice([1, 5, 20, 90])))) for i in range(300)]
    rows += [(5, "again"), (5, "again"), (None, "no id"), (900, None), (901, ""), (902, "long " * 3000)]
    docs = spark.createDataFrame([(i, t, "u", 1) for i, t in rows], SCHEMA).repartition(5)
    used, least = check(rows, packing.pack_documents(docs, length=64).collect(), 64)
    assert used <= least * 1.02 + 1
    # small parts that must exchange documents
    used, least = check(rows, packing.pack(packing.pieces(docs, length=64), 64, per_part=16).collect(), 64)
    assert used <= least * 1.05 + 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_ids_are_returned_when_asked(spark):
    docs = spark.createDataFrame([(1, "one two three", "", 0)], SCHEMA)
    row = packing.pieces(docs, length=2, with_ids=True).orderBy("piece").collect()
    own = Tokenizer.from_file(packing.default_tokenizer()).encode("one two three", add_special_tokens=False).ids
    assert [i for r in row for i in r.ids] == [*own, 1]


def test_tokenizers_that_see_case_or_spaces_get_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, tokenizer = Tokenizer.from_file(path), packing.WordTokenizer(path)
    assert not tokenizer.by_runs and packing.WordTokenizer(packing.default_tokenizer()).by_runs
    texts = ["", "The cat THE CAT", "  two  spaces\n\nlines ", "été 😀"]
    for text, ids in zip(texts, tokenizer.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


def test_what_is_remembered_is_bounded():
    tokenizer = packing.WordTokenizer(packing.default_tokenizer())
    tokenizer.KEPT = 50
    own = Tokenizer.from_file(packing.default_tokenizer())
    letters = "abcdefghij"
    for k in range(30):
        texts = [f"common {letters[k % 10]}word{letters[j % 10]}{letters[j // 10]}{letters[k // 10]}" for j in range(60)]
        for text, ids in zip(texts, tokenizer.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == own.encode(text, add_special_tokens=False).ids
        assert len(tokenizer._known) <= 50
