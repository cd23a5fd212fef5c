import random

import pytest

from sparkvigil.llm import token_counts

SCHEMA = "doc_id bigint, text string, lang string, uid string, chunk int, n_tokens int"


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=token_counts.default_model())


def check(spark, library, rows, **how):
    docs = spark.createDataFrame([(i, t, "en", "u", 3, 4) for i, t in rows], SCHEMA).repartition(4)
    got = token_counts.count_tokens(docs, **how)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", num_threads=1)), n > how.get("limit", 4096)) for i, t in rows]
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()), key=key) == sorted(want, key=key)


def texts(rng):
    """Short and long, with few and with many places where chunks align."""
    words = ["the", "Analysis", "naïve", "日本語", "x", "1234567", "ﬁ", "é", "é", "<s>", "</s>", "▁", "\U0010fffe", "😀", "won't", "\x00", "ａ"]
    yield from [None, "", " ", "  ", "a", "<s>a</s>", "\n", "▁"]
    for n in (30, 200, 900, 5000):
        yield " ".join(rng.choices(words, k=n))
        yield "".join(rng.choices(words, k=n))
        yield "".join(rng.choices("ab", k=n))
        yield "".join(rng.choices(" \n\t\xa0", k=n))
        yield "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n))
        yield "".join(chr(rng.choice((rng.randrange(0xE000, 0xF8FF), rng.randrange(0x10000, 0x10FFFF)))) for _ in range(n))
    for unit in ("a", " ", "=", "ab", "-_", "\x00", "😀", "aaab "):
        yield unit * 3000
    yield "word " * 400 + "a" * 1500 + " and on it goes" * 100 + "=" * 997 + "end"


@pytest.mark.parametrize(("size", "overlap"), [(2, 1), (64, 8), (200, 32)])
def test_spliced_counts_equal_the_library(spark, library, size, overlap):
    rng = random.Random(size)
    found = [t for t in texts(rng) if size > 10 or len(t or "") < 400]
    check(spark, library, list(enumerate(found)), size=size, overlap=overlap, limit=100)


def test_edges(spark, library):
    long = "The quick brown fox jumps over 13 lazy dogs; naïve façade. " * 3000
    rows = [(None, None), (None, "no id"), (1, long), (1, long), (1, long[:-1]), (2, ""), (3, "x" * 16384), (4, "x" * 16385), (5, "y z" * 8192)]
    check(spark, library, rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert token_counts.count_tokens(empty).collect() == []
    with pytest.raises(ValueError):
        token_counts.count_tokens(empty, size=10, overlap=6)


def test_splicing_is_refused_where_it_isnt_proven(spark, library, monkeypatch):
    model = token_counts.PieceModel(token_counts.default_model())
    assert model.splices
    assert model.keys("ab", 0) is not None
    model._lengths = model._lengths + 1  # lengths that don't add up
    assert model.keys("ab", 0) is None


def test_where_lengths_do_not_add_up_chunks_grow_to_the_whole_text(spark, library):
    from pyspark.sql import functions as F

    text = "some words here " * 40
    chunks = spark.createDataFrame([(7, k, k, 3, k * 150, text[k * 150 : k * 150 + 200] if k < 3 else text[450:]) for k in range(4)], "uid bigint, chunk int, upto int, last int, start bigint, text string")
    apart = spark.createDataFrame([(7, 0), (7, 1), (7, 2)], "uid bigint, seam int")
    assert [(r.chunk, r.upto, r.start, r.text) for r in token_counts._joined(chunks, apart, 50).collect()] == [(0, 3, 0, text)]
    assert [(r.chunk, r.upto, r.start) for r in token_counts._joined(chunks, apart.where(F.col("seam") == 1), 50).collect()] == [(1, 2, 150)]
