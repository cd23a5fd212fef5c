import random

import pytest

import corpus_pipeline
from sparkvigil.llm import packing
from tests.llm.test_line_dedup import brute as repeated
from tests.llm.test_quality import corpus
from tests.llm.test_similar import brute_groups, stays

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs, labels = corpus(300)
    rng = random.Random(24)
    rows = [(i, t, "en", rng.choice(["a", "b", None])) for i, t, *_ in docs]
    long = " ".join(rng.choice("alpha beta gamma delta report city".split()) for _ in range(300))
    rows += [(1000 + i, long, "en", "a") for i in range(4)] + [(1100, long + " tail", "en", "a"), (1200, None, None, None), (1201, "", "en", "b"), (1202, "good words\nthe shared line of this corpus", "en", "b"), (1203, "other words here\nthe shared line of this corpus", "en", "b"), (5, rows[5][1], "en", rows[5][3])]
    spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s in rows], SCHEMA).write.parquet(path + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(path + "/labels.parquet")
    return path


def test_each_stage_on_what_the_one_before_kept(spark, sf_dir):
    docs = spark.read.parquet(sf_dir + "/documents.parquet")
    outs = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, sf_dir), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        outs.append([(r.doc_id, r.text) for r in docs.collect()])
    good, lined, single, mix = outs
    truth = {i: q for i, q, _ in corpus(300)[1]}
    kept = {i for i, _ in good}
    assert sum((i in kept) == bool(q) for i, q in truth.items()) > 0.97 * len(truth)
    drops, left = repeated(good), []
    for (_, gone), (i, t) in zip(drops, good, strict=True):
        text = "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone)
        if not gone:
            left.append((i, t))
        elif text.split():
            left.append((i, text))
    assert sorted(map(str, lined)) == sorted(map(str, left))
    # the stage's own rule, by all pairs: word 5-shingles, Jaccard 0.8
    groups = brute_groups([t for _, t in lined])
    assert sorted((i is None, i or 0) for i, _ in single) == stays(lined)
    of = dict(zip(lined, groups, strict=True))
    assert sorted({of[r] for r in single}) == sorted(of[r] for r in single) == sorted(set(groups))
    words = {}
    for i, t in single:
        words.setdefault(i, []).extend((t or "").split())
    for i, t in mix:
        assert t.split() and set(t.split()) <= set(words[i])


def test_run_packs_the_mix(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    at = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert got and max(at.values()) <= 4096
    assert len(at) <= packing.lower_bound(__import__("numpy").array([r.length for r in got]), 4096) + 1
    again = corpus_pipeline.run(spark, sf_dir).collect()
    key = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(got) == key(again)


def test_extra_columns_keep_their_names_and_values(spark, sf_dir):
    names = ["_score", "_hash", "_of", "_drops", "_left", "_keep", "_n", "_tie", "_key", "_copy", "_ranges", "ranges", "hash"]
    docs = spark.read.parquet(sf_dir + "/documents.parquet").where("doc_id < 60")
    for n in names:
        docs = docs.withColumn(n, corpus_pipeline.mixing.F.lit("own"))
    want = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, sf_dir), name)
        assert docs.columns == want
        assert {tuple(r[n] for n in names) for r in docs.collect()} == {("own",) * len(names)}, name


@pytest.mark.parametrize("case", ["no documents", "no labels", "one class"])
def test_tables_with_little_in_them(spark, sf_dir, tmp_path, case):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.where("false") if case == "no documents" else docs.where("doc_id < 80 or doc_id is null")
    labels = labels.where("false" if case == "no labels" else "quality = 1" if case == "one class" else "true")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(got) == (case != "no documents")
    if case == "one class":  # nothing tells bad from good: no document is rejected
        kept = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
        assert kept.count() == docs.count()
