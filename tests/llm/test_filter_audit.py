import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from sparkvigil.llm import filter_audit

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, quality int, mask string, cells int"
LABELS = "doc_id bigint, quality int, toxic int"
LAST = 1 << 63


def brute(rows, labels):
    """{(part, order, step): counts}, each document run through each order."""
    good, toxic = ({i for i, *v in labels if v[at] == 1 and i is not None} for at in (0, 1))
    ids = {}
    for i, text, _ in rows:
        ids.setdefault(text or "", set()).add(LAST if i is None else i)
    fails = []
    for i, text, part in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        marks = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": (LAST if i is None else i) > min(ids[t])}
        fails.append((part or "", {k for k, v in marks.items() if v}, i in good, i in toxic))
    out, shapley = {}, {}
    for part in {p for p, *_ in fails}:
        own = [f for f in fails if f[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for at, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                out[part, "".join(order), at + 1] = [len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def documents(spark, rows):
    return spark.createDataFrame([(i, t, p, None, 0, 9, "m", 1) for i, t, p in rows], SCHEMA).repartition(5)


def found(spark, rows, labels):
    got = filter_audit.audit(documents(spark, rows), spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    out = {tuple(r[:3]): list(r[3:]) for r in got.collect()}
    assert len(out) == got.count()
    return out


@pytest.fixture(scope="module")
def made():
    rng = random.Random(11)
    texts = [None, "", " \n", "ONE", "a#b", "x" * 200_000, "É" * 9 + "A", "É" * 10 + "A", "a\x0bb\x1cc A", "😀 😀 " * 60]
    for n in (99, 100, 101, 400):
        for share in (79, 80, 81, 100):
            kinds = max(1, n * share // 100)
            texts.append(" ".join(f"w{i % kinds}" for i in range(n)) + rng.choice(["", " A#", " " + "Q" * 300, "\t"]))
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, "", "hot", "hot"])) for i in range(300)]
    rows += [(None, "", "en"), (None, "only here", "en"), (None, "only here", "en"), (5, "same id and text", "x"), (5, "same id and text", "x"), (5, "other text", "x"), (-3, rows[0][1], "en")]
    rows += [(1000 + i, "a copy " * 120, "hot") for i in range(200)]
    rng.shuffle(rows)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 1100, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (99999, 1, 1)]
    return rows, labels


def test_every_order_as_documents_run_through_it(spark, made):
    rows, labels = made
    got = found(spark, rows, labels)
    assert got == brute(rows, labels)
    assert len(got) == 600 * len({p or "" for _, _, p in rows})


def test_sql_agrees(spark, made):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(made[0], columns=["doc_id", "text", "lang"]).astype({"doc_id": "Int64"}))
    con.register("labels", pd.DataFrame(made[1], columns=["doc_id", "quality", "toxic"]).astype("Int64"))
    assert {tuple(r[:3]): list(r[3:]) for r in con.execute(filter_audit.ORACLE).fetchall()} == brute(*made)


def test_empty_tables(spark):
    assert found(spark, [], [(1, 1, 1)]) == {}
    rows = [(1, "a", "p"), (2, "a", "q")]
    assert found(spark, rows, []) == brute(rows, [])


def test_other_filters(spark):
    rows = [(i, t, "p") for i, t in enumerate(["", "a", "ab", "b", None, "ab"])]
    filters = {"x": F.col("text").contains("a"), "y": F.length("text") > 1}
    docs, labels = documents(spark, rows), spark.createDataFrame([(2, 1, 0)], LABELS)
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley) for r in filter_audit.audit(docs, labels, filters).collect()}
    assert got == {("xy", 1): (3, 3, 0, 1, 1, 4), ("xy", 2): (3, 0, 2, 0, 0, 2), ("yx", 1): (4, 2, 0, 0, 1, 2), ("yx", 2): (3, 1, 2, 1, 0, 4)}
    with pytest.raises(ValueError):
        filter_audit.audit(docs, labels, {})
