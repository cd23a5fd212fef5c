import hashlib
import random
import re

from sparkvigil.llm import line_dedup

SCHEMA = "doc_id bigint, text string, line int, key string, n_chars bigint"


def brute(rows):
    texts, seen = {}, {}
    for i, t in rows:
        texts[t or ""] = min(texts.get(t or "", 1 << 70), 1 << 69 if i is None else i)
    keyed = {}
    for t, doc in texts.items():
        for no, line in enumerate(t.split("\n")):
            w = ["<*>" if re.search("[0-9]", x) else x for x in re.findall(r"[^\x20\x09-\x0D]+", line)]
            n = len(w)
            if n < 4 or 2 * sum(x != "<*>" for x in w) < n:
                continue
            keys = [(0, tuple(w))]
            if n >= 8:
                keys += [(g + 1, (*w[: 4 + (n - 4) * g // 3], None, *w[4 + (n - 4) * (g + 1) // 3 :], n)) for g in range(3)]
            keyed[t, no] = keys
            for k in keys:
                seen.setdefault(k, {})[t] = doc
    drops = {}
    for (t, no), keys in keyed.items():
        for k in keys:
            if len(seen[k]) >= (3 if k[0] else 2) and min(seen[k], key=seen[k].get) != t:
                drops.setdefault(t, set()).add(no)
    return [(i, sorted(drops.get(t or "", ()))) for i, t in rows]


def rows(seed=14):
    rng, out = random.Random(seed), []
    lines = ["the same passage stands here again and again", "short one", "user alice logged in from the main office today", "user bob logged in from the main office today", "user eve logged in from the main office today", "at 12:30 job 7 ended well", "at 09:10 job 9 ended well", "1 2 3 4 5 6", "", " ", "Licensed under the MIT License."]
    for i in range(60):
        own = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 14))) for _ in range(rng.randrange(0, 6))]
        out.append((i, "\n".join(rng.sample(own + rng.sample(lines, rng.randrange(0, 5)), k=None or len(own)) if own else lines[:2])))
    base = "\n".join(lines)
    out += [(100 + i, base) for i in range(5)] + [(200, base + "\nwith one more line at the end"), (None, None), (300, ""), (301, "\n".join(f"line number {i} of a long one" for i in range(3000)))]
    return out


def test_report_matches_brute_force_and_texts_follow(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, 0, "k", len(t or "")) for i, t in data], SCHEMA).repartition(6)
    got = {r.doc_id: r for r in line_dedup.report(docs).collect()}
    want = dict(brute(data))
    assert len(got) == len(want) == len(data)
    texts = dict(data)
    left = {}
    for i, drops in want.items():
        lines = (texts[i] or "").split("\n")
        kept = "\n".join(x for n, x in enumerate(lines) if n not in drops)
        assert got[i].dropped == ",".join(map(str, drops)), (i, texts[i])
        assert (got[i].n_lines, got[i].n_dropped) == (len(lines), len(drops))
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        if not drops or kept.split():
            left[i] = kept if drops else texts[i]
    out = line_dedup.without_repeated_lines(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == left
    assert all(r.n_chars == len(r.text or "") for r in out.collect())


def test_every_recurring_line_stays_somewhere_and_copies_agree(spark):
    text = "one passage that is long enough\nand another line of its own here"
    docs = spark.createDataFrame([(i, text, 0, "", 0) for i in range(3)] + [(9, text + "\nplus one line of tail text", 0, "", 0)], SCHEMA)
    assert {r.doc_id: r.text for r in line_dedup.without_repeated_lines(docs).collect()} == {0: text, 1: text, 2: text, 9: "plus one line of tail text"}
    assert line_dedup.report(docs.limit(0)).count() == 0


def test_oracle_agrees(spark, tmp_path):
    import duckdb
    import pandas as pd

    data = [r for r in rows(15) if r[0] is not None]
    documents = pd.DataFrame(data, columns=["doc_id", "text"])
    con = duckdb.connect()
    con.register("documents", documents)
    sql = sorted(con.execute(line_dedup.ORACLE).fetchall())
    docs = spark.createDataFrame([(i, t, 0, "", 0) for i, t in data], SCHEMA)
    assert sql == sorted(tuple(r) for r in line_dedup.report(docs).collect())
