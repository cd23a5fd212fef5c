import random
import zlib

from sparkvigil.llm import toxicity

SCHEMA = "doc_id bigint, text string, score string, y int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_matches_edit_distance():
    rng = random.Random(19)
    terms = ["idiot", "moron", "scum", "vequ*", "lowei*", "stupid*", "abc", "worthless"]
    automaton = toxicity.LexiconAutomaton(terms)
    words = [t.rstrip("*") for t in terms]
    for _ in range(6000):
        w = list(rng.choice(words) + rng.choice(["", "", "xyz", "s"]))
        for _ in range(rng.randrange(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.choice([0, 1])] = rng.choice(["", "a", "e", "x", "o"])
        token = "".join(w)
        best = {}
        for t in terms:
            plain = t.rstrip("*")
            d = min(distance(token[:k], plain) for k in range(len(token) + 1)) if t.endswith("*") else distance(token, plain)
            if d == 0 or d == 1 and len(plain) >= 5:
                best[t] = d
        want = (min(best, key=lambda t: (best[t], -len(t), t))) if best else None
        assert automaton.match(token) == ((want, best[want]) if want else None), token


def corpus(n=1500, seed=20):
    rng, docs, labels = random.Random(seed), [], []
    filler = [f"{a}{b}" for a in "the of and reon ing ha tion".split() for b in "st er ly es an ou".split()]
    insults = ["idiot", "moron", "scumbag", "worthless"]
    for i in range(n):
        words = [rng.choice(filler) for _ in range(rng.randrange(5, 60))]
        kind = rng.random()
        if kind < 0.15:
            for _ in range(rng.randrange(1, 3)):
                w = rng.choice(insults) if rng.random() < 0.6 else "grumbl" + rng.choice(filler)
                words.insert(rng.randrange(len(words)), w)
        elif kind < 0.25:  # quoted, and not toxic
            words.insert(rng.randrange(len(words)), 'reported "' + rng.choice(insults) + '" yesterday')
        docs.append((i, " ".join(words), "s", 0))
        labels.append((i, 1, int(kind < 0.15)))
    return docs, labels


def test_held_out_accuracy_quotation_and_misspelling(spark):
    docs, labels = corpus()
    extra = [(9000, None, "", 0), (9001, "", "", 0), (None, "idiot moron", "", 0), (9002, "the worthles idi0t", "", 0), (9003, 'they reported "idiot" yesterday', "", 0), (9004, "word " * 30000, "", 0)]
    df = spark.createDataFrame(docs + extra, SCHEMA).repartition(4)
    known = spark.createDataFrame(labels + [(None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = toxicity.classify(df, known).collect()
    assert len(got) == len(docs) + len(extra)
    truth = {i: t for i, _, t in labels}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in out) / len(out) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[9002].predicted == 1 and by[9003].predicted == 0 and by[9000].predicted == 0


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame(corpus(10)[0], SCHEMA)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in toxicity.classify(df, none).collect()} == {0.5}
    assert toxicity.classify(df.limit(0), none).count() == 0
