import hashlib
import math
import random
import re

from sparkvigil.llm import pii

SCHEMA = "doc_id bigint, text string, term string, hash int"
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    ok = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d),
        "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, r in RULES.items() for m in re.finditer(r, text or "") if ok[k](m[0])]


def texts():
    rng = random.Random(10)
    parts = ["a@b.co", "x..y@z.w..v@u.t", "é", "😀", "@", ".", "..", "-", " ", "  ", "+", "(", ")", "_", "%", "1", "42", "0255", "256", "1.2.3.4", "4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "+1 (555) 123-4567", "+49", "word", "A.b", "\n", "a@b", "c.d"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(900)]
    return out + [None, "", "a" * 60000, "a." * 30000 + "@", "x@" + "a." * 20000 + "b", "1 2" * 20000, "1-" * 30000 + "1", "+" + "1 " * 20000 + "(", "1." * 20000]


def test_base_spans_match_the_definition(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], SCHEMA).repartition(8)
    got = {r.doc_id: r for r in pii.digest(pii.find(docs)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = brute(t)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in RULES], t
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t
        assert r.spans == joined or r.spans.startswith(joined)


def test_disclosing_terms(spark):
    rng = random.Random(11)
    filler = [f"common{i}" for i in range(30)]
    rows = []
    for i in range(200):
        words = [rng.choice(filler) for _ in range(12)]
        if i < 4:
            words[5:5] = ["Zaphodia", "writes", "zb@heart.example"]
        elif i < 8:
            words[5:5] = [f"unique{i}", "writes", f"p{i}@heart.example"]
        elif i < 60:
            words[5:5] = ["writes"]
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, "copied rareword once q@r.example") for i in range(20)]
    rows.append((2000, "ZAPHODIA alone"))
    docs = spark.createDataFrame([(i, t, "", 0) for i, t in rows], SCHEMA)
    assert [r.term for r in pii.disclosing_terms(docs).collect()] == ["zaphodia"]
    found = pii.find(docs)
    got = {r.doc_id: r for r in pii.digest(found).collect()}
    assert got[2000].spans == "term:0:8" and got[1003].spans == "email:21:32"
    clean = {r.doc_id: r.text for r in pii.sanitised(found).collect()}
    assert clean[2000] == " alone" and clean[1003] == "copied rareword once [EMAIL]"
    assert "Zaphodia" not in clean[1] and "zb@" not in clean[1] and " writes [EMAIL] " in clean[1]
    assert pii.digest(pii.find(docs.limit(0))).count() == 0


def brute_terms(rows, around=120, bits=3.0, share=0.5, support=2):
    """The disclosing terms by the definition, over the different texts."""
    texts = {t or "" for _, t in rows}
    near, held, entities = {}, {}, {}
    for t in texts:
        for w in set(re.findall(r"\w{4,}", t.lower())):
            held.setdefault(w, set()).add(t)
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\w+", t)]
        for k, s, e in brute(t):
            entity = f"{k}:{t[s:e]}".lower()
            entities.setdefault(entity, set()).add(t)
            for a, b, w in words:
                if len(w) >= 4 and (max(0, s - around) <= a and b <= s or e <= a and b <= e + around):
                    near.setdefault((w, entity), set()).add(t)
    out = {}
    for (w, entity), of in near.items():
        n = math.log2(len(of) * len(texts) / (len(held[w]) * len(entities[entity])))
        if len(of) >= support and len(of) >= share * len(held[w]) and n >= bits:
            out[w] = max(n, out.get(w, 0))
    return out


def test_terms_against_the_definition(spark):
    rng = random.Random(12)
    people = [(f"person{i}x", f"{i}p@mail.example") for i in range(12)]
    rows = []
    for i in range(500):
        words = [f"filler{rng.randrange(80)}" for _ in range(rng.randrange(3, 60))]
        for name, mail in rng.sample(people, rng.choice([0, 0, 1, 2])):
            words.insert(rng.randrange(len(words)), mail)
            if rng.random() < 0.7:
                words.insert(rng.randrange(len(words)), name)
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[i][1]) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "", 0) for i, t in rows], SCHEMA)
    want = brute_terms(rows)
    got = {r.term: r.bits for r in pii.disclosing_terms(docs).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[w] - want[w]) < 1e-9 for w in want)
    spans = {r.doc_id: [(x.s, x.e) for x in r.term] for r in pii.find(docs).collect()}
    for i, t in rows:
        assert spans[i] == [m.span() for m in re.finditer(r"\w{4,}", t) if m[0].lower() in want]


def test_many_matches_in_one_text_and_words_at_the_edge(spark):
    text = "".join(f"a{i}@b.co " for i in range(20_000))
    docs = spark.createDataFrame([(1, text, "", 0)], SCHEMA)
    got = pii.digest(pii.find(docs)).collect()[0]
    assert got.n_email == 20_000 and got.base_sha256 == hashlib.sha256(",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"\S+", text)).encode()).hexdigest()
    edge = "abcdefghijklm " * 9 + "x@y.zz " + "nopqrstuvwxyz " * 9
    terms = {r.term for r in pii.entities(spark.createDataFrame([(1, edge, "", 0)], SCHEMA)).collect()}
    assert terms == {"abcdefghijklm", "nopqrstuvwxyz"}
