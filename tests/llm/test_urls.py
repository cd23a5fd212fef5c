import random
import re
from collections import Counter, defaultdict

from sparkvigil.llm import urls

SCHEMA = "page_id bigint, url string, html string, host string, parent int"


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def brute_rule(host, path, rules=urls.RULES):
    best = None
    for what, text in rules:
        name, _, rest = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(text) > len(best[1])):
            best = (what, text)
    return best


def pages(seed=21):
    rng, out = random.Random(seed), []
    hosts = ["a.example.com", "example.com", "B.Example.NET", "example.net", "notexample.net", "x.example.org", "com", "évil.com", "ÀB.net", ""]
    for i in range(700):
        path = rng.choice(["", "/", "/en/", "/en/7", "/de/8", "/de/81/x", "/es/3.html", "/fr", "/en"]) + rng.choice(["", str(rng.randrange(99)), "/tail"])
        out.append((i, rng.choice(["http", "HTTPS"]) + "://" + rng.choice(hosts) + path + rng.choice(["", "?q=/en/7", "#top", "?a#b"])))
    out += [(1000, None), (1001, ""), (1002, "no scheme/en/7"), (1003, "x://"), (1004, "http://u:p@example.com:80/en/7"), (1005, "a://b://c/d"), (None, "http://example.com/en/71"), (3, out[3][1])]
    out += [(2000 + i, f"http://deep.example.org/a/b/c/d/{i}/f") for i in range(30)] + [(3000 + i, f"http://wide.example.org/{chr(97 + i % 26)}word{chr(97 + i // 26)}x/y") for i in range(200)]
    return [(i, u, "<p>", "h", 0) for i, u in out]


def test_hosts_paths_and_rules(spark):
    data = pages()
    got = urls.judge(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()
    want = []
    for i, u, *_ in data:
        host, path = brute_parts(u)
        rule = brute_rule(host, path)
        want.append((i, host, path, rule and rule[1]))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.host, r.path, r.rule)) for r in got)
    verdicts = {text: what for what, text in urls.RULES}
    assert all(r.verdict == verdicts[r.rule] if r.rule else r.verdict in ("allow", "block") for r in got)
    by = {r.page_id: r for r in got}
    assert by[1000].verdict == by[1002].verdict == "allow"
    assert by[2003].template == "/a/b/c/d/*/f"
    assert len({r.template for r in got if r.page_id and 3000 <= r.page_id < 3200}) == 1


def test_templates_are_rejected_by_purity(spark):
    rules = (("block", "bad.example/x/1"), ("allow", "good.example/x/1"))
    rows = []
    for host in ("bad.example", "good.example", "new.example"):
        rows += [(len(rows) + i, f"http://{host}/x/{1 if i < 20 else 2}{i}", "", "", 0) for i in range(40)]
        rows += [(len(rows) + i, f"http://{host}/about/me", "", "", 0) for i in range(3)]
    got = urls.judge(spark.createDataFrame(rows, SCHEMA), rules=rules).collect()
    assert {(r.host, r.path.startswith("/x/"), r.verdict) for r in got} == {
        ("bad.example", True, "block"), ("bad.example", False, "allow"), ("good.example", True, "allow"),
        ("good.example", False, "allow"), ("new.example", True, "allow"), ("new.example", False, "allow"),
    }
    assert urls.z((20, 20), (0, 20), 0.5) > 1.96 > urls.z((10, 20), (11, 20), 0.5)


def brute_verdicts(urls_, rules=None, purity=0.8, least=5, weight=4.0):
    """The verdict of each url, by the definition, over one tree of Python objects a host."""
    rows = [(*brute_parts(u), brute_rule(*brute_parts(u), rules or urls.RULES)) for u in urls_]
    label = {"block": 1, "allow": 0}
    known = [label[r[2][0]] for r in rows if r[2]]
    rate = sum(known) / len(known) if known else 0.5
    paths = defaultdict(lambda: [0, 0, 0])
    for host, path, rule in rows:
        c = paths[host, re.sub(r"[^/.]*[0-9][^/.]*", "*", path)]
        c[0] += 1
        if rule:
            c[1] += 1
            c[2] += label[rule[0]]
    segs = {k: ([], k[1].split("/")[1:]) for k in paths}
    while any(left for _, left in segs.values()):
        groups = defaultdict(list)
        for k, (done, left) in segs.items():
            if left:
                groups[k[0], tuple(done)].append(k)
        for ks in groups.values():
            n = Counter()
            for k in ks:
                n[segs[k][1][0]] += paths[k][0]
            rests = {tuple(segs[k][1][1:]) for k in ks}
            variable = len(n) >= urls.DISTINCT and 2 * len(rests) <= len(n)
            for k in ks:
                done, left = segs[k]
                wild = variable and n[left[0]] < urls.SHARE * sum(n.values())
                segs[k] = ([*done, "*" if wild else left[0]], left[1:])
    tree = {k: tuple(done) for k, (done, left) in segs.items()}
    out = {}

    def walk(ks, level, share):
        if len(ks) == 1 and len(tree[ks[0]]) > level + 900:  # no recursion that deep
            (k,), (seen, bad) = ks, paths[ks[0]][1:]
            for _ in tree[k][level:]:
                share = (bad + weight * share) / (seen + weight)
            return out.update({k: share} if seen >= least else {})
        children = defaultdict(list)
        for k in ks:
            if level < len(tree[k]):
                children[tree[k][level]].append(k)
        kinds = defaultdict(list)
        for child, of in children.items():
            after = Counter()
            for k in of:
                if level + 1 < len(tree[k]):
                    after[tree[k][level + 1]] += paths[k][0]
            kind = max(after, key=lambda a: (after[a], a)) if after else "/"
            seen, bad = (sum(paths[k][i] for k in of) for i in (1, 2))
            own = (bad + weight * share) / (seen + weight)
            kinds[kind].append((own, child, max(own * (1 - own), 1e-9) / (seen + weight), seen, of))
        for nodes in kinds.values():
            labelled, rest = sorted(x for x in nodes if x[3]), [x for x in nodes if not x[3]]
            groups = []
            for at, x in enumerate(labelled):
                y = labelled[at - 1]
                if at and abs(x[0] - y[0]) <= 1.96 * (x[2] + y[2]) ** 0.5:
                    groups[-1].append(x)
                else:
                    groups.append([x])
            if len(groups) == 1:
                groups[0] += rest
            elif rest:
                groups.append(rest)
            for g in groups:
                of = [k for x in g for k in x[4]]
                seen, bad = (sum(paths[k][i] for k in of) for i in (1, 2))
                own = (bad + weight * share) / (seen + weight)
                if seen >= least:
                    out.update((k, own) for k in of)
                walk(of, level + 1, own)

    for host in {k[0] for k in paths}:
        ks = [k for k in paths if k[0] == host]
        walk(ks, 0, (sum(paths[k][2] for k in ks) + weight * rate) / (sum(paths[k][1] for k in ks) + weight))
    found = []
    for host, path, rule in rows:
        share = out.get((host, re.sub(r"[^/.]*[0-9][^/.]*", "*", path)))
        found.append((rule[0] if rule else "block" if share is not None and share >= purity else "allow", share))
    return found


def test_verdicts_against_a_plain_tree(spark):
    rng, data = random.Random(5), [(i, u) for i, u, *_ in pages() if i is not None and i < 5000]
    for host in ("a.site.example.com", "b.site.example.net", "c.site.example.org", "d.example.com"):
        for i in range(150):
            lang = rng.choice(["en", "de", "es", "fr", "about"])
            tail = "me" if lang == "about" else rng.choice(["{}", "{}/", "{}.html", "x/{}/y"]).format(rng.randrange(1, 10000))
            data.append((10000 + len(data), f"https://{host}/{lang}/{tail}"))
    want = brute_verdicts([u for _, u in data])
    got = urls.judge(spark.createDataFrame([(k, u, "", "", 0) for k, (_, u) in enumerate(data)], SCHEMA).repartition(3)).collect()
    assert len(got) == len(data)
    for r in got:
        verdict, share = want[r.page_id]
        assert r.verdict == verdict, data[r.page_id]
        assert (share is None) == (r.block_share is None) and (share is None or abs(share - r.block_share) < 1e-9)
    decided = [r for r in got if r.rule is None]
    assert {r.verdict for r in decided} == {"allow", "block"}


def test_labels_below_the_fourth_segment_decide_and_long_urls_end(spark):
    rules = (("block", "d.example/a/b/c/d/bad/"), ("allow", "d.example/a/b/c/d/good/"))
    rows = [f"http://d.example/a/b/c/d/{what}/{i}" for what in ("bad", "good") for i in range(12)]
    # the seventh segment tells them apart; rules know the first hosts' only
    rules = (*rules, *[("block" if i % 2 else "allow", f"e.example/p/q/r/s/t/{'x' if i % 2 else 'y'}/{chr(97 + i)}") for i in range(16)])
    rows += [f"http://e.example/p/q/r/s/t/{'x' if i % 2 else 'y'}/{chr(97 + i)}" for i in range(16)] + [f"http://e.example/p/q/r/s/t/{w}/unruled{chr(97 + i)}" for w in "xy" for i in range(4)]
    rows += ["http://long.example/" + "/".join(chr(97 + i % 26) for i in range(3000)), "http://long.example/" + "z" * 100_000]
    got = urls.judge(spark.createDataFrame([(i, u, "", "", 0) for i, u in enumerate(rows)], SCHEMA), rules=rules).collect()
    want = brute_verdicts(rows, rules)
    for r in got:
        verdict, share = want[r.page_id]
        assert r.verdict == verdict, rows[r.page_id][:60]
        assert (share is None) == (r.block_share is None) and (share is None or abs(share - r.block_share) < 1e-9)
    unruled = {r.path.split("/")[6]: r.verdict for r in got if "unruled" in r.path}
    assert unruled == {"x": "block", "y": "allow"}
    assert next(r for r in got if r.host == "long.example").template.count("/") >= 1


def test_repeated_rows_change_no_template(spark):
    data = [(i, f"http://h.example/user/name{chr(97 + i % 26)}{chr(97 + i // 26)}/{what}", "", "", 0) for i in range(60) for what in ("posts", "likes")]
    once = urls.judge(spark.createDataFrame(data, SCHEMA)).select("path", "template").distinct().collect()
    thrice = urls.judge(spark.createDataFrame(data * 3, SCHEMA)).select("path", "template").distinct().collect()
    assert sorted(once) == sorted(thrice) and len({r.template for r in once}) == 1


def test_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], SCHEMA)).count() == 0
