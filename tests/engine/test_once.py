"""What a parser finds in a line is found once, however many fields come from it."""

from pyspark.sql import functions as F

from sparkvigil.functions import patterns as P
from sparkvigil.functions import text as T
from sparkvigil.functions.generalise import NEEDS, RULES
from sparkvigil.operators import anomalies, graph, parse, policies


def searches(df):
    return df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(")


def test_pairs_are_sought_once(spark):
    lines = spark.createDataFrame([("a=1 b='x y' a=2 level=warn c=",)], "line string")
    assert searches(lines.select(parse.kv_fields(F.col("line")).alias("f"))) == 2  # keys and values
    row = lines.select(F.map_keys(parse.kv_pairs(F.col("line"))).alias("k"), parse.kv_pairs(F.col("line")).alias("m"), parse.kv_fields(F.col("line")).alias("f")).first()
    assert row.k == ["a", "b", "level"] and row.m == {"a": "1", "b": "x y", "level": "warn"} and row.f.severity == "warn"
    assert lines.select(T.first_pairs(F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"), lambda v: v)).first()[0] is None


def test_policy_fields_are_captured_once(spark):
    rows = spark.createDataFrame([("#7 web: sent k=1 k=2", r"^#(\d+) (\w+): (.*)$", {"attr:pid": 1, "trace_id": 2, "message": 3})], "line string, pattern string, groups map<string,int>")
    own = policies.fields(F.col("line"), F.col("pattern"), F.col("groups"))
    got = rows.select(T.let(own, parse._with_traces).alias("f"))
    assert searches(got) == 2
    f = got.first().f
    assert f.message == "sent k=1 k=2" and f.attributes == {"k": "1", "pid": "7", "trace_id": "web"}


def test_patterns_take_one_pass_over_the_counts(spark):
    counts = spark.createDataFrame([("m", w, "t", 50) for w in range(9)] + [("m", 10, "u", 3)], "monitor string, window bigint, template_id string, n bigint")
    windows = spark.createDataFrame([("m", w) for w in range(12)], "monitor string, window bigint")
    got = anomalies.patterns(counts, windows)
    assert {(r.window, r.kind, r.identity, r.direction, r.current, r.baseline) for r in got.collect()} == {(9, "pattern_disappearance", "t", "collapse", 0.0, 50.0), (10, "new_pattern", "u", "new", 3.0, 0.0)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("sort_array") < 12


def test_components_send_nothing_to_the_driver(spark, monkeypatch):
    plans, write = [], graph.written

    def kept(df, tag):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, tag)

    monkeypatch.setattr(graph, "written", kept)
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    assert roots == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}
    assert plans and not any("Broadcast" in p for p in plans)


def test_masks_search_only_texts_that_can_match(spark):
    texts = ["plain words", "a=1 pod=x9 at 10.0.0.1:80", '"pod": "p1" see https://h.example/a/b.pdf', "id ab-12-34 0xAF fe80:0:0:1 12-34", "\u0661\u0662\u0663\u0664\u0665 for file r.txt", "task_id:7 deadbeefdeadbeef block rdd_12 from web.h.example:443", "", None,
             "123e4567-e89b-12d3-a456-426614174000 took 1.5 ms", "x.exe - ran /var/log/a_1-2 C:\\a\\b_1_2"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = T._replace(T.collapse(T._replace(F.coalesce("text", F.lit("")), P.PREMASKS)), P.MASKS)
    got = rows.select(T.mask(T.premask(F.col("text"))).alias("a"), plain.alias("b")).collect()
    assert all(r.a == r.b for r in got) and len({r.a for r in got}) > 7
    assert len(P.PREMASKS) == len(P.PREMASK_NEEDS) and len(P.MASKS) == len(P.MASK_NEEDS) and len(RULES) == len(NEEDS)


def test_templates_parse_each_event_once(spark):
    events = spark.createDataFrame([("a failed",), (" ",), (None,)], "raw string").withColumn("message", F.regexp_replace("raw", "failed", "broke"))
    got = parse.templated(events)
    assert [r.template for r in got.collect()] == ["a broke"]
    assert got.drop("raw").repartition(2)._jdf.queryExecution().analyzed().toString().count("Filter") == 0


def test_admission_reads_a_sample_once_and_shuffles_no_text(spark):
    rows = [
        ("timed", r"^(\S+ \S+) (\w+): (.*)$", {"timestamp": "1", "component": "2", "message": "3"}), ("bare", r"^(?P<all>\w.*)", {"message": "all"}),
        ("led", r"^(\w*)[ ,](.*)$", {"component": "1", "message": "2"}), ("none", r"^\w+", {"component": "0"}), ("any", r"^.+", {"message": "0"}), ("unsent", r"^a", {}), ("open", r"^[a-z]+", {}),
    ]
    policies_ = policies.compiled(spark.createDataFrame(rows, "policy_id string, regex string, groups map<string,string>"))
    lines = ["2024-01-02 03:04:05Z web: k=1 sent", "1970-01-02 03:04:05Z web: old", "1 2 web:   ", "١٢ at", " blank first", "abc\n  more", "", "\n \nx", None]
    samples = spark.createDataFrame([(r[0], x) for r in rows if r[0] != "unsent" for x in lines], "policy_id string, sample string")
    got = policies.admitted(samples, policies_)
    passed = {r.policy_id: (r.samples, r.passed, r.fault) for r in got.collect()}
    assert passed == {"timed": (9, 1, None), "bare": (9, 5, None), "led": (9, 2, None), "none": (9, 0, "no_message_group"), "any": (9, 0, "catch_all"), "unsent": (0, 0, None), "open": (9, 1, None)}
    plan = got._jdf.queryExecution()
    assert searches(got) == 0 and "strategy=broadcast" in plan.optimizedPlan().toString()
    assert plan.analyzed().toString().count("map_entries(") == 0


def test_format_is_told_without_counting_assignments(spark):
    texts = ["a=1 b=2", "a=1", "a = \n b\t= 2", "=a b=", "one two three four a=1", "one two three four five a=1", "x" * 70 + " a=1", "x" * 70 + " a=1 b=1", "a==b=1", "a.b-c_=1b=2", "-a=1", "no", "", None, "a=" + " " * 5000 + "b", "k=1 " + "w " * 20000]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(1)
    log, each = F.col("text"), F.lit(P.KV_ASSIGNMENT)
    n, prefix = F.regexp_count(log, each), F.trim(F.substring(log, F.lit(1), F.greatest(F.regexp_instr(log, each) - 1, F.lit(0))))
    counted = (n >= 2) | ((n == 1) & ((prefix == "") | ((F.length(prefix) <= 64) & (F.size(F.split(prefix, r"\s+")) <= 4))))
    got = rows.select(T.looks_like_kv(log).alias("a"), counted.alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and {r.a for r in got} == {True, False, None}
    plan = rows.select(T.detect_format(log).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(" not in plan
    formats = parse.canonical(rows.withColumnRenamed("text", "raw")).select("format")._jdf.queryExecution().optimizedPlan().toString()
    assert formats.count(r"(?U)^\s+|\s+$") == 1  # a text's ends are trimmed once
