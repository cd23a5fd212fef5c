"""Header families, what a header tells beside them, stamps of more kinds and typed scalars, against plain Python."""

from datetime import UTC, datetime

from pyspark.sql import functions as F

from sparkvigil.functions import times
from sparkvigil.operators import headers, parse


def read(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, raw string")
    got = rows.select("i", parse.structured_fields(F.col("raw")).alias("f"), headers.by_family(F.col("raw"))["family"].alias("family")).orderBy("i").collect()
    return [r.f for r in got], [r.family for r in got]


def test_families_and_what_only_looks_like_one(spark):
    f, family = read(
        spark,
        "2016-09-28 04:30:30, Warn                  cbs    Loaded v=6 name=\"a b\"\n  more",
        "2016-09-28 04:30:30, Info CBS Loaded",
        "2015-07-29 17:41:44,747 - WARN  [Peer[myid=1]/0:0:Election@774] - Notification k=v myid=2 line=9",
        "20171223-22:15:9:606|Step_LSC|30002312|changed x=1",
        "20171223-22:15:9:606|Step_LSC|abc|changed",
        '10.0.0.1 - - [10/Oct/2000:13:55:36 -0700] " GET /a " 404 232',
        '10.0.0.1 - - [10/Oct/2000:13:55:36 -0700] "GET /a" 404 -',
        "",
        None,
    )
    assert family == ["servicing", None, "quorum", "pipes", None, "access", None, None, None]
    assert (f[0].severity, f[0].component, f[0].message, f[0].attributes) == ("WARN", "CBS", 'Loaded v=6 name="a b"', {"v": "6", "name": "a b"})
    # the message's pairs go before the context's, an explicit line before the place in the source
    assert (f[2].component, f[2].attributes) == ("Election", {"myid": "2", "k": "v", "line": "9"})
    assert (f[3].severity, f[3].component, f[3].message, f[3].attributes) == (None, "Step_LSC", "changed x=1", {})
    assert (f[5].severity, f[5].host, f[5].message, f[5].attributes["response_size_bytes"]) == ("WARNING", "10.0.0.1", "GET /a (HTTP 404)", "232")


def test_roles_by_place(spark):
    texts = [
        "2024-01-01 00:00:00 ERROR [pay-api] down", "2024-01-01 00:00:00 ERROR [main] down", "2024-01-01 00:00:00 INFO cart-service n=1", "2024-01-01 00:00:00 INFO cart-service down",
        "2024-01-01 00:00:00 INFO [main] org.apache.Foo: hi", "2024-01-01 00:00:00 25746 INFO nova.wsgi.server [req-38101a0b-2096 x] 10.0.0.1,10.0.0.2 \"GET /v2\" status: 200 len: 1", "2024-01-01 00:00:00 INFO 10.0.0.1 status: 200",
        '2024-01-01 00:00:00 INFO x.y: 10.0.0.999 "GET /v2" status=404', "[10.30 16:49:06] chrome.exe - proxy open", "[Sun Dec 04 04:47:44 2005] [error] mod_jk bad", "no stamp here", "2024-01-01 00:00:00 a=1 a=2 b=[1,2] c='x y'", None,
    ]
    got = [r.o for r in spark.createDataFrame(list(enumerate(texts)), "i int, raw string").select("i", headers.optional(F.col("raw")).alias("o")).orderBy("i").collect()]
    assert [(o.service, o.component) if o else None for o in got] == [
        ("pay-api", None), (None, None), ("cart-service", None), (None, None), (None, "org.apache.Foo"), (None, "nova.wsgi.server"), (None, None), (None, "x.y"), (None, "chrome.exe"), (None, None), None, (None, None), None,
    ]
    assert got[5].attributes == {"request_id": "req-38101a0b-2096", "client_ip": "10.0.0.1", "http_status": "200"} and got[6].attributes == {}
    assert got[7].attributes == {"status": "404", "http_status": "404"} and got[11].attributes == {"a": "1", "c": "x y"}


def test_stamps(spark):
    utc = lambda *a: int(datetime(*a, tzinfo=UTC).timestamp() * 1_000_000)
    # (stamp, in UTC, without a zone, why not)
    cases = [
        ("20171223-22:15:9:606", utc(2017, 12, 23, 22, 15, 9, 606_000), None, "timezone_missing"), ("20171223-22:15:29:6", utc(2017, 12, 23, 22, 15, 29, 600_000), None, "timezone_missing"),
        ("20171223-22:15:29", utc(2017, 12, 23, 22, 15, 29), None, "timezone_missing"), ("2005-06-03-15.42.50.675872", utc(2005, 6, 3, 15, 42, 50, 675_872), None, "timezone_missing"),
        ("Sun Dec 04 04:47:44 2005", utc(2005, 12, 4, 4, 47, 44), None, "timezone_missing"), ("2024-01-01T10:10+02:00", utc(2024, 1, 1, 8, 10), utc(2024, 1, 1, 8, 10), None),
        ("2024-01-01 10:10", None, None, "invalid"), ("2024-01-01 10:10:10,5Z", utc(2024, 1, 1, 10, 10, 10, 500_000), utc(2024, 1, 1, 10, 10, 10, 500_000), None),
        ("10.30 16:49:06", None, None, "year_missing"), ("2024-13-01 10:10:10", None, None, "invalid"), ("", None, None, "missing"), (None, None, None, "missing"),
    ]
    x, none = F.col("x"), F.lit(None).cast("string")
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, x string").select("i", times.normalise(x, F.lit("UTC")).alias("a"), times.normalise(x).alias("b"), times.status(x, none).alias("s"))
    assert [(r.a, r.b, r.s) for r in rows.orderBy("i").collect()] == [c[1:] for c in cases]


def test_first_stamps_stand_anywhere_and_header_stamps_don_t(spark):
    texts = [("x 2024-01-01 00:00:00 y",), ("[Sun Dec 04 04:47:44 2005] z",), ("Sun Dec 04 04:47:44 2005 z",), ("a\n2024-01-01 00:00:00",), (None,)]
    got = spark.createDataFrame(texts, "x string").select(times.first_stamp(F.col("x")), times.header_stamp(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [("2024-01-01 00:00:00", None), ("Sun Dec 04 04:47:44 2005", "Sun Dec 04 04:47:44 2005"), (None, None), (None, None), (None, None)]


def test_typed_scalars(spark):
    cases = {
        "7": ("BIGINT", "7"), "007": ("STRING", "007"), "-7": ("BIGINT", "-7"), "0": ("BIGINT", "0"), "-0": ("BIGINT", "0"), "-07": ("STRING", "-07"), "+3": ("BIGINT", "3"), "1.5": ("DOUBLE", "1.5"), ".5": ("DOUBLE", "0.5"),
        "00.5": ("DOUBLE", "0.5"), "1e5": ("DOUBLE", "100000.0"), "1e999": ("STRING", "1e999"), "nan": ("STRING", "nan"), "": ("STRING", ""), "a": ("STRING", "a"), "9" * 20: ("STRING", "9" * 20), "1.2.3": ("STRING", "1.2.3"),
    }
    rows = spark.createDataFrame([(k,) for k in [*cases, None]], "x string").select("x", headers.typed(F.col("x")).alias("v")).select("x", F.schema_of_variant("v").alias("k"), F.col("v").cast("string").alias("s"))
    got = {r.x: (r.k, r.s) for r in rows.collect()}
    assert got.pop(None) == (None, None) and got == cases
