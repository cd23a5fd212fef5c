"""Dotted paths and attributes of hits, against plain dictionaries."""

import json

import pytest
from pyspark.sql import functions as F

from sparkvigil.functions import variants

MISSING = object()


def plain(source, path):
    parts, now = path.split("."), source
    for i, part in enumerate(parts):
        if not isinstance(now, dict):
            return MISSING
        if ".".join(parts[i:]) in now:
            return now[".".join(parts[i:])]
        now = now.get(part, MISSING)
    return now


HITS = [
    {"kubernetes": {"pod_name": "nested"}}, {"kubernetes.pod_name": "literal", "kubernetes": {"pod_name": "nested"}}, {"kubernetes.pod_name": None, "kubernetes": {"pod_name": "nested"}}, {"kubernetes": {"pod_name": None}},
    {"kubernetes": "no object"}, {}, {"kubernetes": {"labels.pod-template-hash": "h1", "labels": {"pod-template-hash": "h2"}}}, {"kubernetes": {"labels": {"pod-template-hash": "h3"}}}, {"kubernetes.labels": {"pod-template-hash": "lost"}},
    {"kubernetes.labels.pod-template-hash": "h4"}, {"kubernetes": {"pod_name": ["list"]}}, {"kubernetes": {"pod_name": 7, "pod_ip": " ", "container_name": True}},
    {"tcmonit_retag_tcserviceid": "", "kubernetes": {"namespace_labels": {"tcserviceid": 12}}}, {"message": '{"status_code": 503, "method": "get", "process_time_ms": "12.5", "url": null, "request_id": ""}'},
    {"message": ' {"process_time_ms": "soon", "logger": {"a": 1}, "url": "/x"} '}, {"message": '{"broken": '}, {"message": "plain"}, {"message": 5}, {"openshift": {"sequence": 3}, "hostname": "h", "level": "warn", "it's": {"a'b": 1}},
]


@pytest.mark.parametrize("path", ["kubernetes.pod_name", "kubernetes.labels.pod-template-hash", "message", "it's.a'b"])
def test_paths(spark, path):
    rows = spark.createDataFrame([(i, json.dumps(h)) for i, h in enumerate(HITS)], "i int, raw string").withColumn("v", F.try_parse_json("raw"))
    value = variants.at(F.col("v"), path)
    got = {r.i: (r.missing, r.null, r.json) for r in rows.select("i", variants.missing(F.col("v"), path).alias("missing"), F.is_variant_null(value).alias("null"), F.to_json(value).alias("json")).collect()}
    for i, h in enumerate(HITS):
        want = plain(h, path)
        missing, null, said = got[i]
        assert missing == (want is MISSING), (path, h)
        if want is not MISSING:
            assert null == (want is None) and json.loads(said) == want, (path, h)


def test_attributes(spark):
    rows = spark.createDataFrame([(i, json.dumps(h)) for i, h in enumerate(HITS)] + [(99, "not json"), (100, None)], "i int, raw string")
    got = {r.i: r.a for r in rows.select("i", variants.hit_attributes(F.try_parse_json("raw")).alias("a")).collect()}
    assert got[0] == {"pod_name": "nested"} and got[1] == {"pod_name": "literal"}
    assert [got[i] for i in (2, 3, 4, 5, 8, 10, 15, 16, 17, 99, 100)] == [{}] * 11
    assert [got[i]["pod_template_hash"] for i in (6, 7, 9)] == ["h1", "h3", "h4"]
    assert got[11] == {"pod_name": "7", "container_name": "true"} and got[12] == {"service_id": "12"}
    assert got[13] == {"http_status": "503", "http_method": "GET", "process_time_ms": "12.5"} and got[14] == {"http_url": "/x"}
    assert got[18] == {"sequence": "3", "hostname": "h", "log_level": "warn"}
