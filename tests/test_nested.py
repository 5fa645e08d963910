"""Nested records as flat tables."""

import json

from stenbro.operators import nested


def rows(spark, payloads):
    raw = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "analysis_id long, payload string")
    parts = nested.json_parts(raw, "analysis_id", "payload")
    from pyspark.sql import functions as F

    occurred = nested.occurrences(parts, "analysis_id", nested.json_broken(F.col("broken")), nested.json_links(F.col("discarded")), nested.json_forms(F.col("forms")))
    return occurred


def found(occurred):
    return sorted(tuple(r) for r in nested.children(nested.bridge(occurred), nested.objects(occurred)).collect())


def doc(**parts):
    return json.dumps({"technical_seo": parts.get("tech"), "conversion": parts.get("conv")})


def test_shapes(spark):
    shapes = [
        doc(tech={"broken_links_list": ["u1", None, "u2"]}),
        doc(tech={"broken_links_list": {"u1": 404, "u2": 0}}),
        doc(tech={"broken_links_list": [{"url": "u1", "status": 1}, {"url": "u2"}]}),
        doc(tech={"broken_links_list": json.dumps(["u1", "u2"])}),
        json.dumps({"analysis": {"technical_seo": json.dumps({"broken_links_list": ["u1", "u2"]})}, "score": 1}),
    ]
    got = found(rows(spark, shapes))
    assert got == sorted((i, "broken_link", "", u) for i in range(5) for u in ("u1", "u2"))


def test_links_and_forms(spark):
    link = {"href": "/a", "abs": "x"}
    form = {"action": "/f", "fields": ["n", "m"]}
    shapes = [
        doc(tech={"discarded_links": [link, None, {"abs": "y"}]}),
        doc(tech={"discarded_links": {"fil": [link]}}),
        doc(tech={"discarded_links": link}),
        doc(conv={"forms_meta": {"forms": [form]}}),
        doc(conv={"forms_meta": json.dumps({"forms": form})}),
        doc(conv={"forms_meta": {"forms": {"action": "/f", "fields": {"n": {"type": "text"}, "m": {}}}}}),
    ]
    want = [(i, "discarded_link", "", "/a") for i in range(3)]
    want += [(i, "form", "", "/f") for i in (3, 4, 5)] + [(i, "form_field", "/f", n) for i in (3, 4, 5) for n in "nm"]
    assert found(rows(spark, shapes)) == sorted(want)


def test_unusable_and_empty(spark):
    whole = doc(tech={"broken_links_list": ["u"]})
    assert found(rows(spark, [None, "", "null", whole[:-4], "[]", "{}"])) == []
    assert found(rows(spark, []) if False else rows(spark, [None]).limit(0)) == []


def test_equal_objects_are_stored_once(spark):
    form = {"action": "/f", "method": "post", "fields": [{"name": "n", "type": "text"}]}
    turned = {"fields": [{"type": "text", "name": "n"}], "method": "post", "action": "/f"}
    occurred = rows(spark, [doc(conv={"forms_meta": {"forms": [form, turned]}}), doc(conv={"forms_meta": {"forms": [form]}})])
    assert nested.objects(occurred).count() == 2
    assert nested.bridge(occurred).count() == 6
    other = rows(spark, [doc(conv={"forms_meta": {"forms": [form | {"fields": [{"name": "m"}]}]}})])
    a = {r.hash for r in nested.objects(occurred).where("child='form'").collect()}
    assert a.isdisjoint(r.hash for r in nested.objects(other).where("child='form'").collect())
