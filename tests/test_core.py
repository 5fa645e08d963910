"""Rules, relational operators, functions, sources, streams and the registry."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stenbro.functions import text as X
from stenbro.operators import relational as R
from stenbro.operators import rules
from stenbro.sources import files
from stenbro.streaming import events


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    "value,kind,args,want",
    [
        (5, "gt", {"threshold": 4}, True),
        (None, "gt", {"threshold": 4}, False),
        ("7", "<=", {"threshold": 7}, True),
        ("x", "lte", {"threshold": 7}, False),
        ("YES ", "bool_true", {}, True),
        ("", "present", {}, False),
        ("", "true_if_present", {}, True),
        (None, "range", {}, True),
        (3, "range", {"min": 3, "max": None}, True),
        ("Abc", "contains", {"threshold": "bC"}, True),
        ("Abc", "matches", {"threshold": "^a"}, True),
        ("b", "in", {"threshold": ["a", "b"]}, True),
    ],
)
def test_predicates(spark, value, kind, args, want):
    assert one(spark, rules.predicate(F.lit(value), kind, **args)) is want


def test_unknown_rule(spark):
    with pytest.raises(ValueError):
        rules.predicate(F.lit(1), "unheard-of")


def test_levels_first_match(spark):
    rule = {"type": "lte", "levels": [{"threshold": 200, "points": 9}, {"threshold": 500, "points": 5}]}
    assert [one(spark, rules.points(F.lit(v), rule)) for v in (100, 300, 900, None)] == [9, 5, 0, 0]


def test_functions(spark):
    assert one(spark, X.host(F.lit("HTTPS://www.X.dk:80/a?b"))) == "x.dk"
    assert one(spark, X.normal_url(F.lit("http://www.x.dk/a/?q#f"))) == "https://x.dk/a"
    assert one(spark, X.without_tracking(F.lit("https://x.dk/a?utm_source=b&q=1#t"))) == "https://x.dk/a?q=1"
    assert one(spark, X.phone_e164(F.lit("0045 12 34 56 78"))) == "+4512345678"
    assert one(spark, X.left_pad(F.lit("1234567"), 6)) == "1234567"
    assert one(spark, X.company_key(F.lit("Blå Bær A/S"))) == "blaabaer"
    assert one(spark, X.is_filled(F.lit(None).cast("string"))) is False


def test_first_and_folded(spark):
    df = spark.createDataFrame([(1, "a", [None, "y"], 3), (2, "a", ["x"], 1), (3, "b", None, None)], "id long, k string, l array<string>, d int")
    assert sorted(r.id for r in R.first_per(df, ["k"], [F.desc("id")]).collect()) == [2, 3]
    rows = {r.k: (r.l, r.d) for r in R.folded(df, ["k"], {}, ["l"], ["d"], F.col("id")).collect()}
    assert rows["a"][1] == 1 and "x" in rows["a"][0]


def test_sources(spark, tmp_path):
    (tmp_path / "u.txt").write_text("http://a\n\n# no\nhttps://b \nx http://c\n")
    assert sorted(r.url for r in files.url_lines(spark, str(tmp_path / "u.txt")).collect()) == ["http://a", "https://b"]
    (tmp_path / "p.csv").write_text("﻿Postnummer; Bynavn\n1000;By\n", "utf-8")
    assert files.postal_codes(spark, str(tmp_path / "p.csv")).columns == ["postnummer", "bynavn", "label"]
    df = spark.createDataFrame([(1, None)], "a int, b string")
    files.write_csv(df, str(tmp_path / "o"), ["b", "a", "c"], sep=";")
    assert spark.read.csv(str(tmp_path / "o"), sep=";", header=True).columns == ["b", "a", "c"]
    old = spark.createDataFrame([("k", 1, "x")], "key string, v int, t string")
    new = spark.createDataFrame([("k", 2, "y"), ("l", 1, "z")], "key string, v int, t string")
    assert sorted((r.key, r.t) for r in files.upserted(old, new, "key", "v").collect()) == [("k", "y"), ("l", "z")]


def test_stream_counts_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 0{h}:10:00", k) for h in range(4) for k in ("a", "b", "a")], "t string, k string").select(F.col("t").cast("timestamp").alias("ts"), "k")
    rows.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = events.windowed_counts(live, "ts", "k").writeStream.format("memory").queryName("counted").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    want = events.windowed_counts(rows, "ts", "k").collect()
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, want))


def test_registry(spark):
    known, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(known)
    assert entry.entry(spark).columns == ["row_id", "field", "pos", "value"]


@pytest.mark.parametrize("name", ["FIL-08", "RUL-14", "JOI-05", "AGG-06", "WIN-07", "URL-06", "SET-02"])
def test_against_sql(spark, name):
    import glob
    import os

    import duckdb

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = entry.queries()[name](spark, sf)
    cur = c.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, cur.fetchall()))
