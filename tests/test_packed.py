"""Values packed in one field."""

import pytest
from pyspark.sql import functions as F

from stenbro.operators.packed import packed_values, split_packed


def values(spark, text, kind):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(packed_values(F.col("t"), kind)).first()[0]


@pytest.mark.parametrize(
    "text,kind,want",
    [
        ('"Nordby, salg" <a@x.example>; "B" <b@x.example>', "email", ["a@x.example", "b@x.example"]),
        ("Salg / ordre <k@x.example>", "email", ["k@x.example"]),
        ("a@x.example;; N/A", "email", ["a@x.example"]),
        ('a@x.example "b@x.example', "email", ["a@x.example", "b@x.example"]),
        ("0 a@x.example, b@x.example", "email", ["a@x.example", "b@x.example"]),
        ("+45 1571 9276/(0045) 16536842, 16 44 92 65", "phone", ["15719276", "16536842", "16449265"]),
        ("17153788 14325757", "phone", ["17153788", "14325757"]),
        ("https://x.example/side?a=1,2", "site", ["https://x.example/side?a=1,2"]),
        ("https://x.example/a|b; www.y.example", "site", ["https://x.example/a|b", "www.y.example"]),
        ("<https://x.example/> <y.test>", "site", ["https://x.example/", "y.test"]),
        ("", "site", []),
        (None, "email", []),
    ],
)
def test_values(spark, text, kind, want):
    assert values(spark, text, kind) == want


def test_long_value(spark):
    assert len(values(spark, "; ".join(f"a{i}@x.example" for i in range(2000)), "email")) == 2000


def test_positions_ties_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a@x.example, a@x.example", "field"), (1, "a@x.example, a@x.example", "pos"), (2, None, "value")], "row_id long, Email string, field string")
    rows = split_packed(df, "row_id", {"Email": "email"}).collect()
    assert sorted((r.row_id, r.field, r.pos, r.value) for r in rows) == [(1, "Email", p, "a@x.example") for p in (1, 1, 2, 2)]
    assert split_packed(df.limit(0), "row_id", {"Email": "email"}).count() == 0
