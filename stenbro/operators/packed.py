"""Several values packed in one field: one row per value, with its position.

Spans in double quotes or angle brackets may hold delimiters of their own (single quotes are apostrophes as often as
quotes, so they are no spans). They are taken out first: each span is replaced with an
indexed placeholder, the rest is split at the delimiters, and the spans are put back by array lookup. The placeholder
marks are themselves treated as spans wherever a value holds them already, so a placeholder can't be mistaken.

Everything is a built-in expression on one row: no shuffle, no Python, one pass over the scan.

Defined cases: NULL, blank and placeholder fields give no values; a field with an unclosed quote is split as if the
quote were not there; repeated values keep their own positions; extra columns of the input are left alone (the only
names read are the ones given, and only the ones asked for are returned).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "\ue000", "\ue001"
SPAN = rf'"[^"]*"|<[^<>]*>|[{OPEN}{CLOSE}]'

#: Where a field of each kind is cut, once its spans are masked. A site address may hold any of these marks itself, so
#: a mark without space beside it is a delimiter there only if an address begins behind it.
_SITE_BEGINS = rf"{OPEN}|https?://|(?:[\w-]+\.)+[A-Za-z]{{2,}}(?=[/\s;,|?#:]|$)"
DELIMITERS = {
    "email": r"[;,|/\s]+",
    "phone": r"[;,|/&\r\n\t]+|\s(?:og|eller|samt|and|or|\+)\s",
    "site": rf"\s+|[;,|]+(?={_SITE_BEGINS})",
    "plain": r"\s*[;|\r\n\t]+\s*|\s*,\s+",
}
EMAIL = r"[^\s<>\"'(),;:|\[\]\\/]+@[^\s<>\"'(),;:|\[\]\\/@]*[^\s<>\"'(),;:|\[\]\\/@.]"
PHONE = r"(?<![\d])(?:\(?(?:\+|00)45\)?[\s.\-]*)?(\d(?:[ .\-]?\d){7})(?!\d)"
SITE = r"^(?:https?://\S+|(?:[\w-]+\.)+[A-Za-z]{2,}(?:[/:?#]\S*)?)$"
BLANK = ("", "n/a", "na", "none", "null", "nan", "-", "ingen", "ukendt")


def mask_spans(value: Column) -> tuple[Column, Column]:
    """The value with indexed placeholders in place of its spans, and the array of the spans."""
    spans = F.regexp_extract_all(value, F.lit(SPAN), F.lit(0))
    gaps = F.split(value, SPAN, -1)
    masked = F.array_join(
        F.transform(
            gaps,
            lambda gap, i: F.when(i < F.size(spans), F.concat(gap, F.lit(OPEN), i.cast("string"), F.lit(CLOSE))).otherwise(gap),
        ),
        "",
    )
    return masked, spans


def restore_spans(segment: Column, spans: Column) -> Column:
    """A segment of the masked value with its spans put back."""
    return F.array_join(
        F.transform(
            F.split(segment, f"[{OPEN}{CLOSE}]", -1),
            lambda part, i: F.when(i % 2 == 1, F.get(spans, part.cast("int"))).otherwise(part),
        ),
        "",
    )


def _values(kind: str, segment: Column) -> Column:
    """The array of values in one segment."""
    if kind == "email":
        return F.regexp_extract_all(segment, F.lit(EMAIL), F.lit(0))
    if kind == "phone":
        return F.transform(F.regexp_extract_all(segment, F.lit(PHONE), F.lit(1)), lambda x: F.regexp_replace(x, r"\D", ""))
    bare = F.regexp_replace(F.trim(segment), r"^[\s\"'<>;,|]+|[\s\"'<>;,|]+$", "")
    if kind == "site":
        return F.when(bare.rlike(SITE), F.array(bare)).otherwise(F.array().cast("array<string>"))
    return F.when(F.lower(bare).isin(*BLANK), F.array().cast("array<string>")).otherwise(F.array(bare))


def packed_values(value: Column, kind: str) -> Column:
    """The array of the values that a field of this kind holds, in written order."""
    masked, spans = mask_spans(value)
    segments = F.transform(F.split(masked, DELIMITERS[kind], -1), lambda s: restore_spans(s, spans))
    return F.coalesce(F.flatten(F.transform(segments, lambda s: _values(kind, s))), F.array().cast("array<string>"))


def split_packed(df: DataFrame, key: str, kinds: dict[str, str], least: int = 2) -> DataFrame:
    """(key, field, pos, value) of every field in `kinds` (column -> kind) that holds at least `least` values.

    `pos` counts from 1. The fields are unfolded together, so the input is read once whatever their number.
    """
    def placed(c: str, kind: str) -> Column:
        return F.transform(
            packed_values(df[c], kind),
            lambda v, i: F.struct(F.lit(c).alias("field"), (i + 1).cast("bigint").alias("pos"), v.alias("value")),
        )

    packed = [placed(c, kind) for c, kind in kinds.items()]
    kept = [F.when(F.size(p) >= least, p).otherwise(F.array().cast("array<struct<field:string,pos:bigint,value:string>>")) for p in packed]
    return df.select(df[key].alias(key), F.inline(F.concat(*kept)))
