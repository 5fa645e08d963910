"""Similarity of names, in Arrow batches over pairs that a join has brought together."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stenbro.functions import text as X

ALIKE = 0.92


def plain(name: str | None) -> str:
    """A firm's name without legal form and marks."""
    low = re.sub(r"\b(?:aps|a/s|ivs)\b", "", (name or "").strip().lower())
    return " ".join(re.sub(r"[^a-z0-9æøåéèüö ]+", " ", low).split())


def ratio(a: str | None, b: str | None) -> float:
    """Twice the letters of the matching blocks over all letters; 0 if either is empty."""
    x, y = plain(a), plain(b)
    return SequenceMatcher(None, x, y).ratio() if x and y else 0.0


def edits(a: str | None, b: str | None, most: int = 2) -> int:
    """Edits between two names, `most` + 1 for more. Letters that changed places cost the step before them and one more,
    so 'ab' and 'ba' are two edits apart."""
    a, b = sorted((a or "", b or ""), key=len)
    if len(b) - len(a) > most:
        return most + 1
    above = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            best = min(above[j + 1] + 1, row[j] + 1, above[j] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                best = min(best, above[j - 1] + 1)
            row.append(best)
        if min(row) > most:
            return most + 1
        above = row
    return above[-1] if above[-1] <= most else most + 1


def core(name: str | None) -> list[str]:
    return [t for t in re.findall("[0-9a-zæøåéèüö]+", (name or "").lower()) if t not in X.QUALIFIERS]


def confusable(target: str | None, candidate: str | None) -> bool:
    """Names so near that one may be taken for the other, though the first word of one isn't a word of the other."""
    t, c = core(target), core(candidate)
    if not t or not c or t[0] in c:
        return False
    a, b = "".join(t), "".join(c)
    most = 1 if min(len(a), len(b)) <= 7 else 2
    return edits(a, b, most) <= most


def measured(pairs: DataFrame, a: str, b: str, **measures: tuple[Callable, str]) -> DataFrame:
    """`pairs` with measures of the columns `a` and `b`: name -> (function of two names, type)."""
    kinds = {"double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = list(zip(batch.column(a).to_pylist(), batch.column(b).to_pylist(), strict=True))
            made = [pa.array([f(x, y) for x, y in both], kinds[kind]) for f, kind in measures.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *measures])

    return pairs.mapInArrow(read, f"{fields}, " + ", ".join(f"{n} {kind}" for n, (_, kind) in measures.items()))


def accepted_places(firms: DataFrame, places: DataFrame) -> DataFrame:
    """(firm_id, place_id, how): the first place (by place_id) of each firm (firm_id, name, host, phone) that has its host, or
    its phone, or a name that is like its own or holds its first word, and isn't confusable.

    Three equi-joins (host, phone, first word) whose pairs are then measured; never all firms with all places.
    """
    f = firms.select("firm_id", F.col("name").alias("firm_name"), F.nullif("host", F.lit("")).alias("host"), F.nullif("phone", F.lit("")).alias("phone"), F.get(X.core_tokens(F.col("name")), F.lit(0)).alias("word"))
    p = places.select("place_id", F.col("name").alias("place_name"), F.nullif("host", F.lit("")).alias("host"), F.nullif("phone", F.lit("")).alias("phone"), X.core_tokens(F.col("name")).alias("words"))
    same = lambda c: f.where(F.col(c).isNotNull()).select("firm_id", c).join(p.where(F.col(c).isNotNull()).select("place_id", c), c).select("firm_id", "place_id", F.lit(c).alias("how"))
    named = f.select("firm_id", "firm_name", "word").join(p.select("place_id", "place_name", F.explode(F.array_distinct("words")).alias("word")), "word")
    judged = measured(named, "firm_name", "place_name", near=(ratio, "double"), mistaken=(confusable, "boolean"))
    by_name = judged.where((F.col("near") >= ALIKE) | ~F.col("mistaken")).select("firm_id", "place_id", F.lit("name").alias("how"))
    return same("host").unionByName(same("phone")).unionByName(by_name).groupBy("firm_id").agg(F.min(F.struct("place_id", "how")).alias("m")).select("firm_id", "m.*")
