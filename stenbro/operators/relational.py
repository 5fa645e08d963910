"""Relational operators with the orders and ties that first-wins processing needs."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stenbro.functions import text as X
from stenbro.functions import web as W


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order (which must be total for a defined result)."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_n = 1").drop("_n")


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first `n` rows of each key; Spark prunes each partition to `n` before the shuffle."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_n") <= n).withColumnRenamed("_n", "pos")


def waterfall(*steps: Column) -> Column:
    """The first step that gives a value."""
    return F.coalesce(*steps)


def united(df: DataFrame, keys: list[str], lists: dict[str, Column]) -> DataFrame:
    """(keys, lists...): the distinct elements of each list over the rows of a key, sorted; [] where there are none.

    Elements are unfolded and made distinct before they are gathered, so nothing larger than a result is held.
    """
    listed = F.array(*[F.struct(F.lit(name).alias("_c"), c.cast("array<string>").alias("_l")) for name, c in lists.items()])
    each = df.select(*keys, F.inline(listed)).select(*keys, "_c", F.explode_outer("_l").alias("_x")).distinct()
    return each.groupBy(*keys).agg(*[F.array_sort(F.collect_set(F.when(F.col("_c") == name, F.col("_x")))).alias(name) for name in lists])


def folded(df: DataFrame, keys: list[str], first: dict[str, Column], lists: list[str], least: list[str], order: Column) -> DataFrame:
    """Rows of a key as one: first values by `order`, united sorted lists, least numbers. NULL keys are keys."""
    aggs = [F.min_by(c, F.when(c.isNotNull(), order)).alias(name) for name, c in first.items()] + [F.min(c).alias(c) for c in least]
    one = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
    if not lists:
        return one
    many = united(df, keys, {c: F.col(c) for c in lists})
    same = reduce(lambda a, b: a & b, [one[k].eqNullSafe(many[k]) for k in keys])
    return one.join(many, same, "left").select(*[one[k] for k in keys], *[one[c] for c in one.columns if c not in keys], *lists)


def merged_sections(df: DataFrame, key: str, order: str, fields: list[str], most: tuple[str, ...] = ()) -> DataFrame:
    """Fields (section.name) of a key's rows as one: flags or-ed, numbers added (those in `most`: the greatest), lists
    united, other values the last that isn't NULL by `order`. Columns are section_name."""
    kinds = dict(zip(fields, (f.dataType for f in df.select(*[F.col(f) for f in fields]).schema.fields), strict=True))
    flat = df.select(key, order, *[F.col(f).alias(f.replace(".", "_")) for f in fields])
    aggs, lists = [], []
    for field, kind in kinds.items():
        name, of = field.replace(".", "_"), kind.typeName()
        if of == "array":
            lists.append(name)
        elif of == "boolean":
            aggs.append(F.bool_or(name).alias(name))
        elif of in ("integer", "long", "double", "float", "short"):
            aggs.append((F.max if field.split(".")[-1] in most else F.sum)(name).alias(name))
        else:
            aggs.append(F.max_by(name, F.when(F.col(name).isNotNull(), F.col(order))).alias(name))
    one = flat.groupBy(key).agg(*aggs)
    if not lists:
        return one
    many = united(flat, [key], {c: F.col(c) for c in lists})
    return one.join(many.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def best_of(df: DataFrame, keys: list[str], order: list[Column], fields: list[str], n: int) -> DataFrame:
    """(keys, all): the best `n` rows of a key as a list of structs, the best one first."""
    ranked = top_per(df.select(*keys, *[c for c in df.columns if c not in keys]), keys, order, n)
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("all"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def joined_sections(df: DataFrame, key: str, sections: dict[str, list[str]]) -> DataFrame:
    """Sections flattened on their own, only where they are there, and joined back to all keys."""
    whole = df.select(key)
    for section, fields in sections.items():
        part = df.where(F.col(section).isNotNull()).select(key, *[F.col(f).alias(f.replace(".", "_")) for f in fields])
        whole = whole.join(part, key, "left")
    return whole


def counted_by_url(pages: DataFrame, key: str, others: DataFrame, other: str) -> DataFrame:
    """(key, n): how many of the others have an equivalent address: equal scheme and host, path without slashes at its end."""
    same = lambda d, *more: d.select(*more, W.part(F.col("url"), 1).alias("_s"), W.host_of(F.col("url")).alias("_h"), F.regexp_replace(W.part(F.col("url"), 3), "/+$", "").alias("_p"))
    counted = same(others, other).groupBy("_s", "_h", "_p").agg(F.count(other).alias("n"))  # one row an address, however many pages share it
    return same(pages, key).join(counted, ["_s", "_h", "_p"], "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def json_objects(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, members): documents (or what stands under `analysis` in them) that are complete JSON objects, as maps."""
    doc = df.where(F.ltrim(text).startswith("{") & F.try_parse_json(text).isNotNull()).select(key, F.from_json(F.col(text), "map<string,string>").alias("_m"))
    inner = F.from_json(F.try_element_at("_m", F.lit("analysis")), "map<string,string>")
    return doc.select(key, F.coalesce(inner, "_m").alias("members"))


def overlaid(documents: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Defaults overlaid by what a document has; a member that is there wins even if it is NULL."""
    return documents.withColumns({k: F.when(F.map_contains_key("members", k), F.try_element_at("members", F.lit(k))).otherwise(v) for k, v in defaults.items()})


def nested_urls(df: DataFrame, key: str, text: str, only: str = "") -> DataFrame:
    """(key, path, url) of every address in a JSON document, at any depth; `only`: under keys that contain this."""
    kind = df.schema[key].dataType.simpleString()

    def walk(value, path: str):
        if isinstance(value, dict):
            for k, x in value.items():
                yield from walk(x, f"{path}.{k}" if path else k)
        elif isinstance(value, list):
            for k, x in enumerate(value):
                yield from walk(x, f"{path}[{k}]")
        elif isinstance(value, str) and value.startswith(("http://", "https://")) and only.lower() in path.lower():
            yield path, value

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, doc in enumerate(batch.column(text).to_pylist()):
                try:
                    rows += [(k, *found) for found in walk(json.loads(doc), "")] if doc else []
                except ValueError:
                    continue
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(key).take(at), *(pa.array([r[i] for r in rows], pa.string()) for i in (1, 2))], names=[key, "path", "url"])

    return df.select(key, text).mapInArrow(read, f"{key} {kind}, path string, url string")


def document_frequency(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(token, df): in how many rows a token stands."""
    return df.select(F.col(key), F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def frequent_tokens(df: DataFrame, key: str, tokens: Column, share: float = 0.02, top: int = 40, least: int = 2) -> DataFrame:
    """(token, df) of tokens in a share of all rows or among the top, and in `least` rows; equal ones by first key, then token."""
    counted = df.select(F.col(key).alias("_k"), F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"), F.min("_k").alias("_k"))
    whole = df.agg(F.count("*").alias("_n"))
    common = counted.crossJoin(F.broadcast(whole)).where(F.col("df") / F.col("_n") >= share).select("token", "df")
    first = counted.orderBy(F.desc("df"), "_k", "token").limit(top).select("token", "df")
    return common.unionByName(first).where(F.col("df") >= least).distinct()


def keyword_scores(df: DataFrame, key: str, site: str, text: str, top: int = 10) -> DataFrame:
    """(key, score) of each row's text against the most frequent words of its site; equally frequent ones by word."""
    rows = df.select(key, F.coalesce(site, F.lit("")).alias("_s"), F.col(text).alias("_t"))
    words = rows.select("_s", F.explode(F.regexp_extract_all(F.lower("_t"), F.lit(X.KEYWORD), F.lit(0))).alias("w")).where(~F.col("w").isin(*X.STOPWORDS))
    best = top_per(words.groupBy("_s", "w").agg(F.count("*").alias("n")), ["_s"], [F.desc("n"), F.col("w")], top)
    listed = best.groupBy("_s").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]).alias("_k"))
    samples = rows.select(key, "_s", X.keyword_sample(F.col("_t")).alias("_t"))
    return samples.join(listed, "_s", "left").select(key, X.keyword_score(F.col("_t"), F.col("_k")).alias("score"))


def flattened(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs as columns with joined paths; lists stay lists."""
    out: list[Column] = []

    def walk(schema, path: list[str]) -> None:
        for f in schema.fields:
            if f.dataType.typeName() == "struct":
                walk(f.dataType, [*path, f.name])
            else:
                c = F.col(".".join(f"`{p}`" for p in [*path, f.name]))
                out.append(c.alias(sep.join([*path, f.name])))

    walk(df.schema, [])
    return df.select(*out)


def with_missing(df: DataFrame, columns: dict[str, object]) -> DataFrame:
    """Columns that are absent added with their defaults."""
    return df.withColumns({c: F.lit(v) for c, v in columns.items() if c not in df.columns})


def url_columns(df: DataFrame, columns: list[str], pattern: str, least: float) -> DataFrame:
    """(column_name, share, best): the share of values like addresses in each column; best: the greatest, if `least` or more."""
    shares = df.agg(*[F.avg(F.when(F.col(c).rlike(pattern), 1.0).otherwise(0.0)).alias(c) for c in columns])
    most = F.greatest(*[F.col(c) for c in columns])
    return shares.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("share"), ((F.col(c) == most) & (F.col(c) >= least)).alias("best")) for c in columns])))
