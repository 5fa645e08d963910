"""Deeply nested records as related flat tables, with Merkle identities for their subtrees.

A branch of a record is a tree of lists of objects. Each object is canonicalised (absent and null members are the same
and left out, members stand in name order) and hashed bottom-up: the hash of an object covers the hashes of its
children, so equal subtrees have equal identities wherever they occur. Three tables come out:

The levels are the record, its branches `technical_seo` and `conversion`, `forms_meta` within the latter, the elements
of their lists, and the fields of forms. All members of a level are in its body; members of a branch stand there as text, those
that a captured document has beyond the typed ones too.

* ``occurrences``: one row per object as it stands in a record (key, child, ordinals, identities, own members);
* ``objects``: every distinct object once (identity, kind, item, canonical body holding the children's identities);
* ``bridge``: one row per occurrence that ties an object's identity to its record, its parent and its ordinals.

All hashing and unfolding is built-in expressions. `objects` pre-aggregates before its shuffle, so an object that a
third of all rows share leaves one row per task. The join of `bridge` and `objects` is on the identity; a hot identity
is on the bridge's side only and is split by adaptive skew handling.

Captured documents (JSON text) come in several shapes of the same branch; `json_links` and friends turn each known
shape into the canonical one: lists, maps keyed by URL, by reason or by field name, a single object in place of a
list, and any branch as JSON text within the JSON.

Defined cases: NULL sections, NULL and empty lists, empty tables give no rows, but a NULL and an empty list make
different parents; NULL elements keep their place in the count of ordinals but give no row; text that isn't complete
JSON gives no rows; repeated objects keep one row per occurrence. Objects without a name (`item`) are stored, and left
out by `children`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELD = "struct<name:string,type:string,required:boolean>"
OWN = "action:string,method:string,input_count:int,required_pct:double,has_email:boolean,has_honeypot:boolean,is_newsletter:boolean"
FORM = f"struct<{OWN},fields:array<{FIELD}>>"
BROKEN = "struct<url:string,status:int>"
LINK = "struct<href:string,abs:string,reason:string>"
LISTS = {"emails_found": "email", "phone_numbers_found": "phone_number", "trust_signals_found": "trust_signal", "form_field_counts": "form_field_count"}
NUMBERS = ("response_time_ms",)
OCCURRENCE = "struct<child:string,parent_ordinal:int,ordinal:int,parent_hash:string,hash:string,item:string,body:string>"


def merkle(value: Column, kind: T.DataType) -> Column:
    """The identity of a value: 32 hex digits of a SHA-256 over its canonical form."""
    return F.substring(F.sha2(canonical(value, kind), 256), 1, 32)


def canonical(value: Column, kind: T.DataType) -> Column:
    """The canonical text of a value, in which every nested object or list stands as its identity."""
    if isinstance(kind, T.StructType):
        members = [
            F.when(value[f.name].isNotNull(), F.concat(F.lit(f"{f.name}="), _member(value[f.name], f.dataType)))
            for f in sorted(kind.fields, key=lambda f: f.name)
        ]
        text = F.concat(F.lit("{"), F.concat_ws("\x1f", *members), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.concat_ws("\x1f", F.transform(value, lambda x: _member(x, kind.elementType))), F.lit("]"))
    elif isinstance(kind, T.MapType):
        pairs = F.array_sort(F.map_entries(value))
        text = F.concat(
            F.lit("<"),
            F.concat_ws("\x1f", F.transform(pairs, lambda e: F.concat(_member(e["key"], kind.keyType), F.lit("="), _member(e["value"], kind.valueType)))),
            F.lit(">"),
        )
    else:
        text = F.to_json(F.struct(value.alias("v")))
    return F.coalesce(text, F.lit("null"))


def _member(value: Column, kind: T.DataType) -> Column:
    nested = isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
    return merkle(value, kind) if nested else F.coalesce(F.to_json(F.struct(value.alias("v"))), F.lit("null"))


def _nothing(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _type(ddl: str) -> T.DataType:
    return T._parse_datatype_string(f"x {ddl}").fields[0].dataType


def _bodies(values: Column, ddl: str, item) -> Column:
    """(item, body) of each element, elements that are NULL kept in their places."""
    return F.transform(
        values,
        lambda x: F.when(x.isNotNull(), F.struct(item(x).cast("string").alias("item"), canonical(x, _type(ddl)).alias("body"))),
    )


def _hashed(bodies: Column) -> Column:
    """(item, body, hash) from (item, body)."""
    return F.transform(
        bodies,
        lambda x: F.when(x.isNotNull(), F.struct(x["item"].alias("item"), x["body"].alias("body"), F.substring(F.sha2(x["body"], 256), 1, 32).alias("hash"))),
    )


def _rows(child: str, hashed: Column, at: Column | None = None, above: Column | None = None) -> Column:
    """Occurrence structs for the hashed elements of one list; none for a NULL list."""
    rows = F.transform(
        hashed,
        lambda x, i: F.when(
            x.isNotNull(),
            F.struct(
                F.lit(child).alias("child"),
                (F.lit(None) if at is None else at).cast("int").alias("parent_ordinal"),
                (i + 1).alias("ordinal"),
                (F.lit(None) if above is None else above).cast("string").alias("parent_hash"),
                x["hash"].alias("hash"),
                x["item"].alias("item"),
                x["body"].alias("body"),
            ).cast(OCCURRENCE),
        ),
    )
    return F.coalesce(rows, _nothing(OCCURRENCE))


def _branch(members: Column, lists: dict[str, Column]) -> Column:
    """A list of the one (item, body) of a branch: its members by name, then its lists of identities; NULL for no branch."""
    own = F.transform(F.array_sort(F.map_entries(members)), lambda e: F.concat(e["key"], F.lit("="), F.to_json(F.struct(e["value"].alias("v")))))
    ties = [F.concat(F.lit(f"{name}=["), F.array_join(F.transform(c, lambda x: x["hash"]), ",", "null"), F.lit("]")) for name, c in sorted(lists.items())]
    body = F.concat(F.lit("{"), F.concat_ws("\x1f", own, *ties), F.lit("}"))
    return F.when(members.isNotNull(), F.array(F.struct(F.lit(None).cast("string").alias("item"), body.alias("body"))))


def occurrences(df: DataFrame, key: str, broken: Column, discarded: Column, forms: Column, branches: dict[str, Column] | None = None) -> DataFrame:
    """One row per child object of the canonical branches, all levels unfolded in one pass over the input.

    `branches` has the members of `technical_seo`, `conversion` and `forms_meta` as maps, and the other lists of
    `conversion`; without it the lists have no parents. Each step stands in a projection of its own: what a later step
    uses more than once is then computed once.
    """
    above = branches or {}
    parsed = df.select(df[key].alias("analysis_id"), broken.alias("b"), discarded.alias("d"), forms.alias("f"), *[c.alias(name) for name, c in above.items()])
    leaves = parsed.select(
        "analysis_id",
        _hashed(_bodies(F.col("b"), BROKEN, lambda x: x["url"])).alias("b"),
        _hashed(_bodies(F.col("d"), LINK, lambda x: x["href"])).alias("d"),
        F.transform(
            "f",
            lambda x: F.when(
                x.isNotNull(),
                F.struct(*[x[f.name].alias(f.name) for f in _type(f"struct<{OWN}>").fields], _hashed(_bodies(x["fields"], FIELD, lambda g: g["name"])).alias("fields")),
            ),
        ).alias("f"),
        *[_hashed(_bodies(F.col(name), "string", lambda x: x)).alias(name) if name in LISTS else F.col(name) for name in above],
    )
    own = _type(f"struct<{OWN},fields:array<string>>")
    bodied = leaves.withColumn(
        "f",
        F.transform(
            "f",
            lambda x: F.when(
                x.isNotNull(),
                F.struct(
                    x["action"].alias("item"),
                    canonical(
                        F.struct(*[x[f.name].alias(f.name) for f in own.fields[:-1]], F.transform(x["fields"], lambda g: g["hash"]).alias("fields")),
                        own,
                    ).alias("body"),
                    x["fields"].alias("fields"),
                ),
            ),
        ),
    )
    whole = bodied.withColumn(
        "f",
        F.transform(
            "f",
            lambda x: F.when(x.isNotNull(), F.struct(x["item"].alias("item"), x["body"].alias("body"), F.substring(F.sha2(x["body"], 256), 1, 32).alias("hash"), x["fields"].alias("fields"))),
        ),
    )
    none = _nothing(OCCURRENCE)
    fields = F.coalesce(F.flatten(F.transform("f", lambda x, i: F.when(x.isNotNull(), _rows("form_field", x["fields"], i + 1, x["hash"])).otherwise(none))), none)
    rows = []
    tie: dict[str, tuple] = {"t": (), "m": (), "c": ()}
    if branches:
        whole = whole.withColumns({"t": _hashed(_branch(F.col("technical_seo"), {"broken_links_list": F.col("b"), "discarded_links": F.col("d")})), "m": _hashed(_branch(F.col("forms_meta"), {"forms": F.col("f")}))})
        whole = whole.withColumn("c", _hashed(_branch(F.col("conversion"), {"forms_meta": F.col("m")} | {name: F.col(name) for name in LISTS})))
        some = F.when(F.col("t").isNotNull() | F.col("c").isNotNull(), F.create_map().cast("map<string,string>"))
        whole = whole.withColumn("r", _hashed(_branch(some, {"technical_seo": F.col("t"), "conversion": F.col("c")})))
        tie = {name: (F.when(F.col(name).isNotNull(), 1), F.get(F.col(name), F.lit(0))["hash"]) for name in (*tie, "r")}
        rows = [_rows("record", F.col("r")), _rows("technical_seo", F.col("t"), *tie["r"]), _rows("conversion", F.col("c"), *tie["r"]), _rows("forms_meta", F.col("m"), *tie["c"])]
        rows += [_rows(child, F.col(name), *tie["c"]) for name, child in LISTS.items()]
    every = F.concat(_rows("broken_link", F.col("b"), *tie["t"]), _rows("discarded_link", F.col("d"), *tie["t"]), _rows("form", F.col("f"), *tie["m"]), fields, *rows)
    return whole.select("analysis_id", F.explode(every).alias("o")).where("o is not null").select("analysis_id", "o.*")


def objects(occurred: DataFrame) -> DataFrame:
    """Every distinct object once, with its item and its body where the occurrences have it."""
    return occurred.groupBy("hash", "child").agg(*[F.first(c).alias(c) for c in ("item", "body") if c in occurred.columns])


def bridge(occurred: DataFrame) -> DataFrame:
    """The tie of each occurrence to its record, parent and place; no content."""
    return occurred.select("analysis_id", "child", "parent_ordinal", "ordinal", "parent_hash", "hash")


def children(tied: DataFrame, stored: DataFrame) -> DataFrame:
    """Occurrences rebuilt from bridge and store: analysis_id, child, parent_item, item."""
    own = stored.select("hash", "child", "item")
    above = stored.where("child = 'form'").select(F.col("hash").alias("parent_hash"), F.col("item").alias("parent_item"))
    listed = tied.where("child in ('broken_link', 'discarded_link', 'form', 'form_field')")
    whole = listed.withColumn("parent_hash", F.when(F.col("child") == "form_field", F.col("parent_hash"))).join(own.where("item is not null"), ["hash", "child"])
    nested = whole.where(F.col("parent_hash").isNotNull()).join(above, "parent_hash", "left")
    flat = whole.where(F.col("parent_hash").isNull()).withColumn("parent_item", F.lit(""))
    columns = ["analysis_id", "child", F.coalesce("parent_item", F.lit("")).alias("parent_item"), "item"]
    return flat.select(columns).unionByName(nested.select(columns))


def typed_branches(df: DataFrame) -> tuple[Column, Column, Column]:
    """The canonical branches of a table with typed sections."""
    tech, conv = df["technical_seo"], df["conversion"]
    forms = F.transform(
        conv["forms_meta"]["forms"],
        lambda f: F.when(
            f.isNotNull(),
            F.struct(
                *[f[m.name].cast(m.dataType).alias(m.name) for m in _type(f"struct<{OWN}>").fields],
                F.transform(f["fields"], lambda g: g.cast(FIELD)).alias("fields"),
            ),
        ),
    )
    broken = F.transform(tech["broken_links_list"], lambda x: F.when(x.isNotNull(), F.struct(x.alias("url"), F.lit(None).cast("int").alias("status"))))
    return broken, F.transform(tech["discarded_links"], lambda x: x.cast(LINK)), forms


def typed_above(df: DataFrame) -> dict[str, Column]:
    """The levels above, for `occurrences`, of a table with typed sections."""

    def members(value: Column, kind: T.DataType) -> Column:
        pairs = [x for f in kind.fields if not isinstance(f.dataType, (T.ArrayType, T.StructType)) for x in (F.lit(f.name), value[f.name].cast("string"))]
        return F.when(value.isNotNull(), F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()))

    tech, conv = df["technical_seo"], df["conversion"]
    kind = df.schema["conversion"].dataType
    return {
        "technical_seo": members(tech, df.schema["technical_seo"].dataType),
        "conversion": members(conv, kind),
        "forms_meta": members(conv["forms_meta"], kind["forms_meta"].dataType),
    } | {name: conv[name].cast("array<string>") for name in LISTS}


def _get(text: Column, path: str) -> Column:
    return F.get_json_object(text, path)


def _list(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def _map(text: Column) -> Column:
    return F.map_entries(F.from_json(text, "map<string,string>"))


def _is(text: Column, mark: str) -> Column:
    return F.ltrim(text).startswith(mark)


def json_broken(text: Column) -> Column:
    """A list of URLs or of objects with a `url`, or a map keyed by URL; a status stands in the object or the map."""

    def link(url: Column, status: Column) -> Column:
        return F.struct(url.alias("url"), status.try_cast("int").alias("status"))

    none = F.lit(None).cast("string")
    one = lambda x: F.when(_is(x, "{"), link(F.coalesce(_get(x, "$.url"), _get(x, "$.href")), _get(x, "$.status"))).when(x.isNotNull(), link(x, none))
    return (
        F.when(_is(text, "["), F.transform(_list(text), one))
        .when(_is(text, "{"), F.transform(_map(text), lambda e: link(e["key"], e["value"])))
        .when(F.trim(text) != "", F.array(link(text, none)))
    )


def json_links(text: Column) -> Column:
    """A list of link objects, a map of such lists by reason, or a single link object."""

    def link(x: Column, reason: Column | None = None) -> Column:
        why = _get(x, "$.reason") if reason is None else F.coalesce(_get(x, "$.reason"), reason)
        return F.when(_is(x, "{"), F.struct(_get(x, "$.href").alias("href"), _get(x, "$.abs").alias("abs"), why.alias("reason")))

    single = _get(text, "$.href").isNotNull()
    grouped = F.flatten(
        F.transform(
            F.filter(_map(text), lambda e: _is(e["value"], "[") | _is(e["value"], "{")),
            lambda e: F.transform(F.when(_is(e["value"], "["), _list(e["value"])).otherwise(F.array(e["value"])), lambda x: link(x, e["key"])),
        )
    )
    return (
        F.when(_is(text, "["), F.transform(_list(text), lambda x: link(x)))
        .when(_is(text, "{") & single, F.array(link(text)))
        .when(_is(text, "{"), grouped)
    )


def json_fields(text: Column) -> Column:
    """A list of names or of objects with a `name`, or a map keyed by name."""

    def field(name: Column, x: Column | None) -> Column:
        kind, must = (_get(x, "$.type"), _get(x, "$.required").cast("boolean")) if x is not None else (F.lit(None), F.lit(None))
        return F.struct(name.alias("name"), kind.cast("string").alias("type"), must.cast("boolean").alias("required"))

    one = lambda x: F.when(_is(x, "{"), field(_get(x, "$.name"), x)).when(x.isNotNull(), field(x, None))
    return F.when(_is(text, "["), F.transform(_list(text), one)).when(
        _is(text, "{"), F.transform(_map(text), lambda e: field(e["key"], e["value"]))
    )


def json_forms(text: Column) -> Column:
    """A list of forms, or a single form object."""
    form = lambda x: F.when(
        _is(x, "{"),
        F.struct(
            *[_get(x, f"$.{m.name}").try_cast(m.dataType).alias(m.name) for m in _type(f"struct<{OWN}>").fields],
            json_fields(_get(x, "$.fields")).alias("fields"),
        ).cast(FORM),
    )
    return F.when(_is(text, "["), F.transform(_list(text), form)).when(_is(text, "{"), F.array(form(text)))


def json_parts(raw: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, broken, discarded, forms, tech, conv, meta) as JSON text; all NULL where the document isn't complete JSON."""
    doc = raw.select(F.col(key), F.when(F.try_parse_json(payload).isNotNull(), F.col(payload)).alias("whole"))
    doc = doc.select(key, F.coalesce(_get(F.col("whole"), "$.analysis"), F.col("whole")).alias("doc"))
    doc = doc.select(key, _get(F.col("doc"), "$.technical_seo").alias("tech"), _get(F.col("doc"), "$.conversion").alias("conv"))
    doc = doc.select(
        key,
        "tech",
        "conv",
        _get(F.col("tech"), "$.broken_links_list").alias("broken"),
        _get(F.col("tech"), "$.discarded_links").alias("discarded"),
        _get(F.col("conv"), "$.forms_meta").alias("meta"),
    )
    return doc.select(key, "broken", "discarded", _get(F.col("meta"), "$.forms").alias("forms"), "tech", "conv", "meta")


def json_above() -> dict[str, Column]:
    """The levels above, for `occurrences`, of the columns of `json_parts`."""

    def members(name: str, *nested: str) -> Column:
        text = F.when(_is(F.col(name), "{"), F.from_json(name, "map<string,string>"))
        kept = F.map_filter(text, lambda k, v: v.isNotNull() & ~k.isin(*nested))
        return F.transform_values(kept, lambda k, v: F.when(k.isin(*NUMBERS), F.coalesce(v.try_cast("double").cast("string"), v)).otherwise(v))

    def listed(name: str) -> Column:
        text = _get(F.col("conv"), f"$.{name}")
        return F.when(_is(text, "["), _list(text)).when(F.trim(text) != "", F.array(text))

    return {
        "technical_seo": members("tech", "broken_links_list", "discarded_links"),
        "conversion": members("conv", "forms_meta", *LISTS),
        "forms_meta": members("meta", "forms"),
    } | {name: listed(name) for name in LISTS}


def shred(analysis: DataFrame, raw: DataFrame, above: bool = False) -> DataFrame:
    """Occurrences of both forms in which analysis documents are stored; `above`: with the levels above the lists."""
    typed = occurrences(analysis, "analysis_id", *typed_branches(analysis), typed_above(analysis) if above else None)
    parts = json_parts(raw, "analysis_id", "payload")
    text = occurrences(parts, "analysis_id", json_broken(F.col("broken")), json_links(F.col("discarded")), json_forms(F.col("forms")), json_above() if above else None)
    return typed.unionByName(text)
