"""Registry of the core queries: name -> (spark, sf_dir) -> DataFrame, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stenbro.operators import nested, packed
from stenbro.session import table, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


CONTACT_FIELDS = {"Email": "email", "Telefon": "phone", "Hjemmeside": "site"}


@query("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.split_packed(table(spark, sf_dir, "company"), "row_id", CONTACT_FIELDS)


def _occurred(spark: SparkSession, sf_dir: str, above: bool = False) -> DataFrame:
    return nested.shred(table(spark, sf_dir, "site_analysis"), table(spark, sf_dir, "analysis_raw"), above)


def _json(x: str) -> str:
    """SQL of a JSON value, or of the JSON that it holds as text."""
    return f"case when json_type({x}) = 'VARCHAR' then try_cast(({x})->>'$' as json) else {x} end"


def _parts(x: str, kind: str) -> str:
    """SQL of the elements of a list, or the values of an object, as a list of JSON."""
    return f"case json_type({x}) when '{kind}' then json_extract({x}, '{'$[*]' if kind == 'ARRAY' else '$.*'}') else [] end"


P5_SQL = f"""
with doc as (select analysis_id, {_json("coalesce(payload::json->'$.analysis', payload::json)")} as j from analysis_raw where payload is not null and json_valid(payload)),
branch as (select analysis_id, {_json("j->'$.technical_seo'")} as t, {_json("j->'$.conversion'")} as c from doc),
meta as (select analysis_id, t->'$.broken_links_list' as b0, {_json("t->'$.broken_links_list'")} as b, {_json("t->'$.discarded_links'")} as d, {_json("c->'$.forms_meta'")} as m from branch),
part as (select *, {_json("m->'$.forms'")} as f from meta),
form as (select analysis_id, unnest(case json_type(f) when 'OBJECT' then [f] else {_parts("f", "ARRAY")} end) as f from part),
field as (select analysis_id, f->>'$.action' as action, {_json("f->'$.fields'")} as g from form where json_type(f) = 'OBJECT'),
link as (select analysis_id, unnest(case when d->>'$.href' is not null then [d] when json_type(d) = 'OBJECT' then flatten(list_transform({_parts("d", "OBJECT")}, lambda v: case json_type(v) when 'ARRAY' then json_extract(v, '$[*]') else [v] end)) else {_parts("d", "ARRAY")} end) as v from part),
broken as (select analysis_id, case when json_type(v) = 'OBJECT' then coalesce(v->>'$.url', v->>'$.href') else v->>'$' end as item from (select analysis_id, unnest({_parts("b", "ARRAY")}) as v from part)
  union all select analysis_id, unnest(case json_type(b) when 'OBJECT' then json_keys(b) else [] end) from part
  union all select analysis_id, b0->>'$' from part where json_type(b0) = 'VARCHAR' and b is null and trim(b0->>'$') <> ''),
typed as (select analysis_id, unnest(conversion.forms_meta.forms) as f from site_analysis)
select distinct * from (
  select analysis_id, 'broken_link' as child, '' as parent_item, unnest(technical_seo.broken_links_list) as item from site_analysis
  union all select analysis_id, 'discarded_link', '', unnest(technical_seo.discarded_links).href from site_analysis
  union all select analysis_id, 'form', '', f.action from typed
  union all select analysis_id, 'form_field', coalesce(f.action, ''), unnest(f.fields).name from typed
  union all select analysis_id, 'broken_link', '', item from broken
  union all select analysis_id, 'discarded_link', '', v->>'$.href' from link where json_type(v) = 'OBJECT'
  union all select analysis_id, 'form', '', action from field
  union all select analysis_id, 'form_field', coalesce(action, ''), case json_type(v) when 'OBJECT' then v->>'$.name' else v->>'$' end from (select analysis_id, action, unnest({_parts("g", "ARRAY")}) as v from field)
  union all select analysis_id, 'form_field', coalesce(action, ''), unnest(case json_type(g) when 'OBJECT' then json_keys(g) else [] end) from field
) where item is not null"""


@query("p5_found", P5_SQL)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    occurred = written(_occurred(spark, sf_dir).drop("body"))  # the documents are taken apart once, for store and bridge
    return nested.children(nested.bridge(occurred), nested.objects(occurred)).distinct()


@query("p5_objects")
def p5_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.objects(_occurred(spark, sf_dir, above=True))


@query("p5_bridge")
def p5_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.bridge(_occurred(spark, sf_dir, above=True))
