"""The domain's operators on the test tables, by the identifier of the coverage list, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stenbro.functions import text as X
from stenbro.operators import relational as R
from stenbro.operators import rules
from stenbro.queries import query
from stenbro.session import table

NAME = "Vrvirksomhed_virksomhedMetadata_nyesteNavn_navn"
ADDRESS = "Vrvirksomhed_virksomhedMetadata_nyesteBeliggenhedsadresse_"
FORM = "Vrvirksomhed_virksomhedMetadata_nyesteVirksomhedsform_langBeskrivelse"
STATUS = "Vrvirksomhed_virksomhedMetadata_sammensatStatus"
ENDED = "Vrvirksomhed_virksomhedMetadata_ophørsDato"
BLANK_SQL = "lower(trim({0})) in ('','n/a','na','none','null','-','nan')"
HOST_SQL = "regexp_replace(regexp_extract(lower(trim({0})), '^(?:[a-z]+://)?([^/?#:]+)', 1), '^www\\.', '')"
PATH_SQL = "regexp_extract({0}, '^(?:[A-Za-z]+://)?[^/?#]*([^?#]*)', 1)"
QUERY_SQL = "regexp_extract({0}, '\\?([^#]*)', 1)"
ASCII_SQL = "replace(replace(replace(replace(replace(replace({0},'æ','ae'),'ø','oe'),'å','aa'),'Æ','Ae'),'Ø','Oe'),'Å','Aa')"


def on(name: str, source: str, sql: str):
    """Register a query over one table: f(df) -> DataFrame."""

    def add(f):
        query(name, sql)(lambda spark, sf_dir: f(table(spark, sf_dir, source)))
        return f

    return add


def column(name: str, source: str, key: str, out: str, expression, sql: str, where=None, where_sql: str = "true") -> None:
    """Register a query (key, out) of one scalar function over one table; expressions are made when it runs."""

    def f(df: DataFrame) -> DataFrame:
        rows = df if where is None else df.where(where())
        return rows.select(key, expression().alias(out))

    on(name, source, f"select {key}, {sql} as {out} from {source} where {where_sql}")(f)


# --- sources, projections -------------------------------------------------------------------------------------------
on("PRJ-03", "profiles", "select profile_id as id, fullname as name, headline as title from profiles")(
    lambda d: d.select(*[F.col(a).alias(b) for a, b in (("profile_id", "id"), ("fullname", "name"), ("headline", "title"), ("absent", "none")) if a in d.columns])
)
on("PRJ-05", "url_cache", "select cache_id, '' as note, 0 as tries from url_cache")(lambda d: R.with_missing(d, {"note": "", "tries": 0}).select("cache_id", "note", "tries"))
column("PRJ-16", "company", "row_id", "remark", lambda: F.when(~X.is_filled(F.col("Hjemmeside")), "ingen side").otherwise(F.col("HjemmesideBemærkning")), f"case when Hjemmeside is null or {BLANK_SQL.format('Hjemmeside')} then 'ingen side' else \"HjemmesideBemærkning\" end")
column("PRJ-17", "company", "row_id", "effective", lambda: F.when(F.lower(F.trim("HjemmesideGMB")).isin("", "n/a") | F.col("HjemmesideGMB").isNull(), F.col("Hjemmeside")).otherwise(F.col("HjemmesideGMB")), "case when HjemmesideGMB is null or lower(trim(HjemmesideGMB)) in ('','n/a') then Hjemmeside else HjemmesideGMB end")

# --- filters --------------------------------------------------------------------------------------------------------
on("FIL-02", "company", f"""select row_id from company where "{ENDED}" is null or {BLANK_SQL.format(f'"{ENDED}"')}""")(lambda d: d.where(~X.is_filled(F.col(ENDED))).select("row_id"))
column("FIL-04", "company", "row_id", "code", lambda: X.left_pad(F.replace(F.trim("Branchekode"), F.lit("."), F.lit("")), 6), "case when length(replace(trim(Branchekode),'.','')) < 6 then lpad(replace(trim(Branchekode),'.',''),6,'0') else replace(trim(Branchekode),'.','') end")
on("FIL-05", "company", f"""select row_id from company where upper("{STATUS}") in ('AKTIV','NORMAL')""")(lambda d: d.where(F.upper(F.col(STATUS)).isin("AKTIV", "NORMAL")).select("row_id"))
on("FIL-06", "company", "select row_id from company where lower(trim(HjemmesideLiveBool)) = 'true'")(lambda d: d.where(F.lower(F.trim("HjemmesideLiveBool")) == "true").select("row_id") if "HjemmesideLiveBool" in d.columns else d.select("row_id"))
on("FIL-07", "company", f"select row_id from company where Email is not null and not {BLANK_SQL.format('Email')}")(lambda d: d.where(X.is_filled(F.col("Email"))).select("row_id"))
column("FIL-08", "company", "row_id", "site", lambda: X.normal_url(F.col("Hjemmeside")), f"case when {HOST_SQL.format('Hjemmeside')} = '' then null else 'https://' || {HOST_SQL.format('Hjemmeside')} || regexp_replace({PATH_SQL.format('Hjemmeside')}, '/+$', '') end", lambda: X.is_filled(F.col("Hjemmeside")) & ~F.col("Hjemmeside").rlike(r"[\s;,|<>\"]"), f"Hjemmeside is not null and not {BLANK_SQL.format('Hjemmeside')} and not regexp_matches(Hjemmeside, '[\\s;,|<>\"]')")
on("FIL-12", "site_analysis", "select analysis_id, h as href from (select analysis_id, unnest(technical_seo.discarded_links).href as h from site_analysis) where regexp_matches(split_part(h,'?',1), '(?i)\\.(jpg|jpeg|png|gif|webp|svg|css|js|pdf|zip|ico|woff2?|mp4)$')")(
    lambda d: d.select("analysis_id", F.explode("technical_seo.discarded_links").alias("l")).select("analysis_id", F.col("l.href").alias("href")).where(X.is_asset(F.col("href")))
)
column("FIL-15", "site_analysis", "analysis_id", "same_site", lambda: X.host(F.col("url")) == F.regexp_replace(F.lower("site_host"), r"^www\.", ""), f"{HOST_SQL.format('url')} = regexp_replace(lower(site_host), '^www\\.', '')")
on("FIL-21", "contact_candidate", "select candidate_id, e as email, (regexp_extract(lower(e),'@([^@\\s>]+)$',1) = lower(site_host) or ends_with(regexp_extract(lower(e),'@([^@\\s>]+)$',1), '.' || lower(site_host))) as own from (select candidate_id, site_host, unnest(emails) as e from contact_candidate) where e is not null")(
    lambda d: d.select("candidate_id", "site_host", F.explode("emails").alias("email")).where("email is not null").select("candidate_id", "email", ((X.email_domain(F.col("email")) == F.lower("site_host")) | F.endswith(X.email_domain(F.col("email")), F.concat(F.lit("."), F.lower("site_host")))).alias("own"))
)
column("FIL-32", "site_analysis", "analysis_id", "thin", lambda: (F.col("basic_seo.word_count") < 40) & (F.col("technical_seo.total_links_found") <= 2), "basic_seo.word_count < 40 and technical_seo.total_links_found <= 2")
on("FIL-37", "orders", "select o_orderkey from orders where o_totalprice between least(200000.0, 100000.0) and greatest(200000.0, 100000.0) and contains(lower(o_orderpriority), 'urgent')")(
    lambda d: d.where(F.col("o_totalprice").between(F.least(F.lit(200000.0), F.lit(100000.0)), F.greatest(F.lit(200000.0), F.lit(100000.0))) & F.contains(F.lower("o_orderpriority"), F.lit("urgent"))).select("o_orderkey")
)
column("FIL-38", "company", "row_id", "needs_search", lambda: ~X.is_filled(F.col("Hjemmeside")), f"Hjemmeside is null or {BLANK_SQL.format('Hjemmeside')}")

# --- rules ----------------------------------------------------------------------------------------------------------
BOOK = [
    {"rule": "https", "type": "bool_true", "data_key": "is_https", "points": 20},
    {"rule": "status", "type": "equals", "data_key": "status_code", "threshold": 200, "points": 10},
    {"rule": "speed", "type": "lte", "data_key": "response_time_ms", "levels": [{"threshold": 200, "points": 15}, {"threshold": 500, "points": 10}, {"threshold": 1000, "points": 5}]},
    {"rule": "words", "type": "range", "data_key": "word_count", "levels": [{"min": 300, "points": 12}, {"min": 100, "max": 299, "points": 6}]},
    {"rule": "title", "type": "present", "data_key": "title_text", "points": 8},
    {"rule": "banner", "type": "true_if_present", "data_key": "detection_method", "points": 4},
    {"rule": "render", "type": "contains", "data_key": "render_status", "threshold": "Content", "points": 3},
    {"rule": "fetch", "type": "one_of", "data_key": "fetch_method", "threshold": ["httpx", "playwright"], "points": 2},
    {"rule": "canonical", "type": "regex", "data_key": "canonical_url", "threshold": "^https://", "points": 5},
    {"rule": "links", "type": "<", "data_key": "broken_links_count", "threshold": 5, "points": 7},
]
RULE_FIELDS = {
    "is_https": "technical_seo.is_https", "status_code": "technical_seo.status_code", "response_time_ms": "technical_seo.response_time_ms", "word_count": "basic_seo.word_count",
    "title_text": "basic_seo.title_text", "detection_method": "privacy.detection_method", "render_status": "technical_seo.render_status", "fetch_method": "fetch_method",
    "canonical_url": "basic_seo.canonical_url", "broken_links_count": "technical_seo.broken_links_count",
}
RULE_SQL = {
    "https": "case when technical_seo.is_https then 20 else 0 end",
    "status": "case when technical_seo.status_code = 200 then 10 else 0 end",
    "speed": "case when technical_seo.response_time_ms <= 200 then 15 when technical_seo.response_time_ms <= 500 then 10 when technical_seo.response_time_ms <= 1000 then 5 else 0 end",
    "words": "case when basic_seo.word_count >= 300 then 12 when basic_seo.word_count between 100 and 299 then 6 else 0 end",
    "title": "case when basic_seo.title_text <> '' then 8 else 0 end",
    "banner": "case when privacy.detection_method is not null then 4 else 0 end",
    "render": "case when contains(lower(technical_seo.render_status), 'content') then 3 else 0 end",
    "fetch": "case when fetch_method in ('httpx','playwright') then 2 else 0 end",
    "canonical": "case when regexp_matches(basic_seo.canonical_url, '(?i)^https://') then 5 else 0 end",
    "links": "case when technical_seo.broken_links_count < 5 then 7 else 0 end",
}


def _points(df: DataFrame) -> dict:
    return rules.scored({k: F.col(c) for k, c in RULE_FIELDS.items()}, BOOK)


for _id, _rule in {"RUL-01": "https", "RUL-02": "status", "RUL-05": "words", "RUL-06": "title", "RUL-07": "banner", "RUL-09": "fetch"}.items():
    on(_id, "site_analysis", f"select analysis_id, {RULE_SQL[_rule]} as points from site_analysis")(lambda d, r=_rule: d.select("analysis_id", _points(d)[r].alias("points")))
