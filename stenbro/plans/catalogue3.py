"""More operators of the coverage list: filters, rules, joins, merges, texts, addresses, dates, pages, files.

The SQL of an operator says what the list says of it, on the same whole tables; where a table lacks an operator's kind
of input (pages, sitemaps, files), both sides start from the same rows: one writes them in that form and reads them
back with the operator, the other takes them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stenbro.functions import dates as D
from stenbro.functions import text as X
from stenbro.functions import web as W
from stenbro.operators import html as H
from stenbro.operators import relational as R
from stenbro.operators import rules
from stenbro.plans.catalogue import BLANK_SQL, NAME, column, on
from stenbro.plans.catalogue2 import both
from stenbro.queries import query
from stenbro.session import scratch, table
from stenbro.sources import files

# --- SQL of address parts -------------------------------------------------------------------------------------------
SCHEME = "regexp_extract({0}, '^([^:/?#]+):', 1)"
NETLOC = "regexp_extract({0}, '^(?:[^:/?#]+:)?//([^/?#]*)', 1)"
PATH = "regexp_extract({0}, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1)"
QUERY = "regexp_extract({0}, '^[^?#]*\\?([^#]*)', 1)"
HOST = f"lower(regexp_extract({NETLOC}, '^(?:[^@]*@)?([^:]*)', 1))"
BARE = f"regexp_replace({HOST}, '^www\\.', '')"
SEGMENTS = f"list_filter(string_split(lower({PATH}), '/'), lambda s: s <> '')"
ASSET = "regexp_matches(lower(split_part({0},'?',1)), '\\.(jpg|jpeg|png|gif|webp|svg|css|js|pdf|zip|ico|woff2?|mp4)$')"
LINKS_SQL = "(select analysis_id, url, unnest(technical_seo.discarded_links).href as href from site_analysis union all select analysis_id, url, unnest(technical_seo.broken_links_list) from site_analysis)"
COLLAPSE = "trim(regexp_replace({0}, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ')"


def links(d: DataFrame) -> DataFrame:
    """Every link that an analysis lists."""
    discarded = d.select("analysis_id", "url", F.explode("technical_seo.discarded_links").alias("l")).select("analysis_id", "url", F.col("l.href").alias("href"))
    return discarded.unionByName(d.select("analysis_id", "url", F.explode("technical_seo.broken_links_list").alias("href")))


# --- filters --------------------------------------------------------------------------------------------------------
AGG_DOMAINS = r"facebook\.com|instagram\.com|linkedin\.com|krak\.dk|proff\.dk|danskevirksomheder\.dk|trustpilot\.com|trustpilot\.dk|findsmiley\.dk|cvr\.dk|virk\.dk|maps\.google\.|goo\.gl|g\.page|118\.dk|degulesider\.dk|gulesider\.dk"
SITE_SQL = f"(select row_id, {HOST.format('Hjemmeside')} as h from company union all select row_id, regexp_extract(lower(Email), '@([a-z0-9.-]+)', 1) from company)"


def hosts(d: DataFrame) -> DataFrame:
    """Hosts that company rows name: of their site and of their mail address."""
    return d.select("row_id", W.host_of(F.col("Hjemmeside")).alias("h")).unionByName(d.select("row_id", F.regexp_extract(F.lower("Email"), "@([a-z0-9.-]+)", 1).alias("h")))


on("FIL-10", "company", f"select row_id, h, regexp_matches(h, '(?:^|\\.)(?:anmeld-haandvaerker|haandvaerker|find-virksomhed|3byggetilbud|tekniq|cvrapi)\\.dk$|(?:^|\\.)(?:facebook|linkedin|wixsite)\\.com$') as aggregator from {SITE_SQL}")(
    lambda d: hosts(d).withColumn("aggregator", F.col("h").rlike(W.AGGREGATORS))
)
on("FIL-13", "site_analysis", f"select analysis_id, href, regexp_matches({HOST.format('href')}, '^(m2|cdn|media|assets|static)\\.') as cdn from {LINKS_SQL}")(
    lambda d: links(d).select("analysis_id", "href", W.host_of(F.col("href")).rlike(W.CDN_HOST).alias("cdn"))
)
#: Addresses made of an analysis' numbers, in and out of the private ranges.
IP_SQL = "concat_ws('.', [10, 127, 172, 192, 169, 8][(analysis_id % 6 + 1)::int]::varchar, [16, 31, 32, 168, 254, 15][(analysis_id // 7 % 6 + 1)::int]::varchar, (analysis_id % 256)::varchar, (analysis_id // 3 % 300)::varchar)"


def _ip(key: str) -> Column:
    k = F.col(key)
    first, second = (F.element_at(F.array(*map(F.lit, x)), i.cast("int")) for x, i in (((10, 127, 172, 192, 169, 8), k % 6 + 1), ((16, 31, 32, 168, 254, 15), F.floor(k / 7) % 6 + 1)))
    return F.concat_ws(".", first, second, k % 256, F.floor(k / 3) % 300)


on("FIL-14", "site_analysis", f"""select analysis_id, ip, p[4]::int < 256 and (p[1] in ('10','127') or (p[1] = '172' and p[2]::int between 16 and 31) or (p[1] = '192' and p[2] = '168') or (p[1] = '169' and p[2] = '254')) as private from (select analysis_id, {IP_SQL} as ip, string_split({IP_SQL}, '.') as p from site_analysis)""")(
    lambda d: d.select("analysis_id", _ip("analysis_id").alias("ip")).withColumn("private", W.is_private_ip(F.col("ip")))
)
on("FIL-17", "contact_candidate", f"select candidate_id, len(list_filter(['/om', '/kontakt', '/team/a'], lambda r: starts_with({PATH.format('url')}, r))) > 0 as disallowed from contact_candidate")(
    lambda d: d.select("candidate_id", F.exists(F.array(*map(F.lit, ("/om", "/kontakt", "/team/a"))), lambda r: W.part(F.col("url"), 3).startswith(r)).alias("disallowed"))
)
column("FIL-18", "contact_candidate", "candidate_id", "negative", lambda: F.lower("url").rlike("|".join(W.NEGATIVE)), f"regexp_matches(lower(url), '{'|'.join(W.NEGATIVE)}')")
on("FIL-19", "contact_candidate", f"select candidate_id, len(list_filter({W.CONTACT_SLUGS!r}, lambda s: ends_with(p, s) or contains('/' || p || '/', '/' || s || '/'))) > 0 as contactish from (select candidate_id, trim(lower({PATH.format('url')}), '/') as p from contact_candidate)")(
    lambda d: d.select("candidate_id", F.btrim(F.lower(W.part(F.col("url"), 3)), F.lit("/")).alias("p")).select("candidate_id", F.exists(F.array(*map(F.lit, W.CONTACT_SLUGS)), lambda s: F.col("p").endswith(s) | F.contains(F.concat(F.lit("/"), "p", F.lit("/")), F.concat(F.lit("/"), s, F.lit("/")))).alias("contactish"))
)
on("FIL-22", "documents", """with p as (select doc_id, regexp_replace(text, '<[^<>]*>', ' ', 'g') as t, unnest(list_distinct(regexp_extract_all(text, '\\b[0-9]{8}\\b'))) as phone from documents) select doc_id, phone, contains(lower(substr(t, greatest(1, strpos(t, phone) - 20), 48 - greatest(0, 21 - strpos(t, phone)))), 'cvr') as dropped from p where strpos(t, phone) > 0""")(
    lambda d: d.select("doc_id", F.regexp_replace("text", "<[^<>]*>", " ").alias("t"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b[0-9]{8}\b"), F.lit(0)))).alias("phone"))
    .withColumn("at", F.position("phone", "t")).where("at > 0")
    .select("doc_id", "phone", F.contains(F.lower(F.substr("t", F.greatest(F.lit(1), F.col("at") - 20), F.lit(48) - F.greatest(F.lit(0), F.lit(21) - F.col("at")))), F.lit("cvr")).alias("dropped"))
)
SEG = "len(list_filter(range(1, 99), lambda k: k <= len(a) and k <= len(b) and a[1:k] = b[1:k]))"
on("FIL-42", "site_analysis", f"""select analysis_id, coalesce({SCHEME.format('c')} = {SCHEME.format('url')} and {NETLOC.format('c')} = {NETLOC.format('url')} and ({PATH.format('c')} = {PATH.format('url')} or {SEG} > 0), false) as valid from (select analysis_id, url, basic_seo.canonical_url as c, {SEGMENTS.format('url')} as a, {SEGMENTS.format('basic_seo.canonical_url')} as b from site_analysis)""")(
    lambda d: d.select("analysis_id", "url", F.col("basic_seo.canonical_url").alias("c")).select("analysis_id", F.coalesce((W.part(F.col("c"), 1) == W.part(F.col("url"), 1)) & (W.part(F.col("c"), 2) == W.part(F.col("url"), 2)) & ((W.part(F.col("c"), 3) == W.part(F.col("url"), 3)) | (W.same_start(F.col("c"), F.col("url")) > 0)), F.lit(False)).alias("valid"))
)
ACCEPT, REJECT = "product\\.current|category\\.current|page\\.current|canonical_primary_url|custom_canonical_url|link_canonical", "menucategories|categoriesmap|navigation|menu|header|footer|sidebar"
KEYS = ["state.Page.current", "menu.page.current", "store.product.current.url", "x", "a.link_canonical", "FOOTER.link_canonical", "", "category.currently"]
query("FIL-43", f"select k, regexp_matches(lower(k), '{ACCEPT}') and not regexp_matches(lower(k), '{REJECT}') as accepted from (select unnest({KEYS!r}) as k)")(
    lambda spark, _: spark.createDataFrame([(k,) for k in KEYS], "k string").withColumn("accepted", F.lower("k").rlike(ACCEPT) & ~F.lower("k").rlike(REJECT))
)
on("FIL-44", "company", f"select row_id, case when Hjemmeside is null or {BLANK_SQL.format('Hjemmeside')} then 'MISSING_URL' when not regexp_matches({HOST.format('u')}, '^[a-z0-9.-]+\\.[a-z]{{2,}}$') then 'INVALID_URL' when lower(HjemmesideLiveBool) = 'false' then 'DEAD_DOMAIN' else 'OK' end as status from (select *, case when contains(Hjemmeside, '://') then trim(Hjemmeside) else 'https://' || trim(Hjemmeside) end as u from company)")(
    lambda d: d.withColumn("u", F.when(F.contains(F.col("Hjemmeside"), F.lit("://")), F.trim("Hjemmeside")).otherwise(F.concat(F.lit("https://"), F.trim("Hjemmeside"))))
    .select("row_id", F.when(~X.is_filled(F.col("Hjemmeside")), "MISSING_URL").when(~W.host_of(F.col("u")).rlike(r"^[a-z0-9.-]+\.[a-z]{2,}$"), "INVALID_URL").when(F.lower("HjemmesideLiveBool") == "false", "DEAD_DOMAIN").otherwise("OK").alias("status"))
)

# --- rules ----------------------------------------------------------------------------------------------------------
SPELLED = sorted({*rules.SYNONYMS, *rules.SYNONYMS.values(), " LTE ", "Boolean_True", "whatever"})
query("RUL-00", "select s, coalesce(m, trim(lower(s))) as name from (values " + ", ".join(f"('{s}', {repr(rules.SYNONYMS.get(s.strip().lower())) if s.strip().lower() in rules.SYNONYMS else 'null'})" for s in SPELLED) + ") t(s, m)")(
    lambda spark, _: spark.createDataFrame([(s, rules.operator_name(s)) for s in SPELLED], "s string, name string")
)
RULES_GIVEN = [{"type": "gte", "threshold": 3}, {"type": "<", "threshold": 5}, {"type": "eq", "threshold": 1}, {"type": "range", "min": 1, "max": 2}, {"type": ">", "threshold": 3, "min": 4}]
query("PRJ-12", "select * from (values (0, 3, null::int, null::int), (1, null, 5, null), (2, null, null, 1), (3, 1, 2, null), (4, 4, null, null)) t(k, lo, hi, same)")(
    lambda spark, _: spark.createDataFrame([(k, *(rules.bounds(r).get(x) for x in ("min", "max", "equals"))) for k, r in enumerate(RULES_GIVEN)], "k int, lo int, hi int, same int")
)


@rules.function("distinct_signals")
def _signals(p: dict[str, Column]) -> Column:
    """25 for two different signals or more, 10 for one."""
    n = F.size(F.array_distinct(F.transform(F.coalesce(p["value"], F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))))
    return F.when(n >= 2, 25).when(n == 1, 10).otherwise(0)


@rules.function("tenth_of_percent")
def _tenth(p: dict[str, Column]) -> Column:
    """A tenth of a percentage, kept between 0 and 100, rounded half to even."""
    return F.bround(F.least(F.greatest(p["pct"].cast("double"), F.lit(0.0)), F.lit(100.0)) / 10)


RULE_BOOK = [
    {"section": "technical_seo", "rule": "https", "type": "boolean_true", "data_key": "is_https", "points": 25},
    {"section": "technical_seo", "rule": "status", "type": "eq", "data_key": "status_code", "threshold": 200, "points": 55},
    {"section": "technical_seo", "rule": "speed", "type": "range", "data_key": "response_time_ms", "levels": [{"max": 200, "points": 15}, {"max": 800, "points": 0}]},
    {"section": "basic_seo", "rule": "title_length", "type": "range", "data_key": "title_length", "levels": [{"min": 50, "max": 60, "points": 10}, {"min": 40, "max": 70, "points": 5}, {"min": 0, "max": 200, "points": 0}]},
    {"section": "authority", "rule": "words", "type": "gte", "data_key": "word_count", "threshold": 300, "points": 25},
    {"section": "conversion", "rule": "cta", "type": "range", "data_key": "conversion.cta_score", "levels": [{"min": 80, "points": 60}, {"min": 40, "points": 30}]},
    {"section": "conversion", "rule": "trust", "function_name": "distinct_signals", "data_key": "trust_signals_found"},
    {"section": "privacy", "rule": "banner", "function_name": "tenth_of_percent", "data_keys": {"pct": "conversion.cta_score"}},
    {"section": "privacy", "rule": "none", "function_name": "never_registered", "data_key": "cookie_banner_detected"},
    {"section": "privacy", "rule": "absent", "type": "present", "data_key": "no_such_key", "points": 5},
]
MOST = 25 + 55 + 15 + 10 + 25 + 60 + 25 + 10 + 0 + 5
CASES = {
    "https": ("technical_seo.is_https", "case when v then 25 else 0 end", "coalesce(v, false)"),
    "status": ("technical_seo.status_code", "case when v = 200 then 55 else 0 end", "v = 200"),
    "speed": ("technical_seo.response_time_ms", "case when v <= 200 then 15 else 0 end", "v <= 800"),
    "title_length": ("basic_seo.title_length", "case when v between 50 and 60 then 10 when v between 40 and 70 then 5 else 0 end", "v between 0 and 200"),
    "words": ("basic_seo.word_count", "case when v >= 300 then 25 else 0 end", "v >= 300"),
    "cta": ("conversion.cta_score", "case when v >= 80 then 60 when v >= 40 then 30 else 0 end", "v >= 40"),
    "trust": ("coalesce(len(list_distinct(list_transform(conversion.trust_signals_found, lambda x: lower(trim(x))))), 0)", "case when v >= 2 then 25 when v = 1 then 10 else 0 end", "v >= 1"),
    "banner": ("coalesce(round_even(least(greatest(conversion.cta_score, 0), 100) / 10, 0)::int, 0)", "v", "v > 0"),
    "none": ("0", "0", "false"),
    "absent": ("null::int", "0", "false"),
}
LONG_SQL = "(" + " union all ".join(
    f"select analysis_id, {k} as ordinal, '{r['section']}' as section, '{n}' as rule, coalesce({p}, 0)::int as points, case when v is null then 'not_evaluated' when {t} then 'achieved' else 'failed' end as status from (select analysis_id, {v} as v from site_analysis)"
    for k, r in enumerate(RULE_BOOK) for n in [r["rule"]] for v, p, t in [CASES[n]]
) + ")"


def judged(d: DataFrame) -> DataFrame:
    return rules.evaluated(d, "analysis_id", RULE_BOOK)


on("JOI-11", "site_analysis", f"select * from {LONG_SQL}")(judged)
on("RUL-12", "site_analysis", f"select analysis_id, rule, points, points > 0 as passed from {LONG_SQL} where rule in ('trust', 'banner', 'none')")(lambda d: judged(d).where("rule in ('trust', 'banner', 'none')").select("analysis_id", "rule", "points", (F.col("points") > 0).alias("passed")))
on("UDF-01", "site_analysis", f"select rule, sum(points)::bigint as points from {LONG_SQL} where rule in ('trust', 'none') group by 1")(lambda d: judged(d).where("rule in ('trust', 'none')").groupBy("rule").agg(F.sum("points").alias("points")))
on("RUL-13", "site_analysis", f"select rule, status, count(*) as n from {LONG_SQL} group by 1, 2")(lambda d: judged(d).groupBy("rule", "status").agg(F.count("*").alias("n")))
on("RUL-14", "site_analysis", f"select analysis_id, sum(points)::bigint as total, round_even(sum(points) * 100.0 / {MOST}, 0)::bigint as percent, coalesce(string_agg(rule, ',' order by points desc, ordinal) filter (where status = 'achieved'), '') as achieved from {LONG_SQL} group by 1")(
    lambda d: rules.rolled_up(judged(d), "analysis_id", MOST).withColumn("achieved", F.array_join("achieved", ","))
)
on("SRT-04", "site_analysis", f"select analysis_id, rule, row_number() over (partition by analysis_id order by points desc, ordinal) as pos from {LONG_SQL} where status = 'achieved'")(
    lambda d: rules.rolled_up(judged(d), "analysis_id", MOST).select("analysis_id", F.posexplode("achieved").alias("pos", "rule")).withColumn("pos", F.col("pos") + 1)
)
on("SET-08", "site_analysis", f"select analysis_id, rule, status from {LONG_SQL}")(
    lambda d: (lambda j: j.where("status = 'achieved'").select("analysis_id", "rule", F.lit("achieved").alias("status")).unionByName(j.where("status = 'failed'").select("analysis_id", "rule", F.lit("failed").alias("status"))).unionByName(j.where("status = 'not_evaluated'").select("analysis_id", "rule", F.lit("not_evaluated").alias("status"))))(judged(d))
)
on("SNK-10", "site_analysis", f"select analysis_id, row_number() over (partition by analysis_id order by rule) as no, rule, status, points from {LONG_SQL}")(
    lambda d: judged(d).select("analysis_id", F.row_number().over(Window.partitionBy("analysis_id").orderBy("rule")).alias("no"), "rule", "status", "points")
)
on("PRJ-21", "site_analysis", f"select analysis_id, rule, rule || case when status = 'not_evaluated' then ' (N/A)' else ' (' || points || ')' end as label from {LONG_SQL}")(
    lambda d: judged(d).select("analysis_id", "rule", F.concat("rule", F.when(F.col("status") == "not_evaluated", " (N/A)").otherwise(F.concat(F.lit(" ("), F.col("points").cast("string"), F.lit(")")))).alias("label"))
)
LEVELS = {r["rule"]: max([r.get("points", 0), *(x["points"] for x in r.get("levels", []))]) for r in RULE_BOOK}
VALUES_SQL = "(values " + ", ".join(f"('{k}', {v})" for k, v in LEVELS.items()) + ") b(rule, most)"


def book(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEVELS.items()), "rule string, most int")


query("PRJ-22", f"select rule, most from {VALUES_SQL}")(lambda spark, _: book(spark))
on("JOI-15", "site_analysis", f"select analysis_id, rule, points, most from {LONG_SQL} left join {VALUES_SQL} using (rule)")(
    lambda d: judged(d).join(F.broadcast(book(d.sparkSession)), "rule", "left").select("analysis_id", "rule", "points", "most")  # one row a rule of the book
)
on("PRJ-07", "site_analysis", "select analysis_id, basic_seo.title_text as title, conversion.cta_score as cta, technical_seo.response_time_ms as ms, null::varchar as absent, url from site_analysis")(
    lambda d: d.select("analysis_id", *[rules.looked_up(d.schema, s, k).alias(n) for s, k, n in (("technical_seo", "title_text", "title"), ("basic_seo", "conversion.cta_score", "cta"), ("technical_seo", "response_time_ms", "ms"))], rules.looked_up(d.schema, "privacy", "absent").cast("string").alias("absent"), rules.looked_up(d.schema, "privacy", "url").alias("url"))
)
EVERY_KIND = {
    "bool_true": ("technical_seo.is_https", {}, "coalesce(technical_seo.is_https, false)"), "equals": ("technical_seo.status_code", {"threshold": 200}, "coalesce(technical_seo.status_code = 200, false)"),
    "gt": ("basic_seo.word_count", {"threshold": 100}, "coalesce(basic_seo.word_count > 100, false)"), "gte": ("basic_seo.word_count", {"threshold": 100}, "coalesce(basic_seo.word_count >= 100, false)"),
    "lt": ("basic_seo.word_count", {"threshold": 100}, "coalesce(basic_seo.word_count < 100, false)"), "lte": ("basic_seo.word_count", {"threshold": 100}, "coalesce(basic_seo.word_count <= 100, false)"),
    "range": ("basic_seo.h1_count", {"min": 1, "max": 2}, "coalesce(basic_seo.h1_count between 1 and 2, false)"), "present": ("basic_seo.title_text", {}, "coalesce(basic_seo.title_text <> '', false)"),
    "true_if_present": ("basic_seo.title_text", {}, "basic_seo.title_text is not null"), "contains": ("technical_seo.render_status", {"threshold": "CONTENT"}, "coalesce(contains(lower(technical_seo.render_status), 'content'), false)"),
    "one_of": ("fetch_method", {"threshold": ["httpx"]}, "coalesce(fetch_method = 'httpx', false)"), "regex": ("url", {"threshold": "^HTTPS://www"}, "coalesce(regexp_matches(url, '(?i)^https://www'), false)"),
}
on("UDF-02", "site_analysis", "select analysis_id, " + ", ".join(f'{sql} as "is_{k}"' for k, (_, _, sql) in EVERY_KIND.items()) + " from site_analysis")(
    lambda d: d.select("analysis_id", *[rules.predicate(F.col(c), k, **args).alias(f"is_{k}") for k, (c, args, _) in EVERY_KIND.items()])
)

# --- projections ----------------------------------------------------------------------------------------------------
SECTION_FIELDS = {
    "basic_seo": "h1 h1_count meta_description meta_description_length title_text title_length word_count canonical_url canonical_error schema_markup_found".split(),
    "technical_seo": "status_code is_https robots_txt_found sitemap_xml_found response_time_ms total_pages_crawled total_links_found broken_links_count links_checked render_status rendered_content_length soft_404_suspected".split(),
    "conversion": "has_ga4 has_gtm ga4_measurement_id cta_score".split(),
    "privacy": "cookie_banner_detected detection_method cookie_banner_confidence".split(),
}
FLAT_SQL = ", ".join(f"{s}.{f} as {s}_{f}" for s, fs in SECTION_FIELDS.items() for f in fs)


def scalars(d: DataFrame) -> DataFrame:
    return d.select(*[c for c, t in d.dtypes if not t.startswith(("array", "map", "struct"))])


on("PRJ-01", "site_analysis", f"select analysis_id, {FLAT_SQL}, conversion.forms_meta.form_count as conversion_forms_meta_form_count from site_analysis")(lambda d: scalars(R.flattened(d.select("analysis_id", *SECTION_FIELDS))))
on("PRJ-02", "site_analysis", f"select url, analysis_id, {FLAT_SQL} from site_analysis")(lambda d: d.select("url", "analysis_id", *[F.col(f"{s}.{f}").alias(f"{s}_{f}") for s, fs in SECTION_FIELDS.items() for f in fs]))
on("JOI-02", "site_analysis", f"select analysis_id, {FLAT_SQL} from site_analysis")(
    lambda d: R.joined_sections(d, "analysis_id", {s: [f"{s}.{f}" for f in fs] for s, fs in SECTION_FIELDS.items()})
)
on("PRJ-08", "analysis_raw", "with d as (select analysis_id, coalesce(payload::json->'$.analysis', payload::json) as j from analysis_raw where payload is not null and json_valid(payload) and json_type(payload::json) = 'OBJECT') select analysis_id, case when json_exists(j, '$.fetch_method') then j->>'$.fetch_method' else 'unknown' end as fetch_method, case when json_exists(j, '$.url') then j->>'$.url' else '' end as url, case when json_exists(j, '$.benchmark_complete') then j->>'$.benchmark_complete' else 'false' end as benchmark_complete from d")(
    lambda d: R.overlaid(R.json_objects(d, "analysis_id", "payload"), {"fetch_method": "unknown", "url": "", "benchmark_complete": "false"}).select("analysis_id", "fetch_method", "url", "benchmark_complete")
)
column("PRJ-13", "events", "event_id", "v", lambda: X.unwrapped(F.when(F.col("event_id") % 2 == 0, F.replace(F.col("props"), F.lit('"k"'), F.lit('"value"'))).otherwise(F.col("props"))), "case when event_id % 2 = 0 then props->>'$.k' else props end")
on("PRJ-15", "company", f"select row_id, case when contains(Telefon, '@') then 'email' when length(regexp_replace(Telefon,'[^0-9]','','g')) >= 8 then 'phone' when contains(Telefon, '.') then 'website' else 'other' end as kind, regexp_replace(Telefon,'[^0-9]','','g') as digits, length(Telefon) as size from company")(
    lambda d: d.select("row_id", X.contact_kind(F.col("Telefon")).alias("s")).select("row_id", "s.*")
)
RANKED = "row_number() over (partition by site_host order by (name is not null and trim(name) <> '') desc, coalesce(len(emails), 0) desc, dom_distance nulls last, candidate_id)"
on("PRJ-18", "contact_candidate", f"select site_host, max(name) filter (where r = 1) as best_name, max(title) filter (where r = 1) as best_title, max(array_to_string(emails, '; ')) filter (where r = 1) as best_emails, string_agg(candidate_id, ',' order by r) as listed from (select *, {RANKED} as r from contact_candidate) where r <= 5 group by 1")(
    lambda d: R.best_of(d, ["site_host"], [F.desc(F.coalesce(F.trim("name") != "", F.lit(False))), F.desc(F.coalesce(F.size("emails"), F.lit(0))), F.asc_nulls_last("dom_distance"), F.col("candidate_id")], ["name", "title", "emails", "candidate_id"], 5)
    .select("site_host", F.get("all", F.lit(0))["name"].alias("best_name"), F.get("all", F.lit(0))["title"].alias("best_title"), F.array_join(F.get("all", F.lit(0))["emails"], "; ").alias("best_emails"), F.array_join(F.transform("all", lambda x: x["candidate_id"].cast("string")), ",").alias("listed"))
)
on("PRJ-20", "analysis_raw", "select analysis_id, url, count(*) as n from (select r.analysis_id, t.atom as url from (select analysis_id, payload from analysis_raw where payload is not null and json_valid(payload)) r, lateral (select json_extract_string(value, '$') as atom from json_tree(r.payload::json) where type = 'VARCHAR') t) where regexp_matches(url, '^https?://') group by 1, 2")(
    lambda d: R.nested_urls(d, "analysis_id", "payload").groupBy("analysis_id", "url").agg(F.count("*").alias("n"))
)

# --- joins, aggregates, windows -------------------------------------------------------------------------------------
INITIALS = "lower(array_to_string(list_transform(list_filter(string_split(trim(name), ' '), lambda w: w <> ''), lambda w: w[1:1]), ''))"
both("JOI-07", "contact_candidate", "contact_candidate", f"""with n as (select site_host, {INITIALS} as i, min(candidate_id) as c from contact_candidate where name is not null and trim(name) <> '' and length({INITIALS}) between 2 and 3 group by 1, 2), e as (select candidate_id, site_host, regexp_replace(lower(split_part(unnest(emails), '@', 1)), '[^a-zæøå]', '', 'g') as i from contact_candidate where name is null or trim(name) = '') select candidate_id, e.i as initials, n.c as named from e join n using (site_host, i)""")(
    lambda a, b: (lambda i: a.where("name is null or trim(name) = ''").select("candidate_id", "site_host", F.explode("emails").alias("e")).select("candidate_id", "site_host", F.regexp_replace(F.lower(F.split_part("e", F.lit("@"), F.lit(1))), "[^a-zæøå]", "").alias("initials"))
    .join(b.where("trim(name) <> ''").select("site_host", i.alias("initials"), "candidate_id").where(F.length("initials").between(2, 3)).groupBy("site_host", "initials").agg(F.min("candidate_id").alias("named")), ["site_host", "initials"]).select("candidate_id", "initials", "named"))(
        F.lower(F.array_join(F.transform(F.filter(F.split(F.trim("name"), " "), lambda w: w != ""), lambda w: F.substr(w, F.lit(1), F.lit(1))), ""))
    )
)
QUEUE = f"(case when {SCHEME.format('{0}')} = '' then 'https' else lower({SCHEME.format('{0}')}) end || '://' || regexp_replace(regexp_replace(lower({NETLOC.format('{0}')}), case when lower({SCHEME.format('{0}')}) = 'http' then ':80$' else 'Ø' end, ''), case when lower({SCHEME.format('{0}')}) in ('https', '') then ':443$' else 'Ø' end, '') || case when regexp_replace({PATH.format('{0}')}, '/+$', '') = '' then '/' else regexp_replace({PATH.format('{0}')}, '/+$', '') end || case when {QUERY.format('{0}')} <> '' then '?' || {QUERY.format('{0}')} else '' end)"
column("URL-01", "site_analysis", "analysis_id", "u", lambda: W.queue_url(F.col("url")), QUEUE.format("url"))
both("JOI-14", "contact_candidate", "site_analysis", f"select candidate_id, count(analysis_id) as n from contact_candidate c left join (select analysis_id, {SCHEME.format('url')} as s, {HOST.format('url')} as h, rtrim({PATH.format('url')}, '/') as p from site_analysis) a on a.s = {SCHEME.format('c.url')} and a.h = {HOST.format('c.url')} and a.p = rtrim({PATH.format('c.url')}, '/') group by 1")(
    lambda c, a: R.counted_by_url(c, "candidate_id", a, "analysis_id")
)
both("JOI-16", "site_analysis", "site_analysis", f"with p as (select {QUEUE.format('url')} as u, max(technical_seo.status_code) as status from site_analysis group by 1), l as (select analysis_id, href from {LINKS_SQL} where href is not null) select analysis_id, href, coalesce(status, 0) >= 400 as broken, status is null as unprobed from l left join p on p.u = {QUEUE.format('l.href')}")(
    lambda a, b: links(a).where("href is not null").select("analysis_id", "href", W.queue_url(F.col("href")).alias("u")).join(b.groupBy(W.queue_url(F.col("url")).alias("u")).agg(F.max("technical_seo.status_code").alias("status")), "u", "left").select("analysis_id", "href", (F.coalesce("status", F.lit(0)) >= 400).alias("broken"), F.col("status").isNull().alias("unprobed"))
)
on("AGG-11", "site_analysis", f"select analysis_id, case when count(distinct href) > 0 then round_even(100.0 * count(distinct href) filter (where {BARE.format('href')} = {BARE.format('url')}) / count(distinct href), 0)::bigint else 0 end as score from {LINKS_SQL} group by 1")(
    lambda d: links(d).groupBy("analysis_id").agg(F.count_distinct("href").alias("n"), F.count_distinct(F.when(W.bare_host(F.col("href")) == W.bare_host(F.col("url")), F.col("href"))).alias("own")).select("analysis_id", F.when(F.col("n") > 0, F.bround(F.col("own") * 100.0 / F.col("n"), 0)).otherwise(0).cast("bigint").alias("score"))
)
on("AGG-16", "company", """select remark, n from (select "HjemmesideBemærkning" as remark, count(*) as n from company where lower(HjemmesideLiveBool) = 'false' group by 1) order by n desc, remark limit 5""")(
    lambda d: d.where(F.lower("HjemmesideLiveBool") == "false").groupBy(F.col("HjemmesideBemærkning").alias("remark")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "remark").limit(5)
)
on("AGG-24", "url_cache", "select count(*) as rows_seen, count(*) filter (where reason = 'OK') as hits, round(100.0 * count(*) filter (where reason = 'OK') / count(*), 1)::double as hit_pct, avg(length(title))::double as avg_title from url_cache")(
    lambda d: d.agg(F.count("*").alias("rows_seen"), F.count_if(F.col("reason") == "OK").alias("hits"), F.round(F.count_if(F.col("reason") == "OK") * 100.0 / F.count("*"), 1).cast("double").alias("hit_pct"), F.avg(F.length("title")).alias("avg_title"))
)
MERGED_SQL = """select site_host, bool_or(conversion.has_ga4) as conversion_has_ga4, sum(technical_seo.total_links_found)::bigint as technical_seo_total_links_found, max(conversion.cta_score) as conversion_cta_score, arg_max(technical_seo.render_status, analysis_id) filter (where technical_seo.render_status is not null) as technical_seo_render_status, round(sum(privacy.cookie_banner_confidence), 6) as privacy_cookie_banner_confidence, coalesce(u.found, '') as conversion_trust_signals_found from site_analysis left join (select site_host, array_to_string(list_sort(list(distinct x)), '; ') as found from (select site_host, unnest(conversion.trust_signals_found) as x from site_analysis) where x is not null group by 1) u using (site_host) group by site_host, u.found"""
MERGED = ["conversion.has_ga4", "technical_seo.total_links_found", "conversion.cta_score", "technical_seo.render_status", "privacy.cookie_banner_confidence", "conversion.trust_signals_found"]


def merged(d: DataFrame) -> DataFrame:
    got = R.merged_sections(d, "site_host", "analysis_id", MERGED, most=("cta_score",))
    return got.withColumns({"privacy_cookie_banner_confidence": F.round("privacy_cookie_banner_confidence", 6), "conversion_trust_signals_found": F.array_join(F.array_sort("conversion_trust_signals_found"), "; ")})


on("AGG-12", "site_analysis", MERGED_SQL)(merged)
on("PRJ-09", "site_analysis", MERGED_SQL)(merged)
on("WIN-04", "site_analysis", f"select site_host, arg_min(u, (-s, k)) as canonical from (select site_host, analysis_id * 2 as k, 15 as s, basic_seo.canonical_url as u from site_analysis where basic_seo.canonical_url <> '' union all select site_host, analysis_id * 2 + 1, 6, url from site_analysis where url is not null) group by 1")(
    lambda d: d.where("basic_seo.canonical_url <> ''").select("site_host", (F.col("analysis_id") * 2).alias("k"), F.lit(15).alias("s"), F.col("basic_seo.canonical_url").alias("u")).unionByName(d.where("url is not null").select("site_host", (F.col("analysis_id") * 2 + 1).alias("k"), F.lit(6).alias("s"), F.col("url").alias("u"))).groupBy("site_host").agg(F.min_by("u", F.struct(-F.col("s"), "k")).alias("canonical"))
)
PHONES_SQL = "(select site_host, phone, sum(case source when 'json-ld' then 100 when 'mailto' then 50 else 20 end + case when regexp_matches(lower(url), 'kontakt|contact') then 15 else 0 end)::bigint as score, count(distinct url) as pages from (select site_host, source, url, unnest(phones) as phone from contact_candidate) where phone is not null group by 1, 2)"


def phones(d: DataFrame) -> DataFrame:
    """Weight and pages of every phone of a site: by the kind of source, more on a contact page."""
    weight = F.when(F.col("source") == "json-ld", 100).when(F.col("source") == "mailto", 50).otherwise(20) + F.when(F.lower("url").rlike("kontakt|contact"), 15).otherwise(0)
    return d.select("site_host", "source", "url", F.explode("phones").alias("phone")).where("phone is not null").groupBy("site_host", "phone").agg(F.sum(weight).alias("score"), F.count_distinct("url").alias("pages"))


on("AGG-15", "contact_candidate", f"select * from {PHONES_SQL}")(phones)
on("WIN-06", "contact_candidate", f"select site_host, phone, row_number() over (partition by site_host order by score desc, pages desc, starts_with(phone, '+45') desc, abs(length(regexp_replace(phone, '[^0-9]', '', 'g')) - 10), phone) as pos from {PHONES_SQL}")(
    lambda d: phones(d).select("site_host", "phone", F.row_number().over(Window.partitionBy("site_host").orderBy(F.desc("score"), F.desc("pages"), F.desc(F.col("phone").startswith("+45")), F.abs(F.length(X.phone_digits(F.col("phone"))) - 10), "phone")).alias("pos"))
)
on("WIN-08", "site_analysis", "select site_host, analysis_id, row_number() over (partition by site_host order by (regexp_replace(url, '/+$', '') = 'https://' || site_host) desc nulls last, analysis_id) as pos from site_analysis")(
    lambda d: d.select("site_host", "analysis_id", F.row_number().over(Window.partitionBy("site_host").orderBy(F.desc_nulls_last(F.regexp_replace("url", "/+$", "") == F.concat(F.lit("https://"), "site_host")), "analysis_id")).alias("pos"))
)
on("SRT-05", "lineitem", "select l_orderkey, l_linenumber from lineitem order by l_orderkey, l_linenumber limit 500")(lambda d: d.select("l_orderkey", "l_linenumber").orderBy("l_orderkey", "l_linenumber").limit(500))
on("SRT-07", "contact_candidate", f"select site_host, url, pos from (select site_host, url, row_number() over (partition by site_host order by regexp_matches(lower({PATH.format('url')}), 'kontakt|contact|team|om-os') desc, url) as pos from (select distinct site_host, url from contact_candidate)) where pos <= 8")(
    lambda d: R.top_per(d.select("site_host", "url").distinct(), ["site_host"], [F.desc(F.lower(W.part(F.col("url"), 3)).rlike("kontakt|contact|team|om-os")), F.col("url")], 8)
)
on("SET-05", "site_analysis", "select site_host, array_to_string(list_sort(list(distinct x)), '; ') as signals from (select site_host, unnest(conversion.trust_signals_found) as x from site_analysis) group by 1")(
    lambda d: d.select("site_host", F.explode("conversion.trust_signals_found").alias("x")).groupBy("site_host").agg(F.array_join(F.array_sort(F.collect_set("x")), "; ").alias("signals"))
)
both("SET-06", "company", "company", "select row_id, Branchekode from company where Branchekode = '905710' union all select row_id, Branchekode from company where Branchekode = '901800' union all select row_id, Branchekode from company where Branchekode = '905710'")(
    lambda a, b: R.union_all([a.where(F.col("Branchekode") == c).select("row_id", "Branchekode") for c in ("905710", "901800", "905710")])
)
SOCIAL = "regexp_matches({0}, '/(?:side|p)-?[0-9]')"
column("SET-07", "site_analysis", "analysis_id", "kept_moved", lambda: X.moved(F.col("technical_seo.broken_links_list"), F.transform("technical_seo.discarded_links", lambda x: x["href"]), lambda u: u.rlike("/(?:side|p)-?[0-9]")), f"array_to_string(list_filter(technical_seo.broken_links_list, lambda u: not {SOCIAL.format('u')}), ' ') || ' | ' || array_to_string(list_filter(list_transform(technical_seo.discarded_links, lambda x: x.href), lambda u: u is not null), ' ') || ' + ' || array_to_string(list_filter(technical_seo.broken_links_list, lambda u: {SOCIAL.format('u')}), ' ')", lambda: F.col("technical_seo.broken_links_list").isNotNull() & F.col("technical_seo.discarded_links").isNotNull(), "technical_seo.broken_links_list is not null and technical_seo.discarded_links is not null")
on("SET-09", "site_analysis", "select site_host, max(t) as latest, arg_min(source, (-epoch_us(t), k)) as source from (select site_host, fetched_at as t, 'fetched' as source, 0 as k from site_analysis union all select site_host, ingested_at, 'ingested', 1 from site_analysis) group by 1")(
    lambda d: d.select("site_host", F.col("fetched_at").alias("t"), F.lit("fetched").alias("source"), F.lit(0).alias("k")).unionByName(d.select("site_host", F.col("ingested_at").alias("t"), F.lit("ingested").alias("source"), F.lit(1).alias("k"))).groupBy("site_host").agg(F.max("t").alias("latest"), F.min_by("source", F.struct(-F.unix_micros(F.col("t").cast("timestamp")), "k")).alias("source"))
)

# --- texts ----------------------------------------------------------------------------------------------------------
column("TXT-02", "contact_candidate", "candidate_id", "t", lambda: X.title_key(F.col("title")), "trim(regexp_replace(regexp_replace(regexp_replace(translate(lower(trim(title)), 'éèêëáàâäóòôöúùûüíìîïåñç', 'eeeeaaaaoooouuuuiiiianc'), '[^\\p{L}\\p{N}_\\s/+&-]', ' ', 'g'), '[/-]+', ' ', 'g'), '\\s{2,}', ' ', 'g'))")
column("TXT-04", "city_register", "city_id", "t", lambda: X.danish_ascii(F.concat("by_navn", F.lit(" Café Öl Äre Éva æøå"))), "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(by_navn || ' Café Öl Äre Éva æøå','æ','ae'),'ø','oe'),'å','aa'),'Æ','Ae'),'Ø','Oe'),'Å','Aa'),'é','e'),'ö','o'),'ä','a'),'É','E'),'Ö','O'),'Ä','A')")
on("TXT-07", "contact_candidate", "select candidate_id, case when regexp_full_match(t, '(?i)[a-zæøå]{2,}( [a-zæøå]{2,}){1,3}') then array_to_string(list_transform(string_split(t, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') end as n from (select candidate_id, trim(regexp_replace(name, '\\s+', ' ', 'g')) as t from contact_candidate)")(
    lambda d: d.select("candidate_id", X.promoted(F.col("name")).alias("n"))
)
MAIL = "regexp_replace(lower(trim(trim(e), '<>')), '^mailto:\\s*', '')"
both("TXT-13", "contact_candidate", "company", f"select candidate_id, e as raw, case when regexp_full_match({MAIL}, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+') then {MAIL} end as email from (select candidate_id, unnest(emails) as e from contact_candidate union all select row_id, 'mailto:' || Email from company)")(
    lambda c, k: c.select("candidate_id", F.explode("emails").alias("raw")).unionByName(k.select(F.col("row_id").alias("candidate_id"), F.concat(F.lit("mailto:"), "Email").alias("raw"))).withColumn("email", X.normal_email(F.col("raw")))
)
on("TXT-15", "contact_candidate", "select candidate_id, e as email from (select candidate_id, unnest(emails) as e from contact_candidate) where e <> ''")(
    lambda d: d.select("candidate_id", F.explode("emails").alias("e")).where("e <> ''").select("candidate_id", H.decoded(H.encoded(F.col("e"), F.lit(90))).alias("email"))
)
USER = "regexp_replace(lower(split_part(e, '@', 1)), '[^a-z0-9æøå]+', '', 'g')"
on("TXT-16", "contact_candidate", f"select candidate_id, max(len(list_filter(regexp_split_to_array(lower(name), '[^a-zæøå]+'), lambda p: length(p) >= 2 and contains(u, p)))) as score from (select candidate_id, name, {USER} as u from (select candidate_id, name, unnest(emails) as e from contact_candidate where name is not null)) group by 1")(
    lambda d: d.where("name is not null and size(emails) > 0").select("candidate_id", X.best_mail_score(F.col("emails"), F.col("name")).alias("score"))
)
on("TXT-17", "contact_candidate", "select candidate_id, e as email, lower(split_part(e,'@',1)) in ('info','kontakt','kontor','mail','post','salg','ordre','firma','bogholderi') as generic, length(regexp_replace(lower(split_part(e,'@',1)), '[^a-zæøå]', '', 'g')) between 2 and 4 as initials from (select candidate_id, unnest(emails) as e from contact_candidate) where e is not null")(
    lambda d: d.select("candidate_id", F.explode("emails").alias("email")).where("email is not null").withColumns({"generic": X.is_generic_box(F.col("email")), "initials": F.length(F.regexp_replace(F.lower(F.split_part("email", F.lit("@"), F.lit(1))), "[^a-zæøå]", "")).between(2, 4)})
)
column("TXT-18", "company", "row_id", "kind", lambda: X.contact_kind(F.col("Telefon"))["kind"], "case when contains(Telefon,'@') then 'email' when length(regexp_replace(Telefon,'[^0-9]','','g')) >= 8 then 'phone' when contains(Telefon, '.') then 'website' else 'other' end")
QUALIFIERS = "'aps','a','s','ivs','k','i','group','holding','ltd','gmbh','bureau','agency','studio','media','digital','marketing','consult','consulting','solutions','partners','company','co','inc','ab','oy'"
CORE = "list_filter(regexp_extract_all(lower({0}), '[0-9a-zæøåéèüö]+'), lambda t: t not in (" + QUALIFIERS + "))"
both("TXT-24", "company", "url_cache", f"""select row_id, c.n[1] as first, list_contains(u.n, c.n[1]) as contained from (select row_id, {CORE.format(f'"{NAME}"')} as n, regexp_replace(regexp_replace(lower(Hjemmeside), '^(https?://)?(www\\.)?', ''), '[/?].*$', '') as h from company) c join (select {BARE.format('url')} as h, {CORE.format('min(title)')} as n from url_cache where title is not null group by 1) u using (h) where len(c.n) > 0""")(
    lambda c, u: c.select("row_id", X.core_tokens(F.col(NAME)).alias("c"), F.regexp_replace(F.regexp_replace(F.lower("Hjemmeside"), r"^(https?://)?(www\.)?", ""), "[/?].*$", "").alias("h")).where("size(c) > 0").join(u.where("title is not null").groupBy(W.bare_host(F.col("url")).alias("h")).agg(X.core_tokens(F.min("title")).alias("u")), "h").select("row_id", F.get("c", F.lit(0)).alias("first"), F.array_contains("u", F.get("c", F.lit(0))).alias("contained"))
)
CTA = "køb bestil kontakt tilbud book ring prøv buy order contact quote call".split()
on("TXT-26", "documents", f"select doc_id, array_to_string(h, ',') as hits, case when len(h) = 0 then 0 when len(h) <= 2 then 50 else 100 end as score from (select doc_id, list_sort(list_filter({CTA!r}, lambda w: contains(lower(text), w))) as h from documents where text is not null)")(
    lambda d: d.where("text is not null").select("doc_id", X.said(F.col("text"), CTA).alias("h")).select("doc_id", F.array_join("h", ",").alias("hits"), F.when(F.size("h") == 0, 0).when(F.size("h") <= 2, 50).otherwise(100).alias("score"))
)
STRIP = "regexp_replace(regexp_replace(text, '(?is)<(script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^<>]*>', ' ', 'g')"
column("TXT-28", "documents", "doc_id", "plain", lambda: X.tag_free(F.col("text")), STRIP)
on("TXT-29", "documents", "select doc_id, substr(text, greatest(1, strpos(text, '@') - 40), 80 - greatest(0, 41 - strpos(text, '@'))) as near from documents where contains(text, '@')")(lambda d: d.where(F.contains("text", F.lit("@"))).select("doc_id", X.around(F.col("text"), F.instr("text", "@"), 40, 40).alias("near")))
on("EXT-04", "documents", "select doc_id, e as email, substr(text, greatest(1, strpos(text, e) - 220), 440 + length(e) - greatest(0, 221 - strpos(text, e))) as near from (select doc_id, text, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'))) as e from documents)")(
    lambda d: d.select("doc_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0)))).alias("email")).select("doc_id", "email", X.around(F.col("text"), F.position("email", "text"), 220, F.lit(220) + F.length("email")).alias("near"))
)
LANGS = {"da": " og | det | ikke | til | af ", "en": " the | and | with | for | of ", "de": " und | der | die | nicht | mit "}
DETECT = "case " + " ".join(f"when {k} = greatest(da, en, de) then '{k}'" for k in LANGS) + " end"
on("TXT-30", "documents", f"select doc_id, case when da + en + de = 0 then null else {DETECT} end as lang_said from (select doc_id, " + ", ".join(f"len(regexp_extract_all(lower(text), '{p}')) as {k}" for k, p in LANGS.items()) + " from documents where text is not null)")(
    lambda d: d.where("text is not null").select("doc_id", X.language(F.col("text"), LANGS).alias("lang_said"))
)
column("TXT-31", "company", "row_id", "first_director", lambda: F.get(F.filter(F.transform(F.split("Direktørnavn", r'[;,|/"]+'), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)), """list_filter(list_transform(regexp_split_to_array("Direktørnavn", '[;,|/"]+'), lambda x: trim(x)), lambda x: x <> '')[1]""")
LABEL = "split_part(" + BARE + ", '.', 1)"
column("TXT-32", "url_cache", "cache_id", "guess", lambda: F.initcap(F.replace(F.split_part(W.bare_host(F.col("url")), F.lit("."), F.lit(1)), F.lit("-"), F.lit(" "))), f"array_to_string(list_transform(string_split(replace({LABEL.format('url')}, '-', ' '), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')")
on("TXT-33", "url_cache", f"select cache_id, q, row_number() over (partition by cache_id order by k) as pos from (select cache_id, q, min(k) as k from (select cache_id, unnest([title, {LABEL.format('url')}, {LABEL.format('url')} || ' aps', {HOST.format('url')}, 'https://' || {HOST.format('url')} || '/']) as q, unnest([0, 1, 2, 3, 4]) as k from url_cache) where q <> '' group by 1, 2)")(
    lambda d: d.select("cache_id", F.posexplode(F.filter(F.array_distinct(F.array("title", *(lambda label, h: (label, F.concat(label, F.lit(" aps")), h, F.concat(F.lit("https://"), h, F.lit("/"))))(F.split_part(W.bare_host(F.col("url")), F.lit("."), F.lit(1)), W.host_of(F.col("url"))))), lambda q: q != "")).alias("pos", "q")).withColumn("pos", F.col("pos") + 1)
)
on("TXT-34", "url_cache", "select cache_id, normalized_key || t as candidate, k as pos from (select cache_id, normalized_key, unnest(['.dk', '.com', '.eu', '.net']) as t, unnest([1, 2, 3, 4]) as k from url_cache) where normalized_key is not null")(
    lambda d: d.where("normalized_key is not null").select("cache_id", F.posexplode(F.transform(F.array(*map(F.lit, (".dk", ".com", ".eu", ".net"))), lambda t: F.concat("normalized_key", t))).alias("pos", "candidate")).withColumn("pos", F.col("pos") + 1)
)
SOURCES = {"GMB": "Kort", "CVR": "Registeret", "Email": "E-mail"}
column("TXT-40", "company", "row_id", "label", lambda: X.labelled(F.col("HjemmesideKilde"), SOURCES), "case HjemmesideKilde " + " ".join(f"when '{k}' then '{v}'" for k, v in SOURCES.items()) + " else HjemmesideKilde end")
column("TXT-42", "postal_codes", "line_no", "code", lambda: F.regexp_replace(F.split(F.concat_ws(" - ", "Postnummer", "Bynavn"), " - ")[0], "[^0-9]", "").try_cast("int"), "try_cast(regexp_replace(string_split(concat_ws(' - ', Postnummer, Bynavn), ' - ')[1], '[^0-9]', '', 'g') as int)")
on("TXT-43", "company", "select row_id, min_by(h, k) as guess from (select row_id, regexp_extract(lower(trim(e)), '@([a-z0-9.-]+\\.[a-z]+)$', 1) as h, k from (select row_id, unnest(string_split(Email, ';')) as e, unnest(range(len(string_split(Email, ';')))) as k from company)) where h <> '' and h not in ('gmail.com','hotmail.com','outlook.com','live.dk','yahoo.com') and not regexp_matches(h, '\\.(tele|get2net|mail)\\.dk$') group by 1")(
    lambda d: d.select("row_id", F.posexplode(F.split("Email", ";")).alias("k", "e")).select("row_id", "k", F.regexp_extract(F.lower(F.trim("e")), r"@([a-z0-9.-]+\.[a-z]+)$", 1).alias("h")).where((F.col("h") != "") & ~F.col("h").isin("gmail.com", "hotmail.com", "outlook.com", "live.dk", "yahoo.com") & ~F.col("h").rlike(r"\.(tele|get2net|mail)\.dk$")).groupBy("row_id").agg(F.min_by("h", "k").alias("guess"))
)

# --- addresses ------------------------------------------------------------------------------------------------------
query("URL-02")(lambda spark, sf_dir: links(table(spark, sf_dir, "site_analysis")).where("href is not null").select("analysis_id", "href", W.resolved(F.col("url"), F.col("href")).alias("absolute")))
PORT = "regexp_extract(" + NETLOC + ", ':(\\d+)$', 1)"
column("URL-03", "site_analysis", "analysis_id", "u", lambda: W.canonical_out(F.col("url")), f"case when {SCHEME.format('url')} = '' then 'https' else lower({SCHEME.format('url')}) end || '://' || {HOST.format('url')} || case when {PORT.format('url')} not in ('', '80', '443') then ':' || {PORT.format('url')} else '' end || case when {PATH.format('url')} = '/' then '' else {PATH.format('url')} end || case when {QUERY.format('url')} <> '' then '?' || {QUERY.format('url')} else '' end")
on("URL-04", "contact_candidate", f"select candidate_id, {BARE.format('url')} as h, array_to_string(string_split({BARE.format('url')}, '.')[-2:], '.') as apex, string_split({BARE.format('url')}, '.')[-1] as tld, split_part({BARE.format('url')}, '.', 1) as label from contact_candidate")(
    lambda d: d.select("candidate_id", W.bare_host(F.col("url")).alias("h")).select("candidate_id", "h", X.apex(F.col("h")).alias("apex"), F.element_at(F.split("h", r"\."), -1).alias("tld"), F.split_part("h", F.lit("."), F.lit(1)).alias("label"))
)
column("URL-05", "contact_candidate", "candidate_id", "u", lambda: F.concat(W.part(F.col("url"), 1), F.lit("://"), "site_host", W.part(F.col("url"), 3), F.when(W.part(F.col("url"), 4) != "", F.concat(F.lit("?"), W.part(F.col("url"), 4))).otherwise("")), f"{SCHEME.format('url')} || '://' || site_host || {PATH.format('url')} || case when {QUERY.format('url')} <> '' then '?' || {QUERY.format('url')} else '' end")
TYPED = f"""select analysis_id, href, case when pr = 0 and ca = 0 and inf = 0 and bl = 0 then 'other' when pr >= greatest(ca, inf, bl) then 'product' when ca >= greatest(inf, bl) then 'category' when inf >= bl then 'info' else 'blog' end as kind, least(greatest(pr, ca, inf, bl) / 100.0, 1.0)::double as confidence from (select analysis_id, href, case when inf >= 40 then least(pr0, 10) else pr0 end as pr, ca, inf, bl from (select analysis_id, href, case when regexp_matches(q, '(sku|id|product|item|variant|childsku)=') then 50 else 0 end + case when regexp_matches(p, '-[0-9]{{3,}}($|/)') then 40 else 0 end + case when regexp_matches(p, '/p[0-9]{{3,}}') then 30 else 0 end + case when regexp_matches(p, '/(dp|pd)/') then 25 else 0 end + case when regexp_matches(p, '[0-9]{{4,}}') then 20 else 0 end + case when regexp_matches(p, '[a-z][0-9]{{4,}}') then 15 else 0 end + case when len(s) >= 3 then 10 else 0 end as pr0, case when list_has_any(s, ['category','shop','products','produkter','katalog','kategori','tilbud']) then 40 when len(s) <= 2 and not regexp_matches(p, '[0-9]{{3,}}') then 10 else 0 end as ca, case when list_has_any(s, ['om','om-os','about','kontakt','contact']) then 40 when list_has_any(s, ['case','referencer','faq','support','kundeservice']) then 35 when list_has_any(s, ['privacy','cookies','betingelser','persondata']) then 30 else 0 end as inf, case when list_has_any(s, ['blog','nyheder','news','artikler']) then 40 else 0 end + case when regexp_matches(p, '/[0-9]{{4}}(/|-)[0-9]{{2}}/') then 30 else 0 end as bl from (select analysis_id, href, lower({PATH.format('href')}) as p, lower({QUERY.format('href')}) as q, {SEGMENTS.format('href')} as s from {LINKS_SQL})))"""


def typed(d: DataFrame) -> DataFrame:
    return links(d).select("analysis_id", "href", W.page_type(F.col("href")).alias("t")).select("analysis_id", "href", "t.*")


on("URL-07", "site_analysis", TYPED)(typed)
on("AGG-07", "site_analysis", f"select kind, count(*) as n from ({TYPED}) group by 1")(lambda d: typed(d).groupBy("kind").agg(F.count("*").alias("n")))
PROFILES = ["https://www.facebook.com/firma", "https://facebook.com/firma/posts/1", "https://x.com/a", "https://twitter.com/a/status/9", "https://www.instagram.com/p/abc/", "https://instagram.com/firma", "https://tiktok.com/@a/video/1", "https://pinterest.com/pin/7", "https://www.linkedin.com/company/a?share=1", "https://youtube.com/watch?v=1", "https://eksempel.dk/a", "https://netflix.com/"]
query("URL-10", f"select u, case when not regexp_matches(h, '^(facebook|instagram|x|twitter|tiktok|pinterest|linkedin|youtube)\\.com$') then null when (h = 'instagram.com' and regexp_matches(p, '^/(p|reel)/')) or (h = 'facebook.com' and regexp_matches(p, '/share|/posts/|/watch/')) or (h in ('x.com','twitter.com') and contains(p, '/status/')) or (h = 'tiktok.com' and contains(p, '/video/')) or (h = 'pinterest.com' and starts_with(p, '/pin/')) or regexp_matches(q, '(^|&)share=') then 'share' else 'profile' end as kind from (select u, {BARE.format('u')} as h, {PATH.format('u')} as p, {QUERY.format('u')} as q from (select unnest({PROFILES!r}) as u))")(
    lambda spark, _: spark.createDataFrame([(u,) for u in PROFILES], "u string").withColumn("kind", W.social_kind(F.col("u")))
)
PATHS = {"dk": "/kontakt /om-os /medarbejdere", "se": "/kontakt /om-oss /medarbetare", "no": "/kontakt /om-oss /ansatte", "de": "/kontakt /ueber-uns /team"}
on("URL-12", "url_cache", f"select cache_id, unnest(string_split(case string_split({HOST.format('url')}, '.')[-1] " + " ".join(f"when '{k}' then '{v}'" for k, v in PATHS.items()) + " else '/contact /about /team' end, ' ')) as path from url_cache where url is not null")(
    lambda d: d.where("url is not null").select("cache_id", F.explode(F.split(X.labelled(F.element_at(F.split(W.host_of(F.col("url")), r"\."), -1), PATHS, "/contact /about /team"), " ")).alias("path"))
)
REASON = "case when href is null or trim(href) = '' then 'empty' when starts_with(lower(trim(href)), '#') then 'fragment' when regexp_extract(lower(trim(href)), '^([a-z][a-z0-9+.-]*):', 1) not in ('', 'http', 'https') then regexp_extract(lower(trim(href)), '^([a-z][a-z0-9+.-]*):', 1) when regexp_matches(lower(trim(href)), '^(https?:)?//(/|$)') then 'no host' end"
on("URL-14", "site_analysis", f"select reason, count(*) as n from (select {REASON} as reason from {LINKS_SQL}) group by 1")(lambda d: links(d).groupBy(H.link_reason(F.col("href")).alias("reason")).agg(F.count("*").alias("n")))

# --- dates, numbers, lists, JSON ------------------------------------------------------------------------------------
DANISH = "['januar','februar','marts','april','maj','juni','juli','august','september','oktober','november','december'][month(fetched_at)::int]"


def _written_dates(d: DataFrame) -> DataFrame:
    """The fetch time of a page in one of eight ways of writing it, by the page's number."""
    t, k = F.col("fetched_at"), F.col("analysis_id") % 8
    month = F.element_at(F.array(*map(F.lit, D.MONTHS)), F.month(t))
    said = (
        F.when(k == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(k == 2, F.concat(F.day(t), F.lit(". "), month, F.lit(" "), F.year(t)))
        .when(k == 3, F.date_format(t, "dd-MM-yyyy")).when(k == 4, F.date_format(t, "dd/MM/yyyy")).when(k == 5, F.date_format(t, "yyyy/MM/dd"))
        .when(k == 6, F.concat(F.lit("Opdateret d. "), F.day(t), F.lit(". "), F.substr(month, F.lit(1), F.lit(3)), F.lit(". "), F.year(t))).otherwise("engang i maj")
    )
    return d.select("analysis_id", said.alias("said"))


DATES_SQL = "select analysis_id, case when analysis_id % 8 < 2 then date_trunc('second', fetched_at) when analysis_id % 8 < 7 then date_trunc('day', fetched_at)::timestamp end as read from site_analysis"
for _id in ("DAT-01", "DAT-02"):
    on(_id, "site_analysis", DATES_SQL)(lambda d: _written_dates(d).select("analysis_id", D.any_date(F.col("said")).cast("timestamp_ntz").alias("read")))
on("DAT-03", "site_analysis", "select analysis_id, fetched_at::date as read from site_analysis where analysis_id % 8 in (2, 6)")(lambda d: _written_dates(d).where("analysis_id % 8 in (2, 6)").select("analysis_id", D.danish(F.col("said")).cast("date").alias("read")))
on("DAT-07", "site_analysis", "select analysis_id, date_diff('day', fetched_at::date, date '2026-01-01') <= 90 as fresh90, date_diff('day', fetched_at::date, date '2026-01-01') < 30 as fresh30 from site_analysis")(
    lambda d: d.select("analysis_id", F.datediff(F.lit("2026-01-01").cast("date"), "fetched_at").alias("n")).select("analysis_id", (F.col("n") <= 90).alias("fresh90"), (F.col("n") < 30).alias("fresh30"))
)
CONF = "least(1.0, greatest(0.0, least(greatest(o_totalprice / 10000, 0.0), 10.0) / 8 + case when o_orderkey % 2 = 0 then 0.10 else 0 end + case when o_orderkey % 3 = 0 then 0.05 else 0 end - case when o_orderkey % 5 = 0 then 0.10 else 0 end))"
column("MTH-02", "orders", "o_orderkey", "confidence", lambda: F.round(X.confidence(F.col("o_totalprice") / 10000, {0.10: F.col("o_orderkey") % 2 == 0, 0.05: F.col("o_orderkey") % 3 == 0, -0.10: F.col("o_orderkey") % 5 == 0}), 3), f"round({CONF}, 3)")
column("MTH-07", "documents", "doc_id", "cta", lambda: F.least(F.size(X.said(F.col("text"), CTA)) * 20 + F.when(F.contains(F.substring("text", 1, 1000), F.lit("kontakt")), 10).otherwise(0), F.lit(100)), f"least(len(list_filter({CTA!r}, lambda w: contains(lower(text), w))) * 20 + case when contains(substr(text, 1, 1000), 'kontakt') then 10 else 0 end, 100)", lambda: F.col("text").isNotNull(), "text is not null")
column("MTH-08", "company", "row_id", "bucket", lambda: F.when(F.col("AntalAnsatte").try_cast("int") < 1, "0").when(F.col("AntalAnsatte").try_cast("int") < 10, "1-9").when(F.col("AntalAnsatte").try_cast("int") < 50, "10-49").when(F.col("AntalAnsatte").try_cast("int") >= 50, "50+"), "case when try_cast(AntalAnsatte as int) < 1 then '0' when try_cast(AntalAnsatte as int) < 10 then '1-9' when try_cast(AntalAnsatte as int) < 50 then '10-49' when try_cast(AntalAnsatte as int) >= 50 then '50+' end")
on("ARR-01", "site_analysis", "select analysis_id, list_min(n) as least, len(n) as size, len(list_filter(n, lambda x: x > 5)) > 0 as any_large, len(list_filter(n, lambda x: x <= 5)) = 0 as all_large from (select analysis_id, conversion.form_field_counts as n from site_analysis where conversion.form_field_counts is not null)")(
    lambda d: d.select("analysis_id", F.col("conversion.form_field_counts").alias("n")).where("n is not null").select("analysis_id", F.array_min("n").alias("least"), F.size("n").alias("size"), F.exists("n", lambda x: x > 5).alias("any_large"), F.forall("n", lambda x: x > 5).alias("all_large"))
)
on("ARR-03", "contact_candidate", "select candidate_id, unnest(map_keys(hints)) as k, unnest(map_values(hints)) as v from contact_candidate")(
    lambda d: d.select("candidate_id", F.explode(X.literal_map(F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("hints"), lambda e: F.concat(F.lit("'"), e["key"], F.lit("': '"), e["value"], F.lit("'"))), ", "), F.lit("}")))).alias("k", "v"))
)
on("ARR-04", "contact_candidate", "select candidate_id, unnest(map_keys(m)) as k, unnest(map_values(m)) as v from (select candidate_id, map_concat(hints, map {'selector': 'ny', 'kilde': source}) as m from contact_candidate where hints is not null)")(
    lambda d: d.where("hints is not null").select("candidate_id", F.explode(X.merged_maps(F.col("hints"), F.create_map(F.lit("selector"), F.lit("ny"), F.lit("kilde"), "source"))).alias("k", "v"))
)
on("ARR-05", "documents", "select doc_id, k, ((length(t) - length(replace(t, k, ''))) / length(k))::int as n from (select doc_id, lower(text) as t, unnest(['kontakt', 'pris', 'service']) as k from documents where text is not null)")(
    lambda d: d.where("text is not null").select("doc_id", F.lower("text").alias("t")).select("doc_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, ("kontakt", "pris", "service"))), F.array(*[X.count_of(F.col("t"), w) for w in ("kontakt", "pris", "service")]))).alias("k", "n"))
)
on("ARR-06", "contact_candidate", "select candidate_id, unnest(list_transform(map_keys(hints), lambda k: lower(k))) as k, unnest(map_values(hints)) as v from contact_candidate")(
    lambda d: d.select("candidate_id", F.explode(X.lower_keys(F.transform_keys("hints", lambda k, v: F.upper(k)))).alias("k", "v"))
)
on("ARR-07", "site_analysis", f"select analysis_id, href, {SEG} as shared from (select analysis_id, href, {SEGMENTS.format('url')} as a, {SEGMENTS.format('href')} as b from {LINKS_SQL} where href is not null)")(
    lambda d: links(d).where("href is not null").select("analysis_id", "href", W.same_start(F.col("url"), F.col("href")).alias("shared"))
)
on("JSN-10", "contact_candidate", """select candidate_id, '[' || array_to_string(list_transform(emails, lambda e: '"' || replace(replace(e, '\\', '\\\\'), '"', '\\"') || '"'), ',') || ']' as js from contact_candidate where emails is not null and len(list_filter(emails, lambda e: e is null)) = 0""")(
    lambda d: d.where("emails is not null and not exists(emails, e -> e is null)").select("candidate_id", F.to_json("emails").alias("js"))
)

# --- pages: written from the analysis rows, read back by the parser ---------------------------------------------------


def _escaped(c: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def _each(values: Column, make) -> Column:
    return F.coalesce(F.array_join(F.transform(F.filter(values, lambda x: x.isNotNull()), make), ""), F.lit(""))


def _said(c: Column, before: str, behind: str) -> Column:
    return F.coalesce(F.concat(F.lit(before), _escaped(c), F.lit(behind)), F.lit(""))


def _form(f: Column) -> Column:
    kind = lambda g: F.coalesce(g["type"], F.lit("text"))
    attrs = lambda g: F.concat(_said(g["name"], ' name="', '"'), F.when(g["required"], " required").otherwise(""))
    field = lambda g: F.when(kind(g).isin("select", "textarea"), F.concat(F.lit("<"), kind(g), attrs(g), F.lit("></"), kind(g), F.lit(">"))).otherwise(F.concat(F.lit('<input type="'), kind(g), F.lit('"'), attrs(g), F.lit(">")))
    return F.concat(F.lit("<form"), _said(f["action"], ' action="', '"'), _said(f["method"], ' method="', '"'), F.lit(">"), _each(f["fields"], field), F.lit('<input type="submit" value="Send"></form>'))


def rendered(d: DataFrame) -> DataFrame:
    """(analysis_id, html): a page with the title, headings, links, forms, tags and marks that an analysis row lists."""
    seo, tech, conv = F.col("basic_seo"), F.col("technical_seo"), F.col("conversion")
    banner = (
        F.when(F.col("privacy.detection_method") == "selector", '<div id="cookie-bar">Valg</div>')
        .when(F.col("privacy.detection_method") == "text", "<p>Vi bruger cookies. Giv samtykke.</p>")
        .when(F.col("privacy.cookie_banner_confidence") == 0.7, '<script src="https://consent.cookiebot.com/uc.js"></script>').otherwise("")
    )
    ga4 = F.when(conv["has_ga4"], F.concat(F.lit("<script>gtag('config', 'G-"), F.lpad(F.col("analysis_id") % 1000000, 8, "A"), F.lit("');</script>"))).otherwise("")
    gtm = F.when(conv["has_gtm"], "<script>(function(w){})('https://www.googletagmanager.com/gtm.js')</script>").otherwise("")
    ld = F.when(F.size(seo["schema_types"]) > 0, F.concat(F.lit('<script type="application/ld+json">{"@context": "https://schema.org", "@graph": ['), F.array_join(F.transform(seo["schema_types"], lambda t: F.concat(F.lit('{"@type": ["'), t, F.lit('"], "datePublished": "'), F.date_format("fetched_at", "yyyy-MM-dd"), F.lit('"}'))), ", "), F.lit(", ]}</script>"))).otherwise("")
    page = F.concat(
        F.lit('<html lang="da"><head>'), _said(seo["title_text"], "<title>", "</title>"), _said(seo["meta_description"], '<meta name="description" content="', '">'), _said(seo["canonical_url"], '<link rel="canonical" href="', '">'),
        ga4, gtm, ld, F.lit('</head><body><nav><a href="/">Forside</a></nav>'), _each(seo["h1_texts"], lambda x: F.concat(F.lit("<h1>"), _escaped(x), F.lit("</h1>"))),
        _each(seo["schema_types"], lambda t: F.concat(F.lit('<div itemscope itemtype="https://schema.org/'), t, F.lit('"></div>'))), banner,
        _each(F.transform(tech["discarded_links"], lambda x: x["href"]), lambda x: F.concat(F.lit('<a href="'), _escaped(x), F.lit('">x</a> '))),
        _each(F.transform(tech["broken_links_list"], lambda x, i: F.concat(F.lit('<img src="'), _escaped(x), F.when(i % 2 == 0, '" alt="billede">').otherwise('">'))), lambda x: x),
        _each(conv["forms_meta"]["forms"], _form), F.lit("</body></html>"),
    )
    return d.select("analysis_id", page.alias("html"))


def facts(d: DataFrame) -> DataFrame:
    return H.page_facts(rendered(d), "analysis_id", "html")


on("HTM-01", "site_analysis", f"select analysis_id, {COLLAPSE.format('basic_seo.title_text')} as title, basic_seo.meta_description as meta, len(list_filter(coalesce(basic_seo.h1_texts, []), lambda x: x is not null)) as h1_count, nullif(basic_seo.canonical_url, '') as canonical, case when coalesce(basic_seo.canonical_url, '') = '' then 'none' end as canonical_error, coalesce(len(basic_seo.schema_types) > 0, false) as schema_found from site_analysis")(
    lambda d: facts(d).select("analysis_id", "title", F.try_element_at("metas", F.lit("description")).alias("meta"), F.size("h1").alias("h1_count"), H.canonical(F.col("canonicals"))[0].alias("canonical"), H.canonical(F.col("canonicals"))[1].alias("canonical_error"), F.col("ld_found").alias("schema_found"))
)
on("HTM-02", "site_analysis", "select analysis_id, coalesce(nullif(basic_seo.canonical_url, ''), url) as canonical, case when coalesce(basic_seo.canonical_url, '') <> '' then 'dom' else 'self' end as source from site_analysis")(
    lambda d: facts(d).select("analysis_id", H.canonical(F.col("canonicals"))[0].alias("c")).join(d.select("analysis_id", "url"), "analysis_id").select("analysis_id", F.coalesce("c", "url").alias("canonical"), F.when(F.col("c").isNotNull(), "dom").otherwise("self").alias("source"))
)
TYPES = "array_to_string(list_sort(list_distinct(coalesce(basic_seo.schema_types, []))), ',')"
on("HTM-03", "site_analysis", f"select analysis_id, {TYPES} as types from site_analysis")(lambda d: facts(d).select("analysis_id", F.array_join(F.array_sort(F.array_distinct("itemtypes")), ",").alias("types")))
on("HTM-06", "site_analysis", "select analysis_id, '/' as href, 'Forside' as label from site_analysis")(lambda d: facts(d).select("analysis_id", F.inline("links")).where("in_nav").select("analysis_id", "href", F.col("text").alias("label")))
on("HTM-07", "site_analysis", f"select analysis_id, href, {REASON} as reason, count(*) as n from (select analysis_id, '/' as href from site_analysis union all select * from (select analysis_id, unnest(technical_seo.discarded_links).href as href from site_analysis) where href is not null) group by 1, 2, 3")(
    lambda d: facts(d).select("analysis_id", F.inline("links")).select("analysis_id", "href", H.link_reason(F.col("href")).alias("reason")).groupBy("analysis_id", "href", "reason").agg(F.count("*").alias("n"))
)
on("HTM-09", "site_analysis", "with f as (select analysis_id, unnest(list_filter(conversion.forms_meta.forms, lambda x: x is not null)) as f from site_analysis) select analysis_id, f.action as action, lower(coalesce(f.method, 'get')) as method, len(g) as n_fields, len(list_filter(g, lambda x: coalesce(x.required, false))) as n_required, len(list_filter(g, lambda x: coalesce(x.type, 'text') <> 'hidden')) as n_visible, count(*) as n from (select *, list_filter(coalesce(f.fields, []), lambda x: x is not null) as g from f) group by all")(
    lambda d: facts(d).select("analysis_id", F.inline("forms")).groupBy("analysis_id", "action", "method", F.size("fields").alias("n_fields"), F.size(F.filter("fields", lambda x: x["required"])).alias("n_required"), F.size(F.filter("fields", lambda x: x["visible"])).alias("n_visible")).agg(F.count("*").alias("n"))
)
on("HTM-10", "site_analysis", "select analysis_id, case when conversion.has_ga4 then 'G-' || lpad((analysis_id % 1000000)::varchar, 8, 'A') end as ga4, case when conversion.has_gtm then 'ukendt' end as gtm, null::varchar as meta from site_analysis")(
    lambda d: (lambda t: rendered(d).select("analysis_id", *[t[n].alias(n) for n in ("ga4", "gtm", "meta")]))(H.tracking(F.col("html")))
)
BANNER = "case when privacy.detection_method in ('selector', 'text') then privacy.detection_method when privacy.cookie_banner_confidence = 0.7 then 'script' end"
on("HTM-11", "site_analysis", f"select analysis_id, {BANNER} as method, case {BANNER} when 'script' then 0.95 when 'selector' then 0.7 when 'text' then 0.4 end::double as confidence from site_analysis")(
    lambda d: rendered(d).select("analysis_id", *(lambda m: (m[0].alias("method"), m[1].alias("confidence")))(H.cookie_banner(F.col("html"), X.tag_free(F.col("html")))))
)
on("HTM-15", "site_analysis", "with i as (select analysis_id, split_part(x, '?', 1) as src, min(k) as k from (select analysis_id, unnest(b) as x, unnest(range(len(b))) as k from (select analysis_id, technical_seo.broken_links_list as b from site_analysis)) where x is not null group by 1, 2) select analysis_id, count(*) as n_images, count(*) filter (where k % 2 = 0) as with_alt, round_even(100.0 * count(*) filter (where k % 2 = 0) / count(*), 1)::double as alt_pct from i group by 1")(
    lambda d: R.first_per(facts(d).select("analysis_id", F.posexplode("images").alias("k", "i")).withColumn("src", F.split("i.src", r"\?")[0]), ["analysis_id", "src"], [F.col("k")]).groupBy("analysis_id").agg(F.count("*").alias("n_images"), F.count_if(F.col("i.alt").isNotNull()).alias("with_alt")).withColumn("alt_pct", F.bround(F.col("with_alt") * 100.0 / F.col("n_images"), 1).cast("double"))
)
on("HTM-16", "site_analysis", "select analysis_id, coalesce(technical_seo.is_https, false) as hsts, coalesce(technical_seo.is_https, false) as hsts_sub, false as hsts_preload, true as csp, technical_seo.status_code = 200 as nosniff, coalesce(technical_seo.robots_txt_found, false) or conversion.has_gtm is not null as framing from site_analysis where technical_seo.status_code is not null")(
    lambda d: (lambda h: d.where("technical_seo.status_code is not null").select("analysis_id", *[c.alias(n) for n, c in H.security(h).items()]))(
        F.create_map(F.lit("STRICT-Transport-Security"), F.when(F.col("technical_seo.is_https"), "max-age=31536000; includeSubDomains").otherwise("max-age=0; preload"), F.lit("X-Content-Type-Options"), F.when(F.col("technical_seo.status_code") == 200, "NoSniff").otherwise("no"), F.lit("x-frame-options"), F.when(F.col("technical_seo.robots_txt_found"), "SAMEORIGIN").otherwise("ALLOW-ALL"), F.lit("Content-Security-Policy-Report-Only"), F.when(F.col("conversion.has_gtm").isNotNull(), "default-src 'self'; frame-ancestors 'none'").otherwise("frame-ancestors *"))
    )
)
on("JSN-01", "site_analysis", f"select analysis_id, {TYPES} as types, coalesce(len(basic_seo.schema_types) > 0, false) as repaired from site_analysis")(lambda d: facts(d).select("analysis_id", F.array_join(F.array_sort(F.array_distinct("ld_types")), ",").alias("types"), F.col("ld_repaired").alias("repaired")))
on("JSN-05", "site_analysis", "select analysis_id, max(fetched_at::date) as latest from site_analysis where len(basic_seo.schema_types) > 0 group by 1")(lambda d: facts(d).where("size(dates) > 0").select("analysis_id", D.iso(F.array_max("dates")).cast("date").alias("latest")))


def people(d: DataFrame) -> DataFrame:
    """(candidate_id, html): a candidate as a JSON-LD person, with mail, hidden mail and telephone links."""
    ld = F.to_json(F.struct(F.lit("Person").alias("@type"), "name", F.col("title").alias("jobTitle"), F.get("emails", F.lit(0)).alias("email"), F.get("phones", F.lit(0)).alias("telephone")))
    mails = F.array_join(F.transform(F.filter("emails", lambda e: e != ""), lambda e, i: F.when(i % 2 == 0, F.concat(F.lit('<a href="mailto:'), _escaped(e), F.lit('?subject=Hej">skriv</a>'))).otherwise(F.concat(F.lit('<span data-cfemail="'), H.encoded(e, F.lit(61)), F.lit('"></span>')))), "")
    calls = F.array_join(F.transform(F.filter("phones", lambda p: p != ""), lambda p: F.concat(F.lit('<a href="tel:'), _escaped(p), F.lit('">ring</a>'))), "")
    return d.select("candidate_id", F.concat(F.lit('<html><script type="application/ld+json">{"@graph": ['), F.replace(ld, F.lit("</"), F.lit("<\\\\/")), F.lit("]}</script>"), F.coalesce(mails, F.lit("")), F.coalesce(calls, F.lit("")), F.lit("</html>")).alias("html"))


on("JSN-02", "contact_candidate", "select candidate_id, name, title, emails[1] as email, phones[1] as telephone from contact_candidate")(
    lambda d: H.page_facts(people(d), "candidate_id", "html").select("candidate_id", F.inline("people")).select("candidate_id", "name", "title", "email", "telephone")
)
on("JSN-04", "contact_candidate", "select candidate_id, phones[1] as telephone from contact_candidate where phones[1] is not null")(
    lambda d: H.page_facts(people(d), "candidate_id", "html").select("candidate_id", F.explode("people.telephone").alias("telephone")).where("telephone is not null")
)
on("EXT-01", "contact_candidate", "select candidate_id, 'email' as kind, e as value, count(*) as n from (select candidate_id, unnest(emails) as e from contact_candidate) where e <> '' group by all union all select candidate_id, 'phone', p, count(*) from (select candidate_id, unnest(phones) as p from contact_candidate) where p <> '' group by all")(
    lambda d: H.page_facts(people(d), "candidate_id", "html").select("candidate_id", F.inline("links")).select("candidate_id", F.inline(F.array(H.contact_of("href", "cfemail")))).where("value is not null").groupBy("candidate_id", "kind", "value").agg(F.count("*").alias("n"))
)
ROBOTS = "User-agent: *\nDisallow: /admin # intern\nDisallow: /\n# Disallow: /kommentar\nCrawl-delay: 5\n"
on("TXT-41", "site_analysis", "select analysis_id, ['/admin', '/p' || (analysis_id % 7)] as disallows, ['https://' || site_host || '/sitemap.xml'] as sitemaps, 5.0::double as delay from site_analysis")(
    lambda d: d.select("analysis_id", F.concat(F.lit(ROBOTS), F.lit("disallow:/p"), F.col("analysis_id") % 7, F.lit("\nSitemap:  https://"), "site_host", F.lit("/sitemap.xml")).alias("b")).select("analysis_id", *[c.alias(n) for n, c in X.robots(F.col("b")).items()])
)
on("SRC-24", "site_analysis", "select analysis_id, unnest(list_filter(technical_seo.broken_links_list, lambda x: x is not null)) as loc, technical_seo.robots_txt_found is true as nested from site_analysis")(
    lambda d: d.where("size(technical_seo.broken_links_list) > 0").select("analysis_id", F.when(F.col("technical_seo.robots_txt_found"), F.concat(F.lit("<sitemapindex>"), _each(F.col("technical_seo.broken_links_list"), lambda x: F.concat(F.lit("<sitemap><loc> "), _escaped(x), F.lit("</loc></sitemap>"))), F.lit("</sitemapindex>"))).otherwise(F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), _each(F.col("technical_seo.broken_links_list"), lambda x: F.concat(F.lit("<url><loc>"), _escaped(x), F.lit("</loc></url>"))), F.lit("</urlset>"))).alias("x")).select("analysis_id", F.explode(X.sitemap(F.col("x"))).alias("s")).select("analysis_id", "s.loc", "s.nested")
)

# --- files: written to the shared folder in the format, read back -----------------------------------------------------


def _written(spark: SparkSession, df: DataFrame, write) -> str:
    """A new place in the shared folder with `df` written by `write`; it goes when the session's JVM ends."""
    path = scratch(spark)
    write(df, path)
    return path


def round_trip(name: str, source: str, sql: str, prepare, write, read):
    """Register a query that writes a table in a file format and reads it back."""
    query(name, sql)(lambda spark, sf_dir: read(spark, _written(spark, prepare(table(spark, sf_dir, source)), write)))


POSTAL = "Postnummer is not null and Bynavn is not null and trim(Bynavn) <> '' and not contains(Bynavn, chr(34))"
round_trip("SRC-01", "postal_codes", f"select trim(Postnummer) || ' ' || trim(Bynavn) as label from postal_codes where {POSTAL} order by 1",
    lambda d: d.where(POSTAL.replace("chr(34)", "'\"'")).select(F.col("Postnummer").alias(" Postnummer "), F.trim("Bynavn").alias("BYNAVN")), lambda d, p: files.write_csv(d, p, sep=";", bom=True), lambda s, p: files.postal_codes(s, p).select("label").orderBy("label"))
INDUSTRY = "(select distinct Branchekode as branchekode, Branchetekst as nace_titel_dk from company where Branchekode is not null and Branchetekst is not null)"
round_trip("SRC-02", "company", f"select branchekode || ' - ' || nace_titel_dk as label from {INDUSTRY} order by 1",
    lambda d: d.where("Branchekode is not null and Branchetekst is not null").select(F.col("Branchekode").alias("branchekode"), F.col("Branchetekst").alias("nace_titel_dk")).distinct(), lambda d, p: files.write_csv(d, p, sep=";", bom=True), lambda s, p: files.labels(s, p, "branchekode", "nace_titel_dk").orderBy("label"))
round_trip("SRC-03", "company", "select row_id::varchar as row_id, Hjemmeside as fundet_url from company where Hjemmeside <> ''",
    lambda d: d.select("row_id", F.col("Hjemmeside").alias("fundet_url")), lambda d, p: files.write_csv(d, p, sep=";", bom=True), lambda s, p: files.url_list(s, p))
COMPANY = ["row_id", "Email", "Telefon", "AntalAnsatte", "HjemmesideLiveBool"]
_COMPANY_SQL = "select row_id::varchar as row_id, coalesce(Email, '') as Email, coalesce(Telefon, '') as Telefon, coalesce(AntalAnsatte, '') as AntalAnsatte, coalesce(HjemmesideLiveBool, '') as HjemmesideLiveBool from company"
round_trip("SRC-04", "company", _COMPANY_SQL, lambda d: d.select(*COMPANY), lambda d, p: files.write_csv(d, p), lambda s, p: files.all_strings(s, p))
round_trip("SNK-01", "company", _COMPANY_SQL, lambda d: d.select(*COMPANY), lambda d, p: files.write_csv(d, p), lambda s, p: files.all_strings(s, p))
round_trip("SNK-02", "company", _COMPANY_SQL, lambda d: d.select(*COMPANY), lambda d, p: files.write_csv(d, p, bom=True), lambda s, p: files.all_strings(s, p))
round_trip("SNK-03", "company", _COMPANY_SQL, lambda d: d.select(*COMPANY), lambda d, p: files.write_csv(d, p, sep=";", bom=True), lambda s, p: files.all_strings(s, p, ";"))
round_trip("SNK-04", "company", "select row_id::varchar as row_id, coalesce(Email, '') as Email, '' as Mangler from company", lambda d: d, lambda d, p: files.write_csv(d, p, columns=["row_id", "Email", "Mangler"]), lambda s, p: files.all_strings(s, p))
SEED = {"AntalAnsatte": "AntalAnsatte", "Direktørnavn": "Direktørnavn", "Email": "Email", "Hjemmeside": "Hjemmeside", NAME: "Navn"}
round_trip("SNK-09", "company", "select " + ", ".join(f"""coalesce("{a}", '') as "{b}\"""" for a, b in SEED.items()) + " from company", lambda d: d.select(*[F.col(a).alias(b) for a, b in SEED.items()]), lambda d, p: files.write_csv(d, p, columns=list(SEED.values())), lambda s, p: files.all_strings(s, p))
round_trip("SRC-05", "company", "select row_id, try_cast(AntalAnsatte as int) as n from company where try_cast(AntalAnsatte as int) is not null", lambda d: d.select("row_id", F.col("AntalAnsatte").try_cast("int").alias("n")).where("n is not null"), lambda d, p: files.write_csv(d, p), lambda s, p: files.typed(s, p, "row_id bigint, n int"))
round_trip("SRC-06", "company", "select row_id::bigint as row_id, coalesce(lower(trim(HjemmesideLiveBool)) in ('true','1','yes'), false) as live, try_cast(AntalAnsatte as double) as employees from company", lambda d: d.select(*COMPANY), lambda d, p: files.write_csv(d, p),
    lambda s, p: files.all_strings(s, p).select(F.col("row_id").cast("bigint").alias("row_id"), F.lower(F.trim("HjemmesideLiveBool")).isin("true", "1", "yes").alias("live"), F.col("AntalAnsatte").try_cast("double").alias("employees")))
round_trip("SRC-07", "city_register", "select city_id, by_navn, '' as note from city_register", lambda d: d.select("city_id", "by_navn"), lambda d, p: files.write_text(d.select(F.concat_ws(";", "city_id", "by_navn").alias("value")), p, "ISO-8859-1"), lambda s, p: files.decoded_csv(s, p, ["city_id", "by_navn"], {"note": ""}, ";"))
round_trip("SRC-09", "site_analysis", "select trim(url) as url from site_analysis where starts_with(url, 'http')", lambda d: d.select(F.explode(F.array(F.col("url"), F.lit(""), F.concat(F.lit("  "), "url"))).alias("value")), lambda d, p: files.write_text(d, p), lambda s, p: files.url_lines(s, p))
round_trip("SRC-10", "url_cache", "select url, normalized_key as name, null::varchar as phone from url_cache where url is not null and not contains(url, ',')", lambda d: d.where("url is not null and not contains(url, ',')").select(F.explode(F.array(F.concat_ws(",", "url", F.concat(F.lit(" "), "normalized_key")), F.lit("# bemærkning"), F.lit(" "))).alias("value")), lambda d, p: files.write_text(d, p), lambda s, p: files.place_lines(s, p))
round_trip("SRC-12", "title_register", "select StillingsBetegnelseNavn as name, StillingsBetegnelseKode as code from title_register", lambda d: d.select(F.to_json(F.struct(F.col("StillingsBetegnelseNavn").alias("name"), F.col("StillingsBetegnelseKode").alias("code"))).alias("value")), lambda d, p: files.write_text(d, p, "ISO-8859-1"), lambda s, p: files.decoded_json(s, p, "name string, code string"))
round_trip("SRC-15", "title_register", "select StillingsBetegnelseNavn as name from title_register", lambda d: d.select(F.to_json(F.struct(F.col("StillingsBetegnelseNavn").alias("name"))).alias("value")), lambda d, p: files.write_text(d, p, gzip=True), lambda s, p: files.documents(s, p).select(F.try_variant_get("document", "$.name", "string").alias("name")))
round_trip("SNK-06", "site_analysis", "select analysis_id, technical_seo.status_code as status, conversion.cta_score as cta from site_analysis", lambda d: d.select(F.struct("analysis_id", F.col("technical_seo.status_code").alias("status")).alias("analysis"), F.struct(F.col("conversion.cta_score").alias("cta")).alias("score")), lambda d, p: files.write_json(d, p),
    lambda s, p: s.read.schema("analysis struct<analysis_id:bigint,status:int>, score struct<cta:int>").json(p).select("analysis.analysis_id", "analysis.status", "score.cta"))
_KEY = "trim(regexp_replace(lower(trim({0})), '[/-]+', ' ', 'g'))"
round_trip("SNK-07", "title_register", f"select distinct {_KEY.format('n')} as key, code from (select StillingsBetegnelseKode as code, unnest([StillingsBetegnelseNavn, Alias1, Alias2]) as n from title_register) where n is not null and n <> ''",
    lambda d: d.select(F.col("StillingsBetegnelseKode").alias("code"), F.explode(F.array("StillingsBetegnelseNavn", "Alias1", "Alias2")).alias("n")).where("n <> ''").select(X.title_key(F.col("n")).alias("key"), "code").distinct(), lambda d, p: d.write.parquet(p), lambda s, p: s.read.parquet(p))
both("SNK-08", "url_cache", "url_cache", "select normalized_key, url from url_cache where cache_id % 3 <> 0 union all select normalized_key, 'https://ny.example/' || cache_id from url_cache where cache_id % 3 = 0")(
    lambda a, b: files.upserted(a.select("normalized_key", "url", F.lit(0).alias("version")), b.where("cache_id % 3 = 0").select("normalized_key", F.concat(F.lit("https://ny.example/"), "cache_id").alias("url"), F.lit(1).alias("version")), "normalized_key", "version").drop("version")
)
