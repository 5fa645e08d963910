"""Page predicates, page facts, discovery, merges and pipelines of the coverage list, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stenbro.functions import dates as D
from stenbro.functions import text as X
from stenbro.functions import web as W
from stenbro.operators import html as H
from stenbro.operators import relational as R
from stenbro.operators import similarity as S
from stenbro.plans.catalogue import ADDRESS, ASCII_SQL, BLANK_SQL, NAME, STATUS, column, on
from stenbro.plans.catalogue2 import WORDS_SQL, both, tokens
from stenbro.plans.catalogue3 import BARE, HOST, LINKS_SQL, PATH, TYPED, facts, links, typed
from stenbro.plans.catalogue4 import UI
from stenbro.queries import query
from stenbro.session import table

# --- page predicates, on the texts of documents -----------------------------------------------------------------------
GONE = "siden findes ikke|ikke fundet|not found|page not found|kunne ikke findes"
column("FIL-33", "documents", "doc_id", "gone", lambda: F.contains(F.col("text"), F.lit("404")) & F.lower("text").rlike(GONE) | (F.length("text") < 400), f"(contains(text, '404') and regexp_matches(lower(text), '{GONE}')) or length(text) < 400")
PARKED = "domain is for sale|domænet er til salg|parked|under construction|under opbygning|coming soon|hosted by|velkommen til dit nye"
column("FIL-30", "documents", "doc_id", "parked", lambda: F.lower("text").rlike(PARKED) & (F.length("text") < 3000), f"regexp_matches(lower(text), '{PARKED}') and length(text) < 3000")
LOGIN_URL, LOGIN_TEXT = "login|log-ind|signin|konto", "password|adgangskode|kodeord"
column("FIL-31", "documents", "doc_id", "login", lambda: (F.lower("url").rlike(LOGIN_URL) & F.lower("text").rlike(LOGIN_TEXT)) | F.lower("text").rlike("type=.password.|mitid"), f"(regexp_matches(lower(url), '{LOGIN_URL}') and regexp_matches(lower(text), '{LOGIN_TEXT}')) or regexp_matches(lower(text), 'type=.password.|mitid')")
BOT = "captcha|are you a robot|verify you are human|checking your browser|cloudflare ray id|access denied"
column("FIL-34", "documents", "doc_id", "challenge", lambda: F.lower("text").rlike(BOT) & (F.length("text") < 5000), f"regexp_matches(lower(text), '{BOT}') and length(text) < 5000")
JS = "enable javascript|aktiver javascript|id=.(root|app|__next|__nuxt).|noscript"
column("FIL-35", "documents", "doc_id", "needs_script", lambda: F.lower("text").rlike(JS) | ((F.size(tokens(X.tag_free(F.col("text")))) < 20) & F.contains(F.col("text"), F.lit("<script"))), f"regexp_matches(lower(text), '{JS}') or (len({WORDS_SQL.format(chr(40) + 'regexp_replace(regexp_replace(text, ' + repr('(?is)<(script|style)[^>]*>.*?</(?:script|style)>') + ', ' + repr(' ') + ', ' + repr('g') + '), ' + repr('<[^<>]*>') + ', ' + repr(' ') + ', ' + repr('g') + '))')}) < 20 and contains(text, '<script'))")
column("FIL-41", "documents", "doc_id", "article", lambda: F.coalesce(F.lower(W.part(F.col("url"), 3)).rlike("/(nyheder|blog|artikler|news|aktuelt)(/|$)") & ~F.lower(W.part(F.col("url"), 3)).rlike("/(kategori|tag|side)/"), F.lit(False)) & F.coalesce(F.lower("text").rlike("<article|og:type|newsarticle|publiceret|offentliggjort"), F.lit(False)), f"coalesce(regexp_matches(lower({PATH.format('url')}), '/(nyheder|blog|artikler|news|aktuelt)(/|$)') and not regexp_matches(lower({PATH.format('url')}), '/(kategori|tag|side)/'), false) and coalesce(regexp_matches(lower(text), '<article|og:type|newsarticle|publiceret|offentliggjort'), false)")
on("FIL-28", "site_analysis", "select analysis_id, x as src, not regexp_matches(x, '(?i)logo|icon|sprite|spacer|pixel') as meaningful, count(*) as n from (select analysis_id, unnest(technical_seo.broken_links_list) as x from site_analysis) where x <> '' group by all")(
    lambda d: facts(d).select("analysis_id", F.inline("images")).groupBy("analysis_id", "src", (~F.col("decorative")).alias("meaningful")).agg(F.count("*").alias("n"))
)
on("FIL-29", "site_analysis", "select analysis_id, g.name as name, coalesce(g.type, 'text') <> 'hidden' as visible, count(*) as n from (select analysis_id, unnest(f.fields) as g from (select analysis_id, unnest(conversion.forms_meta.forms) as f from site_analysis)) where g is not null group by all")(
    lambda d: facts(d).select("analysis_id", F.inline("forms")).select("analysis_id", F.inline("fields")).groupBy("analysis_id", "name", "visible").agg(F.count("*").alias("n"))
)
_T = f"""list_filter(list_transform(regexp_split_to_array("{NAME}", '[^\\p{{L}}\\p{{N}}_]+'), lambda t: regexp_replace(replace(replace(replace(replace(replace(replace(lower(t),'æ','ae'),'ø','oe'),'å','aa'),'é','e'),'ö','o'),'ä','a'), '[^a-z0-9]', '', 'g')), lambda t: length(t) >= 3 and not regexp_matches(t, '^[0-9]+$') and t not in {X.CORE_STOPWORDS!r})"""
on("FIL-39", "company", f"select row_id, len(list_filter(case when len(list_filter(t, lambda x: length(x) >= 5)) > 0 then list_filter(t, lambda x: length(x) >= 5) else t end, lambda x: contains(h, x))) = 0 as weak from (select row_id, {BARE.format('Hjemmeside')} as h, {_T} as t from company where Hjemmeside like 'http%')")(
    lambda d: d.where(F.col("Hjemmeside").startswith("http")).select("row_id", W.bare_host(F.col("Hjemmeside")).alias("h"), X.brand_tokens(F.col(NAME)).alias("t")).withColumn("s", F.filter("t", lambda x: F.length(x) >= 5)).select("row_id", (~F.exists(F.when(F.size("s") > 0, F.col("s")).otherwise(F.col("t")), lambda x: F.contains(F.col("h"), x))).alias("weak"))
)
_PLAUSIBLE = f"coalesce(len(w) between 2 and 4 and len(list_filter(w, lambda x: regexp_matches(x, '^[A-ZÆØÅ]'))) >= 2 and not regexp_matches(name, '[0-9@/]') and upper(name) <> name and len(list_filter(w, lambda x: list_contains({UI!r}, lower(x)))) = 0, false)"
on("FIL-25", "contact_candidate", f"select candidate_id, ({_PLAUSIBLE} and (coalesce(len(emails), 0) > 0 or trim(coalesce(title, '')) <> '')) or coalesce(hints['selector'] = '.team-card', false) and coalesce(len(phones), 0) > 0 or (coalesce(dom_distance <= 1, false) and coalesce(len(list_filter(emails, lambda e: ends_with(lower(e), '@' || lower(site_host)))), 0) > 0 and coalesce(regexp_matches(lower(url), 'kontakt|contact'), false)) as passes from (select *, list_filter(regexp_split_to_array(trim(name), '\\s+'), lambda x: x <> '') as w from contact_candidate)")(
    lambda d: d.select("candidate_id", (
        (F.coalesce(X.is_plausible_name(F.col("name"), UI), F.lit(False)) & ((F.coalesce(F.size("emails"), F.lit(0)) > 0) | (F.trim(F.coalesce("title", F.lit(""))) != "")))
        | (F.coalesce(F.try_element_at("hints", F.lit("selector")) == ".team-card", F.lit(False)) & (F.coalesce(F.size("phones"), F.lit(0)) > 0))
        | (F.coalesce(F.col("dom_distance") <= 1, F.lit(False)) & F.coalesce(F.exists("emails", lambda e: F.lower(e).endswith(F.concat(F.lit("@"), F.lower("site_host")))), F.lit(False)) & F.coalesce(F.lower("url").rlike("kontakt|contact"), F.lit(False)))
    ).alias("passes"))
)

# --- page facts -----------------------------------------------------------------------------------------------------
on("HTM-05", "site_analysis", "select analysis_id, coalesce(basic_seo.canonical_url, '') <> '' as canonical, len(list_filter(coalesce(basic_seo.h1_texts, []), lambda x: x is not null)) as h1_count, coalesce(list_contains(basic_seo.schema_types, 'Product'), false) as product from site_analysis")(
    lambda d: facts(d).select("analysis_id", H.canonical(F.col("canonicals"))[0].isNotNull().alias("canonical"), F.size("h1").alias("h1_count"), F.array_contains("ld_types", "Product").alias("product"))
)
SIGNALS = (("\"@type\": *\"product\"", 50), ("[0-9]+,[0-9]{2} ?(kr|dkk)|(kr|dkk)\\.? ?[0-9]+", 25), ("(\\$|£|€) ?[0-9]+", 10), ("læg i kurv|køb nu|add to cart|indkøbskurv", 25), ("woocommerce|shopify|magento", 20))
_SIGNAL_SQL = " + ".join(f"case when regexp_matches(lower(text), '{p}') then {n} else 0 end" for p, n in SIGNALS)
on("HTM-08", "documents", f"select doc_id, {_SIGNAL_SQL} as score, {_SIGNAL_SQL} >= 60 as product from documents where text is not null")(
    lambda d: d.where("text is not null").select("doc_id", sum((F.when(F.lower("text").rlike(p), n).otherwise(0) for p, n in SIGNALS), F.lit(0)).alias("score")).withColumn("product", F.col("score") >= 60)
)
TRUST = "garanti certificeret anmeldelser e-mærket trustpilot medlem autoriseret iso".split()
column("HTM-12", "documents", "doc_id", "signals", lambda: F.array_join(X.said(F.col("text"), TRUST), ","), f"array_to_string(list_sort(list_filter({TRUST!r}, lambda w: contains(lower(text), w))), ',')", lambda: F.col("text").isNotNull(), "text is not null")
on("HTM-18", "site_analysis", "select analysis_id, 'https://consent.cookiebot.com/uc.js' as src from site_analysis where privacy.detection_method is null and privacy.cookie_banner_confidence = 0.7")(lambda d: facts(d).select("analysis_id", F.explode("scripts").alias("src")))
column("HTM-20", "site_analysis", "analysis_id", "state", lambda: F.when(F.col("technical_seo.status_code").isNull(), "no answer").when(F.col("technical_seo.status_code").isin(401, 403), "closed").when(F.col("technical_seo.status_code") >= 500, "server error").when(F.col("technical_seo.status_code") >= 400, "gone").when(F.lower("basic_seo.title_text").rlike("log ind|login"), "login").otherwise("live"), "case when technical_seo.status_code is null then 'no answer' when technical_seo.status_code in (401, 403) then 'closed' when technical_seo.status_code >= 500 then 'server error' when technical_seo.status_code >= 400 then 'gone' when regexp_matches(lower(basic_seo.title_text), 'log ind|login') then 'login' else 'live' end")
_KEYED = f"""regexp_replace({ASCII_SQL.format(f'''lower(regexp_replace("{NAME}", '(?i)\\s+(aps|a/s|i/s|k/s|ivs|p/s)\\.?$', ''))''')}, '[^a-z0-9]', '', 'g')"""
_HITS = f"len(list_filter(list_distinct({WORDS_SQL.format(f'{chr(34)}{NAME}{chr(34)}')}), lambda w: length(w) >= 3 and contains(lower(title), w)))"
both("HTM-22", "company", "url_cache", f"select row_id, cache_id, case when {_HITS} >= 2 then 3 else 0 end + case when contains(title, Vrvirksomhed_cvrNummer) then 3 else 0 end as confirmed from company c join url_cache u on u.normalized_key = {_KEYED} where title is not null and Vrvirksomhed_cvrNummer is not null")(
    lambda c, u: c.where("Vrvirksomhed_cvrNummer is not null").select("row_id", "Vrvirksomhed_cvrNummer", X.company_key(F.col(NAME)).alias("normalized_key"), F.array_distinct(tokens(F.col(NAME))).alias("w")).join(u.where("title is not null").select("cache_id", "normalized_key", "title"), "normalized_key")
    .select("row_id", "cache_id", (F.when(F.size(F.filter("w", lambda w: (F.length(w) >= 3) & F.contains(F.lower("title"), w))) >= 2, 3).otherwise(0) + F.when(F.contains("title", F.col("Vrvirksomhed_cvrNummer")), 3).otherwise(0)).alias("confirmed"))
)
both("MTH-05", "company", "url_cache", f"select row_id, cache_id, (case when regexp_matches({HOST.format('url')}, '\\.dk$') then 2 else 0 end + least(3, {_HITS}) + case when contains({BARE.format('url')}, {_KEYED}) then 3 else 0 end + case when contains(lower(title), 'vvs') then 1 else 0 end + case when contains(lower(title), 'el') then 1 else 0 end)::bigint as score from company c join url_cache u on u.normalized_key = {_KEYED} where title is not null")(
    lambda c, u: c.select("row_id", X.company_key(F.col(NAME)).alias("normalized_key"), F.array_distinct(tokens(F.col(NAME))).alias("w")).join(u.where("title is not null").select("cache_id", "normalized_key", "url", F.lower("title").alias("t")), "normalized_key")
    .select("row_id", "cache_id", (F.when(W.host_of(F.col("url")).endswith(".dk"), 2).otherwise(0) + F.least(F.lit(3), F.size(F.filter("w", lambda w: (F.length(w) >= 3) & F.contains("t", w)))) + F.when(F.contains(W.bare_host(F.col("url")), F.col("normalized_key")), 3).otherwise(0) + F.when(F.contains("t", F.lit("vvs")), 1).otherwise(0) + F.when(F.contains("t", F.lit("el")), 1).otherwise(0)).cast("bigint").alias("score"))
)

# --- projections, addresses, dates, JSON ----------------------------------------------------------------------------
on("PRJ-11", "site_analysis", "select analysis_id, basic_seo.canonical_url as technical_seo_canonical_url, coalesce(basic_seo.h1, basic_seo.h1_texts[1]) as basic_seo_h1, length(basic_seo.meta_description) as meta_description_length, coalesce(basic_seo.h1_count, len(basic_seo.h1_texts)) as h1_count from site_analysis")(
    lambda d: d.select("analysis_id", F.col("basic_seo.canonical_url").alias("technical_seo_canonical_url"), F.coalesce("basic_seo.h1", F.get("basic_seo.h1_texts", F.lit(0))).alias("basic_seo_h1"), F.length("basic_seo.meta_description").alias("meta_description_length"), F.coalesce("basic_seo.h1_count", F.size("basic_seo.h1_texts")).alias("h1_count"))
)
_STEP = "arg_min(name, candidate_id) filter (where source = '{0}' and trim(name) <> '')"
STEPS = ("json-ld", "mailto", "dom")
on("PRJ-19", "contact_candidate", f"select site_host, coalesce({', '.join(_STEP.format(s) for s in STEPS)}) as name, case " + " ".join(f"when {_STEP.format(s)} is not null then '{s}'" for s in STEPS) + " end as step from contact_candidate group by 1")(
    lambda d: d.groupBy("site_host").agg(*[F.min_by(F.struct("name", "source"), F.when((F.col("source") == s) & (F.trim("name") != ""), F.col("candidate_id"))).alias(f"s{k}") for k, s in enumerate(STEPS)]).select("site_host", R.waterfall(*[F.col(f"s{k}") for k in range(len(STEPS))]).alias("s")).select("site_host", "s.name", F.col("s.source").alias("step"))
)
on("URL-09", "site_analysis", f"select t.analysis_id, href, case when coalesce(list_contains(basic_seo.schema_types, 'Product'), false) then 'product' when kind = 'product' and coalesce(len(basic_seo.schema_types), 0) > 0 then 'other' else kind end as kind from ({TYPED}) t join site_analysis using (analysis_id)")(
    lambda d: links(d.select("analysis_id", "url", "technical_seo")).select("analysis_id", "href", W.page_type(F.col("href"))["kind"].alias("k")).join(d.select("analysis_id", F.col("basic_seo.schema_types").alias("t")), "analysis_id").select("analysis_id", "href", F.when(F.coalesce(F.array_contains("t", "Product"), F.lit(False)), "product").when((F.col("k") == "product") & (F.coalesce(F.size("t"), F.lit(0)) > 0), "other").otherwise(F.col("k")).alias("kind"))
)
LOCALES = {"dk": "da-DK", "se": "sv-SE", "no": "nb-NO", "de": "de-DE", "fi": "fi-FI", "example": "da-DK"}
column("URL-11", "url_cache", "cache_id", "locale", lambda: X.labelled(F.element_at(F.split(W.host_of(F.col("url")), r"\."), -1), LOCALES, "en-GB"), f"case string_split({HOST.format('url')}, '.')[-1] " + " ".join(f"when '{k}' then '{v}'" for k, v in LOCALES.items()) + " else 'en-GB' end", lambda: F.col("url").isNotNull(), "url is not null")
_MONTHS_SQL = "case lower(regexp_extract({0}, '[a-z]+')) " + " ".join(f"when '{m}' then {k}" for k, m in enumerate(D.MONTHS, 1)) + " end"
_DA = "[0-9]{1,2}\\.? (?:" + "|".join(D.MONTHS) + ") [0-9]{4}"
on("DAT-04", "documents", f"select doc_id, list_max(list_concat(list_transform(regexp_extract_all(text, '\\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\b'), lambda x: try_cast(x as date)), list_transform(regexp_extract_all(lower(text), '{_DA}'), lambda x: try_cast(regexp_extract(x, '([0-9]{{4}})$', 1) || '-' || lpad(({_MONTHS_SQL.format('x')})::varchar, 2, '0') || '-' || lpad(regexp_extract(x, '^[0-9]+'), 2, '0') as date)))) as latest from documents where text is not null")(
    lambda d: d.where("text is not null").select("doc_id", F.array_max(F.concat(F.transform(F.regexp_extract_all("text", F.lit(r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"), F.lit(0)), lambda x: F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).cast("date")), F.transform(F.regexp_extract_all(F.lower("text"), F.lit(_DA), F.lit(0)), lambda x: D.danish(x).cast("date")))).alias("latest"))
)
on("DAT-05", "site_analysis", "select analysis_id, greatest(j, s, m) as latest, case greatest(j, s, m) when j then 'json-ld' when m then 'meta' else 'sitemap' end as source from (select analysis_id, case when len(basic_seo.schema_types) > 0 then fetched_at::date end as j, case when analysis_id % 3 = 0 then ingested_at::date end as s, case when analysis_id % 2 = 0 then fetched_at::date end as m from site_analysis) where j is not null or s is not null or m is not null")(
    lambda d: facts(d).select("analysis_id", D.iso(F.array_max("dates")).cast("date").alias("j")).join(d.select("analysis_id", F.when(F.col("analysis_id") % 3 == 0, F.to_date("ingested_at")).alias("s"), F.when(F.col("analysis_id") % 2 == 0, F.to_date("fetched_at")).alias("m")), "analysis_id")
    .withColumn("latest", F.greatest("j", "s", "m")).where("latest is not null").select("analysis_id", "latest", F.when(F.col("j") == F.col("latest"), "json-ld").when(F.col("m") == F.col("latest"), "meta").otherwise("sitemap").alias("source"))
)
on("JSN-03", "events", "select event_id, (props->>'$.k')::int as k from events")(
    lambda d: d.select("event_id", F.concat(F.lit("<script>window.__INITIAL_STATE__ = {data: "), "props", F.lit(", tom: undefined,};</script>")).alias("h")).select("event_id", F.get_json_object(H.runtime_state(F.col("h")), "$.data.k").cast("int").alias("k"))
)
on("JSN-07", "company", f"""select row_id, trim("{ADDRESS}postnummer") as zip, trim("{ADDRESS}postdistrikt") as city from company where regexp_matches("{ADDRESS}postnummer", '^[0-9]{{4}}$') and regexp_matches(trim("{ADDRESS}postdistrikt"), '^[^0-9,]+$') and "{ADDRESS}vejnavn" is not null and not contains("{ADDRESS}vejnavn", ',')""")(
    lambda d: d.where(F.col(ADDRESS + "postnummer").rlike("^[0-9]{4}$") & F.trim(F.col(ADDRESS + "postdistrikt")).rlike("^[^0-9,]+$") & F.col(ADDRESS + "vejnavn").isNotNull() & ~F.contains(F.col(ADDRESS + "vejnavn"), F.lit(","))).select("row_id", F.concat(ADDRESS + "vejnavn", F.lit(" 7, "), ADDRESS + "postnummer", F.lit(" "), F.trim(F.col(ADDRESS + "postdistrikt")), F.lit(", Danmark")).alias("a")).select("row_id", *[c.alias(n) for n, c in X.address_tail(F.col("a")).items()])
)
on("JSN-09", "company", """select row_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split("Direktørnavn", ';'), lambda x: trim(x)), lambda x: x not in ('', 'N/A')))), '; ') as directors from company where "Direktørnavn" is not null""")(
    lambda d: d.where("`Direktørnavn` is not null").select("row_id", F.concat(F.transform(F.split("Direktørnavn", ";"), lambda x: F.struct(F.lit("PERSON").alias("kind"), F.lit("DIREKTION").alias("role"), x.alias("name"))), F.array(F.struct(F.lit("VIRKSOMHED").alias("kind"), F.lit("DIREKTION").alias("role"), F.lit("Holding").alias("name")), F.struct(F.lit("PERSON").alias("kind"), F.lit("REVISION").alias("role"), F.lit("En Revisor").alias("name")))).alias("p"))
    .select("row_id", F.array_join(X.participants(F.col("p"), "PERSON", ("DIREKTION", "BESTYRELSE")), "; ").alias("directors"))
)

# --- merges, discovery, pipelines -----------------------------------------------------------------------------------
query("AGG-19")(lambda spark, sf_dir: table(spark, sf_dir, "site_analysis").select("analysis_id", X.spread(F.col("conversion.form_field_counts"), 2).alias("kept")))
on("AGG-23", "site_analysis", "select site_host, case when bool_or(r = 'login') then 'false' when bool_or(r = 'live') then 'true' when bool_and(r = 'ssl error') then 'true' else arg_max(r, analysis_id) end as live from (select site_host, analysis_id, case when technical_seo.status_code = 200 then 'live' when technical_seo.status_code = 403 then 'login' when technical_seo.status_code is null then 'ssl error' else 'status ' || technical_seo.status_code end as r from site_analysis) group by 1")(
    lambda d: d.select("site_host", "analysis_id", F.when(F.col("technical_seo.status_code") == 200, "live").when(F.col("technical_seo.status_code") == 403, "login").when(F.col("technical_seo.status_code").isNull(), "ssl error").otherwise(F.concat(F.lit("status "), F.col("technical_seo.status_code").cast("string"))).alias("r")).groupBy("site_host").agg(F.bool_or(F.col("r") == "login").alias("a"), F.bool_or(F.col("r") == "live").alias("b"), F.bool_and(F.col("r") == "ssl error").alias("c"), F.max_by("r", "analysis_id").alias("d")).select("site_host", F.when(F.col("a"), "false").when(F.col("b") | F.col("c"), "true").otherwise(F.col("d")).alias("live"))
)
on("AGG-18", "site_analysis", "select analysis_id, round_even(100.0 * count(*) filter (where k % 2 = 0) / count(*), 1)::double as alt_pct, avg(length(x))::double as mean_size from (select analysis_id, x, k, row_number() over (partition by analysis_id order by k) as r from (select analysis_id, unnest(b) as x, unnest(range(len(b))) as k from (select analysis_id, technical_seo.broken_links_list as b from site_analysis)) where x is not null) where r <= 8 group by 1")(
    lambda d: facts(d).select("analysis_id", F.inline(F.slice("images", 1, 8))).groupBy("analysis_id").agg(F.bround(F.count_if(F.col("alt").isNotNull()) * 100.0 / F.count("*"), 1).cast("double").alias("alt_pct"), F.avg(F.length("src")).alias("mean_size"))
)
query("TXT-22")(
    lambda spark, sf_dir: S.measured(_near(spark, sf_dir), "name", "title", similarity=(S.ratio, "double")).select("row_id", "cache_id", "similarity")
)
query("TXT-23")(lambda spark, sf_dir: S.measured(_near(spark, sf_dir), "name", "title", distance=(S.edits, "int"), confusable=(S.confusable, "boolean")).select("row_id", "cache_id", "distance", "confusable"))


def _near(spark, sf_dir: str) -> DataFrame:
    """Names and titles of firms and pages that share a lookup key."""
    c, u = table(spark, sf_dir, "company"), table(spark, sf_dir, "url_cache")
    return c.select("row_id", F.col(NAME).alias("name"), X.company_key(F.col(NAME)).alias("normalized_key")).join(u.select("cache_id", "normalized_key", "title"), "normalized_key").select("row_id", "cache_id", "name", "title")


query("JOI-09")(
    lambda spark, sf_dir: S.accepted_places(
        table(spark, sf_dir, "company").select(F.col("row_id").alias("firm_id"), F.col(NAME).alias("name"), W.bare_host(F.col("Hjemmeside")).alias("host"), X.phone_key(F.col("Telefon")).alias("phone")),
        table(spark, sf_dir, "url_cache").select(F.col("cache_id").alias("place_id"), F.col("title").alias("name"), W.bare_host(F.col("url")).alias("host"), F.lit(None).cast("string").alias("phone")),
    )
)
BOXES = "('info','kontakt','kontor','mail','post','salg','ordre','firma','bogholderi')"
on("EXT-08", "contact_candidate", f"select site_host, array_to_string(list_sort(list(e) filter (where r <= 3)), '; ') as mails, max(p) as phone from (select site_host, e, null as p, row_number() over (partition by site_host order by e) as r from (select distinct site_host, lower(e) as e from (select site_host, unnest(emails) as e from contact_candidate) where split_part(lower(e), '@', 1) in {BOXES} and ends_with(lower(e), '@' || lower(site_host))) union all select site_host, null, arg_min(p, (case when source = 'json-ld' then 0 else 1 end, p)), 99 from (select site_host, source, unnest(phones) as p from contact_candidate) where p is not null group by 1) group by 1")(
    lambda d: R.top_per(d.select("site_host", F.explode("emails").alias("e")).where(X.is_generic_box(F.col("e")) & F.lower("e").endswith(F.concat(F.lit("@"), F.lower("site_host")))).select("site_host", F.lower("e").alias("e")).distinct(), ["site_host"], [F.col("e")], 3).groupBy("site_host").agg(F.array_join(F.array_sort(F.collect_list("e")), "; ").alias("mails"))
    .join(d.select("site_host", "source", F.explode("phones").alias("p")).where("p is not null").groupBy("site_host").agg(F.min_by("p", F.struct(F.when(F.col("source") == "json-ld", 0).otherwise(1), "p")).alias("phone")), "site_host", "full_outer")
)
_SLUG = "case when regexp_matches(p, '(kontakt|contact)') then 40 when regexp_matches(p, '(team|medarbejdere|om-os)') then 25 else 0 end - length(p)"
on("EXT-10", "site_analysis", f"select site_host, href, pos from (select site_host, href, row_number() over (partition by site_host order by {_SLUG} desc, href) as pos from (select distinct s.site_host, href, lower({PATH.format('href')}) as p from {LINKS_SQL} l join site_analysis s using (analysis_id) where {BARE.format('href')} = s.site_host)) where pos <= 20")(
    lambda d: (lambda l: R.top_per(l.where(W.bare_host(F.col("href")) == F.col("site_host")).select("site_host", "href", F.lower(W.part(F.col("href"), 3)).alias("p")).distinct(), ["site_host"], [F.desc(F.when(F.col("p").rlike("kontakt|contact"), 40).when(F.col("p").rlike("team|medarbejdere|om-os"), 25).otherwise(0) - F.length("p")), F.col("href")], 20).select("site_host", "href", "pos"))(
        links(d).join(d.select("analysis_id", "site_host"), "analysis_id")
    )
)
on("EXT-12", "site_analysis", f"select site_host, count(*)::bigint as n_links, count(distinct href) as n_distinct, count(*) filter (where kind = 'product') as n_product, count(*) filter (where kind = 'info') as n_info, count(*) filter (where kind = 'category') as n_category from ({TYPED}) t join site_analysis s using (analysis_id) group by 1")(
    lambda d: typed(d).join(d.select("analysis_id", "site_host"), "analysis_id").groupBy("site_host").agg(F.count("*").alias("n_links"), F.count_distinct("href").alias("n_distinct"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("product", "info", "category")])
)
_MAILHOST = "nullif(regexp_extract(lower(Email), '@([a-z0-9.-]+\\.[a-z]+)$', 1), '')"
on("EXT-14", "company", f"""select row_id, trim("{NAME}") as name, list_filter(list_transform(regexp_split_to_array("Direktørnavn", '[;,|/"]+'), lambda x: trim(x)), lambda x: x not in ('', 'N/A'))[1] as director, right(regexp_replace(Telefon, '[^0-9]', '', 'g'), 8) as phone, try_cast(AntalAnsatte as int) as employees from company where upper("{STATUS}") in ('AKTIV', 'NORMAL')""")(
    lambda d: d.where(F.upper(F.col(STATUS)).isin("AKTIV", "NORMAL")).select("row_id", F.trim(F.col(NAME)).alias("name"), F.get(F.filter(F.transform(F.split("Direktørnavn", r'[;,|/"]+'), lambda x: F.trim(x)), lambda x: ~x.isin("", "N/A")), F.lit(0)).alias("director"), X.phone_key(F.col("Telefon")).alias("phone"), F.col("AntalAnsatte").try_cast("int").alias("employees"))
)
on("EXT-16", "company", f"select row_id, coalesce(case when Hjemmeside is not null and not {BLANK_SQL.format('Hjemmeside')} then Hjemmeside end, case when HjemmesideGMB is not null and not {BLANK_SQL.format('HjemmesideGMB')} then HjemmesideGMB end, 'https://' || {_MAILHOST}) as site, case when Hjemmeside is not null and not {BLANK_SQL.format('Hjemmeside')} then 'given' when HjemmesideGMB is not null and not {BLANK_SQL.format('HjemmesideGMB')} then 'gmb' when {_MAILHOST} is not null then 'mail' end as source from company")(
    lambda d: d.withColumn("m", F.nullif(F.regexp_extract(F.lower("Email"), r"@([a-z0-9.-]+\.[a-z]+)$", 1), F.lit(""))).select("row_id", R.waterfall(X.filled(F.col("Hjemmeside")), X.filled(F.col("HjemmesideGMB")), F.concat(F.lit("https://"), "m")).alias("site"), F.when(X.is_filled(F.col("Hjemmeside")), "given").when(X.is_filled(F.col("HjemmesideGMB")), "gmb").when(F.col("m").isNotNull(), "mail").alias("source"))
)
