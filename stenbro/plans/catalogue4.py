"""Operators of the coverage list that need several branches or thresholds, each in full, with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from stenbro.functions import text as X
from stenbro.functions import web as W
from stenbro.operators import relational as R
from stenbro.operators import rules, titles
from stenbro.plans.catalogue import ADDRESS, ASCII_SQL, BLANK_SQL, NAME, STATUS, on
from stenbro.plans.catalogue2 import WORDS_SQL, both, tokens
from stenbro.plans.catalogue3 import AGG_DOMAINS, ASSET, BARE, HOST, IP_SQL, LINKS_SQL, PATH, QUERY, _ip, hosts, links
from stenbro.queries import query
from stenbro.session import table

# --- filters --------------------------------------------------------------------------------------------------------
PLACE = "rav"
on("FIL-01", "company", f"""select row_id from company where Branchekode = '905710' and ("{ADDRESS}postnummer" in ('1014','1015','1028') or contains(lower("{ADDRESS}postdistrikt"), '{PLACE}'))""")(
    lambda d: d.where((F.col("Branchekode") == "905710") & (F.col(ADDRESS + "postnummer").isin("1014", "1015", "1028") | F.contains(F.lower(F.col(ADDRESS + "postdistrikt")), F.lit(PLACE)))).select("row_id")
)
#: Status phrases of firms that are closed or closing; fixed.
CLOSED = (
    "OPHØRT", "UNDER FRIVILLIG LIKVIDATION", "UNDER KONKURS", "UNDER REASSUMERING", "UNDER REKONSTRUKTION", "UNDER TVANGSOPLØSNING", "OPLØST EFTER ERKLAERING",
    "OPLØST EFTER FRIVILLIG LIKVIDATION", "OPLØST EFTER FUSION", "OPLØST EFTER GRAENSEOVERSKRIDENDE FUSION", "OPLØST EFTER GRAENSEOVERSKRIDENDE HJEMSTEDSFLYTNING",
    "OPLØST EFTER GRAENSEOVERSKRIDENDE SPALTNING", "OPLØST EFTER KONKURS", "OPLØST EFTER SPALTNING", "SLETTET", "TVANGSOPLØST",
)
#: What a row's history of states holds: its own, and by its number one of these.
STATES = ["Normal", "Under reassumering", "Opløst efter fusion", "Aktiv", "", "Tvangsopløst den 1.1."]
on("FIL-03", "company", f"""select row_id from company where len(list_filter({list(CLOSED)!r}, lambda p: len(list_filter(["{STATUS}", {STATES!r}[(row_id % 6 + 1)::int]], lambda s: contains(upper(s), p))) > 0)) = 0""")(
    lambda d: d.withColumn("h", F.array(F.col(STATUS), F.element_at(F.array(*map(F.lit, STATES)), (F.col("row_id") % 6 + 1).cast("int")))).where(~F.exists("h", lambda s: F.coalesce(X.any_of(F.upper(s), CLOSED), F.lit(False)))).select("row_id")
)
HOSTS_SQL = f"(select row_id, {HOST.format('Hjemmeside')} as h from company union all select row_id, regexp_extract(lower(Email), '@([a-z0-9.-]+)', 1) from company)"
on("FIL-09", "company", f"select row_id, h, h = '' or regexp_matches(h, '\\.(tele|get2net|mail)\\.dk$') or regexp_matches(regexp_replace(h, '^www\\.', ''), '{AGG_DOMAINS}') as bad from {HOSTS_SQL}")(
    lambda d: hosts(d).withColumn("bad", (F.col("h") == "") | X.ends_any(F.col("h"), X.ISP_SUFFIXES) | F.regexp_replace("h", r"^www\.", "").rlike(AGG_DOMAINS))
)
CHECKED = f"(select analysis_id, href from {LINKS_SQL} union all select analysis_id, 'http://' || {IP_SQL} || '/x' from site_analysis union all select analysis_id, 'https://cdn.' || site_host || '/a' from site_analysis union all select analysis_id, 'https://' || site_host || '/IMG/a/resize/b' from site_analysis)"
on("FIL-11", "site_analysis", f"select analysis_id, href, coalesce(regexp_matches(lower(href), '^https?://') and not {ASSET.format('href')} and not regexp_matches({HOST.format('href')}, '^(m2|cdn|media|assets|static)\\.') and not (contains(lower(split_part(href,'?',1)), '/img/') and contains(lower(split_part(href,'?',1)), '/resize/')) and not (p[4] <> '' and try_cast(p[4] as int) < 256 and (p[1] in ('10','127') or (p[1] = '172' and try_cast(p[2] as int) between 16 and 31) or (p[1] = '192' and p[2] = '168') or (p[1] = '169' and p[2] = '254'))), false) as worth from (select *, case when regexp_matches({HOST.format('href')}, '^[0-9.]+$') then string_split({HOST.format('href')}, '.') else ['','','',''] end as p from {CHECKED})")(
    lambda d: links(d).select("analysis_id", "href").unionByName(d.select("analysis_id", F.explode(F.array(F.concat(F.lit("http://"), _ip("analysis_id"), F.lit("/x")), F.concat(F.lit("https://cdn."), "site_host", F.lit("/a")), F.concat(F.lit("https://"), "site_host", F.lit("/IMG/a/resize/b")))).alias("href"))).withColumn("worth", F.coalesce(W.worth_checking(F.col("href"), X.is_asset(F.col("href"))), F.lit(False)))
)
on("FIL-16", "contact_candidate", f"select candidate_id, h = s as same_host, array_to_string(string_split(h, '.')[-2:], '.') = array_to_string(string_split(s, '.')[-2:], '.') as same_apex, string_split(h, '.')[-1] = string_split(s, '.')[-1] as same_tld, string_split(h, '.')[-2] = string_split(s, '.')[-2] as same_brand from (select candidate_id, {BARE.format('url')} as h, regexp_replace(lower(site_host), '^www\\.', '') as s from contact_candidate)")(
    lambda d: d.select("candidate_id", W.bare_host(F.col("url")).alias("h"), F.regexp_replace(F.lower("site_host"), r"^www\.", "").alias("s")).select("candidate_id", (F.col("h") == F.col("s")).alias("same_host"), (X.apex(F.col("h")) == X.apex(F.col("s"))).alias("same_apex"), *[(F.try_element_at(F.split("h", r"\."), F.lit(k)) == F.try_element_at(F.split("s", r"\."), F.lit(k))).alias(n) for k, n in ((-1, "same_tld"), (-2, "same_brand"))])
)
FAKE_DOMAINS, FAKE = ("example.com", "test.dk", "domain.com", "mysite.com", "yourdomain.com"), ("contact@mysite.com", "contact@example.com", "support@example.com", "admin@example.com", "noreply@example.com")
MAILS_SQL = "(select candidate_id, unnest(list_concat(emails, ['Noreply@Example.com', 'a@sub.test.dk', 'b@TEST.dk', 'ny@mysite.com', 'ok' || candidate_id || '@firma.example'])) as e from contact_candidate where emails is not null)"
on("FIL-20", "contact_candidate", f"select candidate_id, e as email from {MAILS_SQL} where e <> '' and lower(e) not in {FAKE!r} and string_split(lower(e), '@')[-1] not in {FAKE_DOMAINS!r}")(
    lambda d: d.where("emails is not null").select("candidate_id", F.explode(F.concat("emails", F.array(*map(F.lit, ("Noreply@Example.com", "a@sub.test.dk", "b@TEST.dk", "ny@mysite.com")), F.concat(F.lit("ok"), "candidate_id", F.lit("@firma.example"))))).alias("email")).where((F.col("email") != "") & ~F.lower("email").isin(*FAKE) & ~F.element_at(F.split(F.lower("email"), "@"), -1).isin(*FAKE_DOMAINS))
)
NUMBERS_SQL = "(select candidate_id, unnest(list_concat(phones, ['20' || substr(candidate_id::varchar, 1, 6), '3' || substr(candidate_id::varchar, 1, 7), '+45 4' || substr(candidate_id::varchar, 1, 7), '45 20' || substr(candidate_id::varchar, 1, 6), '71' || substr(candidate_id::varchar, 1, 6)])) as p from contact_candidate where phones is not null)"
on("FIL-23", "contact_candidate", f"select candidate_id, p as phone, regexp_matches(n, '^(?:2[1-9]|[4-9][0-9])[0-9]{{6}}$') or regexp_matches(n, '^45(?:2[1-9]|[3-9][0-9])[0-9]{{6}}$') as valid from (select candidate_id, p, regexp_replace(p, '[^0-9]', '', 'g') as n from {NUMBERS_SQL}) where p is not null")(
    lambda d: d.where("phones is not null").select("candidate_id", F.explode(F.concat("phones", F.array(*[F.concat(F.lit(a), F.substr(F.col("candidate_id").cast("string"), F.lit(1), F.lit(n))) for a, n in (("20", 6), ("3", 7), ("+45 4", 7), ("45 20", 6), ("71", 6))]))).alias("phone")).where("phone is not null").withColumn("valid", X.is_danish_phone(X.phone_digits(F.col("phone"))))
)
UI = "kontakt os find vej læs mere salg support team om info menu ring se alle telefon mail direktør chef leder adresse vej gade torv".split()
on("FIL-24", "contact_candidate", f"select candidate_id, coalesce(len(w) between 2 and 4 and len(list_filter(w, lambda x: regexp_matches(x, '^[A-ZÆØÅ]'))) >= 2 and not regexp_matches(name, '[0-9@/]') and upper(name) <> name and len(list_filter(w, lambda x: list_contains({UI!r}, lower(x)))) = 0, false) as plausible from (select candidate_id, name, list_filter(regexp_split_to_array(trim(name), '\\s+'), lambda x: x <> '') as w from contact_candidate)")(
    lambda d: d.select("candidate_id", F.coalesce(X.is_plausible_name(F.col("name"), UI), F.lit(False)).alias("plausible"))
)
CITY = "case when lower(trim({0})) in ('', 'n/a') then null when lower(trim({0})) = 'copenhagen' then 'københavn' else lower(trim({0})) end"
on("FIL-40", "company", f"""select row_id, case when z1 is not null and z2 is not null then z1 <> z2 when c1 is not null and c2 is not null then c1 <> c2 else false end as mismatch from (select row_id, case when not {BLANK_SQL.format('GPlacePostnr')} then trim(GPlacePostnr) end as z1, case when not {BLANK_SQL.format(f'"{ADDRESS}postnummer"')} then trim("{ADDRESS}postnummer") end as z2, {CITY.format('GPlaceBy')} as c1, {CITY.format(f'"{ADDRESS}postdistrikt"')} as c2 from company)""")(
    lambda d: d.select("row_id", X.places_differ(F.col("GPlacePostnr"), F.col(ADDRESS + "postnummer"), F.col("GPlaceBy"), F.col(ADDRESS + "postdistrikt")).alias("mismatch"))
)

# --- rules ----------------------------------------------------------------------------------------------------------
on("RUL-03", "site_analysis", "select analysis_id, coalesce(basic_seo.word_count > 100, false) as more, coalesce(basic_seo.word_count < 100, false) as fewer, false as of_text from site_analysis")(
    lambda d: d.select("analysis_id", rules.predicate(F.col("basic_seo.word_count"), "gt", threshold=100).alias("more"), rules.predicate(F.col("basic_seo.word_count"), "<", threshold=100).alias("fewer"), rules.predicate(F.col("url"), "greater_than", threshold=1).alias("of_text"))
)
on("RUL-04", "site_analysis", "select analysis_id, coalesce(basic_seo.word_count >= 100, false) as least, coalesce(basic_seo.word_count <= 100, false) as most from site_analysis")(
    lambda d: d.select("analysis_id", rules.predicate(F.col("basic_seo.word_count"), "ge", threshold=100).alias("least"), rules.predicate(F.col("basic_seo.word_count"), "less_than_or_equal", threshold=100).alias("most"))
)
on("RUL-08", "site_analysis", "select analysis_id, coalesce(list_contains(basic_seo.schema_types, 'LocalBusiness'), false) as listed, coalesce(contains(lower(technical_seo.render_status), 'content'), false) as said from site_analysis")(
    lambda d: d.select("analysis_id", rules.predicate(F.col("basic_seo.schema_types"), "contains", listed=True, threshold="LocalBusiness").alias("listed"), rules.predicate(F.col("technical_seo.render_status"), "contains", threshold="CONTENT").alias("said"))
)
on("RUL-10", "site_analysis", "select analysis_id, coalesce(regexp_matches(url, '(?i)^HTTPS://WWW'), false) as good, false as bad from site_analysis")(
    lambda d: d.select("analysis_id", rules.predicate(F.col("url"), "regex", threshold="^HTTPS://WWW").alias("good"), rules.predicate(F.col("url"), "regex", threshold="([a-z").alias("bad"))
)
LEVELED = {"type": "range", "levels": [{"max": 200, "points": 15}, {"min": 200, "max": 800, "points": 0}, {"type": "gte", "threshold": 2000, "points": 1}]}
on("RUL-11", "site_analysis", "select analysis_id, case when v <= 200 then 15 when v <= 800 then 0 when v >= 2000 then 1 else 0 end as points, coalesce(v <= 800 or v >= 2000, false) as passed from (select analysis_id, technical_seo.response_time_ms as v from site_analysis)")(
    lambda d: d.select("analysis_id", *[c.alias(n) for c, n in zip(rules.outcome(F.col("technical_seo.response_time_ms"), LEVELED), ("points", "passed"), strict=True)])
)

# --- projections ----------------------------------------------------------------------------------------------------
OUTPUT = [
    "Vrvirksomhed_cvrNummer", NAME, "Direktørnavn", "Telefon", "Email", "Hjemmeside", "HjemmesideGMB", "HjemmesideGMB_Rå", "HjemmesideGMB_Kilde", "HjemmesideGMB_PlaceId", "HjemmesideGMB_By", "HjemmesideGMB_Postnr",
    "HjemmesideGMB_Status", "HjemmesideGMB_Score", "HjemmesideGMB_Confirm", "HjemmesideLiveBool", "HjemmesideBemærkning", "HjemmesideKilde", "HjemmesideSøgeord", "HjemmesideKandidater", "HjemmesideScore",
    "HjemmesideConfirm", "HjemmesidePlaceId", "HjemmesideRå", "HjemmesideNotat", "GPlaceBy", "GPlacePostnr", ADDRESS + "vejnavn", ADDRESS + "husnummerFra", ADDRESS + "postnummer", ADDRESS + "postdistrikt",
    "Branchekode", "Branchetekst", "AntalAnsatte", "Vrvirksomhed_virksomhedMetadata_nyesteVirksomhedsform_virksomhedsformkode", "Vrvirksomhed_virksomhedMetadata_nyesteVirksomhedsform_langBeskrivelse", STATUS,
    "Vrvirksomhed_virksomhedMetadata_ophørsDato", "HjemmesideFindesIkke",
]
on("PRJ-04", "company", "select row_id, " + ", ".join(f"""coalesce("{c}", 'N/A') as "{c}\"""" if c != "HjemmesideFindesIkke" else f"'N/A' as {c}" for c in OUTPUT) + " from company")(
    lambda d: d.select("row_id", *[F.coalesce(F.col(c).cast("string") if c in d.columns else F.lit(None), F.lit("N/A")).alias(c) for c in OUTPUT])
)
PATHS = {"a": "technical_seo.broken_links_list[0].url", "b": "technical_seo.broken_links_list.0.url", "c": "conversion.emails_found[0]", "d": "technical_seo.broken_links_list[0:2]", "e": "no.such[3].path"}
JSON_OK = "payload is not null and json_valid(payload)"
on("PRJ-06", "analysis_raw", f"select analysis_id, payload->>'$.technical_seo.broken_links_list[0].url' as a, payload->>'$.technical_seo.broken_links_list[0].url' as b, payload->>'$.conversion.emails_found[0]' as c, null::varchar as d, 'none' as e from analysis_raw where {JSON_OK}")(
    lambda d: d.where(F.try_parse_json("payload").isNotNull()).select("analysis_id", *[X.at_path(F.col("payload"), p, "none" if n == "e" else None).alias(n) for n, p in PATHS.items()])
)
on("PRJ-10", "site_analysis", "select analysis_id, coalesce(nullif(basic_seo.title_text, ''), basic_seo.h1) as text, array_to_string(case when len(basic_seo.h1_texts) > 0 then basic_seo.h1_texts else basic_seo.schema_types end, '|') as list, coalesce(nullif(technical_seo.broken_links_count, 0), technical_seo.links_checked) as number from site_analysis")(
    lambda d: d.select("analysis_id", X.overlay(F.col("basic_seo.h1"), F.col("basic_seo.title_text"), F.lit("")).alias("text"), F.array_join(X.overlay(F.col("basic_seo.schema_types"), F.col("basic_seo.h1_texts"), F.array().cast("array<string>")), "|").alias("list"), X.overlay(F.col("technical_seo.links_checked"), F.col("technical_seo.broken_links_count"), F.lit(0)).alias("number"))
)
_GIVEN = "case when trim({0}) in ('', 'N/A') then null else trim({0}) end"
on("SRC-30", "profiles", f"select profile_id, coalesce({_GIVEN.format('fullname')}, nullif(concat_ws(' ', {_GIVEN.format('first_name')}, {_GIVEN.format('last_name')}), '')) as name, {_GIVEN.format('headline')} as title, profile_url as url, 'linkedin' as source, location.city as city from profiles")(
    lambda d: (lambda g: d.select("profile_id", F.coalesce(g("fullname"), F.nullif(F.concat_ws(" ", g("first_name"), g("last_name")), F.lit(""))).alias("name"), g("headline").alias("title"), F.col("profile_url").alias("url"), F.lit("linkedin").alias("source"), F.col("location.city").alias("city")))(lambda c: F.when(~F.trim(c).isin("", "N/A"), F.trim(c)))
)

# --- joins, aggregates, windows -------------------------------------------------------------------------------------
NAMES_SQL = "(select StillingsBetegnelseKode as code, StillingsBetegnelseNavn as n, true as main from title_register union all select StillingsBetegnelseKode, Alias1, false from title_register union all select StillingsBetegnelseKode, Alias2, false from title_register)"
FUZZY = f"""k as (select distinct code, unnest({WORDS_SQL.format('n')}) as t from {NAMES_SQL}), m as (select distinct code, unnest({WORDS_SQL.format('n')}) as t from {NAMES_SQL} where main), raw as (select v, unnest({WORDS_SQL.format('v')}) as t from vals), s as (select v, code, count(*) as n from raw join k using (t) group by all), r as (select *, row_number() over (partition by v order by n desc, code) as r from s), b as (select v, min(code) filter (where r = 1) as code, max(n) as best, sum(n) filter (where r <= 3) as three from r group by 1), f as (select v, code from b where best / three >= 0.98 and (select count(*) from m where m.code = b.code and m.t in (select t from raw where raw.v = b.v)) / (select count(*) from m where m.code = b.code) >= 0.75)"""
both("JOI-05", "profiles", "title_register", f"with vals as (select distinct headline as v from profiles where headline is not null), {FUZZY} select profile_id, f.code from profiles join f on f.v = headline")(
    lambda p, t: p.select("profile_id", F.col("headline").alias("v")).join(titles.fuzzy(p.select(F.col("headline").alias("v")).where("v is not null").distinct(), titles.named(t), tokens), "v").select("profile_id", "code")
)
OVERRIDES = {"boss": "Direktør", "salgschef": "Salgsleder"}
_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(translate(lower(trim({0})), 'éèêëáàâäóòôöúùûüíìîïåñç', 'eeeeaaaaoooouuuuiiiianc'), '[^\\p{{L}}\\p{{N}}_\\s/+&-]', ' ', 'g'), '[/-]+', ' ', 'g'), '\\s{{2,}}', ' ', 'g'))"
both("JOI-04", "contact_candidate", "title_register", f"""with vals as (select distinct title as v from contact_candidate where trim(title) <> ''), e as (select {_KEY.format('n')} as key, max(code) as code from {NAMES_SQL} where n <> '' group by 1), {FUZZY}, o as (select v, case when {_KEY.format('v')} = 'boss' then 'Direktør' when {_KEY.format('v')} = 'salgschef' then 'Salgsleder' end as label from vals) select candidate_id, case when o.label is not null then 'override' when e.code is not null then 'exact' when f.code is not null then 'fuzzy' end as how, case when o.label is not null then coalesce((select code from e where key = lower(o.label)), 'custom') else coalesce(e.code, f.code) end as code from contact_candidate c join o on o.v = c.title left join e on e.key = {_KEY.format('c.title')} left join f on f.v = c.title where o.label is not null or e.code is not null or f.code is not null""")(
    lambda c, t: c.select("candidate_id", F.col("title").alias("v")).join(titles.looked_up(c.select(F.col("title").alias("v")).where("trim(v) <> ''").distinct(), titles.named(t), tokens, OVERRIDES), "v").select("candidate_id", "how", "code")
)
both("JOI-12", "documents", "city_register", f"with d as (select doc_id, unnest({WORDS_SQL.format('text')}) as t from documents), s as (select distinct unnest({WORDS_SQL.format('by_navn')}) as t from city_register) select doc_id, count(*) as n from d anti join s using (t) group by 1")(
    lambda d, c: d.select("doc_id", F.explode(tokens(F.col("text"))).alias("t")).join(c.select(F.explode(tokens(F.col("by_navn"))).alias("t")).distinct(), "t", "left_anti").groupBy("doc_id").agg(F.count("*").alias("n"))
)
_FIRM_KEY = f"""regexp_replace({ASCII_SQL.format(f'''lower(regexp_replace("{NAME}", '(?i)\\s+(aps|a/s|i/s|k/s|ivs|p/s)\\.?$', ''))''')}, '[^a-z0-9]', '', 'g')"""
_LABEL = f"regexp_replace(split_part({BARE.format('url')}, '.', 1), '[^a-z0-9]', '', 'g')"
both("JOI-17", "company", "url_cache", f"""select row_id, arg_max(url, (score, -cache_id)) as url, max(score) as score from (select row_id, cache_id, url, (case when regexp_matches(url, '\\.dk(/|$)') then 2 else 0 end + least(3, len(list_filter(list_distinct({WORDS_SQL.format(f'"{NAME}"')}), lambda w: length(w) >= 3 and contains(lower(title), w)))) + 3)::bigint as score from company join (select cache_id, url, coalesce(title, '') as title, {_LABEL} as k from url_cache) u on u.k = {_FIRM_KEY}) group by 1""")(
    lambda c, u: c.select("row_id", X.company_key(F.col(NAME)).alias("k"), F.array_distinct(tokens(F.col(NAME))).alias("w"))
    .join(u.select("cache_id", "url", F.lower(F.coalesce("title", F.lit(""))).alias("title"), F.regexp_replace(F.split_part(W.bare_host(F.col("url")), F.lit("."), F.lit(1)), "[^a-z0-9]", "").alias("k")), "k")
    .withColumn("score", (F.when(F.col("url").rlike(r"\.dk(/|$)"), 2).otherwise(0) + F.least(F.lit(3), F.size(F.filter("w", lambda w: (F.length(w) >= 3) & F.contains("title", w)))) + 3).cast("bigint"))
    .groupBy("row_id").agg(F.max_by("url", F.struct("score", -F.col("cache_id"))).alias("url"), F.max("score").alias("score"))
)
on("AGG-03", "company", f"select count(*) as n, count(*) filter (where Hjemmeside is not null and not {BLANK_SQL.format('Hjemmeside')}) as with_site, count(*) filter (where lower(HjemmesideLiveBool) = 'true') as live, count(*) filter (where Email is null or {BLANK_SQL.format('Email')}) as without_email, count(*) filter (where (Email is not null and not {BLANK_SQL.format('Email')}) or (Telefon is not null and not {BLANK_SQL.format('Telefon')})) as with_contact from company")(
    lambda d: d.agg(F.count("*").alias("n"), F.count_if(X.is_filled(F.col("Hjemmeside"))).alias("with_site"), F.count_if(F.lower("HjemmesideLiveBool") == "true").alias("live"), F.count_if(~X.is_filled(F.col("Email"))).alias("without_email"), F.count_if(X.is_filled(F.col("Email")) | X.is_filled(F.col("Telefon"))).alias("with_contact"))
)
_BRAND = f"""list_filter(list_transform(regexp_split_to_array("{NAME}", '[^\\p{{L}}\\p{{N}}_]+'), lambda t: regexp_replace(replace(replace(replace(replace(replace(replace(lower(t),'æ','ae'),'ø','oe'),'å','aa'),'é','e'),'ö','o'),'ä','a'), '[^a-z0-9]', '', 'g')), lambda t: length(t) >= 3 and not regexp_matches(t, '^[0-9]+$') and t not in {X.CORE_STOPWORDS!r})"""
query("AGG-05", f"with t as (select token, count(*) as df, min(row_id) as k from (select distinct row_id, unnest({_BRAND}) as token from company) group by 1), r as (select *, row_number() over (order by df desc, k, token) as r from t) select token, df from r where (df / (select count(*) from company) >= 0.02 or r <= 40) and df >= 2")(
    lambda spark, sf_dir: R.frequent_tokens(table(spark, sf_dir, "company"), "row_id", X.brand_tokens(F.col(NAME)))
)
_PART = "select site_host, unnest({0}) as token, {1} as w from site_analysis"
on("AGG-06", "site_analysis", f"select site_host, token, n from (select *, row_number() over (partition by site_host order by n desc, token) as r from (select site_host, token, sum(w)::bigint as n from ({_PART.format(WORDS_SQL.format('basic_seo.title_text'), 3)} union all {_PART.format(WORDS_SQL.format('basic_seo.meta_description'), 2)} union all select site_host, unnest({WORDS_SQL.format('h')}), 1 from (select site_host, unnest(basic_seo.h1_texts) as h from site_analysis)) where length(token) >= 4 and token not in {X.STOPWORDS!r} group by all)) where r <= 10")(
    lambda d: R.top_per(
        R.union_all([d.select("site_host", F.explode(tokens(F.col(f"basic_seo.{c}"))).alias("token"), F.lit(w).alias("w")) for c, w in (("title_text", 3), ("meta_description", 2))] + [d.select("site_host", F.explode("basic_seo.h1_texts").alias("h")).select("site_host", F.explode(tokens(F.col("h"))).alias("token"), F.lit(1).alias("w"))])
        .where((F.length("token") >= 4) & ~F.col("token").isin(*X.STOPWORDS)).groupBy("site_host", "token").agg(F.sum("w").alias("n")), ["site_host"], [F.desc("n"), F.col("token")], 10,
    ).drop("pos")
)
_LAST = "(select site_host, k, string_agg(hk || '=' || hv, '; ' order by hk) as hints from (select site_host, lower(name) as k, hk, arg_max(hv, candidate_id) as hv from (select candidate_id, site_host, name, unnest(map_keys(hints)) as hk, unnest(map_values(hints)) as hv from contact_candidate where trim(name) <> '') group by all) group by all)"
_ALL = "(select site_host, lower(name) as k, string_agg(distinct x, '; ' order by x) as {0} from (select site_host, name, unnest({0}) as x from contact_candidate where trim(name) <> '') where x is not null group by all)"
on("AGG-13", "contact_candidate", f"select g.*, coalesce(e.emails, '') as emails, coalesce(p.phones, '') as phones, coalesce(h.hints, '') as hints from (select site_host, lower(name) as k, arg_min(name, candidate_id) as name, arg_min(title, candidate_id) filter (where title is not null) as title, min(dom_distance) as dom_distance from contact_candidate where trim(name) <> '' group by 1, 2) g left join {_ALL.format('emails')} e using (site_host, k) left join {_ALL.format('phones')} p using (site_host, k) left join {_LAST} h using (site_host, k)")(
    lambda d: titles.entities(d.where("trim(name) <> ''").withColumn("k", F.lower("name")), ["site_host", "k"], "candidate_id")
)
URLISH = "^(https?://|www\\.)"
on("AGG-17", "company", "select c as column_name, share, share = max(share) over () and share >= 0.2 as best from (select unnest(['Hjemmeside', 'Email', 'Telefon', 'HjemmesideRå']) as c, unnest([avg(case when regexp_matches(Hjemmeside, '" + URLISH + "') then 1.0 else 0.0 end), avg(case when regexp_matches(Email, '" + URLISH + "') then 1.0 else 0.0 end), avg(case when regexp_matches(Telefon, '" + URLISH + "') then 1.0 else 0.0 end), avg(case when regexp_matches(\"HjemmesideRå\", '" + URLISH + "') then 1.0 else 0.0 end)])::double as share from company)")(
    lambda d: R.url_columns(d, ["Hjemmeside", "Email", "Telefon", "HjemmesideRå"], r"^(https?://|www\.)", 0.2)
)
on("WIN-02", "contact_candidate", "select site_host, right(regexp_replace(phone,'[^0-9]','','g'), 8) as last8, arg_min(phone, (candidate_id, k)) as phone from (select candidate_id, site_host, unnest(phones) as phone, unnest(range(len(phones))) as k from contact_candidate) where phone is not null group by 1, 2")(
    lambda d: d.select("candidate_id", "site_host", F.posexplode("phones").alias("k", "phone")).where("phone is not null").groupBy("site_host", X.phone_key(F.col("phone")).alias("last8")).agg(F.min_by("phone", F.struct("candidate_id", "k")).alias("phone"))
)
TRACKED = "utm_source utm_medium utm_campaign utm_term utm_content utm_id gclid gbraid wbraid dclid fbclid igshid mc_cid mc_eid msclkid yclid ref ref_src source campaign".split()
HOST_MAP = {"m.facebook.com": "facebook.com", "mobile.twitter.com": "x.com", "twitter.com": "x.com"}
_TRACKED_SQL = "(select candidate_id, url from contact_candidate union all select candidate_id, 'https://m.facebook.com/' || candidate_id || '/?utm_id=1&v=' || (candidate_id % 9) || '&fbclid=x#top' from contact_candidate)"
_KEPT = f"list_filter(string_split({QUERY.format('url')}, '&'), lambda p: p <> '' and lower(split_part(p,'=',1)) not in {tuple(TRACKED)!r})"
_MAPPED = "case " + " ".join(f"when {BARE.format('url')} = '{a}' then '{b}'" for a, b in HOST_MAP.items()) + f" else {BARE.format('url')} end"
on("URL-06", "contact_candidate", f"select candidate_id, 'https://' || {_MAPPED} || regexp_replace({PATH.format('url')}, '/+$', '') || case when len({_KEPT}) > 0 then '?' || array_to_string({_KEPT}, '&') else '' end as u from {_TRACKED_SQL}")(
    lambda d: d.select("candidate_id", F.explode(F.array(F.col("url"), F.concat(F.lit("https://m.facebook.com/"), "candidate_id", F.lit("/?utm_id=1&v="), F.col("candidate_id") % 9, F.lit("&fbclid=x#top")))).alias("url")).select("candidate_id", W.shared_form(F.col("url"), TRACKED, HOST_MAP).alias("u"))
)
query("TXT-39", f"select doc_id, left(sha1(left(coalesce(text, ''), 512)), 12) as fp, sha256(left(text, 4096)) as sha, sha256(left(text, 4096)) in {X.PARKED_HASHES!r} as parked, md5(url) as file_key from documents")(
    lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in X.fingerprints(F.col("text"), F.col("url")).items()])
)
