"""Joins, aggregates, windows, sorts, sets, functions and streams of the coverage list, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stenbro.functions import text as X
from stenbro.operators import relational as R
from stenbro.plans.catalogue import ASCII_SQL, BLANK_SQL, FORM, NAME, PATH_SQL, column, on
from stenbro.queries import query
from stenbro.session import table
from stenbro.streaming import events as stream


def both(name: str, a: str, b: str, sql: str):
    """Register a query over two tables: f(a, b) -> DataFrame."""

    def add(f):
        query(name, sql)(lambda spark, sf_dir: f(table(spark, sf_dir, a), table(spark, sf_dir, b)))
        return f

    return add


WORDS_SQL = "list_filter(regexp_split_to_array(lower({0}), '[^a-zæøå0-9]+'), lambda x: x <> '')"


def tokens(c):
    return F.filter(F.split(F.lower(c), "[^a-zæøå0-9]+"), lambda t: t != "")


# --- joins ----------------------------------------------------------------------------------------------------------
both("JOI-01", "region", "city_register", "select r_regionkey, city_id from region, city_register")(lambda a, b: a.select("r_regionkey").crossJoin(b.select("city_id")))
both("JOI-06", "company", "url_cache", f"""select row_id, u.url as cached_url from company c left join url_cache u on u.normalized_key = regexp_replace({ASCII_SQL.format(f'''lower(regexp_replace("{NAME}", '(?i)\\s+(aps|a/s|i/s|k/s|ivs|p/s)\\.?$', ''))''')}, '[^a-z0-9]', '', 'g')""")(
    lambda c, u: c.select("row_id", X.company_key(F.col(NAME)).alias("normalized_key")).join(u.select("normalized_key", F.col("url").alias("cached_url")), "normalized_key", "left").select("row_id", "cached_url")
)
both("JOI-08", "contact_candidate", "company", """select candidate_id from contact_candidate c where exists (select 1 from company k where lower(trim(k."Direktørnavn")) = lower(trim(c.name)))""")(
    lambda c, k: c.select("candidate_id", F.lower(F.trim("name")).alias("n")).join(k.select(F.lower(F.trim("Direktørnavn")).alias("n")), "n", "left_semi").select("candidate_id")
)
both("JOI-13", "profiles", "contact_candidate", "select profile_id from profiles p where fullname is not null and not exists (select 1 from contact_candidate c where c.name = p.fullname)")(
    lambda p, c: p.where("fullname is not null").join(c.select(F.col("name").alias("fullname")), "fullname", "left_anti").select("profile_id")
)

# --- aggregates -----------------------------------------------------------------------------------------------------
on("AGG-01", "url_cache", "select method, count(*) as n from url_cache group by 1")(lambda d: d.groupBy("method").agg(F.count("*").alias("n")))
on("AGG-02", "company", f"""select form, n from (select coalesce("{FORM}",'') as form, count(*) as n from company group by 1) order by n desc, form limit 5""")(
    lambda d: d.groupBy(F.coalesce(F.col(FORM), F.lit("")).alias("form")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "form").limit(5)
)
on("AGG-04", "contact_candidate", "select source, dom_distance, count(*) as n from contact_candidate group by grouping sets ((source), (dom_distance))")(
    lambda d: d.groupingSets([[F.col("source")], [F.col("dom_distance")]], "source", "dom_distance").agg(F.count("*").alias("n"))
)
on("token_df", "company", f"""select token, df from (select token, count(*) as df from (select distinct row_id, unnest({WORDS_SQL.format(f'"{NAME}"')}) as token from company) group by 1) where df >= 2""")(
    lambda d: R.document_frequency(d, "row_id", tokens(F.col(NAME))).where("df >= 2")
)
on("AGG-08", "site_analysis", "select site_host, max(fetched_at) as latest from site_analysis group by 1")(lambda d: d.groupBy("site_host").agg(F.max("fetched_at").alias("latest")))
on("AGG-09", "site_analysis", "select site_host, floor(sum(basic_seo.word_count) / count(basic_seo.word_count))::bigint as mean_words from site_analysis group by 1")(
    lambda d: d.groupBy("site_host").agg(F.floor(F.sum("basic_seo.word_count") / F.count("basic_seo.word_count")).cast("bigint").alias("mean_words"))
)
on("AGG-10", "site_analysis", "select analysis_id, case when technical_seo.links_checked > 0 then round(100.0 * technical_seo.broken_links_count / technical_seo.links_checked, 1)::double else 0.0::double end as pct from site_analysis")(
    lambda d: d.select("analysis_id", F.when(F.col("technical_seo.links_checked") > 0, F.round(F.lit(100.0) * F.col("technical_seo.broken_links_count") / F.col("technical_seo.links_checked"), 1)).otherwise(0.0).alias("pct"))
)
on("AGG-21", "contact_candidate", "select site_host, array_to_string(list_sort(list_distinct(list(source))), '; ') as sources from contact_candidate group by 1")(
    lambda d: d.groupBy("site_host").agg(F.array_join(F.array_sort(F.collect_set("source")), "; ").alias("sources"))
)
on("AGG-22", "title_register", f"select distinct StillingsBetegnelseKode as code, unnest({WORDS_SQL.format('Alias1')}) as token from title_register")(
    lambda d: d.select(F.col("StillingsBetegnelseKode").alias("code"), F.explode(tokens(F.col("Alias1"))).alias("token")).distinct()
)

# --- windows, sorts, sets -------------------------------------------------------------------------------------------
on("WIN-01", "contact_candidate", "select candidate_id, site_host, name from (select *, row_number() over (partition by site_host, name order by candidate_id) r from contact_candidate) where r = 1")(
    lambda d: R.first_per(d.select("candidate_id", "site_host", "name"), ["site_host", "name"], [F.col("candidate_id")])
)
on("WIN-03", "site_analysis", "select site_host, analysis_id from (select *, row_number() over (partition by site_host order by conversion.cta_score desc nulls last, analysis_id) r from site_analysis) where r = 1")(
    lambda d: R.first_per(d.select("site_host", "analysis_id", F.col("conversion.cta_score").alias("s")), ["site_host"], [F.desc_nulls_last("s"), F.col("analysis_id")]).drop("s")
)
on("WIN-05", "company", f"select row_id, coalesce(case when HjemmesideGMB is not null and not {BLANK_SQL.format('HjemmesideGMB')} then HjemmesideGMB end, case when Hjemmeside is not null and not {BLANK_SQL.format('Hjemmeside')} then Hjemmeside end, case when Email like '%@%' then 'mail' end) as step from company")(
    lambda d: d.select("row_id", R.waterfall(X.filled(F.col("HjemmesideGMB")), X.filled(F.col("Hjemmeside")), F.when(F.contains(F.col("Email"), F.lit("@")), F.lit("mail"))).alias("step"))
)
on("WIN-07", "contact_candidate", "select candidate_id, pos from (select candidate_id, row_number() over (partition by site_host, source order by dom_distance nulls last, candidate_id) as pos from contact_candidate) where pos <= 3")(
    lambda d: R.top_per(d.select("candidate_id", "site_host", "source", "dom_distance"), ["site_host", "source"], [F.asc_nulls_last("dom_distance"), F.col("candidate_id")], 3).select("candidate_id", "pos")
)
on("WIN-09", "title_register", "select StillingsBetegnelseKode as code, row_number() over (partition by DiscoAms08Navn order by StillingsBetegnelseKode) as n from title_register")(
    lambda d: d.select(F.col("StillingsBetegnelseKode").alias("code"), F.row_number().over(Window.partitionBy("DiscoAms08Navn").orderBy("StillingsBetegnelseKode")).alias("n"))
)
on("SRT-02", "lineitem", "select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 100")(
    lambda d: d.select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(100)
)
on("SRT-03", "site_analysis", f"select site_host, analysis_id from (select site_host, analysis_id, row_number() over (partition by site_host order by conversion.cta_score desc nulls last, length({PATH_SQL.format('url')}), analysis_id) r from site_analysis) where r <= 20")(
    lambda d: R.top_per(d.select("site_host", "analysis_id", "url", F.col("conversion.cta_score").alias("s")), ["site_host"], [F.desc_nulls_last("s"), F.length(X.path(F.col("url"))), F.col("analysis_id")], 20).select("site_host", "analysis_id")
)
column("SRT-06", "site_analysis", "analysis_id", "first3", lambda: F.array_join(F.slice("technical_seo.broken_links_list", 1, 3), " "), "array_to_string(technical_seo.broken_links_list[1:3], ' ')")
column("SRT-08", "contact_candidate", "candidate_id", "sorted", lambda: F.array_join(F.array_sort(F.array_distinct("emails")), "; "), "array_to_string(list_sort(list_distinct(emails)), '; ')", lambda: F.col("emails").isNotNull(), "emails is not null")
both("SET-01", "profiles", "contact_candidate", "select profile_id as id, fullname as name from profiles union all select candidate_id, name from contact_candidate")(
    lambda p, c: p.select(F.col("profile_id").alias("id"), F.col("fullname").alias("name")).unionByName(c.select(F.col("candidate_id").alias("id"), "name"))
)
both("SET-02", "contact_candidate", "profiles", "select distinct name from contact_candidate except select fullname from profiles")(lambda c, p: c.select("name").distinct().exceptAll(p.select(F.col("fullname").alias("name")).distinct()))
both("SET-03", "contact_candidate", "profiles", "select name from contact_candidate intersect select fullname from profiles")(lambda c, p: c.select("name").intersect(p.select("fullname")))
column("SET-04", "site_analysis", "analysis_id", "differ", lambda: F.coalesce("conversion.has_ga4", F.lit(False)) != F.coalesce("conversion.has_gtm", F.lit(False)), "coalesce(conversion.has_ga4,false) <> coalesce(conversion.has_gtm,false)")

# --- scalar functions -----------------------------------------------------------------------------------------------
column("TXT-01", "url_cache", "cache_id", "t", lambda: X.collapse(F.col("title")), "trim(regexp_replace(title, '\\s+', ' ', 'g'))")
column("TXT-03", "url_cache", "cache_id", "t", lambda: F.array_join(tokens(F.col("title")), "|"), f"array_to_string({WORDS_SQL.format('title')}, '|')")
column("TXT-05", "company", "row_id", "k", lambda: X.company_key(F.col(NAME)), f"""regexp_replace({ASCII_SQL.format(f'''lower(regexp_replace("{NAME}", '(?i)\\s+(aps|a/s|i/s|k/s|ivs|p/s)\\.?$', ''))''')}, '[^a-z0-9]', '', 'g')""")
column("TXT-06", "contact_candidate", "candidate_id", "n", lambda: F.lower(X.collapse(F.col("name"))), "lower(trim(regexp_replace(name, '\\s+', ' ', 'g')))")
on("TXT-12", "company", "select row_id, unnest(regexp_extract_all(Email, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) as email from company")(
    lambda d: d.select("row_id", F.explode(F.regexp_extract_all("Email", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0))).alias("email"))
)
column("TXT-14", "documents", "doc_id", "t", lambda: F.regexp_replace(F.regexp_replace(F.col("text"), r"(?i)\s*[\[(](at|snabel-a)[\])]\s*", "@"), r"(?i)\s*[\[(](dot|punktum)[\])]\s*", "."), "regexp_replace(regexp_replace(text, '(?i)\\s*[\\[(](at|snabel-a)[\\])]\\s*', '@', 'g'), '(?i)\\s*[\\[(](dot|punktum)[\\])]\\s*', '.', 'g')")
column("TXT-19", "company", "row_id", "e164", lambda: X.phone_e164(F.col("Telefon")), "case when length(regexp_replace(regexp_replace(Telefon,'[^0-9]','','g'),'^00','')) = 8 then '+45' || regexp_replace(regexp_replace(Telefon,'[^0-9]','','g'),'^00','') when length(regexp_replace(regexp_replace(Telefon,'[^0-9]','','g'),'^00','')) between 9 and 15 then '+' || regexp_replace(regexp_replace(Telefon,'[^0-9]','','g'),'^00','') end")
column("TXT-20", "company", "row_id", "last8", lambda: X.phone_key(F.col("Telefon")), "right(regexp_replace(Telefon,'[^0-9]','','g'), 8)")
column("count_service", "documents", "doc_id", "n", lambda: X.count_of(F.lower("text"), "service"), "((length(lower(text)) - length(replace(lower(text),'service',''))) / 7)::int")
column("TXT-27", "documents", "doc_id", "words", lambda: F.size(F.filter(F.split(F.trim("text"), "[ \\n\\t\\r]+"), lambda t: t != "")), "len(list_filter(regexp_split_to_array(trim(text), '[ \\n\\t\\r]+'), lambda x: x <> ''))", lambda: F.col("text").isNotNull(), "text is not null")
column("emails_redacted", "documents", "doc_id", "t", lambda: X.redacted(F.col("text")), "regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[email]', 'g')")
column("text_md5", "documents", "doc_id", "h", lambda: F.md5("text"), "md5(text)")
column("URL-13", "url_cache", "cache_id", "u", lambda: F.when(F.col("url").startswith("ttps://"), F.concat(F.lit("h"), F.col("url"))).when(F.col("url").startswith("//"), F.concat(F.lit("https:"), F.col("url"))).when(~F.contains(F.col("url"), F.lit("://")), F.concat(F.lit("https://"), F.col("url"))).otherwise(F.col("url")), "case when starts_with(url,'ttps://') then 'h' || url when starts_with(url,'//') then 'https:' || url when not contains(url,'://') then 'https://' || url else url end")
column("DAT-06", "site_analysis", "analysis_id", "days", lambda: X.floor_days(F.col("ingested_at"), F.col("fetched_at")), "floor((epoch(date_trunc('second', ingested_at)) - epoch(date_trunc('second', fetched_at))) / 86400)::bigint")
column("MTH-01", "orders", "o_orderkey", "scaled", lambda: F.bround(F.least(F.greatest(F.col("o_totalprice") / 5000, F.lit(0.0)), F.lit(50.0)), 2), "round_even(least(greatest(o_totalprice / 5000, 0.0), 50.0), 2)")
column("ARR-02", "contact_candidate", "candidate_id", "joined", lambda: F.coalesce(F.nullif(F.array_join(F.array_sort(F.array_distinct("emails")), "; "), F.lit("")), F.lit("N/A")), "coalesce(nullif(array_to_string(list_sort(list_distinct(emails)), '; '), ''), 'N/A')")
column("fetch_method", "analysis_raw", "analysis_id", "method", lambda: F.coalesce(F.get_json_object("payload", "$.analysis.fetch_method"), F.get_json_object("payload", "$.fetch_method")), "coalesce(payload->>'$.analysis.fetch_method', payload->>'$.fetch_method')", lambda: F.try_parse_json("payload").isNotNull(), "payload is not null and json_valid(payload)")
on("STR-01", "events", "select date_trunc('hour', ts) as window_start, event_type, count(*) as n from events group by all")(lambda d: stream.windowed_counts(d, "ts", "event_type"))
on("user_events_once", "events", "select user_id, event_type from (select distinct user_id, event_type from events)")(lambda d: stream.without_repeats(d.select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts").select("user_id", "event_type"))
both("names_per_site", "contact_candidate", "profiles", "select site_host, count(*) as n, count(distinct name) as names from contact_candidate where name is not null group by 1")(
    lambda c, _: c.where("name is not null").groupBy("site_host").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))
)

# --- without SQL: held against the same in plain Python -------------------------------------------------------------
query("TXT-25")(lambda spark, sf_dir: R.keyword_scores(table(spark, sf_dir, "documents"), "doc_id", "site_host", "text"))
query("TXT-35")(lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", X.sanitised(F.col("text")).alias("t")))
