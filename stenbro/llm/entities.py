"""Records of other sources matched with register firms that share no identifier: a cascade of exact joins.

Firms are known by the words of their names. A firm's brands are its words that fewer than BRAND_FIRMS firms share; of a
name without any, the rarest word, however many firms share it. Legal forms never are. A record is read for brands first:
the words of its title or slug and the beginnings of its address and lookup key, of any length, are joined with the words
of the register, and the longest brand found is the record's (one of fewer than COMMON firms before others, so that a trade
of a small register doesn't pass for one), or else the rarest of those that BRAND_FIRMS firms or more share. Such a word
may be another firm's trade, so what comes out with it is the record's firm only if it is that firm's brand and no other
firm with the word fits. A brand of fewer than SHORT letters counts as a word or a whole label only: as a beginning it fits
too many other words.

Then rules run from strong to weak; each is an exact join of the records that no earlier rule has resolved (anti-join),
and resolves a record if one firm only comes out:

1. site: the record's host is the host that one firm alone gives as its own;
2. trade: brand and another word of the name;
3. town: brand and town;
4. brand: the brand of a single firm, unless the record names another firm's trade;
5. main: the one firm of several of a brand that is no holding or property company, if the record names none either.

Rules 2 to 5 run over all records, each once, as if none had a site. That gives their confidence: the labels are the
records that the site rule resolves, held out from them, and a rule's confidence is its precision over the labelled
records that it resolves itself in the cascade, smoothed by one right and one wrong case. The site rule is measured
against the trade rule. A record with a site then keeps the site's firm.

Everything is built-in expressions and exact joins on keys of single records. Each rule's firms are folded to one row a
key (host, brand, brand and trade, brand and town) before the join, with the lowest and highest number, so a key of any
number of firms meets a record once; what many records share is on the records' side only and is split by adaptive skew
handling.

Defined cases: NULL and blank names, titles and addresses match nothing; a firm on several rows is one firm; records
with equal contents are matched each; names given by firms without a number are not matched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stenbro.session import written

RULES = ("site", "trade", "town", "brand", "main")
#: A word of so many firms is the brand of a firm that has no rarer word only; one of so many is a trade or another common word.
BRAND_FIRMS, COMMON = 20, 4
#: A brand of fewer letters is no brand as the beginning of a longer label.
SHORT = 5
LEGAL = "aps a s i is as k ks ivs amba fmba pmba anpartsselskab aktieselskab interessentskab kommanditselskab fa firmaet".split()
HOLDING = "holding holdings invest investering ejendomme ejendom udlejning kapital finans".split()


def folded(text: Column) -> Column:
    """Lower case without marks; Danish letters and their two-letter spellings alike."""
    text = F.translate(F.lower(text), "áàâãäéèêëíìîïóòôõöúùûüýñç", "aaaaaeeeeiiiiooooouuuuync")
    for a, b in (("æ", "a"), ("ø", "o"), ("å", "a"), ("ae", "a"), ("oe", "o"), ("aa", "a")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def words(text: Column) -> Column:
    return F.filter(F.split(folded(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def compact(text: Column) -> Column:
    return F.regexp_replace(folded(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def host(url: Column) -> Column:
    """The host of an address without scheme and www."""
    return F.nullif(F.regexp_extract(F.lower(url), r"^\s*(?:https?://)?(?:www\.)?([^/?#:\s]+\.[^/?#:\s]+)", 1), F.lit(""))


def town(text: Column) -> Column:
    """A town's compact form without its district."""
    return compact(F.regexp_replace(text, r"(?i)\s+(?:[CNSVKØ]|SV|NV|SØ|NØ)\s*$", ""))


def beginnings(text: Column) -> Column:
    """All beginnings of a compact label of SHORT letters or more, and the label itself."""
    size = F.length(text)
    return F.when(size >= SHORT, F.transform(F.sequence(F.lit(SHORT), size), lambda n: F.substr(text, F.lit(1), n))).otherwise(F.array(text))


def firms(register: DataFrame, number: str, name: str, district: str, site: str) -> DataFrame:
    """(cvr, words, town, host) of every spelling of every numbered firm."""
    given = F.explode_outer(F.split(F.coalesce(F.col(site), F.lit("")), r"[\s;,|<>\"]+"))
    return (
        register.where(F.col(number).rlike(r"^\d{8}$"))
        .select(F.col(number).alias("cvr"), words(F.col(name)).alias("words"), town(F.col(district)).alias("town"), given.alias("site"))
        .select("cvr", "words", "town", host(F.col("site")).alias("host"))
        .distinct()
    )


def word_firms(firm: DataFrame) -> DataFrame:
    """(word, n_firms) of the words of firms' names but legal forms and single letters."""
    each = firm.select("cvr", F.explode("words").alias("word")).where((F.length("word") > 1) & ~F.col("word").isin(LEGAL)).distinct()
    return each.groupBy("word").agg(F.count("*").alias("n_firms"))


def pages(cache: DataFrame) -> DataFrame:
    """Cached pages as records."""
    label = F.split_part(host(F.col("url")), F.lit("."), F.lit(1))
    return cache.select(
        F.lit("url_cache").alias("src"),
        F.col("cache_id").alias("rec_id"),
        host(F.col("url")).alias("host"),
        words(F.col("title")).alias("words"),
        F.array(compact(F.col("normalized_key")), compact(label)).alias("glued"),
    )


def profiles(persons: DataFrame, *more: str) -> DataFrame:
    """Profiles as records, by the slug of their firm's page, with more of their columns."""
    slug = F.regexp_extract(F.col("company_url"), r"/(?:company|school|showcase)/([^/?#]+)", 1)
    slug = F.coalesce(F.try_url_decode(F.regexp_replace(slug, r"\+", "%2B")), slug)
    return persons.select(
        F.lit("profile").alias("src"), F.col("profile_id").alias("rec_id"), F.lit(None).cast("string").alias("host"), words(slug).alias("words"), F.array(compact(slug)).alias("glued"), *more
    )


def place(words: str = "words", glued: str = "glued") -> Column:
    """What records with the same words and labels share."""
    return F.concat_ws("\x1f", F.array_join(words, " "), F.array_join(glued, " "))


def branded(places: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """`places` (keys, words, glued, ...) with brand, trades (common words said) and rest (what follows the brand).

    `known`: (word, n_firms, own: whether it is a firm's brand). Places without a brand have NULL. The keys must be unique.
    """
    whole = F.transform("words", lambda w: F.struct(w.alias("word"), F.lit(True).alias("whole")))
    begun = F.transform(F.flatten(F.transform("glued", beginnings)), lambda w: F.struct(w.alias("word"), F.lit(False).alias("whole")))
    keyed = places.select(*keys, F.inline(F.array_distinct(F.concat(whole, begun)))).where((F.length("word") > 1) & ~F.col("word").isin(LEGAL))
    rare = F.col("n_firms") < BRAND_FIRMS
    order = F.struct(rare, F.col("n_firms") < COMMON, F.when(rare, 0).otherwise(-F.col("n_firms")), F.length("word"), "word")
    found = keyed.join(known, "word").groupBy(*keys).agg(
        F.max_by(F.when(F.col("own"), F.col("word")), F.when(F.col("own"), order)).alias("brand"),
        F.collect_set(F.when(F.col("whole") & (F.col("n_firms") >= COMMON), F.col("word"))).alias("trades"),
    )
    rest = F.filter(F.transform("glued", lambda g: F.when(g.startswith(F.col("brand")), F.substr(g, F.length("brand") + 1))), lambda x: x.isNotNull() & (x != ""))
    none = F.array().cast("array<string>")
    return places.join(found, list(keys), "left").withColumns({"rest": F.coalesce(rest, none), "trades": F.coalesce("trades", none)})


def firm_brands(firm: DataFrame, known: DataFrame) -> DataFrame:
    """(brand, n_firms, own, cvr, words, town): every word of firms' names, and whether it is the firm's brand."""
    each = firm.select("cvr", "words", "town", F.explode("words").alias("word")).distinct().join(known, "word")
    named = each.groupBy("cvr", "words", "town").agg(F.collect_list(F.struct("n_firms", F.col("word").alias("brand"))).alias("brands"))
    named = named.select("cvr", "words", "town", F.array_min("brands")["n_firms"].alias("least"), F.inline("brands"))
    own = (F.col("n_firms") < BRAND_FIRMS) | (F.col("n_firms") == F.col("least"))
    return named.select("brand", "n_firms", own.alias("own"), "cvr", "words", "town")


def _folded(firms: DataFrame, *keys: str) -> DataFrame:
    """(keys, cvr, other, own) with the lowest and the highest number of the firms (keys, cvr, own) of each key."""
    return firms.groupBy(*keys).agg(F.min("cvr").alias("cvr"), F.max("cvr").alias("other"), F.max("own").alias("own"))


def _single(pairs: DataFrame) -> DataFrame:
    """Records for which one firm only came out, by a brand of its own."""
    found = pairs.groupBy("src", "rec_id").agg(F.min("cvr").alias("cvr"), F.max("other").alias("other"), F.max("own").alias("own"))
    return found.where("cvr = other and own").select("src", "rec_id", "cvr")


def _of_one(firm: DataFrame, key: str) -> DataFrame:
    """(key, cvr) of the keys that one firm alone has."""
    return firm.groupBy(key).agg(F.min("cvr").alias("cvr"), F.max("cvr").alias("other")).where("cvr = other").drop("other")


def site_matches(record: DataFrame, firm: DataFrame) -> DataFrame:
    """(src, rec_id, cvr) of the records whose host is one firm's."""
    return record.where("host is not null").join(_of_one(firm.where("host is not null"), "host"), "host").select("src", "rec_id", "cvr")


def rule_matches(rule: str, record: DataFrame, brands: DataFrame) -> DataFrame:
    """(src, rec_id, cvr) of the records (src, rec_id, brand, words, rest, trades) that a rule resolves.

    `brands`: what `firm_brands` returns.
    """
    if rule == "trade":
        trade = F.explode(F.array_except("words", F.array("brand", *map(F.lit, LEGAL)))).alias("trade")
        begun = F.flatten(F.transform("rest", lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda n: F.substr(r, F.lit(1), n))))
        said = record.select("src", "rec_id", "brand", F.explode(F.array_distinct(F.concat("words", begun))).alias("trade"))
        return _single(said.join(_folded(brands.select("brand", "cvr", "own", trade), "brand", "trade"), ["brand", "trade"]))
    if rule == "town":
        two = F.zip_with("words", F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))), lambda a, b: F.concat(a, b))
        said = F.array_distinct(F.concat("words", F.filter(two, lambda x: x.isNotNull()), "rest"))
        said = record.select("src", "rec_id", "brand", F.explode(said).alias("town"))
        return _single(said.join(_folded(brands.where("town <> ''"), "brand", "town"), ["brand", "town"]))
    if rule == "brand":
        one = brands.where("n_firms = 1").groupBy("brand").agg(F.min("cvr").alias("cvr"), F.array_distinct(F.flatten(F.collect_list("words"))).alias("named"))
        pairs = record.join(one, "brand")
        pairs = pairs.where((F.size(F.array_except("trades", "named")) == 0) | F.arrays_overlap(F.array_except("trades", F.array("brand")), F.col("named")))
        return pairs.select("src", "rec_id", "cvr")
    holding = F.array(*map(F.lit, HOLDING))
    main = _folded(brands.where(~F.arrays_overlap("words", holding)), "brand").where("cvr = other and own")
    return record.where(~F.arrays_overlap("words", holding)).join(main, "brand").select("src", "rec_id", "cvr")


def matched_entities(records: DataFrame, firm: DataFrame) -> DataFrame:
    """(src, rec_id, cvr, rule, confidence) of every record that belongs to a numbered firm."""
    firm = written(firm)
    brands = written(firm_brands(firm, word_firms(firm)))
    known = written(brands.groupBy(F.col("brand").alias("word")).agg(F.max("n_firms").alias("n_firms"), F.max("own").alias("own")))
    left = written(branded(records, known, "src", "rec_id").where("brand is not null").select("src", "rec_id", "brand", "words", "rest", "trades"))
    resolved: list[DataFrame] = []
    for rule in RULES[1:]:
        found = rule_matches(rule, left, brands).withColumn("rule", F.lit(rule))
        resolved.append(written(found))
        if rule != RULES[-1]:
            left = written(left.join(resolved[-1].select("src", "rec_id"), ["src", "rec_id"], "left_anti"))
    weaker = reduce(DataFrame.unionByName, resolved)
    site = site_matches(records, firm).withColumnRenamed("cvr", "site_cvr")
    every = written(weaker.join(site, ["src", "rec_id"], "full_outer"))
    own = F.coalesce("site_cvr", "cvr").alias("cvr")
    whole = every.select("src", "rec_id", own, F.when(F.col("site_cvr").isNotNull(), RULES[0]).otherwise(F.col("rule")).alias("rule"))
    return whole.join(rule_precision(every), "rule").select("src", "rec_id", "cvr", "rule", "confidence")


def rule_precision(every: DataFrame) -> DataFrame:
    """(rule, confidence) from the records (rule, cvr, site_cvr) that both the site rule and another one resolve."""
    right = F.count_if(F.col("cvr") == F.col("site_cvr"))
    labelled = every.where("cvr is not null and site_cvr is not null")
    counted = labelled.groupBy("rule").agg(right.alias("n_right"), F.count("*").alias("n"))
    site = labelled.where("rule = 'trade'").agg(right.alias("n_right"), F.count("*").alias("n")).select(F.lit(RULES[0]).alias("rule"), "n_right", "n")
    rules = every.sparkSession.createDataFrame([(r,) for r in RULES], "rule string")
    known = rules.join(counted.unionByName(site), "rule", "left")
    return known.select("rule", ((F.coalesce("n_right", F.lit(0)) + 1) / (F.coalesce("n", F.lit(0)) + 2)).alias("confidence"))
