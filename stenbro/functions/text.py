"""Text, address and contact functions as column builders; all run inside whole-stage code."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that stand for none; fixed.
BLANKS = ("", "n/a", "na", "none", "null", "-", "nan")
#: Fixed lists of hosts that are never a firm's own site.
ISP_SUFFIXES = (".tele.dk", ".post.tele.dk", ".post10.tele.dk", ".mail.tele.dk", ".get2net.dk", ".mail.dk")
ASSETS = r"(?i)\.(jpg|jpeg|png|gif|webp|svg|css|js|pdf|zip|ico|woff2?|mp4)$"
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref")
LEGAL_SUFFIX = r"(?i)\s+(aps|a/s|i/s|k/s|ivs|p/s)\.?$"
GENERIC_BOXES = ("info", "kontakt", "kontor", "mail", "post", "salg", "ordre", "firma", "bogholderi")


def is_filled(c: Column) -> Column:
    """Neither NULL nor a value that stands for none."""
    return F.coalesce(~F.lower(F.trim(c)).isin(*BLANKS), F.lit(False))


def filled(c: Column) -> Column:
    """The value, or NULL where it stands for none."""
    return F.when(is_filled(c), c)


def collapse(c: Column) -> Column:
    """White space runs as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def danish_ascii(c: Column) -> Column:
    """Danish letters in two Latin ones."""
    for a, b in (("æ", "ae"), ("ø", "oe"), ("å", "aa"), ("Æ", "Ae"), ("Ø", "Oe"), ("Å", "Aa")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, "éöäÉÖÄ", "eoaEOA")


def plain_letters() -> tuple[str, str]:
    """Latin letters with marks and their bare letters, by what they decompose to."""
    pairs = [(chr(k), d[0]) for k in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFKD", chr(k))) > 1 and d[0].isascii() and d[0].isalpha() and all(map(unicodedata.combining, d[1:]))]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def title_key(c: Column) -> Column:
    """A title for comparing: lower case without marks (ø and æ stay), letters, digits and / + - & only, separators as one space."""
    bare = F.regexp_replace(F.translate(F.lower(F.trim(c)), *plain_letters()), r"[^\p{L}\p{N}_\s/+&-]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[/-]+", " "), r"\s{2,}", " "))


def promoted(c: Column) -> Column:
    """Two to four words of letters with their first ones in upper case, the rest as written; NULL for anything else."""
    t = collapse(c)
    words = F.transform(F.split(t, " "), lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2))))
    return F.when(t.rlike("(?iu)^[a-zæøå]{2,}( [a-zæøå]{2,}){1,3}$"), F.array_join(words, " "))


def normal_email(c: Column) -> Column:
    """Lower case, without brackets and `mailto:`; NULL if that is no address."""
    e = F.regexp_replace(F.lower(F.btrim(F.trim(c), F.lit("<>"))), r"^mailto:\s*", "")
    return F.when(e.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), e)


def best_mail_score(mails: Column, name: Column) -> Column:
    """The most parts of a name (two letters or more) that the mailbox of one of the addresses holds."""
    parts = F.filter(F.split(F.lower(name), "[^a-zæøå]+"), lambda p: F.length(p) >= 2)
    user = lambda e: F.regexp_replace(F.lower(F.split_part(e, F.lit("@"), F.lit(1))), "[^a-z0-9æøå]+", "")
    return F.array_max(F.transform(mails, lambda e: F.size(F.filter(parts, lambda p: F.contains(user(e), p)))))


#: Fixed words that qualify a firm's name.
QUALIFIERS = "aps a s ivs k i group holding ltd gmbh bureau agency studio media digital marketing consult consulting solutions partners company co inc ab oy".split()


def core_tokens(name: Column) -> Column:
    """The words of a firm's name but those that qualify it."""
    return F.filter(F.regexp_extract_all(F.lower(name), F.lit("[0-9a-zæøåéèüö]+"), F.lit(0)), lambda t: ~t.isin(QUALIFIERS))


def said(text: Column, terms: list[str]) -> Column:
    """The terms that a text holds, sorted."""
    low = F.lower(text)
    return F.array_sort(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), t) for t in terms])))


def tag_free(c: Column) -> Column:
    """A page's text: scripts and styles with what they hold, then tags, as spaces."""
    return F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>", " "), "<[^<>]*>", " ")


def around(text: Column, at: Column, before: int, behind) -> Column:
    """The text from `before` characters before a place to `behind` ones behind it."""
    behind = F.lit(behind) if isinstance(behind, int) else behind
    return F.substr(text, F.greatest(F.lit(1), at - before), F.lit(before) + behind - F.greatest(F.lit(0), F.lit(before + 1) - at))


def language(text: Column, words: dict[str, str]) -> Column:
    """The language whose words (alternatives of a pattern) a text has most, the first of several; NULL without any."""
    low = F.lower(text)
    counts = [F.size(F.regexp_extract_all(low, F.lit(p), F.lit(0))) for p in words.values()]
    best = F.greatest(*counts)
    got = F.when(best == 0, None)
    for name, n in zip(words, counts, strict=True):
        got = got.when(n == best, name)
    return got


def labelled(c: Column, labels: dict[str, str], other: str | None = None) -> Column:
    """A value's label, another one's own text or `other`."""
    got = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in labels.items():
        got = got.when(c == k, v)
    return got.otherwise(c if other is None else F.lit(other))


def confidence(score: Column, signals: dict[float, Column]) -> Column:
    """A score of 0 to 10 over 8, with what each signal that holds adds, kept between 0 and 1."""
    total = F.least(F.greatest(score, F.lit(0.0)), F.lit(10.0)) / 8
    for add, holds in signals.items():
        total = total + F.when(holds, add).otherwise(0.0)
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def literal_map(c: Column) -> Column:
    """A dict literal with quoted keys and values as a map."""
    return F.from_json(F.regexp_replace(F.regexp_replace(c, '"', '\\\\"'), r"(?<=[{ ])'|'(?=[:,}])", '"'), "map<string,string>")


def merged_maps(first: Column, later: Column) -> Column:
    """Two maps as one; the later one's values win."""
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.map_contains_key(later, k)), later)


def lower_keys(m: Column) -> Column:
    return F.transform_keys(m, lambda k, v: F.lower(k))


def company_key(c: Column) -> Column:
    """A firm's name without legal form, in lower-case letters and digits."""
    return F.regexp_replace(danish_ascii(F.lower(F.regexp_replace(c, LEGAL_SUFFIX, ""))), "[^a-z0-9]", "")


def left_pad(c: Column, size: int, fill: str = "0") -> Column:
    """As zero filling: longer values stay whole."""
    return F.when(F.length(c) < size, F.lpad(c, size, fill)).otherwise(c)


def host(url: Column) -> Column:
    """Host of an address, without scheme, `www.`, port and path; '' where there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z]+://)?([^/?#:]+)", 1), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z]+://)?[^/?#]*([^?#]*)", 1)


def query_string(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def apex(h: Column) -> Column:
    """The last two labels of a host."""
    return F.regexp_extract(h, r"([^.]+\.[^.]+)$", 1)


def is_asset(url: Column) -> Column:
    return F.split(url, r"\?")[0].rlike(ASSETS)


def without_tracking(url: Column) -> Column:
    """The address without fragment and tracking parameters."""
    kept = F.filter(F.split(query_string(url), "&"), lambda p: (p != "") & ~F.split(p, "=")[0].isin(*TRACKING))
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def normal_url(url: Column) -> Column:
    """Address for comparing: lower host without www, no fragment, query or slash at the end, with https."""
    return F.when(host(url) == "", None).otherwise(F.concat(F.lit("https://"), host(url), F.regexp_replace(path(url), "/+$", "")))


def phone_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def phone_key(c: Column) -> Column:
    """The last eight digits."""
    return F.right(phone_digits(c), F.lit(8))


def phone_e164(c: Column) -> Column:
    """+45 and eight digits, or + and the digits of a longer number; NULL if neither."""
    d = F.regexp_replace(phone_digits(c), "^00", "")
    return F.when(F.length(d) == 8, F.concat(F.lit("+45"), d)).when(F.length(d).between(9, 15), F.concat(F.lit("+"), d))


def email_domain(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, "@([^@\\s>]+)$", 1))


def contact_kind(c: Column) -> Column:
    """(kind, digits, size) of a contact value: an address with @, a phone of eight digits or more, a site with a point, or other."""
    digits = phone_digits(c)
    kind = F.when(F.contains(c, F.lit("@")), "email").when(F.length(digits) >= 8, "phone").when(F.contains(c, F.lit(".")), "website").otherwise("other")
    return F.struct(kind.alias("kind"), digits.alias("digits"), F.length(c).alias("size"))


def unwrapped(c: Column) -> Column:
    """A JSON object whose only member is `value` as that value; anything else as it is."""
    only = F.json_object_keys(c)
    return F.when((F.size(only) == 1) & (F.get(only, F.lit(0)) == "value"), F.get_json_object(c, "$.value")).otherwise(c)


def moved(low: Column, high: Column, test) -> Column:
    """The elements of `low` that stay, then `high` with those added that the test moves there, as text."""
    kept = lambda c: F.filter(c, lambda u: u.isNotNull())
    return F.concat(F.array_join(F.filter(low, lambda u: ~test(u)), " "), F.lit(" | "), F.array_join(kept(high), " "), F.lit(" + "), F.array_join(F.filter(low, test), " "))


def is_generic_box(c: Column) -> Column:
    return F.lower(F.split(c, "@")[0]).isin(*GENERIC_BOXES)


def count_of(text: Column, word: str) -> Column:
    """Occurrences of a word that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def redacted(c: Column) -> Column:
    """E-mail addresses replaced with a mark."""
    return F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days between, floored as by a time difference (not by calendar dates)."""
    return F.floor((F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 86400).cast("bigint")


#: (pattern, replacement) of secrets in log lines and texts: keys, tokens, authorisation headers, credentials in addresses.
SECRETS = (
    (r"(?i)(?U)\bkey=AIza[0-9A-Za-z\-_]{20,100}", "key=****"),
    (r"(?i)key%3DAIza[0-9A-Za-z\-_]{20,100}", "key%3D****"),
    (r"AIza[0-9A-Za-z\-_]{20,100}", "AIza****"),
    (r"(?i)(?U)([?&])(api[_-]?key|x-api-key|access[_-]?key|token|access_token|signature)=([^&\s]+)", "$1$2=****"),
    (r"(?i)(?U)Authorization:\s*Bearer\s+[A-Za-z0-9\-\._~\+\/]+=*", "Authorization: Bearer ****"),
    (r"(?i)(?U)Authorization:\s*Basic\s+[A-Za-z0-9\+\/=]+", "Authorization: Basic ****"),
    (r"(?i)(?U)://([^:@/\s]+):([^@/\s]+)@", "://$1:****@"),
)


def sanitised(c: Column) -> Column:
    """Secrets masked, then e-mail addresses replaced with a mark; in this order a password isn't taken for a mailbox."""
    for pattern, mask in SECRETS:
        c = F.regexp_replace(c, pattern, mask)
    return F.regexp_replace(c, r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL REDACTED]")


PARKED_HASHES = (
    "0e6926b1e4e9bf8f26cf03f7d560b87c6edb743736df27bc19d976329a4d4d25",
    "9f1a41985bf2a2e64ce0dc4f44f6d90f692b29239c8804b1ca4b98fca6be7e2a",
    "77e80d7c4f19e4b0c6eabf4ef98d5ee05bf0879c2f6f392a6bfab4e0c79d0a3f",
)


def fingerprints(text: Column, url: Column) -> dict[str, Column]:
    """12 digits of the SHA-1 of the first 512 characters, the SHA-256 of 4,096 and whether it is a parked page's, the MD5 of the address."""
    page = F.sha2(F.substring(text, 1, 4096), 256)
    return {"fp": F.substring(F.sha1(F.substring(F.coalesce(text, F.lit("")), 1, 512)), 1, 12), "sha": page, "parked": page.isin(*PARKED_HASHES), "file_key": F.md5(url)}


CORE_STOPWORDS = tuple("aps a/s ks k/s ps p/s ivs holding invest investment group grupp gruppen service services company co firma solutions consult entreprise enterprise consulting partner partners".split())


def brand_tokens(name: Column) -> Column:
    """Tokens of a firm's name in a-z and digits: three characters or more, no numbers, no legal forms or common words."""

    def norm(t: Column) -> Column:
        t = F.lower(t)
        for a, b in (("æ", "ae"), ("ø", "oe"), ("å", "aa"), ("é", "e"), ("ö", "o"), ("ä", "a")):
            t = F.replace(t, F.lit(a), F.lit(b))
        return F.regexp_replace(t, "[^a-z0-9]", "")

    return F.filter(F.transform(F.split(name, r"(?U)\W+"), norm), lambda t: (F.length(t) >= 3) & ~t.rlike("^[0-9]+$") & ~t.isin(*CORE_STOPWORDS))


KEYWORD = "[a-zæøå]{4,}"
STOPWORDS = tuple("og i på for der det den til er som med af en et at this that with from about your our you we the and".split())
CONVERSION = tuple("køb bestil kontakt pris tilbud gratis levering garanti buy order contact price offer free delivery warranty".split())


def keyword_sample(text: Column) -> Column:
    return F.substring(F.lower(F.coalesce(text, F.lit(""))), 1, 200_000)


def keyword_score(sample: Column, keywords: Column) -> Column:
    """Mean over the keywords of 0, .8, 1, .9, .7 by their count (0, to 3, to 6, to 10, more); 0.1 more, to 1 at most, with a word that sells.

    `sample` is `keyword_sample` of a text, in a projection of its own, else it is made again for each keyword.
    """

    def one(k: Column) -> Column:
        n = (F.length(sample) - F.length(F.replace(sample, k, F.lit("")))) / F.length(k)
        return F.when(n == 0, 0.0).when(n <= 3, 0.8).when(n <= 6, 1.0).when(n <= 10, 0.9).otherwise(0.7)

    mean = F.when(F.size(keywords) > 0, F.bround(F.aggregate(keywords, F.lit(0.0), lambda a, k: a + one(k)) / F.size(keywords), 3)).otherwise(0.0)
    return F.when(sample.rlike("|".join(CONVERSION)), F.least(F.lit(1.0), mean + 0.1)).otherwise(mean)


def robots(body: Column) -> dict[str, Column]:
    """Disallowed path beginnings (without '/', which would be all), sitemaps and the crawl delay of a robots.txt; comments don't count."""
    lines = F.transform(F.split(body, r"\R"), lambda x: F.trim(F.split(x, "#")[0]))
    given = lambda name: F.filter(F.transform(lines, lambda x: F.regexp_extract(x, rf"(?i)^{name}:\s*(\S+)", 1)), lambda x: x != "")
    return {"disallows": F.filter(given("disallow"), lambda x: x != "/"), "sitemaps": given("sitemap"), "delay": F.get(given("crawl-delay"), F.lit(0)).try_cast("double")}


def sitemap(body: Column) -> Column:
    """[(loc, nested)] of a sitemap's pages, or of the sitemaps that a sitemap index names (nested).

    Read by pattern, as an XML reader would stop the job at a body that isn't well-formed.
    """
    found = F.regexp_extract_all(body, F.lit(r"(?is)<(?:[a-z]+:)?loc>\s*(.*?)\s*</(?:[a-z]+:)?loc>"), F.lit(1))
    nested = body.rlike("(?i)<(?:[a-z]+:)?sitemapindex")

    def plain(c: Column) -> Column:
        for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            c = F.replace(c, F.lit(name), F.lit(mark))
        return c

    return F.transform(found, lambda x: F.struct(plain(x).alias("loc"), nested.alias("nested")))


def any_of(c: Column, parts) -> Column:
    """Whether a text holds one of the parts."""
    got = F.lit(False)
    for p in parts:
        got = got | F.contains(c, F.lit(p))
    return got


def ends_any(c: Column, ends) -> Column:
    got = F.lit(False)
    for e in ends:
        got = got | c.endswith(e)
    return got


def is_danish_phone(digits: Column) -> Column:
    """Eight digits that begin with 2 (not 20) or 4 to 9, or 45 and eight that begin with 2 (not 20) to 9."""
    return digits.rlike(r"^(?:2[1-9]|[4-9]\d)\d{6}$") | digits.rlike(r"^45(?:2[1-9]|[3-9]\d)\d{6}$")


def is_plausible_name(name: Column, not_names: list[str]) -> Column:
    """Two to four words, two or more of them capitalised, no digits, @ or /, not all in upper case, no word of pages or roles."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    capital = F.size(F.filter(words, lambda w: w.rlike("^[A-ZÆØÅ]"))) >= 2
    return F.size(words).between(2, 4) & capital & ~name.rlike("[0-9@/]") & (F.upper(name) != name) & ~F.exists(words, lambda w: F.lower(w).isin(not_names))


def places_differ(zip_a: Column, zip_b: Column, city_a: Column, city_b: Column) -> Column:
    """Whether two places differ: by their codes if both have one, else by their towns if both have one."""

    def town(c: Column) -> Column:
        low = F.lower(F.trim(c))
        return F.when(low == "copenhagen", "københavn").when(~low.isin("", "n/a"), low)

    a, b = F.trim(filled(zip_a)), F.trim(filled(zip_b))
    return F.when(a.isNotNull() & b.isNotNull(), a != b).when(town(city_a).isNotNull() & town(city_b).isNotNull(), town(city_a) != town(city_b)).otherwise(False)


def at_path(document: Column, path: str, default: str | None = None) -> Column:
    """The value at a dotted path with list places (`a.b[0].c` or `a.b.0.c`) of a JSON document.

    A path with a slice is none, and anything that isn't there gives the default.
    """
    if not re.fullmatch(r"[^.\[\]]+(?:\.[^.\[\]]+|\[\d+\])*", path):
        return F.lit(default).cast("string")
    steps = re.sub(r"\.(\d+)(?=\.|\[|$)", r"[\1]", path)
    found = F.get_json_object(document, f"$.{steps}")
    return found if default is None else F.coalesce(found, F.lit(default))


def overlay(below: Column, above: Column, empty: Column) -> Column:
    """The value above, unless it is NULL or empty."""
    return F.when(above.isNotNull() & (above != empty), above).otherwise(below)


def address_tail(address: Column) -> dict[str, Column]:
    """Code and town of an address line that ends with them, with or without the country behind."""
    form = r"(?:^|[,\s])(\d{4})\s+([^,\d]+?)(?:,\s*(?:Danmark|Denmark))?\s*$"
    return {"zip": F.nullif(F.regexp_extract(address, form, 1), F.lit("")), "city": F.nullif(F.regexp_extract(address, form, 2), F.lit(""))}


def participants(people: Column, kind: str, roles: tuple[str, ...]) -> Column:
    """Names of the participants (kind, role, name) of a kind in one of the roles, each once, sorted."""
    kept = F.filter(people, lambda p: (p["kind"] == kind) & p["role"].isin(*roles))
    return F.array_sort(F.array_distinct(F.filter(F.transform(kept, lambda p: F.trim(p["name"])), lambda n: ~n.isin("", "N/A"))))


def spread(numbers: Column, within: int) -> Column:
    """Numbers in their order without those within so much of one that was kept before."""
    none = F.array().cast("array<int>")
    return F.aggregate(F.filter(numbers, lambda x: x.isNotNull()), none, lambda kept, x: F.when(F.exists(kept, lambda k: F.abs(k - x) <= within), kept).otherwise(F.concat(kept, F.array(x.cast("int")))))
