"""Address functions as column builders: parts, comparing forms, resolution against a base, page types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
#: Fixed prefixes of hosts that serve files.
CDN_HOST = r"^(m2|cdn|media|assets|static)\."
#: Ranges that are private: 10/8, 172.16/12, 192.168/16, 127/8, 169.254/16.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PRIVATE = rf"^(?:(?:10|127)\.{OCTET}|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168|169\.254)\.{OCTET}\.{OCTET}$"
#: Fixed terms and path parts.
NEGATIVE = "privacy privatliv persondata cookie gdpr terms betingelser vilkår legal politik recruit rekruttering karriere job stillinger klage patientinformation sitemap".split()
CONTACT_SLUGS = (
    "kontakt contact kontakt-os contact-us team teams medarbejder medarbejdere people staff ledelse about om-os kontakt-oss kontakta om-oss medarbetare personal mitarbeiter ueber-uns uber-uns"
).split()
AGGREGATORS = r"(?:^|\.)(?:anmeld-haandvaerker|haandvaerker|find-virksomhed|3byggetilbud|tekniq|cvrapi)\.dk$|(?:^|\.)(?:facebook|linkedin|wixsite)\.com$"


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 host and port, 3 path, 4 query, 5 fragment; '' where there is none."""
    return F.regexp_extract(url, SPLIT, k)


def host_of(url: Column) -> Column:
    """Lower-case host without port and credentials."""
    return F.lower(F.regexp_extract(part(url, 2), r"^(?:[^@]*@)?([^:]*)", 1))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host_of(url), r"^www\.", "")


def queue_url(url: Column) -> Column:
    """For comparing and queueing: lower scheme and host, no default port, fragment or slash at the end; '/' for no path."""
    scheme = F.lower(F.when(part(url, 1) == "", "https").otherwise(part(url, 1)))
    netloc = F.lower(part(url, 2))
    netloc = F.when(scheme == "http", F.regexp_replace(netloc, ":80$", "")).when(scheme == "https", F.regexp_replace(netloc, ":443$", "")).otherwise(netloc)
    path = F.regexp_replace(part(url, 3), "/+$", "")
    query = F.when(part(url, 4) != "", F.concat(F.lit("?"), part(url, 4))).otherwise("")
    return F.concat(scheme, F.lit("://"), netloc, F.when(path == "", "/").otherwise(path), query)


def canonical_out(url: Column) -> Column:
    """For output: as `queue_url`, but the path as written, and none for the root."""
    scheme = F.lower(F.when(part(url, 1) == "", "https").otherwise(part(url, 1)))
    port = F.regexp_extract(part(url, 2), r":(\d+)$", 1)
    other = (port != "") & ~(((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")))
    query = F.when(part(url, 4) != "", F.concat(F.lit("?"), part(url, 4))).otherwise("")
    return F.concat(scheme, F.lit("://"), host_of(url), F.when(other, F.concat(F.lit(":"), port)).otherwise(""), F.when(part(url, 3) == "/", "").otherwise(part(url, 3)), query)


def without_dots(path: Column) -> Column:
    """A path with its '.' and '..' segments worked off."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x))),
    )
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def resolved(base: Column, ref: Column) -> Column:
    """A reference against the address of its page, as RFC 3986 has it."""
    site = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    tail = F.concat(F.when(part(ref, 4) != "", F.concat(F.lit("?"), part(ref, 4))).otherwise(""), F.when(part(ref, 5) != "", F.concat(F.lit("#"), part(ref, 5))).otherwise(""))
    folder = F.regexp_extract(part(base, 3), "^(.*/)", 1)
    merged = F.concat(F.when(folder == "", "/").otherwise(folder), part(ref, 3))
    query = F.when(part(base, 4) != "", F.concat(F.lit("?"), part(base, 4))).otherwise("")
    return (
        F.when(ref == "", base)
        .when(part(ref, 1) != "", ref)
        .when(ref.startswith("//"), F.concat(part(base, 1), F.lit("://"), part(ref, 2), without_dots(part(ref, 3)), tail))
        .when(part(ref, 3).startswith("/"), F.concat(site, without_dots(part(ref, 3)), tail))
        .when(part(ref, 3) != "", F.concat(site, without_dots(merged), tail))
        .when(part(ref, 4) != "", F.concat(site, part(base, 3), tail))
        .otherwise(F.concat(site, part(base, 3), query, tail))
    )


def segments(url: Column) -> Column:
    return F.filter(F.split(F.lower(part(url, 3)), "/"), lambda s: s != "")


def is_private_ip(host: Column) -> Column:
    return host.rlike(PRIVATE)


def worth_checking(url: Column, asset: Column) -> Column:
    """A page to probe: http(s), no asset, no file host, no resized picture, no private address."""
    low = F.lower(F.split(url, r"\?")[0])
    resized = F.contains(low, F.lit("/img/")) & F.contains(low, F.lit("/resize/"))
    return low.rlike("^https?://") & ~asset & ~host_of(url).rlike(CDN_HOST) & ~resized & ~is_private_ip(host_of(url))


def same_start(a: Column, b: Column) -> Column:
    """How many leading path segments two addresses share."""
    both = F.arrays_zip(segments(a).alias("x"), segments(b).alias("y"))
    run = F.aggregate(
        both,
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, z: F.struct((acc["n"] + F.when(acc["on"] & F.coalesce(z["x"] == z["y"], F.lit(False)), 1).otherwise(0)).alias("n"), (acc["on"] & F.coalesce(z["x"] == z["y"], F.lit(False))).alias("on")),
    )
    return run["n"]


#: Fixed segments by which a page's type is told, with their weights.
CATEGORY = "category shop products produkter katalog kategori tilbud".split()
INFO = (("om om-os about kontakt contact".split(), 40), ("case referencer faq support kundeservice".split(), 35), ("privacy cookies betingelser persondata".split(), 30))
BLOG = "blog nyheder news artikler".split()


def page_type(url: Column) -> Column:
    """(kind, confidence): the type with the highest score, in the order product, category, info, blog; 'other' without any."""
    path, query, parts = F.lower(part(url, 3)), F.lower(part(url, 4)), segments(url)
    has = lambda words: F.arrays_overlap(parts, F.array(*map(F.lit, words)))
    scores = (("(sku|id|product|item|variant|childsku)=", query, 50), (r"-\d{3,}($|/)", path, 40), (r"/p\d{3,}", path, 30), ("/(dp|pd)/", path, 25), (r"\d{4,}", path, 20), (r"[a-z]\d{4,}", path, 15))
    product = F.when(F.size(parts) >= 3, 10).otherwise(0)
    for pattern, where, weight in scores:
        product = product + F.when(where.rlike(pattern), weight).otherwise(0)
    category = F.when(has(CATEGORY), 40).when((F.size(parts) <= 2) & ~path.rlike(r"\d{3,}"), 10).otherwise(0)
    info = F.when(F.lit(False), 0)
    for words, weight in INFO:
        info = info.when(has(words), weight)
    info = info.otherwise(0)
    product = F.when(info >= 40, F.least(product, F.lit(10))).otherwise(product)
    blog = F.when(has(BLOG), 40).otherwise(0) + F.when(path.rlike(r"/\d{4}[/-]\d{2}/"), 30).otherwise(0)
    most = F.greatest(product, category, info, blog)
    kind = F.when(most == 0, "other").when(product == most, "product").when(category == most, "category").when(info == most, "info").when(blog == most, "blog")
    return F.struct(kind.alias("kind"), F.least(most / 100.0, F.lit(1.0)).cast("double").alias("confidence"))


#: Fixed networks, and the paths of their posts and shared pages.
NETWORKS = r"^(facebook|instagram|x|twitter|tiktok|pinterest|linkedin|youtube)\.com$"
POSTS = (("instagram.com", "^/(p|reel)/"), ("facebook.com", "/share|/posts/|/watch/"), ("x.com", "/status/"), ("twitter.com", "/status/"), ("tiktok.com", "/video/"), ("pinterest.com", "^/pin/"))


def social_kind(url: Column) -> Column:
    """'profile' or 'share' of an address on a social network, NULL elsewhere."""
    host, path = bare_host(url), part(url, 3)
    shared = part(url, 4).rlike("(^|&)share=")
    for network, pattern in POSTS:
        shared = shared | ((host == network) & path.rlike(pattern))
    return F.when(host.rlike(NETWORKS), F.when(shared, "share").otherwise("profile"))


def shared_form(url: Column, tracked: list[str], hosts: dict[str, str]) -> Column:
    """An address without tracking parameters, fragment and slash at its end, with https and its host's main name."""
    host = bare_host(url)
    main = F.when(F.lit(False), host)
    for a, b in hosts.items():
        main = main.when(host == a, b)
    kept = F.filter(F.split(part(url, 4), "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(tracked))
    return F.concat(F.lit("https://"), main.otherwise(host), F.regexp_replace(part(url, 3), "/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
