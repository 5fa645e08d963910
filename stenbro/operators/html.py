"""Facts of web pages: one tolerant pass of the standard library's parser per page, in Arrow batches, into one struct.

Everything that needs the page's tree is read in that pass; what follows from texts and attributes (tracking tags, cookie
banners, canonical rules, link reasons) is built-in expressions over the struct, so a query that wants one fact pays for
one parse and no more.

Defined cases: NULL and empty pages have no facts (counts 0, lists empty, texts NULL); unclosed and misplaced tags are
read as they come; text in scripts and styles is no text of the page; very long pages are parsed whole; repeated pages
are parsed each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINK = "struct<href:string,text:string,in_nav:boolean,cfemail:string>"
FIELD = "struct<name:string,type:string,required:boolean,visible:boolean>"
FORM = f"struct<action:string,method:string,fields:array<{FIELD}>>"
IMAGE = "struct<src:string,alt:string,decorative:boolean>"
PERSON = "struct<type:string,name:string,title:string,email:string,telephone:string>"
FACTS = (
    f"title string, h1 array<string>, canonicals array<string>, lang string, metas map<string,string>, text string, links array<{LINK}>, forms array<{FORM}>, "
    f"images array<{IMAGE}>, scripts array<string>, buttons array<string>, itemtypes array<string>, ld_types array<string>, ld_found boolean, ld_repaired boolean, "
    f"people array<{PERSON}>, dates array<string>"
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = re.compile(r"display:\s*none|visibility:\s*hidden")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_DECORATIVE = re.compile(r"(?i)logo|icon|sprite|spacer|pixel")


def _plain(text: str) -> str:
    """White space (as HTML has it) collapsed."""
    return _SPACE.sub(" ", text).strip(" ")


class _Page(HTMLParser):
    """One page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: list[str] | None = None
        self.h1: list[str] = []
        self.canonicals: list[str] = []
        self.lang: str | None = None
        self.metas: dict[str, str] = {}
        self.words: list[str] = []
        self.links: list[dict] = []
        self.forms: list[dict] = []
        self.images: list[dict] = []
        self.scripts: list[str] = []
        self.buttons: list[str] = []
        self.itemtypes: list[str] = []
        self.data: list[str] = []
        self.open: list[str] = []
        self.sinks: dict[str, list[str] | None] = {"title": None, "h1": None, "a": None, "button": None, "ld": None}

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag not in _VOID:
            self.open.append(tag)
        if "itemscope" in a and a.get("itemtype", "").strip("/ "):
            self.itemtypes.append(a["itemtype"].strip("/ ").rsplit("/", 1)[-1])
        if tag == "html":
            self.lang = a.get("lang") or self.lang
        elif tag == "title" and self.title is None:
            self.title = self.sinks["title"] = []
        elif tag == "h1" and not _HIDDEN.search(a.get("style", "")) and "hidden" not in a:
            self.sinks["h1"] = []
        elif tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.canonicals.append(a.get("href", "").strip())
        elif tag == "meta" and (key := a.get("name") or a.get("property") or a.get("itemprop")):
            self.metas.setdefault(key.lower(), a.get("content", ""))
        elif tag == "a":
            self.links.append({"href": a.get("href"), "text": "", "in_nav": "nav" in self.open or "header" in self.open, "cfemail": a.get("data-cfemail")})
            self.sinks["a"] = []
        elif a.get("data-cfemail"):
            self.links.append({"href": None, "text": "", "in_nav": False, "cfemail": a["data-cfemail"]})
        if tag == "form":
            self.forms.append({"action": a.get("action"), "method": (a.get("method") or "get").lower(), "fields": []})
        elif tag in ("input", "select", "textarea") and "form" in self.open and self.forms:
            kind = (a.get("type") or "text").lower() if tag == "input" else tag
            if kind not in ("submit", "button", "image", "reset"):
                shown = kind != "hidden" and "hidden" not in a and not _HIDDEN.search(a.get("style", "")) and a.get("aria-hidden") != "true"
                self.forms[-1]["fields"].append({"name": a.get("name"), "type": kind, "required": "required" in a, "visible": shown})
        if tag == "button":
            self.sinks["button"] = []
        elif tag == "input" and a.get("type", "").lower() in ("submit", "button") and a.get("value"):
            self.buttons.append(a["value"])
        elif tag == "img":
            src = a.get("src") or a.get("data-src") or a.get("srcset", "").split(",")[0].split(" ")[0]
            plain = a.get("alt") == "" or a.get("role") == "presentation" or a.get("aria-hidden") == "true" or _HIDDEN.search(a.get("style", ""))
            within = "footer" in self.open or "nav" in self.open
            if src:
                self.images.append({"src": src, "alt": a.get("alt"), "decorative": bool(plain or within or _DECORATIVE.search(a.get("class", "") + " " + src))})
        elif tag == "script":
            if a.get("src"):
                self.scripts.append(a["src"])
            if a.get("type", "").lower() == "application/ld+json":
                self.sinks["ld"] = []

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        sink = {"script": "ld"}.get(tag, tag)
        if (held := self.sinks.get(sink)) is not None:
            whole = "".join(held)
            text = _plain(whole)
            self.sinks[sink] = None
            if sink == "h1":
                self.h1.append(text)
            elif sink == "a" and self.links:
                self.links[-1]["text"] = text
            elif sink == "button":
                self.buttons.append(text)
            elif sink == "ld":
                self.data.append(whole)

    def handle_data(self, data):
        if "script" in self.open or "style" in self.open:
            if self.sinks["ld"] is not None:
                self.sinks["ld"].append(data)
            return
        for name in ("title", "h1", "a", "button"):
            if self.sinks[name] is not None:
                self.sinks[name].append(data)
        if "title" not in self.open:
            self.words.append(data)


def read_json(text: str):
    """(value, repaired): JSON, also with comments, trailing commas and line ends in strings; (None, False) if neither."""
    try:
        return json.loads(text), False
    except ValueError:
        pass
    mended = re.sub(r"<!--|-->|/\*.*?\*/|^\s*//[^\n]*", "", text, flags=re.S | re.M)
    mended = re.sub(r",\s*([}\]])", r"\1", mended)
    try:
        return json.loads(mended, strict=False), True
    except ValueError:
        return None, False


def _walk(value):
    """All objects in a JSON value, outer ones first."""
    if isinstance(value, dict):
        yield value
        for x in value.values():
            yield from _walk(x)
    elif isinstance(value, list):
        for x in value:
            yield from _walk(x)


def _text(value) -> str | None:
    if isinstance(value, list):
        value = value[0] if value else None
    return value if isinstance(value, str) else None


def read_page(page: str | None) -> dict:
    """The facts of one page."""
    p = _Page()
    if page:
        p.feed(page)
        p.close()
    types, people, dates, repaired, found = [], [], [], False, False
    for text in p.data:
        value, mended = read_json(text)
        repaired |= mended
        for x in _walk(value):
            own = x.get("@type")
            kinds = [t for t in (own if isinstance(own, list) else [own]) if isinstance(t, str)]
            types += kinds
            found |= bool(kinds)
            if {"Person", "Organization", "LocalBusiness"} & set(kinds):
                people.append({"type": kinds[0], "name": _text(x.get("name")), "title": _text(x.get("jobTitle")), "email": _text(x.get("email")), "telephone": _text(x.get("telephone"))})
            dates += [x[k] for k in ("datePublished", "dateModified", "uploadDate") if isinstance(x.get(k), str)]
    words = _plain("\n".join(p.words))
    return {
        "title": _plain("".join(p.title)) if p.title is not None else None,
        "h1": p.h1, "canonicals": p.canonicals, "lang": p.lang, "metas": list(p.metas.items()), "text": words or None, "links": p.links, "forms": p.forms,
        "images": p.images, "scripts": p.scripts, "buttons": p.buttons, "itemtypes": p.itemtypes, "ld_types": types, "ld_found": found, "ld_repaired": repaired,
        "people": people, "dates": dates,
    }


def page_facts(df: DataFrame, key: str, page: str) -> DataFrame:
    """(key, facts...) of every page."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, {FACTS}"
    made = pa.schema([])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts = [read_page(x) for x in batch.column(page).to_pylist()]
            columns = [batch.column(key), *(pa.array([f[name] for f in facts], made.field(name).type) for name in made.names)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, *made.names])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    made = to_arrow_schema(_parse_datatype_string(FACTS))
    return df.select(key, page).mapInArrow(read, schema)


# --- facts that follow from others ----------------------------------------------------------------------------------
def canonical(canonicals: Column) -> tuple[Column, Column]:
    """(address, error): the one canonical link; several or none are errors."""
    one = F.array_distinct(F.filter(canonicals, lambda x: x != ""))
    error = F.when(F.size(one) == 0, "none").when(F.size(one) > 1, "several")
    return F.when(F.size(one) == 1, F.get(one, F.lit(0))), error


def link_reason(href: Column) -> Column:
    """Why a link is no page of a site: empty, fragment, its scheme, or no host; NULL for a page."""
    low = F.lower(F.trim(href))
    scheme = F.regexp_extract(low, r"^([a-z][a-z0-9+.-]*):", 1)
    return (
        F.when(href.isNull() | (low == ""), "empty")
        .when(low.startswith("#"), "fragment")
        .when((scheme != "") & ~scheme.isin("http", "https"), scheme)
        .when(low.rlike(r"^(https?:)?//(/|$)"), "no host")
    )


#: Fixed marks of tags in a page's source: (name, pattern of its identifier, pattern of its presence).
TAGS = (
    ("ga4", r"\b(G-[A-Z0-9]{6,12})\b", r"gtag\('config',\s*'G-|googletagmanager\.com/gtag/js"),
    ("gtm", r"\b(GTM-[A-Z0-9]{4,9})\b", r"googletagmanager\.com/gtm\.js"),
    ("google_ads", r"\b(AW-\d{6,12})\b", r"\bAW-\d{6,12}\b"),
    ("meta", r"fbq\('init',\s*'(\d{6,20})'", r"connect\.facebook\.net|fbq\("),
    ("tiktok", r"ttq\.load\('([A-Z0-9]{10,30})'", r"analytics\.tiktok\.com|ttq\.load"),
    ("linkedin", r"_linkedin_partner_id\s*=\s*\"?(\d{4,10})", r"snap\.licdn\.com|_linkedin_partner_id"),
    ("pinterest", r"pintrk\('load',\s*'(\d{8,20})'", r"pintrk\(|s\.pinimg\.com/ct"),
    ("uet", r"\bti:\s*\"?(\d{6,12})", r"bat\.bing\.com"),
)
UNKNOWN = "ukendt"


def tracking(page: Column) -> dict[str, Column]:
    """Identifier by tag: 'ukendt' where a tag is there without one, NULL where it isn't there."""
    return {
        name: F.when(F.regexp_extract(page, own, 1) != "", F.regexp_extract(page, own, 1)).when(page.rlike(there), UNKNOWN)
        for name, own, there in TAGS
    }


#: Fixed names of consent services.
CONSENT = r"(?i)cookiebot|cookieinformation|onetrust|cookielaw|usercentrics|quantcast|didomi|iubenda|termly|osano|trustarc"


def cookie_banner(page: Column, text: Column) -> tuple[Column, Column]:
    """(method, confidence): a consent service's script, an element named for cookies or consent, or words about them."""
    script = page.rlike(rf"(?i)<script[^>]*(?:{CONSENT[4:]})")
    element = page.rlike(r"(?i)(?:class|id)=[\"'][^\"']*(?:cookie|consent)[^\"']*[\"']")
    said = text.rlike(r"(?i)\bcookies?\b") & text.rlike(r"(?i)gdpr|samtykke|consent|accept")
    method = F.when(script, "script").when(element, "selector").when(said, "text")
    return method, F.when(script, 0.95).when(element, 0.7).when(said, 0.4)


def security(headers: Column) -> dict[str, Column]:
    """Security facts of response headers, whose names are compared in lower case."""
    h = F.map_from_entries(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    get = lambda name: F.coalesce(F.try_element_at(h, F.lit(name)), F.lit(""))
    hsts, csp = F.lower(get("strict-transport-security")), F.lower(F.concat_ws("; ", F.nullif(get("content-security-policy"), F.lit("")), F.nullif(get("content-security-policy-report-only"), F.lit(""))))
    on = F.coalesce(F.regexp_extract(hsts, r"max-age=\"?(\d+)", 1).try_cast("bigint") > 0, F.lit(False))
    ancestors = F.regexp_extract(csp, r"frame-ancestors\s+([^;]*)", 1)
    return {
        "hsts": on,
        "hsts_sub": on & F.contains(hsts, F.lit("includesubdomains")),
        "hsts_preload": on & F.contains(hsts, F.lit("preload")),
        "csp": csp != "",
        "nosniff": F.lower(F.trim(get("x-content-type-options"))) == "nosniff",
        "framing": F.lower(F.trim(get("x-frame-options"))).isin("deny", "sameorigin") | ((ancestors != "") & (F.trim(ancestors) != "*")),
    }


def decoded(code: Column) -> Column:
    """An address hidden as hexadecimal digits, of which the first two are the key of all others; NULL if it is no code."""
    n = F.length(code)
    byte = lambda i: F.conv(F.substr(code, i, F.lit(2)), 16, 10).cast("int")
    whole = code.rlike("^(?:[0-9a-fA-F]{2}){2,}$")
    at = F.sequence(F.lit(3), F.greatest(n - 1, F.lit(3)), F.lit(2))
    hexed = F.array_join(F.transform(at, lambda i: F.lpad(F.hex(byte(i).bitwiseXOR(byte(F.lit(1)))), 2, "0")), "")
    return F.when(whole, F.try_validate_utf8(F.try_to_binary(hexed, F.lit("hex")).cast("string")))


def encoded(text: Column, key: Column) -> Column:
    """The code of an address under a key of one byte; `decoded` takes it back."""
    byte = F.lpad(F.hex(key), 2, "0")
    body = F.hex(F.encode(text, "UTF-8"))
    at = F.sequence(F.lit(1), F.greatest(F.length(body) - 1, F.lit(1)), F.lit(2))
    return F.concat(byte, F.array_join(F.transform(at, lambda i: F.lpad(F.hex(F.conv(F.substr(body, i, F.lit(2)), 16, 10).cast("int").bitwiseXOR(key)), 2, "0")), ""))


def contact_of(href: str, code: str) -> Column:
    """(kind, value) of a link: the address of a mail link or of a hidden one, the number of a telephone link; NULLs otherwise."""
    link = F.trim(F.col(href))
    mail = F.regexp_replace(F.regexp_replace(link, "(?i)^mailto:\\s*", ""), r"\?.*$", "")
    is_mail, is_phone = link.rlike("(?i)^mailto:"), link.rlike("(?i)^tel:")
    kind = F.when(is_mail | F.col(code).isNotNull(), "email").when(is_phone, "phone")
    value = F.when(is_mail, mail).when(F.col(code).isNotNull(), decoded(F.col(code))).when(is_phone, F.regexp_replace(link, "(?i)^tel:\\s*", ""))
    return F.struct(kind.alias("kind"), value.alias("value"))


def runtime_state(page: Column, name: str = "__INITIAL_STATE__") -> Column:
    """The state object that a page's script assigns to a name, as JSON: bare keys quoted, `undefined` as null, no trailing commas."""
    found = F.regexp_extract(page, rf"(?s){name}\s*=\s*(\{{.*?\}})\s*;?\s*</script>", 1)
    quoted = F.regexp_replace(found, r"([{,]\s*)([A-Za-z_]\w*)\s*:", '$1"$2":')
    return F.nullif(F.regexp_replace(F.regexp_replace(quoted, r":\s*undefined\b", ": null"), r",\s*([}\]])", "$1"), F.lit(""))
