"""Template residue, filler, error pages and script or access notices in place of content.

1. Every value is normalised and masked: single spaces, addresses, dates and numbers replaced by marks.
2. Equal masked values are grouped by the SHA-256 of their form across all fields and hosts; a group keeps its rows and
   hosts. Groups pre-aggregate, so a message that a third of all rows share is one row per task.
3. The groups, not the rows, are classified by one value of theirs (the others differ in masked marks only). It is cut
   into parts at dashes, bars and sentence ends. What is residue wherever it stands: delimited placeholders, runs of
   filler words, and a message phrase or bare placeholder that makes up COVERED of its part's words, common openings and
   endings of messages ("you must ... to view this page", "powered by ...") included. Words are read after repair of
   garbled text, and words one typo away from a phrase's word as that word.
4. A phrase or bare placeholder amid more words may be residue or content that speaks of it. The part is then masked
   further (capitalised words outside the phrase, placeholders) to a frame, the frames of all residue are grouped across
   groups, fields and hosts, and it is residue if its frame recurs: real messages are the same on many hosts, a sentence that only
   speaks of one stands on its own.
5. Classified groups are joined back to their rows by hash.

Defined cases: NULL and blank values are no cases; very long values are handled whole; equal rows are cases each; a
frame counts as recurring when it stands on two hosts, and rows without a host count for none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stenbro.llm import garbled
from stenbro.session import written

ADDRESS = r"(?i)\bhttps?://\S+|\bwww\.\S+|\S+@\S+\.\w+"
DATE = r"\b\d{1,4}[-./]\d{1,2}[-./]\d{1,4}\b"
NUMBER = r"\d+"


def masked(text: Column) -> Column:
    """The masked form by which values are grouped."""
    form = F.trim(F.regexp_replace(text, r"\s+", " "))
    for pattern, mark in ((ADDRESS, "@"), (DATE, "#"), (NUMBER, "0")):
        form = F.regexp_replace(form, pattern, mark)
    return form


#: Placeholders that are one wherever they stand, as written.
PLACEHOLDERS = [
    r"\{\{.*?\}\}",
    r"\{%.*?%\}",
    r"<%.*?%>",
    r"<\?.*?\?>",
    r"%%\s*[\w.]+\s*%%",
    r"%[A-Za-z_][\w.]*%",
    r"(?<![\w%])%(?:\d\$)?[sdSD](?!\w)",
    r"[$#]\{[^{}]*\}",
    r"\{\$?[A-Za-zÆØÅæøå_][\w. -]*\}",
    r"\$[A-Za-z_]{3,}\$",
    r"#[A-ZÆØÅa-zæøå_]{3,}#",
    r"\[\[.*?\]\]",
    r"\[(?!(?i:nyt|nyhed|video|udsolgt|annonce|sponsoreret|opdateret|billede[rt]?|sic|beta|link)\])[^\]]*[A-Za-zÆØÅæøå_.]{4,}[^\]]*\]",
    r"<<\s*[\w.]+\s*>>",
    r"\(\(\s*[\w.]+\s*\)\)",
    r"@[A-Z]\w*(?:\.\w+)+",
    r"__[A-Za-zÆØÅæøå][\w.]*?__",
    r"\{\d+\}",
    r"<(?!/?(?i:b|i|em|strong|br|p|span|a|h\d|u|small|sup|sub)\b)[A-Za-zÆØÅæøå][^<>]*>",
    r"(?<![\w-])[xX]{3,}(?![\w-])",
    r"(?<![\w-])TODO(?![\w-])",
    r"\[object Object\]",
    r"(?i:(?:^\s*|[|·–:.]\s*|\s-\s+)(?:null|nan|todo|tbd|none)(?:\s*$|\s*[|·–:.]|\s+-\s))",
]
#: Words that are placeholders if they stand alone or in a recurring frame.
BARE = [
    r"(?<![\w/.@-])[A-Za-zæøå]+\d?(?:_[A-Za-z0-9æøå]+)+(?![\w/@-])",
    r"(?i:(?<![\w-])undefined(?![\w-]))",
]
#: Phrases of messages and filler, in lower case.
_THING = (
    "(?:den ønskede |denne |dette )?(?:dokumentet?|artikle?n?|siden?|undersiden|adressen|webstedet|hjemmesiden|serveren|databasen|"
    "applikationen|forbindelsen|tjenesten|filen|ressourcen|linket|indholdet|systemet)"
)
_FAILED = (
    "(?:blev ikke fundet|kunne ikke (?:findes|startes|indlæses|åbnes|vises|kontaktes|nås)|findes ikke(?: længere)?|eksisterer ikke(?: længere)?|"
    "er desværre ikke (?:tilgængelig|fundet)|er ikke tilgængeligt?|er flyttet eller slettet|er (?:blevet )?(?:flyttet|slettet|fjernet)|svarer ikke|"
    "er (?:midlertidigt )?nede|er midlertidigt utilgængeligt?|returnerede en fejl|er overbelastet|fejlede)"
)
_CAUSE = "(?:java ?scripts?|scripts?|scripting|cookies og scripts|cookies and scripts|cookies)"
PHRASES = [
    # error pages
    rf"\b{_THING} {_FAILED}\b",
    r"\b\w{2,}(?:en|et) (?:blev ikke fundet|kunne ikke (?:vises|findes|startes|indlæses)|findes ikke længere|er desværre ikke tilgængelig|er flyttet eller slettet)\b",
    r"\b(?:adgang(?:en)?|visning af siden)(?: er)? (?:nægtet|forbudt|kræver login|spærret for din konto)",
    r"\b(?:adgang(?:en)?|visning af siden) er spærret\b",
    r"\b(?:the|this|that|requested) (?:requested )?(?:page|document|article|resource|url|file|site|address|link)(?: you requested)? (?:does not exist|was moved permanently|has been (?:re)?moved|has moved|is not available|is unavailable|was not found|could not be found|cannot be found|not found|no longer exists)",
    r"\b(?:page|document|article|resource|file|url) not found\b",
    r"\b(?:bad|invalid) (?:gateway|request|response from upstream)\b",
    r"\b(?:internal|fatal|unexpected|temporary|unhandled|uncaught) (?:server )?(?:error|exception)\b",
    r"\b(?:access (?:is )?denied|access forbidden|service (?:temporarily )?unavailable|gateway time-?out|request timed? ?out|too many requests|connection (?:refused|timed out))\b",
    r"(?:^|[:(] ?)(?:http|error|fejl|eror|err|status|statuskode)(?: code| kode)?:? ?000(?=$|\s*[:|·–.()]|\s+-|\s+\w)",
    r"\bsidefejl\b|\bfejlmeddelelse:",
    # scripts, browsers, access
    rf"\b{_CAUSE} (?:is|are|er|skal være|must be) (?:required|disabled|not enabled|turned off|blocked|enabled|påkrævet|slået (?:fra|til)|deaktiveret|blokeret|krævet|nødvendigt?)\b",
    r"\b(?:enable|activate|turn on|allow|switch on) (?:java ?script|scripts|scripting|cookies and scripts)\b",
    r"\b(?:aktiver(?:e)?|slå|tillade?|tillad) (?:java ?script|scripts|scripting|cookies og scripts)\b(?: til\b)?",
    r"\b(?:skal(?: du)?|venlig at|husk at) (?:bruge|benytte|opdatere)(?: til)? (?:en )?(?:nyere|din) browser\b",
    r"\b(?:please|must|need to) (?:use|update|upgrade)(?: to)? (?:a |your )?(?:newer |modern )?browser\b",
    r"\b(?:din browser|denne enhed|din enhed) (?:understøtter ikke|har slået|blokerer)\b(?: \w+ (?:fra|til)\b)?",
    r"\byour (?:browser|device) (?:does not|doesn't|has|blocks)\b(?: \w+ \w+)?",
    rf"\b(?:{_THING} kan ikke vises,? (?:fordi|da) )?scripts er blokeret\b",
    r"\b(?:\S+ (?:does not|doesn't) )?work(?:s)? properly without java ?script\b",
    r"\b(?:checking|verifying) (?:your browser|the connection|your connection|that you are human|if the site connection)\b",
    r"\bverify (?:that )?you are (?:human|not a robot)\b|\bi'?m not a robot\b|\bare you a robot\b",
    r"\bvi tjekker din browser\b|\b(?:siden|vi) bekræfter din forbindelse\b|\bbekræft,? at \w{1,3} ikke er en robot\b|\bbekræft,? at du er et menneske\b",
    # filler and leftovers of templates
    r"\b(?:bla|test|asdf|qwerty|lorem|foo|tekst)(?: (?:bla|test|asdf|qwerty|ipsum|bar|tekst)\b)+(?! af)",
    r"\bher kommer der snart(?: \w+\b)?|\beksempeltekst\b|\bskal erstattes\b|\bpladsholder\b|\bplaceholder text\b|\bdummy text\b|\bdummytekst\b|\bfyldtekst\b",
    r"^(?:overskrift|heading|headline|titel|title|tekst|afsnit) 0(?=$|\s+\S)",
    r"^(?:ny side|new page|startside 0|side 0)(?=$|\s+\S)",
    r"\bunavngivet (?:side|dokument)\b|\buntitled (?:document|page)\b|\b(?:sample|example) page\b|\beksempelside\b|\bhello world\b",
    r"\b(?:endnu et websted|just another) .{0,20}?(?:lavet med|site|sidebyggeren)\b|\bsidebyggeren\b|\bcoming soon\b|\bunder (?:construction|opbygning)\b",
    r"\byour (?:headline|page title|company text|company name|company|description|title|text|content|name|tagline|keywords?) (?:goes )?here\b",
    r"\b(?:add|insert|replace with|enter|type|write) (?:your|the|a) (?:headline|page title|company text|company name|description|title|text|content|tagline|keywords?)\b.{0,20}\bhere\b",
    r"\b(?:indsæt|tilføj|skriv|udfyld|angiv|erstat) (?:sidens|firmaets|virksomhedens|din|en|et|dit|jeres)(?: korte?)? (?:titel|navn|tekst|overskrift|beskrivelse|slogan|indhold)\b.{0,10}\b(?:her|i dette felt|senere)\b",
    r"\b(?:titel|beskrivelse|tekst|overskrift|navn|indhold|metabeskrivelse|sidetitel) mangler\b",
]
#: What messages begin and end with; it belongs to a phrase beside it and is none of its own.
AROUND = [
    r"\b(?:for at (?:fortsætte|se siden|bruge siden) skal du|husk at|vær venlig at|venligst|du skal|skal du|hovsa|ups|beklager|desværre|vent venligst|et øjeblik)\b",
    r"\b(?:we're sorry,? but|we are sorry,? but|sorry|oops|please|you (?:must|need to|have to)|to continue)\b",
    r"\b(?:for at (?:se|bruge) (?:siden|indholdet)|for at fortsætte|i din browser|og genindlæse?(?: siden)?|og prøve igen|prøv igen(?: senere)?|kontakt webmaster(?: hvis fejlen fortsætter)?)\b",
    r"\b(?:powered by \w+|reload|to (?:view|see|use) (?:this|the) (?:page|site)|in your browser|and reload|on this server|try again(?: later)?|before you continue|in index\.php|som|eller slettet)\b",
]
COVERED = 0.6
PART = re.compile(r"\s+[-–—|·]\s+|[|·]|(?<=[.!?…])\s+")
RENDER = r"\b(?:err|error|exception|time-?out|failed|crash(?:ed)?)\b"
LOREM = set("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat".split())


@lru_cache(1)
def _rules() -> tuple[re.Pattern, ...]:
    return tuple(map(re.compile, ("|".join(PLACEHOLDERS), "|".join(BARE), "|".join(PHRASES), "|".join(AROUND), RENDER, garbled.SUSPECT)))


@lru_cache(1)
def _typos() -> tuple[set[str], dict[str, str]]:
    """Words of the phrases, and each word with one letter left out -> the word."""
    plain = re.sub(r"\\[a-z]|\(\?[:=!<]*|[a-zæøå]\?", lambda m: m.group()[0] if m.group()[-1:] == "?" and m.group()[0].isalpha() else " ", " ".join(PHRASES + AROUND))
    words = {w for w in re.findall(r"[a-zæøå]{4,}", plain)} | {"not", "has", "was", "the", "ikke", "page"} | {w for w in LOREM if len(w) > 3}
    words |= {"dokumentet", "artiklen", "siden", "side", "findes", "scripts", "javascript", "error", "http", "fejl", "document", "undefined"}
    left_out: dict[str, str] = {}
    for w in sorted(w for w in words if len(w) > 3):
        for i in range(len(w)):
            left_out.setdefault(w[:i] + w[i + 1 :], w)
    return words, left_out


@lru_cache(200_000)
def _read(word: str) -> str:
    """The phrase word that a word is one typo away from, or the word."""
    words, left_out = _typos()
    if len(word) < 4 or word in words:
        return word
    if found := left_out.get(word):
        return found  # a letter left out
    for i in range(len(word)):
        short = word[:i] + word[i + 1 :]
        if short in words and len(short) > 2:
            return short  # a letter too many
        other = left_out.get(short)
        if other is not None and len(other) == len(word) and sum(a != b for a, b in zip(word, other, strict=True)) <= 2 and sorted(word) == sorted(other):
            return other  # two letters changed places
        if other is not None and len(other) == len(word) and sum(a != b for a, b in zip(word, other, strict=True)) == 1:
            return other  # another letter
    return word


WORD = re.compile(r"[a-zæøå]+")
#: Words of phrases that are too short for typos.
SHORT = {"bla", "foo", "err", "ny", "new", "til", "url"}


#: A value without any of these has no placeholder.
MARKED = re.compile(r"[{}<>%$#\[\]_@()]|[xX]{3}|(?i:todo|undefined|null|nan|tbd|none)")


def read_value(text: str | None, rendered: bool = False) -> tuple[str | None, str | None, str | None]:
    """(kind, None, frame) of residue wherever it stands, (None, kind, frame) of what is residue if its frame recurs.

    Kinds are 'placeholder', 'filler' and 'message'. `rendered`: the value is a render status.
    """
    if text is None or not text.strip():
        return None, None, None
    placeholder, bare, phrase, around, render, suspect = _rules()
    read = garbled.repair(text)[0] if suspect.search(text) else text
    marked = MARKED.search(read) is not None
    if marked and placeholder.search(read) or read is not text and placeholder.search(text):
        part = next((p for p in PART.split(" ".join(read.split())) if placeholder.search(p)), "")
        return "placeholder", None, _frame(part, part, [m.span() for m in placeholder.finditer(part)], "placeholder")
    low = " ".join(read.lower().replace("’", "'").split())
    words = WORD.findall(low)
    if len(words) >= 3 and sum(_lorem(w) for w in words) * 2 >= len(words) or _run(words) >= 4:
        return "filler", None, None
    known = _typos()[0]
    if rendered and render.search(re.sub(r"\d", "0", WORD.sub(lambda m: _read(m.group()), low))):
        return "message", None, None
    if not (marked and bare.search(read)) and not any(_read(w) in known or w in SHORT for w in words):
        return None, None, None
    weak: tuple[str | None, str | None, str | None] = None, None, None
    for part in PART.split(" ".join(read.replace("’", "'").split())):
        form = re.sub(r"\d", "0", WORD.sub(lambda m: _read(m.group()), part.lower())).strip(" .!?…")
        spans, kind = [m.span() for m in phrase.finditer(form)], "message"
        if not spans and marked:
            spans, kind = [m.span() for m in bare.finditer(part)], "placeholder"
            form = part.strip(" .!?…") if spans else form
        if not spans:
            continue
        inside = spans + [m.span() for m in around.finditer(form if kind == "message" else form.lower())]
        total = [m.span() for m in WORD.finditer(form.lower())]
        covered, n = sum(any(a <= x and y <= b for a, b in inside) for x, y in total), len(total)
        if kind == "placeholder":  # one word, whatever it is put together from
            joined = sum(any(a <= x and y <= b for a, b in spans) for x, y in total) - len(spans)
            covered, n = covered - joined, n - joined
        if covered >= COVERED * n:
            return kind, None, _frame(part, form, spans, kind)
        weak = weak if weak[1] else (None, kind, _frame(part, form, spans, kind))
    return weak


def _frame(part: str, form: str, spans: list[tuple[int, int]], kind: str) -> str:
    """A part with its placeholders and the names outside its phrase masked, without names at its ends."""
    if kind == "placeholder":
        for a, b in reversed(spans):
            form = form[:a] + "¤" + form[b:]
        part = form
    names = set() if part.upper() == part else {_read(w.lower()) for w in re.findall(r"(?<=\s)[A-ZÆØÅ][\wæøåÆØÅ]*", part)}
    said = {w for a, b in spans for w in WORD.findall(form[a:b].lower())} if kind == "message" else set()
    masked = WORD.sub(lambda m: "~" if m.group() in names - said else m.group(), form.lower())
    return re.sub(r"~(?:[\s/&-]+~)+", "~", re.sub(r"~(?:-\w+)+", "~", masked)).strip(" ~.,:!?-/&")


def residue_kind(text: str | None, field: str = "", recurring: bool = False) -> str | None:
    """The kind of one value; `recurring`: its frame is known to recur."""
    kind, weak, _ = read_value(text, field == "render_status")
    return kind or (weak if recurring else None)


def _lorem(word: str) -> bool:
    return word in LOREM or (len(word) > 3 and _read(word) in LOREM)


def _run(words: list[str]) -> int:
    """The longest run of filler words."""
    best = now = 0
    for w in words:
        now = now + 1 if _lorem(w) else 0
        best = max(best, now)
    return best


def messages(df: DataFrame, key: str, host: str, fields: dict[str, Column], status: str = "render_status") -> tuple[DataFrame, DataFrame]:
    """(values, groups): the values with the hash of their masked form, and the groups of equal forms that are residue.

    values: rec_id, field, form_hash; groups: form_hash, fields, example, n_rows, n_hosts, kind, status_kind. `status`
    names the field that holds render states, to which one rule more applies.
    """
    listed = F.array(*[F.struct(F.lit(f).alias("field"), c.alias("text")) for f, c in fields.items()])
    rows = df.select(df[key].alias("rec_id"), df[host].alias("host"), F.inline(listed)).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")
    rows = rows.withColumn("form_hash", F.sha2(masked(F.col("text")), 256))
    groups = rows.groupBy("form_hash").agg(
        F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"),
        F.min("text").alias("example"),
        F.count("*").alias("n_rows"),
        F.approx_count_distinct("host").alias("n_hosts"),
        F.min("host").alias("low_host"),
        F.max("host").alias("high_host"),
    )

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, read = [], []
            for k, (text, listed) in enumerate(zip(batch.column("example").to_pylist(), batch.column("fields").to_pylist(), strict=True)):
                one = read_value(text)
                of_status = read_value(text, True)[0] if status in listed.split(",") else one[0]
                if one[0] or one[1] or of_status:
                    kept.append(k)
                    read.append((*one, of_status))
            at = pa.array(kept, pa.int64())
            columns = [batch.column(c).take(at) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([r[i] for r in read], pa.string()) for i in range(4))], names=[*batch.schema.names, "kind", "weak", "frame", "status_kind"])

    schema = "form_hash string, fields string, example string, n_rows bigint, n_hosts bigint, low_host string, high_host string, kind string, weak string, frame string, status_kind string"
    found = written(groups.mapInArrow(classify, schema))
    recurring = found.where("frame <> ''").groupBy("frame").agg(F.min("low_host").alias("low"), F.max("high_host").alias("high")).where("low <> high").select("frame", F.lit(True).alias("recurs"))
    kind = F.coalesce("kind", F.when(F.col("recurs"), F.col("weak")))
    kinds = found.join(recurring, "frame", "left").select("form_hash", "fields", "example", "n_rows", "n_hosts", kind.alias("kind"), F.coalesce("status_kind", kind).alias("status_kind"))
    return rows.select("rec_id", "field", "form_hash"), kinds.where("kind is not null or status_kind is not null")


def unusable(df: DataFrame, key: str, host: str, fields: dict[str, Column], status: str = "render_status") -> DataFrame:
    """(rec_id, field, kind) of every value that isn't content."""
    values, groups = messages(df, key, host, fields, status)
    kind = F.when(F.col("field") == status, F.col("status_kind")).otherwise(F.col("kind"))
    return values.join(groups.select("form_hash", "kind", "status_kind"), "form_hash").select("rec_id", "field", kind.alias("kind")).where("kind is not null")
