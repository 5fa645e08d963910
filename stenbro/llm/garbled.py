"""Text decoded with the wrong character encoding: found by a garbling cost, repaired by a strict round trip.

A repair encodes the text under a candidate legacy encoding (the one it was wrongly read with) and decodes the bytes
strictly as the intended encoding. It is accepted when the garbling cost drops, and tried again on its result, for
text that went through several wrong readings. What a whole text doesn't allow, because only a part of it is damaged,
is tried word by word. Bytes written as numeric entities are one more candidate.

The cost counts marks of damage: replacement and control characters, pairs that are UTF-8 bytes read as another
encoding, box drawing, symbols and lost letters ('?') within words, and letters in a case that their neighbours
exclude. Correct foreign letters, degree and unit signs beside digits, and questions cost nothing.

Values whose characters can't cost anything are passed over in the scan's own filter, before Python.

Defined cases: NULL, empty and plain ASCII values are no cases; very long values are handled whole; repeated rows each
keep their row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (read as, meant as), fixed candidates. 'sloppy' is cp1252 with control characters where it has no letter.
ROUND_TRIPS = [
    ("sloppy", "utf-8"),
    ("latin-1", "utf-8"),
    ("mac_roman", "utf-8"),
    ("cp850", "utf-8"),
    ("cp437", "utf-8"),
    ("cp1250", "utf-8"),
    ("iso8859_2", "utf-8"),
    ("cp1251", "utf-8"),
    ("cp850", "cp1252"),
    ("cp437", "cp1252"),
    ("sloppy", "cp850"),
    ("mac_roman", "cp1252"),
    ("sloppy", "mac_roman"),
]
#: What a reading as a single-byte encoding may bring in.
EXPECTED = set("æøåÆØÅéÉüöäÜÖÄ–—·’“”…«»½²³°§ ")


def _encode(text: str, codec: str) -> bytes:
    if codec != "sloppy":
        return text.encode(codec)
    return b"".join(c.encode("latin-1") if "\x80" <= c <= "\x9f" else c.encode("cp1252") for c in text)


@lru_cache(1)
def _continuations() -> dict[str, str]:
    """Characters that the bytes 0x80-0xBF are read as, by encoding."""
    out = {}
    for codec in ("cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1250", "cp1251"):
        read = {bytes([b]).decode(codec, "ignore") or chr(b) for b in range(0x80, 0xC0)} | {chr(b) for b in range(0x80, 0xA0)}
        out[codec] = "[" + re.escape("".join(sorted(read))) + "]"
    return out


L, U = "a-zæøåäöüéèß", "A-ZÆØÅÄÖÜÉ"


@lru_cache(1)
def _marks() -> list[tuple[float, re.Pattern]]:
    c = _continuations()
    latin = f"(?:{c['cp1252']}|{c['latin-1']})"
    inside = "°µ›‹†‡¤¢¥£§¶±¾¿Œ®¯¨´¸•‰‚„ƒˆ˜©ª¬º¹³²½¼ðþÐÞ\\u2202-\\u22ff"
    return [
        (3, re.compile("�")),
        (2, re.compile("[\x80-\x84\x86-\x9f]")),
        (2, re.compile(f"[ÂÃÄÅÆÇÈÉÊËÎÏÐÑ]{latin}|â{latin}{latin}|ï»¿|ã€")),
        (2, re.compile(f"√{c['mac_roman']}|‚Ä{c['mac_roman']}|¬{c['mac_roman']}")),
        (2, re.compile("[─-▟]")),
        (2, re.compile(f"ÔÇ.|Ô{c['cp850']}{c['cp850']}|Γ{c['cp437']}")),
        (2, re.compile("[ĂĹĎ][\x80-\xbf¦¸ĄŁşŞťŤžŽ˛¤ą»Ľ˝ľżŻ…†‡‰‹‘’“”•–—™›]")),
        (2, re.compile("[РСГВ][\x80-\x9fЂ-Џђ-џ‚ѓ„…†‡€‰‹‘’“”•–—™›¤¦§©«¬®°±¶µ·»№]")),
        (1, re.compile(f"(?<=[{L}{U}])[{inside}](?=[{L}{U}])")),
        (1, re.compile(f"(?<=[{L}])[°›†µ](?![{L}{U}0-9])|(?<=[{U}])[›†](?![{L}{U}0-9])")),
        (1, re.compile(f"(?<![{L}{U}0-9 ])[›†](?=[{L}])|(?<=[ ])[›†°](?=[{L}]{{2}})|(?<=[ ])µ(?=[{L}]{{3}})|^[›†°µ](?=[{L}]{{2}})")),
        (1, re.compile(f"(?<=[{L}{U}])[‘“”](?=[{L}{U}])|(?<![{L}{U}])‘(?=[{L}]+[^’']*$)")),
        (1, re.compile("(?<=[BCDFGHJKLMNPQRSTVWXZ])’(?=[BCDFGHJKLMNPQRSTVWXZ])(?!S\\b)")),
        (1, re.compile(f"(?<![{L}{U}0-9])’(?=[{L}]{{4}})")),
        (1, re.compile(f"(?<=[{L}])[ÀÁÂÃÇÈÊËÌÍÎÏÑÒÓÔÕÙÚÛÝ](?![{U}])")),
        (1, re.compile(f"(?<=[{U}])[àáâãçêëìíîïñòóôõùúûý](?=[{U}])")),
        (0.5, re.compile("[ÕÏ]|(?<= )[ûÀ](?= )")),
    ]


LOST = re.compile(rf"(?<=[{L}{U}])\?(?=[{L}{U}])|(?<![^\s(«\"'])\?(?=[{L}{U}])|(?<=\s)\?(?=\s)")
LOST_IN_NAME = re.compile(r"\?")
ENTITY = re.compile(r"(?:&#(?:12[89]|1[3-9]\d|2[0-4]\d|25[0-5]);)+")
ADDRESS = re.compile(r"\S*(?:://|www\.|/\S*\?\S*=)\S*")


def _entity_bytes(run: str) -> str | None:
    """The text that a run of numeric entities holds as UTF-8 bytes, or None."""
    try:
        return bytes(int(n) for n in re.findall(r"\d+", run)).decode("utf-8")
    except UnicodeDecodeError:
        return None


def cost(text: str, name: bool = False) -> float:
    """The garbling cost; `name`: the value is a bare name, in which a question mark has no place."""
    total = sum(weight * len(mark.findall(text)) for weight, mark in _marks())
    if "?" in text:
        total += len((LOST_IN_NAME if name else LOST).findall(ADDRESS.sub(" ", text)))
    if "&#" in text:
        total += sum(2 for m in ENTITY.finditer(text) if _entity_bytes(m.group()) is not None)
    return total


def _best(text: str, now: float, name: bool) -> tuple[str, float, str]:
    """The candidate reading with the lowest cost."""
    found = text, now, ""
    if "&#" in text:
        read = ENTITY.sub(lambda m: _entity_bytes(m.group()) or m.group(), text)
        if (c := cost(read, name)) < found[1]:
            found = read, c, "entities>utf-8"
    for wrong, right in ROUND_TRIPS:
        try:
            read = _encode(text, wrong).decode(right)
        except UnicodeError:
            continue
        if right != "utf-8" and not set(read) - set(text) <= EXPECTED:
            continue  # any byte is some letter there; only expected ones count as a repair
        if read != text and (c := cost(read, name)) < found[1]:
            found = read, c, f"{wrong}>{right}"
    return found


def repair(text: str, name: bool = False) -> tuple[str, float, float, str]:
    """(repaired text, cost before, cost after, readings taken); the text itself where no reading helps."""
    before = now = cost(text, name)
    steps: list[str] = []
    while now:  # each layer taken off lowers the cost, so this ends
        read, c, step = _best(text, now, name)
        if not step:
            parts = re.split("([ \n\t]+)", text)
            worst = [(_best(p, k, name) if (k := cost(p, name)) else (p, 0, "")) for p in parts]
            step = "+".join(dict.fromkeys(w[2] for w in worst if w[2]))
            read = "".join(w[0] for w in worst)
            c = cost(read, name)
            if not step or c >= now:
                break
        text, now = read, c
        steps.append(step)
    return text, before, now, " ".join(steps)


#: A value without any of these characters costs nothing.
SUSPECT = "[^\\x00-\\x7FæøåÆØÅ–·éü]|\\?|&#"


def is_garbled(before: float, steps: str) -> bool:
    """A mark of damage, or a weak one that a reading explains."""
    return before >= 1 or bool(before and steps)


def repaired_values(df: DataFrame, key: str, fields: dict[str, Column], names: tuple[str, ...] = ()) -> DataFrame:
    """(field, rec_id, original, repaired, cost_before, cost_after, readings) of every garbled value.

    `fields`: output field name -> column expression of `df`; `names`: fields that hold bare names.
    """
    listed = F.array(*[F.struct(F.lit(f).alias("field"), c.alias("text")) for f, c in fields.items()])
    values = df.select(df[key].alias("rec_id"), F.inline(F.filter(listed, lambda v: v["text"].rlike(SUSPECT))))

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            rows = []
            for k, (field, text) in enumerate(zip(batch.column("field").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                of = text, field in names
                if (read := known.get(of)) is None:
                    if len(known) > 50_000:
                        known.clear()
                    read = known[of] = repair(*of)
                if is_garbled(read[1], read[3]):
                    rows.append((k, *read))
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("field").take(at),
                    batch.column("rec_id").take(at),
                    batch.column("text").take(at),
                    pa.array([r[1] for r in rows], pa.string()),
                    pa.array([r[2] for r in rows], pa.float64()),
                    pa.array([r[3] for r in rows], pa.float64()),
                    pa.array([r[4] for r in rows], pa.string()),
                ],
                names=["field", "rec_id", "original", "repaired", "cost_before", "cost_after", "readings"],
            )

    return values.mapInArrow(mend, "field string, rec_id bigint, original string, repaired string, cost_before double, cost_after double, readings string")
