"""Free-entered values mapped to a reference list through a BK-tree.

The tree holds the compact forms of the reference entries under the Levenshtein metric. A search visits only the
children whose edge lies within the radius of the distance to their parent (triangle inequality), so it returns every
entry within the radius. The threshold itself is in Damerau-Levenshtein edits, where changed places count once: such
an edit is at most two Levenshtein edits, so a search with twice the radius misses none, and hits are checked exactly.

Distinct values are searched, once each, and joined back to their rows. The reference list goes to the tasks in shards
(SHARD entries or SHARD_CHARS characters, whichever comes first), so what is broadcast is bounded. A shard gives a
value's winners: the best exact and near entry, and up to two owners of an abbreviation. They are merged by the same
rule that decides within a shard, so the result doesn't depend on the number of shards.

A value is reduced to candidate forms before it is searched: all its parts between separators, without words that only
decorate (ranks, labels, districts), joined without spaces; a role and its field change places ("head of sales").
Letters are compared without marks and Danish spellings (ae, oe, aa). An abbreviated part ("Salg.r") is looked up in
the class of the entries that begin with its first letters, a range of the sorted list, and its end compared with
theirs; it counts as one edit, and only if it fits a single entry.

Ranking: an exact form before a near one; then the least distance, the earlier part, the least identifier.

Defined cases: NULL and blank values give no rows; values equal to an entry give none; values that stand for no entry
come out as 'none'; equal values each keep their row; very long values are searched whole.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD, SHARD_CHARS = 50_000, 4_000_000
#: A worker keeps the results of so many forms.
KEPT = 200_000
NONE = "none"
_TREES: dict = {}


def folded(text: str) -> str:
    """Lower case without marks; Danish letters and their two-letter spellings alike."""
    text = text.lower().replace("æ", "ae").replace("ø", "oe").replace("å", "aa")
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return text.replace("ae", "a").replace("oe", "o").replace("aa", "a")


def compact(text: str) -> str:
    return re.sub(r"[\W_]+", "", folded(text))


def spelt(text: str) -> str:
    """As `compact`, with two letters for a Danish one: a slip may make or break such a pair."""
    text = text.lower().replace("æ", "ae").replace("ø", "oe").replace("å", "aa")
    return re.sub(r"[\W_]+", "", "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)))


def measure(a: str) -> Callable[[str], int]:
    """The Levenshtein distance from `a`, bit-parallel, with what depends on `a` alone worked out once."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    n = len(a)
    every, top = (1 << n) - 1, 1 << n >> 1
    mask = masks.get

    def distance(b: str) -> int:
        if not n:
            return len(b)
        plus, minus, score = every, 0, n
        for c in b:
            eq = mask(c, 0)
            x = eq | minus
            d = ((((eq & plus) + plus) ^ plus) | eq) & every
            hp, hm = minus | (every & ~(d | plus)), plus & d
            if hp & top:
                score += 1
            elif hm & top:
                score -= 1
            hp = (hp << 1 | 1) & every
            hm = hm << 1 & every
            plus, minus = hm | (every & ~(x | hp)), hp & x
        return score

    return distance


def levenshtein(a: str, b: str) -> int:
    """Edit distance."""
    return measure(a)(b)


def damerau(a: str, b: str) -> int:
    """Edit distance in which neighbours that changed places count once (the unrestricted one, a metric)."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, match = [far, i], 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            if x == y:
                match = j
            row.append(min(rows[i][j] + (x != y), rows[i][j + 1] + 1, row[j] + 1, rows[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        last[x] = i
        rows.append(row)
    return rows[-1][-1]


class BkTree:
    """Forms under the Levenshtein metric."""

    def __init__(self, forms):
        self.root: tuple[str, dict] | None = None
        for form in forms:
            self.add(form)

    def add(self, form: str) -> None:
        if self.root is None:
            self.root = (form, {})
            return
        node, distance = self.root, measure(form)
        while d := distance(node[0]):
            nearer = node[1].get(d)
            if nearer is None:
                node[1][d] = (form, {})
                return
            node = nearer

    def within(self, form: str, radius: int) -> list[tuple[int, str]]:
        """Every form at a distance of at most `radius`."""
        out, stack, distance = [], [self.root] if self.root else [], measure(form)
        while stack:
            own, nearer = stack.pop()
            if nearer and abs(len(own) - len(form)) - radius > max(nearer):
                continue  # no child lies that far from its parent
            d = distance(own)
            if d <= radius:
                out.append((d, own))
            for e, node in nearer.items():
                if d - radius <= e <= d + radius:
                    stack.append(node)
        return out

    def within_all(self, forms: list[str], radii: list[int]) -> list[list[tuple[int, str]]]:
        """`within` of many forms at once: they go down the tree together, each dropping out by its own inequality.

        The distances of a node to all forms that reach it are one pass of word-parallel steps. Forms of more than 64
        letters, which fill no machine word, go singly.
        """
        out: list[list[tuple[int, str]]] = [[] for _ in forms]
        small = [k for k, f in enumerate(forms) if 0 < len(f) <= 64]
        for k in set(range(len(forms))) - set(small):
            out[k] = self.within(forms[k], radii[k])
        if not small or not self.root:
            return out
        masks: dict[str, dict[int, int]] = {}
        for at, k in enumerate(small):
            for i, c in enumerate(forms[k]):
                of = masks.setdefault(c, {})
                of[at] = of.get(at, 0) | 1 << i
        tables: dict[str, np.ndarray] = {}
        for c, of in masks.items():
            tables[c] = np.zeros(len(small), np.uint64)
            tables[c][list(of)] = np.fromiter(of.values(), np.uint64, len(of))
        size = np.array([len(forms[k]) for k in small], np.int64)
        every = np.array([(1 << len(forms[k])) - 1 for k in small], np.uint64)
        last, radius, one = (size - 1).astype(np.uint64), np.array([radii[k] for k in small], np.int64), np.uint64(1)
        stack = [(self.root, np.arange(len(small)))]
        while stack:
            (own, nearer), at = stack.pop()
            full, high = every[at], last[at]
            plus, minus, score = full.copy(), np.zeros(len(at), np.uint64), size[at]
            nothing = np.zeros(len(at), np.uint64)
            for c in own:
                eq = tables[c][at] if c in tables else nothing
                x = eq | minus
                d = ((((eq & plus) + plus) ^ plus) | eq) & full
                hp, hm = minus | (full & ~(d | plus)), plus & d
                score = score + ((hp >> high) & one).astype(np.int64) - ((hm >> high) & one).astype(np.int64)
                hp, hm = ((hp << one) | one) & full, (hm << one) & full
                plus, minus = hm | (full & ~(x | hp)), hp & x
            r = radius[at]
            for k in np.flatnonzero(score <= r).tolist():
                out[small[at[k]]].append((int(score[k]), own))
            for e, node in nearer.items():
                if len(reach := at[np.abs(score - e) <= r]):
                    stack.append((node, reach))
        return out


#: A winner: (spelling, 0 exact or 1 near or 2 abbreviated, rank, rank, owner); the least one decides.
Winner = tuple[int, int, int, int, str]


def decided(winners: list[Winner]) -> tuple[str, int]:
    """(identifier, distance) out of the winners of all shards; an abbreviation of two entries stands for none."""
    alone: dict[tuple[int, int], set[str]] = {}
    for spelling, how, _, place, owner in winners:
        if how == 2:
            alone.setdefault((spelling, place), set()).add(owner)
    single = [(spelling, 1, 1, place, next(iter(owners))) for (spelling, place), owners in alone.items() if len(owners) == 1]
    best = min([w for w in winners if w[1] < 2] + single, default=None)
    if best is None:
        return NONE, -1
    return best[4], best[2] if best[1] else 0


class Reference:
    """Entries (identifier, forms) with the search for free-entered values."""

    def __init__(self, entries: list[tuple[str, list[str]]], kind: str):
        self.kind = kind
        self.owners: dict[str, str] = {}
        for owner, forms in sorted(entries):
            for form in forms:
                for key in (compact(form), spelt(form)) if form else ():
                    if key:
                        self.owners.setdefault(key, owner)
        self.tree = BkTree(self.owners)
        self.ordered = sorted(self.owners)
        self.known: dict[str, tuple[int, str] | None] = {}

    def winners(self, values: list[str]) -> list[list[Winner]]:
        """What the entries of this shard offer for each value."""
        out: list[list[Winner]] = [[] for _ in values]
        left = range(len(values))
        for spelling, key in enumerate((compact, spelt)):
            read = {k: list(dict.fromkeys(f for f in (title_forms if self.kind == "title" else town_forms)(values[k], key) if f)) for k in left}
            done = set()
            for k, forms in read.items():
                exact = next(((spelling, 0, place, 0, owner) for place, form in enumerate(forms) if (owner := self.owners.get(form))), None)
                if exact:
                    out[k].append(exact)
                    done.add(k)
            near = self._near(f for k, forms in read.items() if k not in done for f in forms if "." not in f)
            for k, forms in read.items():
                if k in done:
                    continue
                for place, form in enumerate(forms):
                    if "." in form:
                        out[k] += [(spelling, 2, 1, place, owner) for owner in self._abbreviated(form)]
                found = [(spelling, 1, near[form][0], place, near[form][1]) for place, form in enumerate(forms) if near.get(form)]
                if found:
                    out[k].append(min(found))
                    done.add(k)
            left = [k for k in left if k not in done]
        return out

    def find(self, value: str) -> tuple[str, int]:
        """(identifier, distance) of the entry that a value stands for; ('none', -1) if for none."""
        return decided(self.winners([value])[0])

    def _near(self, forms: Iterator[str]) -> dict[str, tuple[int, str] | None]:
        """(distance, owner) of the nearest entry within the threshold of each form, the least owner of several."""
        found: dict[str, tuple[int, str] | None] = {form: self.known.get(form) for form in forms}
        new = [form for form in found if form not in self.known]
        limits = [2 if len(form) > 6 else 1 if len(form) > 3 else 0 for form in new]
        for form, limit, hits in zip(new, limits, self.tree.within_all(new, [2 * x for x in limits]), strict=True):
            best: tuple[int, str] | None = None
            for d, own in hits:
                if d > 1:
                    d = damerau(form, own)
                if d <= limit and 4 * d <= max(len(form), len(own)):
                    rank = d, self.owners[own]
                    if best is None or rank < best:
                        best = rank
            found[form] = self.known[form] = best
        for form in list(self.known)[: max(0, len(self.known) - KEPT)]:
            del self.known[form]
        return found

    def _abbreviated(self, form: str) -> list[str]:
        """The two least owners of entries that begin and end with the parts around a point."""
        head, _, tail = form.partition(".")
        if len(head) < 3:
            return []
        owners: set[str] = set()
        for k in range(bisect_left(self.ordered, head), len(self.ordered)):
            own = self.ordered[k]
            if not own.startswith(head):
                break
            if len(own) > len(head) + len(tail) and own.endswith(tail):
                owners.add(self.owners[own])
        return sorted(owners)[:2]


#: Words that decorate a title or a town; fixed values.
DECORATION = (
    "senior junior konst konstitueret konstituteret ansvarlig vores titel stilling ledende fung fungerende sr jr lead chief head teamleder medejer partner "
    "indehaver barsel dk freelance selvstændig nuværende current interim deltid fuldtid vikar nyansat erfaren"
).split()
DISTRICTS = set("c n o s v k sv nv so no so nordvest sydvest centrum".split())
_CUT = re.compile(r"\s+(?:hos|at|@|ved|in|i)\s+|\s*[|·•@/&()\[\]:;]\s*|\s+[-–—]\s+|,\s*|\s+(?:og|and)\s+")
_FOR = re.compile(r"^(\w+)\s+(?:for|of|inden for|af)\s+(\w[\w -]*)$")


def _bare(part: str) -> str:
    words = part.split()
    while len(words) > 1 and words[0].strip(".:-").lower() in DECORATION and words[0].strip(".:-").lower() not in ("lead", "head", "chief"):
        words = words[1:]
    return " ".join(words).strip(" .!*-–")


def title_forms(value: str, spell=compact) -> list[str]:
    """Forms of a free-entered title or headline, those of earlier parts first; forms with a point are abbreviations."""
    text = " ".join(value.split()).strip(" •*-–")
    parts = [p for p in (x.strip() for x in _CUT.split(text)) if p]
    parts = [p for p in parts if p.strip(".:- ").lower() not in DECORATION] or parts
    out: list[str] = []

    def add(form: str) -> None:
        key = spell(_bare(form))
        out.append(key)
        for tail in ("en", "n", "et"):
            if key.endswith(tail) and len(key) > 8:
                out.append(key[: -len(tail)])
        point = re.search(r"(\w{3,})\.(\w*)", form)
        if point and (point.group(2) or form.rstrip().endswith(".")):
            head = _bare(form[: point.end(1)])
            out.append(spell(head) + "." + spell(point.group(2)))

    for part in parts:
        add(part)
        if named := _FOR.match(_bare(part)):
            add(named.group(2) + named.group(1))
            add(named.group(2) + "s" + named.group(1))
    for a, b in zip(parts, parts[1:], strict=False):
        one, two = _bare(a), _bare(b)
        if " " not in one and " " not in two:
            add(two + one)
            add(two + "s" + one)
            add(one + two)
    return out


def town_forms(value: str, spell=compact) -> list[str]:
    """Forms of a free-entered town."""
    text = " ".join(value.split())
    text = re.sub(r"(?i)^greater\s+|\s+area$|\((?:dk|danmark|denmark)\)|^dk[- ]?(?=\d)|\b\d{3,4}\b", " ", text)
    part = re.split(r"\s*[,/|(]\s*|\s+[-–]\s+|\s+i\s+", text.strip())[0]
    part = re.sub(r"(?i)\s+(?:kommune|by|og omegn|omegn|city|storby|municipality)$", "", part.strip())
    words = part.split()
    if len(words) > 1 and folded(words[-1]) in DISTRICTS:
        words = words[:-1]
    if words:
        short = folded(words[0]).strip(".")
        if words[0][-1:] == "." and len(words) > 1:
            words[0] = {"s": "sønder", "n": "nørre"}.get(short, words[0])
        words[0] = {"nr": "nørre", "ndr": "nørre", "sdr": "sønder", "sd": "sønder", "st": "store", "ll": "lille", "gl": "gammel"}.get(short, words[0])
    out = [spell(" ".join(words)), spell(text)]
    if words and len(words[-1]) > 3 and words[-1][-1] == ".":
        out.append(out[0] + ".")
    return out


def mapped_values(values: DataFrame, reference: DataFrame, key: str, forms: list[str], kind: str) -> DataFrame:
    """(src, rec_id, value, ref_id, distance) of the non-blank `values` (src, rec_id, value) that equal no entry.

    `reference`: the list, with its identifier `key` and the columns that hold its forms.
    """
    spark = values.sparkSession
    exact = reference.select(F.explode(F.array(*forms)).alias("value")).where("value is not null").distinct()
    free = values.select("src", "rec_id", "value").where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "").join(exact, "value", "left_anti")
    distinct = free.select("value").distinct()
    passes, shard, chars = [], [], 0

    def one_pass(entries: list) -> DataFrame:
        content, name = spark.sparkContext.broadcast(entries), uuid.uuid4().hex

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if name not in _TREES:
                _TREES.clear() if len(_TREES) > 8 else None
                _TREES[name] = Reference(content.value, kind)
            own = _TREES[name]
            for batch in batches:
                found = own.winners(batch.column("value").to_pylist())
                listed = [[dict(zip(_FIELDS, w, strict=True)) for w in ws] for ws in found]
                yield pa.RecordBatch.from_arrays([batch.column("value"), pa.array(listed, _WINNERS)], names=["value", "winners"])

        return distinct.mapInArrow(find, "value string, winners array<struct<spelling:int,how:int,a:int,b:int,owner:string>>")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decided([tuple(w[f] for f in _FIELDS) for w in ws]) for ws in batch.column("winners").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("value"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int32())], names=["value", "ref_id", "distance"])

    for row in reference.select(key, *forms).toLocalIterator():
        shard.append((str(row[0]), [x for x in row[1:] if x]))
        chars += sum(map(len, shard[-1][1]))
        if len(shard) >= SHARD or chars >= SHARD_CHARS:
            passes.append(one_pass(shard))
            shard, chars = [], 0
    if shard or not passes:
        passes.append(one_pass(shard))
    every = passes[0]
    if len(passes) > 1:
        for more in passes[1:]:
            every = every.unionByName(more)
        every = every.groupBy("value").agg(F.flatten(F.collect_list("winners")).alias("winners"))
    best = every.mapInArrow(decide, "value string, ref_id string, distance int")
    return free.join(best, "value").select("src", "rec_id", "value", "ref_id", "distance")


_FIELDS = ("spelling", "how", "a", "b", "owner")
_WINNERS = pa.list_(pa.struct([(f, pa.int32()) for f in _FIELDS[:4]] + [("owner", pa.string())]))
