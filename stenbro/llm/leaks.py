"""Evaluation passages in a training corpus: CGK embedding, bit-sampling LSH over windows, exact edit verification.

The items are a stated query set; they go to every task in blocks of a bounded number of words, and all documents pass
every block. In a task, texts become numbers of the words that the items use (0: none of them). Then, block by block:

1. Each item has a window of its own size: half of the words that it is asked to be reproduced with (share x its
   length), rounded down to one of WINDOWS, so a reproduced stretch holds whole windows at many places. Items of one
   window size are worked off together, from single words up.
2. A stretch that reproduces an item holds, in some window of twice the asked length, at least as many words that items
   use; places outside all such windows are passed over, which loses nothing. So are windows with more than a third of
   foreign words, which the next steps would hardly ever meet.
3. Windows at every remaining place of the texts and every place of the items are embedded by the CGK random walk: step
   j writes the word under the pointer, and moves the pointer on if a random bit of (j, word) says so. Windows at a small
   edit distance then agree in most steps.
4. Of each embedding SAMPLE steps are hashed; windows that agree in them meet. This is repeated REPEATS times with fresh
   bits. A window without an edit is always met, one with an edit in four of five cases or so.
5. Meetings of one text and item are gathered by diagonal (two overlapping grids, so no stretch falls between). Cells
   whose met windows cover COVERED of the asked words are verified. `recall_by_edits` in the tests measures what this
   finds against the alignment of everything, by the rate of edited words.
6. Verification: a region must share a common subsequence of the asked length with the item (an upper bound of what an
   alignment can match, word-parallel), and then passes a local alignment of words (match +1, other word, added
   word or missing word -1) of the whole item against the region; the words matched in the best stretch must be at least the asked ones.

Words are compared in lower case without markup, entities, hyphens at line ends, apostrophes and Danish letters'
spellings (ae, oe, aa, or the bare letter).

Defined cases: NULL and empty texts or passages give no rows; items without a word give none; an item of up to three
words is asked for one word, so any text with one of its words has it; repeated items and documents each keep their own
rows.
"""

from __future__ import annotations

import html
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stenbro.llm.tokens import blocks

#: Window sizes. Above the last one a wider window costs more and finds no more.
WINDOWS = (1, 2, 3, 6, 12, 24)
SAMPLE, REPEATS = 8, 8
GRID = 64
#: Share of the asked words that the windows met must cover.
COVERED = 0.65
#: Words of the items that are sent to the tasks at once; more are worked off in several passes.
BLOCK_WORDS = 500_000
WORD = re.compile(r"\w+")
TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_MODELS: dict = {}


def words_of(text: str) -> list[str]:
    """The words of a text in their compared form."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub("", text)
    text = text.lower().replace("-\n", "").replace("­", "").replace("'", "").replace("’", "")
    text = text.replace("æ", "a").replace("ø", "o").replace("å", "a")
    return WORD.findall(text.replace("ae", "a").replace("oe", "o").replace("aa", "a"))


class _Known(dict):
    def __missing__(self, key):
        return 0


class Level:
    """LSH tables of the items of one window size."""

    def __init__(self, window: int, which: np.ndarray, words: list[np.ndarray], asked: np.ndarray, n_words: int, rng: np.random.Generator):
        self.window, self.which, self.least = window, which, int(asked[which].min())
        self.steps = 2 * window
        size = min(SAMPLE, self.steps)
        self.draws = rng.integers(1, 1 << 62, (REPEATS, n_words + 2), np.int64)  # 0: a word of no item; the last: behind the window
        self.turns = rng.integers(1, 1 << 62, (REPEATS, self.steps), np.int64) | 1
        self.sampled = [np.sort(rng.choice(self.steps, size, replace=False)).tolist() for _ in range(REPEATS)]
        lengths = np.array([len(words[i]) for i in which], np.int64)
        flat = np.concatenate([np.concatenate([words[i], np.zeros(window, np.int32)]) for i in which])
        item = np.repeat(which, lengths + window)
        place = np.concatenate([np.arange(n + window) for n in lengths])
        starts = np.flatnonzero(place <= np.repeat(lengths, lengths + window) - window)
        self.tables = []
        for r in range(REPEATS):
            keys = self.embed(flat, starts, r)
            order = np.argsort(keys, kind="stable")
            distinct, first = np.unique(keys[order], return_index=True)
            at = starts[order]
            self.tables.append((distinct, np.append(first, len(order)), item[at], place[at]))

    def embed(self, words: np.ndarray, starts: np.ndarray, repeat: int) -> np.ndarray:
        """The hash of the sampled steps of the CGK embedding of the windows at `starts`."""
        draws, turns, sampled = self.draws[repeat], self.turns[repeat], set(self.sampled[repeat])
        behind = len(draws) - 1
        at = np.zeros(len(starts), np.int64)
        keys = np.zeros(len(starts), np.int64)
        for j in range(self.sampled[repeat][-1] + 1):
            drawn = draws[np.where(at < self.window, words[np.minimum(starts + at, len(words) - 1)], behind)]
            if j in sampled:
                keys = (keys ^ drawn) * np.int64(-7046029254386353131)
                keys ^= keys >> np.int64(29)
            at += (drawn * turns[j] >> np.int64(40)) & 1
        return keys


class Items:
    """The items of one block."""

    def __init__(self, ids: list[int], passages: list[str | None], share: float, seed: int = 7):
        self.ids = np.array(ids, np.int64)
        lists = [words_of(p) if p else [] for p in passages]
        self.vocabulary = _Known()
        for own in lists:
            for w in own:
                if w not in self.vocabulary:
                    self.vocabulary[w] = len(self.vocabulary) + 1
        self.lengths = np.array([len(own) for own in lists], np.int64)
        self.asked = np.ceil(self.lengths * share).astype(np.int64)
        self.words = [np.array([self.vocabulary[w] for w in own], np.int32) for own in lists]
        self._masks: dict[int, dict[int, int]] = {}
        rng = np.random.default_rng(seed)
        sizes = np.array(WINDOWS)[np.searchsorted(WINDOWS, np.maximum(1, self.asked // 2), "right") - 1]
        self.levels = [
            Level(w, which, self.words, self.asked, len(self.vocabulary), rng) for w in WINDOWS if len(which := np.flatnonzero((sizes == w) & (self.asked > 0)))
        ]


    def masks(self, item: int) -> dict[int, int]:
        """The places of an item's words as bits."""
        if item not in self._masks:
            own = self._masks[item] = {}
            for k, w in enumerate(self.words[item].tolist()):
                own[w] = own.get(w, 0) | 1 << k
        return self._masks[item]


def _dense(words: np.ndarray, bounds: np.ndarray, least: int, window: int) -> np.ndarray:
    """Places where a window may begin that takes part in a reproduced stretch."""
    known = np.concatenate([[0], np.cumsum(words > 0)])
    n = len(words)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    here = np.arange(n)
    wide = known[np.minimum(here + 2 * least, ends)] - known[:-1] >= least
    mark = np.zeros(n + 1, np.int64)
    first = np.flatnonzero(wide)
    np.add.at(mark, first, 1)
    np.add.at(mark, np.minimum(first + 2 * least, ends[first]), -1)
    near = np.minimum(here + window, ends)
    return np.flatnonzero((np.cumsum(mark)[:n] > 0) & (known[near] - known[:-1] >= window - window // 3) & (near - here == window))


def _cells(items: Items, level: Level, words: np.ndarray, starts: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """(text, item, first, behind) of the regions to verify, in places of `words`."""
    found, longest, window = [], int(items.lengths.max()) + 1, level.window
    for r in range(REPEATS):
        keys, first, item, place = level.tables[r]
        own = level.embed(words, starts, r)
        k = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        hit = np.flatnonzero(keys[k] == own)
        k = k[hit]
        n = first[k + 1] - first[k]
        at = np.repeat(first[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) if len(k) else np.zeros(0, np.int64)
        where = np.repeat(starts[hit], n)
        found.append((where * len(items.ids) + item[at]) * longest + place[at])
    met, place = np.divmod(np.unique(np.concatenate(found)), longest)
    if not len(met):
        return np.zeros((0, 4), np.int64)
    where, item = np.divmod(met, len(items.ids))
    diagonal = where - place
    regions = []
    for shift in (0, GRID // 2):
        cell = np.stack([text_of[where], item, (diagonal + shift) // GRID])
        order = np.lexsort((place, cell[2], cell[1], cell[0]))
        c, p, d = cell[:, order], place[order], diagonal[order]
        begins = np.concatenate([[True], (np.diff(c, axis=1) != 0).any(axis=0)])
        group = np.flatnonzero(begins)
        step = np.append(np.diff(p), window)
        step[np.append(group[1:], len(p)) - 1] = window
        covered = np.add.reduceat(np.minimum(step, window), group)
        low, high = np.minimum.reduceat(d, group), np.maximum.reduceat(d, group)
        own = c[1, group]
        kept = covered >= COVERED * items.asked[own]
        regions.append(np.stack([c[0, group], own, low - GRID // 2, high + items.lengths[own] + GRID // 2], axis=1)[kept])
    return np.concatenate(regions)


def _united(regions: np.ndarray) -> np.ndarray:
    """Overlapping regions of a text and an item as one."""
    every = regions[np.lexsort((regions[:, 2], regions[:, 1], regions[:, 0]))]
    if not len(every):
        return every
    same = (np.diff(every[:, :2], axis=0) == 0).all(axis=1) & (every[1:, 2] <= every[:-1, 3])
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    return np.stack([every[first, 0], every[first, 1], every[first, 2], np.maximum.reduceat(every[:, 3], first)], axis=1)


def in_common(masks: dict[int, int], n: int, text: list[int]) -> int:
    """Length of the longest common subsequence of an item (its word -> places as bits) and a text, word-parallel."""
    full = state = (1 << n) - 1
    for w in text:
        if at := masks.get(w):
            u = state & at
            state = ((state + u) | (state - u)) & full
    return n - state.bit_count()


def matched(items: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Words matched in the best local alignment of each item with each text (pair by pair).

    Pairs lie along the inner axis, so every step is one vector operation over all of them.
    """
    n, m, pairs = max(map(len, items)), max(map(len, texts)), len(items)
    kind, unit = (np.int32, 1 << 12) if n < 1 << 12 and n + m < 1 << 18 else (np.int64, 1 << 24)
    a = np.full((n, pairs), -1, np.int32)
    b = np.full((m, pairs), -2, np.int32)
    for k, (x, y) in enumerate(zip(items, texts, strict=True)):
        a[: len(x), k] = x
        b[: len(y), k] = y
    b[b == 0] = -2
    unit = kind(unit)  # a cell is score * unit + words matched
    ramp = (np.arange(m, dtype=kind) * unit)[:, None]
    row = np.zeros((m + 1, pairs), kind)
    best = np.zeros((m, pairs), kind)
    cell, other = np.empty((m, pairs), kind), np.empty((m, pairs), kind)
    for i in range(n):
        np.multiply(b == a[i], 2 * unit + kind(1), out=cell)
        cell += row[:-1]
        cell -= unit
        np.subtract(row[1:], unit, out=other)
        np.maximum(cell, other, out=cell)
        np.maximum(cell, 0, out=cell)
        cell += ramp
        np.maximum.accumulate(cell, axis=0, out=row[1:])
        row[1:] -= ramp
        np.maximum(best, row[1:], out=best)
    return best.max(axis=0) & (unit - 1)


def found_in(items: Items, texts: list[str | None]) -> tuple[list[int], list[int], list[int]]:
    """Positions of texts, positions of items and words matched, of every reproduced item."""
    lists = [words_of(t) if t else [] for t in texts]
    counts = np.array([len(x) for x in lists], np.int64)
    flat: list[str] = []
    for x in lists:
        flat += x
    words = np.fromiter(map(items.vocabulary.__getitem__, flat), np.int32, len(flat))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    if not len(words) or not items.levels:
        return [], [], []
    text_of = np.repeat(np.arange(len(texts)), counts)
    regions = [np.zeros((0, 4), np.int64)]
    for level in items.levels:
        starts = _dense(words, bounds, level.least, level.window)
        if len(starts):
            regions.append(_united(_cells(items, level, words, starts, text_of)))
    regions = np.concatenate(regions)
    best: dict[tuple[int, int], int] = {}
    inside = [(t, i, words[max(lo, bounds[t]) : min(hi, bounds[t + 1])]) for t, i, lo, hi in regions.tolist()]
    # what has too few words in common in any order-keeping way can't be aligned with enough of them
    inside = [x for x in inside if in_common(items.masks(x[1]), len(items.words[x[1]]), x[2].tolist()) >= items.asked[x[1]]]
    inside.sort(key=lambda x: len(x[2]))
    at = 0
    while at < len(inside):
        some = inside[at : at + 256]
        some = some[: max(1, (1 << 20) // max(1, len(some[-1][2])))]
        at += len(some)
        for (t, i, _), n in zip(some, matched([items.words[i] for _, i, _ in some], [x for _, _, x in some]).tolist(), strict=True):
            if n >= items.asked[i]:
                best[t, i] = max(n, best.get((t, i), 0))
    pairs = sorted(best)
    return [t for t, _ in pairs], [i for _, i in pairs], [best[p] for p in pairs]


def leaked_items(documents: DataFrame, items: DataFrame, key: str, text: str, item_key: str, passage: str, share: float = 1 / 3) -> DataFrame:
    """(key, item_key, matched): documents in which one stretch reproduces at least `share` of an item's words."""
    spark = documents.sparkSession
    kind = documents.schema[key].dataType.simpleString()
    source = documents.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = None
    rows, block = items.select(item_key, passage).toLocalIterator(), []

    def one_pass(block: list) -> DataFrame:
        content = spark.sparkContext.broadcast(([r[0] for r in block], [r[1] for r in block], share))
        name = uuid.uuid4().hex

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if name not in _MODELS:
                _MODELS.clear()
                _MODELS[name] = Items(*content.value)
            model = _MODELS[name]
            for part in blocks(batches, "text"):
                t, i, n = found_in(model, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(t, pa.int64())), pa.array(model.ids[i] if i else [], pa.int64()), pa.array(n, pa.int32())],
                    names=["key", "item", "matched"],
                )

        return source.mapInArrow(find, f"key {kind}, item bigint, matched int")

    size = 0
    for row in rows:
        block.append(row)
        size += (row[1] or "").count(" ") + 1
        if size >= BLOCK_WORDS:
            out = one_pass(block) if out is None else out.unionByName(one_pass(block))
            block, size = [], 0
    if block or out is None:
        out = one_pass(block) if out is None else out.unionByName(one_pass(block))
    return out.select(F.col("key").alias(key), F.col("item").alias(item_key), "matched")
