"""Byte-level BPE over the distinct words of a partition, by a pair occurrence index.

`PairIndex` holds the distinct pre-tokens that a partition shows, as one chain of byte symbols, and maps every
adjacent pair to all its positions. The ranks that occur are active; they are applied in ascending order, each to all
the positions of its pair, and only the lists of the pairs beside a merged position change.

`UnitEncoder` stands before it. A text is cut before each space that follows a character other than white space; no
pre-token crosses such a cut, so every cut piece (a unit) has ids of its own, and a unit is encoded when it is first
seen in a Python worker. A batch of texts then is a list of unit numbers and two array gathers.
"""

from __future__ import annotations

import base64
import heapq
import re
from itertools import chain

import numpy as np

#: Fixed pattern of the public vocabulary's pre-tokenizer.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct units that a worker keeps; when there are more, it starts over with an empty store.
KEPT_UNITS = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary in the form 'base64 rank' per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PairIndex:
    """Ids of many distinct byte strings at once. A pair (a, b) is kept as the number a << 17 | b."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.merged: dict[int, int] = {}

    def merge_of(self, pair: int) -> int:
        """The id that a pair merges to, or -1."""
        found = self.merged[pair] = self.ranks.get(self.bytes_of[pair >> 17] + self.bytes_of[pair & 0x1FFFF], -1)
        return found

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word; an empty word gives no ids."""
        whole = self.ranks.get
        out: list[list[int]] = [[] for _ in words]
        open_words = []
        for k, word in enumerate(words):
            if (rank := whole(word)) is not None:
                out[k] = [rank]
            elif word:
                open_words.append(k)
        if not open_words:
            return out
        lengths = np.array([len(words[k]) for k in open_words], np.int64)
        starts = np.concatenate([[1], 1 + np.cumsum(lengths + 1)])  # a -1 stands before, between and after the words
        symbols = np.full(int(starts[-1]) + 1, -1, np.int64)
        at = np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(int(lengths.sum()))
        symbols[at] = self.byte_ids[np.frombuffer(b"".join(words[k] for k in open_words), np.uint8)]
        symbol, following = self._merge(symbols)
        for k, i in zip(open_words, starts[:-1].tolist(), strict=True):
            own = out[k]
            while (c := symbol[i]) >= 0:
                own.append(c)
                i = following[i]
        return out

    def _merge(self, symbols: np.ndarray) -> tuple[list[int], list[int]]:
        n = len(symbols)
        left, right = symbols[:-1], symbols[1:]
        places = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left[places] << 17) | right[places]
        order = np.argsort(keys, kind="stable")
        distinct, firsts = np.unique(keys[order], return_index=True)
        positions: dict[int, list[int]] = {}
        active: dict[int, list[int]] = {}
        known, merge_of = self.merged.get, self.merge_of
        for pair, own in zip(distinct.tolist(), np.split(places[order], firsts[1:]), strict=True):
            rank = known(pair)
            if rank is None:
                rank = merge_of(pair)
            if rank >= 0:
                positions[pair] = own.tolist()
                active.setdefault(rank, []).append(pair)
        symbol, following, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = list(active)
        heapq.heapify(heap)

        def add(pair: int, place: int) -> None:
            rank = known(pair)
            if rank is None:
                rank = merge_of(pair)
            if rank >= 0:
                own = positions.get(pair)
                if own is not None:
                    own.append(place)
                else:
                    positions[pair] = [place]
                    pairs = active.get(rank)
                    if pairs is None:
                        active[rank] = [pair]
                        heapq.heappush(heap, rank)
                    else:
                        pairs.append(pair)

        while heap:
            rank = heapq.heappop(heap)
            pairs = active.pop(rank)
            found = sorted((i, pair) for pair in pairs for i in positions.pop(pair)) if len(pairs) > 1 else [(i, pairs[0]) for i in sorted(positions.pop(pairs[0]))]
            high = rank << 17
            for i, pair in found:
                j = following[i]
                if symbol[i] != pair >> 17 or symbol[j] != pair & 0x1FFFF:
                    continue  # an earlier merge took one of the two
                symbol[i] = rank
                symbol[j] = -2
                k = following[i] = following[j]
                before[k] = i
                if (c := symbol[k]) >= 0:
                    add(high | c, i)
                h = before[i]
                if (c := symbol[h]) >= 0:
                    add(c << 17 | rank, h)
        return symbol, following


class _Numbers(dict):
    """Numbers keys in the order they are first looked up."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class UnitEncoder:
    """Encodes batches of texts; keeps what it learnt about units for the next batch."""

    CUT = re.compile(r"(?<=\S) ")

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.index = PairIndex(ranks)
        self.find = regex.compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        self.units = _Numbers()
        self.words: dict[str, list[int]] = {}
        self.flat = np.zeros(0, np.int32)
        self.offsets = np.zeros(1, np.int64)
        self.unsafe = np.zeros(0, bool)

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Unit numbers of all texts, one after the other, and the count of units of each text. NULL and '' have none.

        All texts are first cut at every space. A cut behind white space isn't safe; a text that shows a piece which
        is empty or ends in white space is cut again, at the safe places only.
        """
        if len(self.units) > KEPT_UNITS:
            self.clear()
        own = [text.split(" ") if text else [] for text in texts]
        numbers, counts = self._number(own)
        unsafe = self.unsafe[numbers]
        if not unsafe.any():
            return numbers, counts
        of_text = np.repeat(np.arange(len(texts)), counts)
        again = np.zeros(len(texts), bool)
        again[of_text[unsafe]] = True
        fresh, fresh_counts = self._number([self.CUT.split(texts[k]) for k in np.flatnonzero(again).tolist()])
        counts = counts.copy()
        kept = numbers[~again[of_text]]
        counts[again] = fresh_counts
        whole = np.empty(int(counts.sum()), np.int64)
        new = again[np.repeat(np.arange(len(texts)), counts)]
        whole[new], whole[~new] = fresh, kept
        return whole, counts

    def _number(self, own: list[list]) -> tuple[np.ndarray, np.ndarray]:
        parts: list = []
        for pieces in own:
            if pieces:
                pieces[0] = (pieces[0],)  # no space stands before the first unit
                parts += pieces
        numbers = np.fromiter(map(self.units.__getitem__, parts), np.int64, len(parts))
        self._learn()
        return numbers, np.fromiter(map(len, own), np.int64, len(own))

    def _learn(self) -> None:
        known = len(self.offsets) - 1
        if len(self.units) == known:
            return
        fresh = list(self.units)[known:]
        words, find, text_of = self.words, self.find, self.unit_text
        pieces = []
        for u in fresh:  # the pattern leaves a word whole, and a mark behind a word alone
            if u.__class__ is str and u.isalpha():
                pieces.append((" " + u,))
            elif u.__class__ is str and u[-1:] in ".,;:" and u[:-1].isalpha():
                pieces.append((" " + u[:-1], u[-1]))
            else:
                pieces.append(find(text_of(u)))
        wanted = list({w for own in pieces for w in own if w not in words})
        for word, ids in zip(wanted, self.index.encode([w.encode("utf-8", "surrogatepass") for w in wanted]), strict=True):
            words[word] = ids
        ids = [words[own[0]] if len(own) == 1 else [i for w in own for i in words[w]] for own in pieces]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))])
        last = [(u if u.__class__ is str else u[0])[-1:] for u in fresh]
        self.unsafe = np.concatenate([self.unsafe, np.array([not c or c.isspace() for c in last], bool)])

    @staticmethod
    def unit_text(unit: str | tuple[str]) -> str:
        """A unit as it stands in its text; the first unit of a text is a tuple, all others follow a space."""
        return unit[0] if isinstance(unit, tuple) else " " + unit

    def lengths(self, numbers: np.ndarray) -> np.ndarray:
        """Token counts of units."""
        return self.offsets[numbers + 1] - self.offsets[numbers]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other (int32), and the offsets of each text in them (int32)."""
        numbers, counts = self.numbers(texts)
        lengths = self.lengths(numbers)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.offsets[numbers] - (ends - lengths), lengths) + np.arange(total)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return self.flat[at], bounds.astype(np.int32)
