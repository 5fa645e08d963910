"""Token ids of a corpus, and oversized texts cut into pieces, both over one encoder per Python worker.

Neither shuffles: documents go through `mapInArrow` once, in blocks of bounded text size, and a worker keeps what it
has learnt about words between blocks and tasks. The vocabulary (under a megabyte, checked) is broadcast.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stenbro.llm.bpe import UnitEncoder

BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters of text that a block holds, unless a single text has more.
BLOCK_CHARS = 4_000_000
#: Largest vocabulary file that is broadcast.
VOCABULARY_BYTES = 32 << 20

_ENCODERS: dict = {}


def vocabulary(spark, path: str):
    """The vocabulary file as a broadcast of (name, content)."""
    if os.path.getsize(path) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((os.path.basename(path), f.read()))


def encoder(kind: type, content) -> UnitEncoder:
    """The encoder of this Python worker, made once per vocabulary."""
    import base64

    name, data = content.value
    key = kind, name, len(data)
    if key not in _ENCODERS:
        _ENCODERS[key] = kind({base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)})
    return _ENCODERS[key]


def blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about BLOCK_CHARS of text each."""
    for batch in batches:
        sizes = np.diff(np.frombuffer(batch.column(column).buffers()[1], np.int32, batch.num_rows + 1, batch.column(column).offset * 4)) if pa.types.is_string(batch.column(column).type) else None
        if sizes is None:
            sizes = np.array([len(x or "") for x in batch.column(column).to_pylist()])
        block = np.cumsum(sizes, dtype=np.int64) // BLOCK_CHARS
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def token_ids(df: DataFrame, key: str, text: str, path: str = BYTE_BPE_50K) -> DataFrame:
    """(key, ids): the ids of every text, without special tokens.

    NULL and empty texts have an empty list; strings of special tokens in a text are ordinary text; repeated keys keep
    their rows. Only the two named columns are read.
    """
    content = vocabulary(df.sparkSession, path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(UnitEncoder, content)
        for block in blocks(batches, "text"):
            ids, offsets = own.encode(block.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
            yield pa.RecordBatch.from_arrays([block.column("key"), lists], names=["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return source.mapInArrow(encode, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


class PieceEncoder(UnitEncoder):
    """Also knows the atoms of units: parts that begin with white space, between which a text may be cut.

    No pre-token crosses the place before a run of white space, so token counts of atoms add up exactly.
    """

    ATOMS = re.compile(r"(?<=\S)(?=\s)")
    SPACE = re.compile(r"\s*")
    WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = 1, 2, 3, 4, 5

    def clear(self) -> None:
        super().clear()
        self.atom_at = np.zeros(1, np.int64)
        self.atoms = np.zeros((4, 0), np.int32)  # tokens, characters, strength before, strength behind

    def _learn(self) -> None:
        known = len(self.offsets) - 1
        super()._learn()
        fresh = list(self.units)[known:]
        if not fresh:
            return
        counts, rows = [], []
        lengths = np.diff(self.offsets[known:]).tolist()
        for u, n in zip(fresh, lengths, strict=True):
            text = self.unit_text(u)
            core = text[1:] if text[:1] == " " else text
            if core.isalnum() or not any(map(str.isspace, core)):
                counts.append(1)
                rows.append((n, len(text), 0, self._behind(text)))
                continue
            parts = self.ATOMS.split(text)
            counts.append(len(parts))
            for part in parts:
                rows.append((sum(len(self.words[w]) for w in self.find(part)), len(part), self._before(part), self._behind(part)))
        self.atom_at = np.concatenate([self.atom_at, self.atom_at[-1] + np.cumsum(np.array(counts, np.int64))])
        self.atoms = np.concatenate([self.atoms, np.array(rows, np.int32).reshape(-1, 4).T], axis=1)

    def _before(self, part: str) -> int:
        lines = self.SPACE.match(part).group().count("\n")
        return self.PARAGRAPH if lines > 1 else self.LINE if lines else 0

    def _behind(self, part: str) -> int:
        last = part.rstrip("\"')]»”’")[-1:]
        return self.SENTENCE if last and last in ".!?…" else self.CLAUSE if last and last in ",;:–" else self.WORD

    def atoms_of(self, numbers: np.ndarray) -> np.ndarray:
        counts = self.atom_at[numbers + 1] - self.atom_at[numbers]
        ends = np.cumsum(counts)
        at = np.repeat(self.atom_at[numbers] - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.atoms[:, at]

    def count(self, text: str) -> int:
        """Tokens of one text."""
        words = self.find(text)
        fresh = [w for w in dict.fromkeys(words) if w not in self.words]
        for word, ids in zip(fresh, self.index.encode([w.encode() for w in fresh]), strict=True):
            self.words[word] = ids
        return sum(len(self.words[w]) for w in words)

    def pieces(self, text: str, atoms: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
        """(start, end, tokens, tokens shared with the piece before) of the pieces of one text, in order."""
        room = limit - overlap
        hard = atoms[0].max(initial=0) > min(room, max(overlap, 1))
        if hard:
            atoms = self._harder(text, atoms, max(1, min(room, overlap or room) // 8))
        tokens, chars = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in atoms[:2])
        strength = np.concatenate([[0], np.where(atoms[2][1:] > 0, atoms[2][1:], atoms[3][:-1])])
        cores = self._bisect(tokens, strength, room)
        out = []
        for lo, hi in cores:
            first = int(np.searchsorted(tokens, tokens[lo] - overlap)) if lo else 0
            start, end = int(chars[first]), int(chars[hi])
            n, shared = int(tokens[hi] - tokens[first]), int(tokens[lo] - tokens[first])
            while hard and (n := self.count(text[start:end])) > limit and first < lo:
                first += 1
                start, shared = int(chars[first]), int(tokens[lo] - tokens[first])
            out.append((start, end, n, shared))
        return out

    @staticmethod
    def _bisect(tokens: np.ndarray, strength: np.ndarray, room: int) -> list[tuple[int, int]]:
        out, stack = [], [(0, len(tokens) - 1)]
        while stack:
            lo, hi = stack.pop()
            size = tokens[hi] - tokens[lo]
            if size <= room or hi - lo < 2:
                out.append((lo, hi))
                continue
            middle = (tokens[lo] + tokens[hi]) / 2
            a = max(lo + 1, int(np.searchsorted(tokens, middle - size / 4)))
            b = min(hi, int(np.searchsorted(tokens, middle + size / 4, "right")))
            if a >= b:
                a, b = lo + 1, hi
            near = strength[a:b]
            best = np.flatnonzero(near == near.max()) + a
            cut = int(best[np.argmin(np.abs(tokens[best] - middle))])
            stack += [(cut, hi), (lo, cut)]
        return out

    def _harder(self, text: str, atoms: np.ndarray, most: int) -> np.ndarray:
        """Atoms of more than `most` tokens cut at pre-tokens, and these between characters."""
        columns, at = [], 0
        for n, size, before, behind in atoms.T.tolist():
            if n <= most:
                columns.append((n, size, before, behind))
            else:
                parts: list[str] = []
                for word in self.find(text[at : at + size]):
                    step = len(word) if len(self.words.get(word) or self.index.encode([word.encode()])[0]) <= most else max(1, most // 4)
                    parts += [word[i : i + step] for i in range(0, len(word), step)]
                for i, part in enumerate(parts):
                    columns.append((self.count(part), len(part), 0 if i else before, behind if i == len(parts) - 1 else 0))
            at += size
        return np.array(columns, np.int32).T


PIECES = "array<struct<piece:int,start:int,end:int,tokens:int,shared:int,text:string>>"


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 2048, overlap: int = 128, path: str = BYTE_BPE_50K, with_text: bool = True) -> DataFrame:
    """(key, n_tokens, pieces) of every text of more than `limit` tokens.

    Pieces are at most `limit` tokens and cover the text without a gap; each but the first begins with up to `overlap`
    tokens of the piece before, as near to it as a word boundary allows. Cuts are found by bisection: at the strongest
    boundary (paragraph, line, sentence, clause, word) in the middle half, then again in both parts while they exceed
    `limit` less `overlap`. A stretch without white space is cut between pre-tokens, then between characters.

    A token takes a byte at least, so texts of at most `limit` bytes are passed over before Python; NULL and empty
    texts give no rows; `start` and `end` count characters from 0.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    content = vocabulary(df.sparkSession, path)
    fields = pa.struct([(n, pa.int32()) for n in ("piece", "start", "end", "tokens", "shared")] + [("text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: PieceEncoder = encoder(PieceEncoder, content)
        for block in blocks(batches, "text"):
            texts = block.column("text").to_pylist()
            numbers, counts = own.numbers(texts)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            sums = np.concatenate([[0], np.cumsum(own.lengths(numbers))])[bounds]
            totals = np.diff(sums)
            over = np.flatnonzero(totals > limit).tolist()
            rows = []
            for k in over:
                cuts = own.pieces(texts[k], own.atoms_of(numbers[bounds[k] : bounds[k + 1]]), limit, overlap)
                rows.append([{"piece": i, "start": a, "end": b, "tokens": n, "shared": s, "text": texts[k][a:b] if with_text else None} for i, (a, b, n, s) in enumerate(cuts)])
            yield pa.RecordBatch.from_arrays(
                [block.column("key").take(pa.array(over, pa.int64())), pa.array(totals[over], pa.int32()), pa.array(rows, pa.list_(fields))],
                names=["key", "n_tokens", "pieces"],
            )

    kind = df.schema[key].dataType.simpleString()
    source = df.where(F.octet_length(text) > limit).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return source.mapInArrow(cut, f"key {kind}, n_tokens int, pieces {PIECES}").withColumnRenamed("key", key)
