"""Byte-level BPE by merge ranks: whole texts to ids and ids to bytes.

A text is cut into the matches of the tokenizer's pattern; each is merged on its own, and matches
that a worker has met before are looked up. The merges keep a segment tree over byte positions whose
leaves hold (rank, position) of the pair that starts there; the root is the leftmost minimum. A merge
changes three leaves at most (the merged pair, its dead right neighbour, the live pair to the left),
each in logarithmic time, so a match of n bytes takes n log n steps however long it is. Matches of
up to 65 bytes are merged many at once, a row of a numpy array each; longer ones one by one.

Ids are columns of bytes: little-endian unsigned 32-bit integers. A null text gives no ids.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagekin.llm.common import blocks, fresh, slices, worker_cache

#: Matches that a worker remembers; emptied when there are more.
REMEMBERED = 250_000
NEVER = 1 << 62
LONGEST = 64
#: Letters, numbers and white space among the characters below U+0100, in the notation of re.
LATIN = {r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ÿ", r"\p{N}": "0-9²³¹¼½¾", r"\s": "\\t-\\r \\x85\\xa0"}


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


def latin_pattern(pattern: str):
    """The pattern for texts of characters below U+0100 in the faster re, or None if it uses more."""
    for name, members in LATIN.items():
        pattern = re.sub(r"\[([^\]]*)\]", lambda m, n=name, x=members: "[" + m[1].replace(n, x) + "]", pattern)
        pattern = pattern.replace(name, f"[{members}]")
    pattern = pattern.replace(r"\S", f"[^{LATIN[chr(92) + 's']}]")
    return None if re.search(r"\\[pPwWdDbBX]|\(\?[^!:=]", pattern) else re.compile(pattern)


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match: the leftmost pair of lowest rank is merged until none has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = n - 1
    tree = [NEVER] * (2 * size)
    after, before = list(range(1, n + 1)), list(range(-1, n))

    def pair(i: int) -> int:
        middle = after[i]
        rank = ranks.get(piece[i:after[middle]]) if middle < n else None
        return NEVER if rank is None else rank << 32 | i

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            value = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == value:
                return
            tree[k] = value
            k >>= 1

    tree[size:] = [pair(i) for i in range(size)]
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    while (least := tree[1]) < NEVER:
        i = least & 0xFFFFFFFF
        dead = after[i]
        after[i] = after[dead]
        before[after[i]] = i
        if dead < size:
            put(dead, NEVER)
        put(i, pair(i))
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:after[i]]])
        i = after[i]
    return ids


class Merger:
    """Merges many short matches at once: a segment tree in each row of an array."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = [(left << 32 | right, rank) for token, rank in ranks.items() for k in range(1, len(token))
                 if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None]
        pairs.sort()
        self.keys = np.array([key for key, _ in pairs] or [-1], np.int64)
        self.joined = np.array([rank for _, rank in pairs] or [0], np.int64)

    def _pair(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf values for ids side by side; ids below 0 stand for no neighbour."""
        key = left << 32 | right
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        fits = (self.keys[k] == key) & (left >= 0) & (right >= 0)
        return np.where(fits, self.joined[k] << 8 | at, NEVER)

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        found: list[bytes] = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces])
        floor = 0
        for size in (4, 8, 16, 32, LONGEST):
            chosen = np.flatnonzero((sizes > floor) & (sizes <= size + 1))
            floor = size + 1
            for part in np.array_split(chosen, -(-len(chosen) // 20_000)) if len(chosen) else ():
                for k, one in zip(part.tolist(), self._rows([pieces[k] for k in part], size), strict=True):
                    found[k] = one
        for k in np.flatnonzero(sizes > LONGEST + 1).tolist():
            found[k] = np.array(merged(pieces[k], self.ranks), "<u4").tobytes()
        return found

    def _rows(self, pieces: list[bytes], size: int) -> list[bytes]:
        m, width = len(pieces), size + 2
        lengths = np.array([len(p) for p in pieces])
        codes = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
        token = np.where(np.arange(width) < lengths[:, None], self.single[codes], -1)
        after = np.tile(np.arange(1, width + 1, dtype=np.int16), (m, 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int16), (m, 1))
        alive = np.arange(width) < lengths[:, None]
        tree = np.full((m, 2 * size), NEVER, np.int64)
        tree[:, size:] = self._pair(token[:, :size], token[:, 1:size + 1], np.arange(size))
        for k in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        row = np.flatnonzero(tree[:, 1] < NEVER)
        while len(row):
            least = tree[row, 1]
            i = least & 255
            dead = after[row, i].astype(np.int64)
            follows = after[row, dead].astype(np.int64)
            token[row, i], token[row, dead], alive[row, dead] = least >> 8, -1, False
            after[row, i], before[row, np.minimum(follows, width - 1)] = follows, i
            left = before[row, i].astype(np.int64)
            here = token[row, i]
            right = np.where(follows < width, token[row, np.minimum(follows, width - 1)], -1)
            leaves = [(dead, np.full(len(row), NEVER)), (i, self._pair(here, right, i)),
                      (left, self._pair(np.where(left >= 0, token[row, left], -1), here, left))]
            paths = []
            for at, value in leaves:
                real = (at >= 0) & (at < size)
                rows, node = row[real], at[real] + size
                tree[rows, node] = value[real]
                paths.append((rows, node))
            step = size
            while step > 1:
                step >>= 1
                paths = [(rows, node >> 1) for rows, node in paths]
                for rows, node in paths:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            row = row[tree[row, 1] < NEVER]
        ids = token[alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(1)) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Codec:
    """Encoder of one rank file and pattern."""

    def __init__(self, raw: bytes, pattern: str):
        ranks = read_ranks(raw)
        self.merger = Merger(ranks)
        self.whole = {token: np.array([rank], "<u4").tobytes() for token, rank in ranks.items()}
        self.known: dict[str, bytes] = {}
        self.find = regex.compile(pattern).findall
        latin = latin_pattern(pattern)
        self.find_latin = latin.findall if latin else self.find

    def matches(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.find(text)
        return self.find_latin(text)

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text; the texts are taken together in groups of about half a million characters."""
        for group in blocks(texts, lambda t: len(t or "") + 1, 500_000):
            cut = [self.matches(t) if t else [] for t in group]
            if len(self.known) > REMEMBERED:
                self.known.clear()
            new: set[str] = set()
            for pieces in cut:
                new.update(filterfalse(self.known.__contains__, pieces))
            raw = {piece: piece.encode("utf-8") for piece in new}
            self.known.update((piece, self.whole[b]) for piece, b in raw.items() if b in self.whole)
            rest = [piece for piece, b in raw.items() if b not in self.whole]
            self.known.update(zip(rest, self.merger.ids([raw[p] for p in rest]), strict=True))
            for pieces in cut:
                yield b"".join(map(self.known.__getitem__, pieces))


class Decoder:
    """The tokens of a rank file by id."""

    def __init__(self, raw: bytes):
        ranks = read_ranks(raw)
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def _kept(kind, raw: bytes, *more: str):
    """The worker's encoder or decoder for this rank file, made once a process."""
    kept = worker_cache(kind.__name__)
    key = hashlib.sha256(raw + "".join(more).encode()).digest()
    if key not in kept:
        kept.clear()
        kept[key] = kind(raw, *more)
    return kept[key]


def _sent(df: DataFrame, path: str):
    """The rank file, read where the driver runs; it holds a vocabulary, not data."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encoded(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text in a binary column."""
    raw = _sent(df, path)

    @F.arrow_udf("binary")
    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _kept(Codec, raw.value, pattern)
        for texts in parts:
            for few in slices(texts):  # an answer may have fewer rows than a batch; whole batches of ids are large
                yield pa.array(coder.encode(few.to_pylist()), pa.binary(), size=len(few))

    return df.withColumn(ids, encode(text))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids",
               out: str = "decoded") -> DataFrame:
    """``df`` with the ids of each whole text and the bytes decoded from these ids, by one Python worker a task."""
    raw = _sent(df, path)
    kind = pa.struct([("ids", pa.binary()), ("decoded", pa.binary())])

    @F.arrow_udf("struct<ids:binary,decoded:binary>")
    def both(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder, back = _kept(Codec, raw.value, pattern), _kept(Decoder, raw.value)
        for texts in parts:
            for few in slices(texts, 200):
                coded = list(coder.encode(few.to_pylist()))
                yield pa.StructArray.from_arrays(
                    [pa.array(coded, pa.binary()), pa.array(map(back.decode, coded), pa.binary(), size=len(coded))],
                    fields=list(kind))

    own = fresh(df, "_coded")
    found = df.withColumn(own, both(text))
    return found.withColumns({ids: F.col(f"{own}.ids"), out: F.col(f"{own}.decoded")}).drop(own)


def decoded(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids stand for."""
    raw = _sent(df, path)

    @F.arrow_udf("binary")
    def decode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _kept(Decoder, raw.value)
        for rows in parts:
            for few in slices(rows):
                yield pa.array((coder.decode(r.as_py()) for r in few), pa.binary(), size=len(few))

    return df.withColumn(out, decode(ids))
