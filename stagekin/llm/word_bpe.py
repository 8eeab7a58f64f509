"""BPE with word ends by batched merge rounds, from texts to ids and back, as a tokenizer file describes it.

New words of a group of texts are laid into one flat array of symbols. Each round finds the rank of
every adjacent pair by binary search over the sorted pair keys, takes the lowest a word and merges it;
words without a ranked pair leave the array. All occurrences of a word's lowest pair are merged in the
same round, from left to right, where no pair of the merged symbol ranks lower (known from the file);
else only the leftmost, which is what one merge after the other gives in both cases. A round costs the
length of the words still there, a long word takes as many rounds as it has different pairs to merge,
so memory is linear in a word and there is no longest one. Finished words are remembered up to a bound,
which never changes a result.

The file's normalizer and splitting pattern cut a text into words. Runs of characters below U+0100
are cut here; any other run of a text between white space goes through the library's own normalizer
and splitter, not its merges. Strings of added tokens are those tokens.

Null and empty texts give no ids, and no ids decode to the empty text. Decoding joins the tokens by one
space, as a file without a decoder asks for. Repeated rows give equal ids; other columns pass unchanged,
an input column named like the output is replaced.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagekin.llm.byte_bpe import latin_pattern
from stagekin.llm.common import blocks, slices, worker_cache

#: Words and runs that a worker remembers; forgotten when there are more, or more characters than that times 16.
REMEMBERED = 200_000
NEVER = np.iinfo(np.int64).max
#: Bytes of new words merged together.
TOGETHER = 1_000_000
ASCII_SPACE = re.compile(r"[ \t-\r]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the files: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(shown))
    return [chr(c) for _, c in sorted([(b, b) for b in shown] + [(b, 256 + k) for k, b in enumerate(rest)])]


class Rounds:
    """Merges of many words at once."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        letters = byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self.final = np.array([vocab.get(c + suffix, -1) for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)
        rank = np.arange(len(pairs))
        lowest = np.full(max(vocab.values(), default=0) + 1, NEVER)  # rank of a symbol's best pair
        np.minimum.at(lowest, left, rank)
        np.minimum.at(lowest, right, rank)
        self.together = lowest[self.result] > rank
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        # a pair listed twice has the rank of its last line, as in a dictionary
        last = np.append(key[order][1:] != key[order][:-1], True) if len(key) else np.zeros(0, bool)
        self.keys, self.ranks = key[order][last], rank[order][last]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NEVER)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.inner[codes]
        ends = np.cumsum(sizes)
        symbol[ends[sizes > 0] - 1] = self.final[codes[ends[sizes > 0] - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        symbol, word = symbol[symbol >= 0], word[symbol >= 0]  # bytes without a token give none
        best = np.full(len(symbol), NEVER)
        inside = np.flatnonzero(word[1:] == word[:-1])
        best[inside] = self._rank(symbol[inside], symbol[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lengths = np.diff(np.append(starts, len(word)))
            lowest = np.repeat(np.minimum.reduceat(best, starts), lengths)
            live = lowest < NEVER
            if not live.all():
                done.append((word[~live], symbol[~live]))
                symbol, word, best, lowest = symbol[live], word[live], best[live], lowest[live]
                if not len(symbol):
                    break
            hit = np.flatnonzero(best == lowest)
            run = np.concatenate(([True], hit[1:] != hit[:-1] + 1))  # of the same pair side by side every other one
            hit = hit[(hit - np.maximum.accumulate(np.where(run, hit, 0))) % 2 == 0]
            first = np.concatenate(([True], word[hit[1:]] != word[hit[:-1]]))
            hit = hit[first | self.together[best[hit]]]
            symbol[hit] = self.result[best[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # a merged pair is one place less for the pairs behind it
            symbol, word, best = symbol[keep], word[keep], best[keep]
            changed = np.concatenate((at, at[at > 0] - 1))
            best[changed] = NEVER
            changed = changed[changed + 1 < len(symbol)]
            changed = changed[word[changed] == word[changed + 1]]
            best[changed] = self._rank(symbol[changed], symbol[changed + 1])
        if not done:
            return [b""] * len(words)
        word, symbol = (np.concatenate(c) for c in zip(*done, strict=True))
        flat = symbol[np.argsort(word, kind="stable")].astype("<u4").tobytes()
        cut = (np.cumsum(np.bincount(word, minlength=len(words))) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)]


class Encoder:
    """Texts to ids by one tokenizer file."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, parts = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        normal = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        added = spec.get("added_tokens") or []
        known = (model["type"] == "BPE" and not model.get("continuing_subword_prefix") and not model.get("byte_fallback")
                 and not model.get("ignore_merges") and not model.get("unk_token")
                 and normal == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"]
                 and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and not parts[1]["use_regex"]
                 and not parts[1]["add_prefix_space"] and r"[^\s\p{L}\p{N}]+" in parts[0]["pattern"].get("Regex", "")
                 and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added))
        latin = latin_pattern(parts[0]["pattern"]["Regex"]) if known else None
        if latin is None:
            raise ValueError("a word-level BPE file is needed: NFC, white space, lower case, split by a pattern, byte level")
        self.find = latin.findall
        self.rounds = Rounds(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        strings = sorted(self.added, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, strings)) + ")") if strings else None
        self.cutter = _normalizer_and_splitter(raw)
        self.letters = str.maketrans({c: chr(b) for b, c in enumerate(byte_letters())})
        self.known: dict[str, bytes] = {}
        self.runs: dict[str, list[str]] = {}

    def _foreign(self, run: str) -> list[str]:
        """The words of a run that holds characters from U+0100 on, by the library's normalizer and splitter."""
        if run not in self.runs:
            if len(self.runs) > REMEMBERED // 4:
                self.runs.clear()
            normalizer, splitter = self.cutter
            found = splitter.pre_tokenize_str(normalizer.normalize_str(run))
            words = [w.translate(self.letters).encode("latin-1").decode("utf-8") for w, _ in found]
            if len(run) > 100:
                return words
            self.runs[run] = words
        return self.runs[run]

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self.find(text.lower())
        try:
            text.encode("latin-1")
            return self.find(text.lower())
        except UnicodeEncodeError:
            pass
        found: list[str] = []
        for run in ASCII_SPACE.split(text):
            found += self.find(run.lower()) if max(run, default="") <= "\xff" else self._foreign(run)
        return found

    def _cut(self, text: str) -> list[str | bytes]:
        """Words, and the ids of added tokens between them."""
        if not self.marks or not self.marks.search(text):
            return self._words(text)
        found: list[str | bytes] = []
        for k, part in enumerate(self.marks.split(text)):
            found += [self.added[part]] if k % 2 else self._words(part)
        return found

    def _learn(self, words: set[str]) -> None:
        for some in blocks(words, lambda w: len(w) + 1, TOGETHER):
            self.known.update(zip(some, self.rounds.ids([w.encode("utf-8") for w in some]), strict=True))

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text; the texts are taken together in groups of about half a million characters."""
        for group in blocks(texts, lambda t: len(t or "") + 1, 500_000):
            cut = [self._cut(t) if t else [] for t in group]
            words = {w for some in cut for w in some if isinstance(w, str)}
            if len(self.known) + len(words) > REMEMBERED:
                self.known.clear()
            self._learn({w for w in words if w not in self.known})
            for some in cut:
                yield b"".join([w if isinstance(w, bytes) else self.known[w] for w in some])
            if any(len(w) > 1_000 for w in words):  # a few very long words must not fill the memory
                self.known = {w: ids for w, ids in self.known.items() if len(w) <= 1_000}


def _normalizer_and_splitter(raw: bytes):
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(raw.decode("utf-8"))
    return library.normalizer, library.pre_tokenizer


class Decoder:
    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        if spec.get("decoder") is not None:
            raise ValueError("a file without a decoder is needed")
        tokens = {k: t for t, k in spec["model"]["vocab"].items()}
        tokens.update((t["id"], t["content"]) for t in spec.get("added_tokens") or [])
        self.tokens = [tokens.get(k, "").encode("utf-8") for k in range(max(tokens, default=-1) + 1)]

    def decode(self, ids: bytes | None) -> bytes:
        return b" ".join(map(self.tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def _kept(kind, raw: bytes):
    """The worker's encoder or decoder of this file, made once a process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    kept = worker_cache(f"word_bpe.{kind.__name__}")
    key = hashlib.sha256(raw).digest()
    if key not in kept:
        kept.clear()
        kept[key] = kind(raw)
    return kept[key]


def _sent(df: DataFrame, path: str):
    """The tokenizer file, read where the driver runs; it holds a vocabulary, not data."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encoded(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text in a binary column, little-endian unsigned 32-bit integers."""
    raw = _sent(df, path)

    @F.arrow_udf("binary")
    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _kept(Encoder, raw.value)
        for texts in parts:
            for few in slices(texts):
                yield pa.array(coder.encode(few.to_pylist()), pa.binary(), size=len(few))

    return df.withColumn(ids, encode(text))


def decoded(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text that the ids stand for, in UTF-8."""
    raw = _sent(df, path)

    @F.arrow_udf("binary")
    def decode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _kept(Decoder, raw.value)
        for rows in parts:
            for few in slices(rows, 100):
                yield pa.array((coder.decode(r.as_py()) for r in few), pa.binary(), size=len(few))

    return df.withColumn(out, decode(ids))
