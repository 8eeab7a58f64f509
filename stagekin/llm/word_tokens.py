"""Whole texts to ids with a tokenizer file of the tokenizers library, equal words once.

Where the file drops white space, lower-cases and splits by a pattern, a text of characters below
U+0100 is cut into words, found again by their hashes in sorted arrays; a word met for the first time
is cut into the matches of the pattern and the library encodes each distinct match once. Any other file or text goes to the library whole.

The string of an added token in a text is that token, as in the library; a text that may hold one goes to the library
whole. With ``special_as_text`` it is ordinary text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np

from stagekin.llm.byte_bpe import latin_pattern
from stagekin.llm.common import blocks, worker_cache
from stagekin.llm.shingles import BYTE_STEP, word_hashes

#: Words that a worker remembers; all are forgotten when there would be more.
REMEMBERED = 1_600_000
#: A word is known by one hash and checked by another.
STEPS = (BYTE_STEP, 0xD1342543DE82EF95)
#: No-break space and next line are white space like the others.
SPACES = bytes(32 if b in (0x85, 0xA0) else b for b in range(256))


class WordEncoder:
    def __init__(self, raw: bytes, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(raw.decode("utf-8"))
        self.tokenizer.encode_special_tokens = special_as_text
        self.size = self.tokenizer.get_vocab_size()
        pattern = self._pattern(json.loads(raw))
        latin = latin_pattern(pattern) if pattern else None
        # with ``special_as_text`` the library still finds added tokens that are not special
        added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()
                 if not (special_as_text and t.special)]
        self.find = latin.findall if latin and not any(re.search(r"\s", t) or not t for t in added) else None
        self.added = [t.encode("latin-1") for t in added if max(t, default="\0") <= "\xff"]
        self.last = np.zeros(self.size, bool)  # ids that end a word
        for token, k in self.tokenizer.get_vocab().items():
            self.last[k] = token.endswith("</w>")
        self.pieces: dict[str, bytes] = {}
        self._forget()

    @staticmethod
    def _pattern(spec: dict) -> str | None:
        """The splitting pattern, if the file normalizes, drops white space and splits as the shortcut needs."""
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        normal = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        fits = (normal == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"]
                and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
                and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"])
        pattern = parts[0]["pattern"].get("Regex") if fits else None
        return pattern if pattern and r"[^\s\p{L}\p{N}]+" in pattern else None

    def _plain(self, text: str) -> bytes | None:
        """The lower-cased text, a byte a character; None: the library must see the whole text."""
        try:
            plain = text.lower().encode("latin-1").translate(SPACES) if self.find else None
        except UnicodeEncodeError:
            return None
        return None if plain is None or any(t in plain for t in self.added) else plain

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without white space; many go to the library in one text, told apart by their last ids."""
        found: list[bytes] = []
        for k in range(0, len(pieces), 500):
            part = pieces[k:k + 500]
            ids = self._whole([" ".join(part)])[0]
            ends = ((np.flatnonzero(self.last[np.frombuffer(ids, "<u4")]) + 1) * 4).tolist()
            found += ([ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if len(ends) == len(part)
                      else self._whole(part))
        return found

    def _learn(self, words: list[str], keys: np.ndarray, checks: np.ndarray) -> None:
        """Adds words that are not known; ``keys`` are sorted."""
        if len(self.keys) + len(keys) > REMEMBERED:
            self._forget()
        if len(self.pieces) > REMEMBERED // 8:
            self.pieces.clear()
        cut = [self.find(word) for word in words]
        new = list({piece for pieces in cut for piece in pieces if piece not in self.pieces})
        self.pieces.update(zip(new, self._ids(new), strict=True))
        coded = [b"".join([self.pieces[p] for p in pieces]) for pieces in cut]
        counts = np.array([len(c) // 4 for c in coded], np.int32)
        at = np.searchsorted(self.keys, keys)
        starts = len(self.flat) + np.cumsum(counts, dtype=np.int64) - counts
        self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(coded), "<u4")))
        self.keys, self.checks = np.insert(self.keys, at, keys), np.insert(self.checks, at, checks)
        self.starts, self.counts = np.insert(self.starts, at, starts), np.insert(self.counts, at, counts)

    def _forget(self) -> None:
        self.keys, self.checks = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.starts, self.counts, self.flat = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, "<u4")

    def _look_up(self, texts: list[bytes]) -> list[np.ndarray] | None:
        """Ids of each text by the hashes of its words; None if two words share one of their hashes."""
        data = b" ".join(texts) + b" "
        first, last, (keys, checks) = word_hashes(data, STEPS)
        distinct, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
        sure = checks[index]
        if (checks != sure[inverse]).any():
            return None
        at = np.minimum(np.searchsorted(self.keys, distinct), max(0, len(self.keys) - 1))
        known = self.keys[at] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        if (self.checks[at[known]] != sure[known]).any():
            return None
        if not known.all():
            if len(self.keys) + len(distinct) > REMEMBERED:
                self._forget()
                known[:] = False
            new = index[~known]
            words = [data[a:b].decode("latin-1") for a, b in zip(first[new].tolist(), last[new].tolist(), strict=True)]
            self._learn(words, distinct[~known], sure[~known])
            at = np.searchsorted(self.keys, distinct)
        starts, counts = self.starts[at][inverse], self.counts[at][inverse].astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(counts)))
        ids = self.flat[np.repeat(starts - ends[:-1], counts) + np.arange(ends[-1])]
        sizes = np.cumsum([len(t) + 1 for t in texts])
        cut = ends[np.searchsorted(first, np.concatenate(([0], sizes)))].tolist()
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; the texts are taken together in groups of about a million characters."""
        for group in blocks(texts, lambda t: len(t or "") + 1, 1_000_000):
            plain = [self._plain(t or "") for t in group]
            quick = [p for p in plain if p is not None]
            found = iter(self._look_up(quick) or self._whole_arrays([t or "" for t, p in zip(group, plain, strict=True)
                                                                     if p is not None]))
            for text, one in zip(group, plain, strict=True):
                yield self._whole_arrays([text])[0] if one is None else next(found)

    def _whole_arrays(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(ids, "<u4") for ids in self._whole(texts)]


def encoder(raw: bytes, special_as_text: bool = False) -> WordEncoder:
    """The worker's encoder for this tokenizer file, made once a process, on one thread a task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    kept = worker_cache("word_tokens")
    key = hashlib.sha256(raw).digest(), special_as_text
    if key not in kept:
        kept.clear()
        kept[key] = WordEncoder(raw, special_as_text)
    return kept[key]


def id_type(size: int) -> str:
    """The narrowest file type that holds ids below ``size``."""
    return "<u2" if size <= 1 << 16 else "<u4"
