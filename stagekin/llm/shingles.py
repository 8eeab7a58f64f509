"""Word-shingle sets of many texts at once, and the segment keys that find similar sets.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. A set holds the 64-bit
hashes of all runs of ``width`` words (of the whole sequence where there are fewer words).
"""

from __future__ import annotations

import numpy as np

from stagekin.llm.common import worker_cache

U = np.uint64
#: Odd multipliers of the hash: bytes within a word, words within a shingle, finishing steps.
BYTE_STEP = 0x9E3779B97F4A7C15
WORD_STEPS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
              0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)
#: Bytes hashed in one go.
STRETCH = 1 << 19
SMALL = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """step**i and its inverse modulo 2**64, for i below n; kept in the worker for the next call."""
    kept = worker_cache("powers")
    if n > 2 * STRETCH:  # a single word of that length
        kept = {}
    if step not in kept or len(kept[step][0]) < n:
        kept[step] = []
        for base in (step, pow(step, -1, 1 << 64)):
            table = np.full(n, U(base))
            table[:1] = 1
            kept[step].append(np.multiply.accumulate(table))
    up, down = kept[step]
    return up[:n], down[:n]


def word_hashes(data: bytes, steps: tuple[int, ...] = (BYTE_STEP,)) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """First and last byte of each word of ``data``, which ends in a space, and its hash for each step.

    A word's hash is a polynomial in its bytes; the difference of running sums gives those of many words
    at once. The sums go over stretches of about ``STRETCH`` bytes, so memory does not grow with a text.
    """
    codes = np.frombuffer(data, np.uint8)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    edges = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
    first, last = edges[0::2], edges[1::2]
    found = [np.empty(len(first), np.uint64) for _ in steps]
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(last, first[a] + STRETCH)))
        low, own = first[a:b] - first[a], codes[first[a]:last[b - 1]].astype(np.uint64) + U(1)
        high = last[a:b] - first[a]
        for step, out in zip(steps, found, strict=True):
            up, down = _powers(len(own), step)
            sums = np.concatenate(([U(0)], np.cumsum(own * up)))
            out[a:b] = mix((sums[high] - sums[low]) * down[low] + (high - low).astype(np.uint64))
        a = b
    return first, last, found


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text; empty for null or a text without words."""
    found: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0
    for text in texts:
        group.append(text.encode("utf-8", "replace") if text else b"")
        size += len(group[-1])
        if size >= 4_000_000:
            found += _sets(group, width)
            group, size = [], 0
    return found + _sets(group, width)


def _sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    first, _, (words,) = word_hashes((b" ".join(texts) + b" ").translate(SMALL))
    cut = np.searchsorted(first, np.append(starts, sizes.sum()))
    full = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        full += words[k: k + len(full)] * U(WORD_STEPS[k])
    full = mix(full)
    found = []
    for i in range(len(texts)):
        a, b = cut[i], cut[i + 1]
        if b - a >= width:
            one = np.sort(full[a: b - width + 1])
            found.append(one[np.concatenate(([True], one[1:] != one[:-1]))])
        elif b > a:
            short = (words[a:b] * np.array(WORD_STEPS[: b - a], np.uint64)).sum(dtype=np.uint64)
            found.append(mix(np.array([short + U(b - a)], np.uint64)))
        else:
            found.append(np.empty(0, np.uint64))
    return found
