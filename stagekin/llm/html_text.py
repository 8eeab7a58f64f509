"""Main text of pages: every block of text is labelled by a recurrent network that has read the whole page.

A page is a sequence of leaf blocks, each a run of text between block-level tags. A block is read as the
path of its tags with their class and id names, its hashed words, and a few measures (length, share of
linked text, place). A bidirectional LSTM goes over all blocks of the page, however many, and a logistic
layer labels each; main text is joined by newlines. The network is written and trained in numpy, on pages
made up in many layouts (``html_pages``), in a few seconds and always alike; its weights go to the tasks.

White space of any kind inside a block becomes one space, line breaks (``<br>``) too. Character references
are decoded once. Scripts, styles and other text that no browser shows is no block; where such an element is
never closed, only its start tag is left out. Formulas, drawings and the fallback of objects are text like any
other and stand in their line. A null or empty page, or one without main text, gives an empty text. Other tags
that are never closed end with the page.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagekin.llm.common import blocks
from stagekin.llm.html_pages import training_page

#: Comment, declaration, or tag with its name and attributes; quoted ``>`` do not end a tag.
TOKEN = (r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
         r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']*+(?:\"[^\"]*+\"|'[^']*+'))*+[^>\"']*+>|[^>]*+(?:>|\Z))")
NAMES = r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))"
#: Elements that stand in a line of text, that have no content, and whose content is no text of the page.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr br object param svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template title iframe annotation annotation-xml".split())
#: Tags inside a formula or drawing stand in its line, but these end it, as in a browser.
FOREIGN = frozenset(("math", "svg"))
BREAKOUT = frozenset("body blockquote center dd div dl dt embed h1 h2 h3 h4 h5 h6 head hr li menu nobr ol p pre ruby "
                     "table ul article section main header footer nav aside".split())
#: An open element of the value ends where one of the key begins inside the same parent.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
TAGS = re.compile(TOKEN, re.S)
ENDS = {tag: re.compile(rf"</{tag}(?![^\s/>])[^>]*(?:>|\Z)", re.I) for tag in HIDDEN}
BUCKETS, EMBEDDED, WORD_BUCKETS, MEASURES, HIDDEN_UNITS = 1024, 16, 64, 5, 14
PAGES, EPOCHS = 700, 4


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % BUCKETS


def _names(attributes: str) -> tuple[int, ...]:
    found = []
    for values in re.findall(NAMES, attributes, re.I) if "=" in attributes else ():
        found += [w for w in re.split(r"[^a-z0-9]+", " ".join(values).lower()) if w]
    return tuple(_bucket("." + w) for w in found)


def leaf_blocks(page: str) -> list[tuple[str, tuple[int, ...], float]]:
    """(text, path, share of its characters in links) of each block of a page."""
    found: list[tuple[str, tuple[int, ...], float]] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    opened: dict[str, int] = {}  # open elements by tag, and their buckets: the path without a walk over the stack
    buckets: dict[int, int] = {}
    parts: list[str] = []
    linked = links = at = 0
    foreign, endless = "", set()

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            path = tuple(sorted(buckets.keys() | ({_bucket("/" + stack[-1][0])} if stack else set())))
            found.append((text, path, min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    def push(tag: str, own: tuple[int, ...]) -> None:
        stack.append((tag, own))
        opened[tag] = opened.get(tag, 0) + 1
        for b in own:
            buckets[b] = buckets.get(b, 0) + 1

    def pop() -> str:
        tag, own = stack.pop()
        opened[tag] -= 1
        for b in own:
            buckets[b] -= 1
            if not buckets[b]:
                del buckets[b]
        return tag

    def add(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw)
        parts.append(text)
        if links:
            linked += len(text)

    while token := TAGS.search(page, at):
        if token.start() > at:
            add(page[at:token.start()])
        at = token.end()
        tag = (token[2] or "").lower()
        if foreign and (tag in BREAKOUT or token[1] and tag == foreign):
            foreign = ""
        if not tag or foreign and tag not in HIDDEN:
            continue
        elif token[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in INLINE or tag in VOID or not opened.get(tag):
                continue
            flush()
            while pop() != tag:
                pass
            links = 0
        elif tag in HIDDEN:
            if not token[3].endswith("/>") and tag not in endless:
                end = ENDS[tag].search(page, at)  # nothing but their own end tag counts in them
                at = end.end() if end else at
                if not end:
                    endless.add(tag)
        elif tag in ("br", "wbr", "img"):
            parts.append(" " if tag == "br" else "")
        elif tag in INLINE:
            links += tag == "a"
            if tag in FOREIGN and not token[3].endswith("/>"):
                foreign = tag
        else:
            flush()
            if stack and stack[-1][0] == "p":
                pop()
            while stack and stack[-1][0] in CLOSES.get(tag, ()):
                pop()
            if tag not in VOID:
                push(tag, (_bucket(tag), *_names(token[3])))
    if at < len(page):
        add(page[at:])
    flush()
    return found


def _inputs(pages: list[list[tuple[str, tuple[int, ...], float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Path buckets of all blocks one after the other, where each block's begin, hashed words, measures."""
    paths, starts, words, measures = [], [], [], []
    for page in pages:
        for k, (text, path, share) in enumerate(page):
            starts.append(len(paths))
            paths += path or (0,)
            own = text.lower().split()
            bag = np.bincount([zlib.crc32(w.encode("utf-8", "replace")) % WORD_BUCKETS for w in own]
                              + [0] * (not own), minlength=WORD_BUCKETS) / max(1, len(own)) ** 0.5
            words.append(bag)
            measures.append((np.log1p(len(text)) / 8, share, k / len(page), 1 / (1 + len(own)),
                             sum(text.count(c) for c in ".,!?") / len(text)))
    return (np.array(paths, np.int64), np.array(starts, np.int64), np.array(words, np.float32).reshape(-1, WORD_BUCKETS),
            np.array(measures, np.float32).reshape(-1, MEASURES))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embedding bag of the path, two LSTMs in opposite directions, a logistic layer."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        wide, h = EMBEDDED + WORD_BUCKETS + MEASURES, HIDDEN_UNITS
        self.weights = {"embed": rng.normal(0, 0.3, (BUCKETS, EMBEDDED)).astype(np.float32),
                        "out": rng.normal(0, 0.2, 2 * h).astype(np.float32), "out_bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.weights[f"in_{side}"] = rng.normal(0, wide ** -0.5, (wide, 4 * h)).astype(np.float32)
            self.weights[f"rec_{side}"] = rng.normal(0, h ** -0.5, (h, 4 * h)).astype(np.float32)
            self.weights[f"bias_{side}"] = np.concatenate((np.zeros(h), np.ones(h), np.zeros(2 * h))).astype(np.float32)

    def _run(self, side: str, given: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States of one direction over (step, page, input); masked steps leave the state as it is."""
        h = HIDDEN_UNITS
        state, cell = np.zeros((given.shape[1], h), np.float32), np.zeros((given.shape[1], h), np.float32)
        found = np.zeros((*given.shape[:2], h), np.float32)
        order = range(len(given)) if side == "f" else range(len(given) - 1, -1, -1)
        gates_in = given @ self.weights[f"in_{side}"] + self.weights[f"bias_{side}"]
        for t in order:
            gates = gates_in[t] + state @ self.weights[f"rec_{side}"]
            i, f, o = (_sigmoid(gates[:, k * h:(k + 1) * h]) for k in range(3))
            g = np.tanh(gates[:, 3 * h:])
            new = f * cell + i * g
            top = np.tanh(new)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, i, f, o, g, cell, top, state, m))
            cell = np.where(m, new, cell)
            state = np.where(m, o * top, state)
            found[t] = state
        return found

    def _padded(self, pages: list) -> tuple[np.ndarray, np.ndarray, tuple]:
        paths, starts, words, measures = _inputs(pages)
        sizes = np.array([len(p) for p in pages])
        longest = max(1, int(sizes.max(initial=0)))
        mask = np.arange(longest)[:, None] < sizes[None, :]
        given = np.zeros((longest, len(pages), EMBEDDED + WORD_BUCKETS + MEASURES), np.float32)
        column = np.repeat(np.arange(len(pages)), sizes)
        step = np.arange(len(column)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        if len(column):
            given[step, column] = np.concatenate((np.add.reduceat(self.weights["embed"][paths], starts), words, measures), 1)
        return given, mask, (paths, starts, step, column)

    def chances(self, pages: list) -> list[np.ndarray]:
        given, mask, (_, _, step, column) = self._padded(pages)
        states = np.concatenate((self._run("f", given, mask, None), self._run("b", given, mask, None)), 2)
        chance = _sigmoid(states @ self.weights["out"] + self.weights["out_bias"])
        sizes = np.cumsum([len(p) for p in pages])
        return np.split(chance[step, column], sizes[:-1])

    def gradients(self, pages: list, labels: list[list[int]]) -> dict[str, np.ndarray]:
        given, mask, (paths, starts, step, column) = self._padded(pages)
        wanted = np.zeros(mask.shape, np.float32)
        wanted[step, column] = np.concatenate([np.array(x, np.float32) for x in labels])
        kept = {side: [] for side in "fb"}
        states = {side: self._run(side, given, mask, kept[side]) for side in "fb"}
        both = np.concatenate((states["f"], states["b"]), 2)
        wrong = (_sigmoid(both @ self.weights["out"] + self.weights["out_bias"]) - wanted) * mask / mask.sum()
        grads = {"out": np.einsum("tn,tnh->h", wrong, both), "out_bias": wrong.sum(keepdims=True)[0]}
        back_in = np.zeros_like(given)
        h = HIDDEN_UNITS
        for n, side in enumerate("fb"):
            down = wrong[:, :, None] * self.weights["out"][n * h:(n + 1) * h]
            w_in, w_rec = self.weights[f"in_{side}"], self.weights[f"rec_{side}"]
            g_in, g_rec, g_bias = np.zeros_like(w_in), np.zeros_like(w_rec), np.zeros(4 * h, np.float32)
            d_state = np.zeros((len(pages), h), np.float32)
            d_cell = np.zeros_like(d_state)
            for t, i, f, o, g, cell, top, before, m in reversed(kept[side]):
                total = d_state + down[t]
                d_top = total * o * (1 - top * top) + d_cell
                gates = np.concatenate((d_top * g * i * (1 - i), d_top * cell * f * (1 - f),
                                        total * top * o * (1 - o), d_top * i * (1 - g * g)), 1) * m
                g_in += given[t].T @ gates
                g_rec += before.T @ gates
                g_bias += gates.sum(0)
                back_in[t] += gates @ w_in.T
                d_state = np.where(m, gates @ w_rec.T, total)
                d_cell = np.where(m, d_top * f, d_cell)
            grads |= {f"in_{side}": g_in, f"rec_{side}": g_rec, f"bias_{side}": g_bias}
        embed = np.zeros_like(self.weights["embed"])
        spans = np.diff(np.append(starts, len(paths)))
        np.add.at(embed, paths, np.repeat(back_in[step, column][:, :EMBEDDED], spans, 0))
        return grads | {"embed": embed}

    def fit(self, pages: list, labels: list, epochs: int = EPOCHS, size: int = 10, rate: float = 0.02) -> Labeller:
        order = np.random.default_rng(1)
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        steps, step = epochs * -(-len(pages) // size), 0
        for _ in range(epochs):
            for chosen in np.array_split(order.permutation(len(pages)), -(-len(pages) // size)):
                step += 1
                pace = np.float32(rate * (1 - step / (steps + 1)))
                for k, g in self.gradients([pages[c] for c in chosen], [labels[c] for c in chosen]).items():
                    g = np.clip(g, -1, 1)
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.01 * (g * g - square[k])
                    self.weights[k] = self.weights[k] - pace * (mean[k] / (1 - 0.9 ** step)) / (
                        np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-7)
        return self


def labelled_pages(n: int, seed: int) -> tuple[list, list]:
    """Blocks of made-up pages and their labels."""
    rng, pages, labels = random.Random(seed), [], []
    while len(pages) < n:
        page, texts = training_page(rng)
        known = {" ".join(t.split()): label for t, label in texts}
        own = leaf_blocks(page)
        answer = [known.get(text, 0) for text, _, _ in own]
        if own:
            pages.append(own)
            labels.append(answer)
    return pages, labels


_fitted: dict[int, dict[str, np.ndarray]] = {}


def fitted(seed: int = 3) -> dict[str, np.ndarray]:
    """Weights of the labeller; trained once a process, always the same."""
    if seed not in _fitted:
        _fitted[seed] = Labeller(seed).fit(*labelled_pages(PAGES, seed)).weights
    return _fitted[seed]


def main_texts(pages: list[str | None], labeller: Labeller) -> list[str]:
    found = [""] * len(pages)
    cut = [leaf_blocks(p) if p else [] for p in pages]
    # pages of like length together, so few steps are padding
    order = sorted((i for i, c in enumerate(cut) if c), key=lambda i: len(cut[i]))
    for group in blocks(order, lambda i: len(cut[i]), 4000):
        for i, chance in zip(group, labeller.chances([cut[i] for i in group]), strict=True):
            found[i] = "\n".join(text for (text, _, _), c in zip(cut[i], chance, strict=True) if c > 0.5)
    return found


def extracted(pages: DataFrame, weights: dict[str, np.ndarray] | None = None, column: str = "html") -> DataFrame:
    """``pages`` with the main text of each in ``text`` (a column of that name is replaced)."""
    sent = pages.sparkSession.sparkContext.broadcast(weights or fitted())

    @F.arrow_udf("string")
    def extract(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller = Labeller()
        labeller.weights = sent.value
        for rows in parts:
            texts = []
            for group in blocks(rows.to_pylist(), lambda p: len(p or "") + 1, 4_000_000):
                texts += main_texts(group, labeller)
            yield pa.array(texts, pa.string())

    return pages.withColumn("text", extract(column))
