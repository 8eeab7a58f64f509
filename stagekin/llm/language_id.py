"""Language of a text by a byte convolutional network, trained here on labelled texts.

A text is cut into windows of ``WINDOW`` bytes. Bytes are embedded, filters of several widths slide over
them, each filter's maximum over the window feeds a softmax. A text's probabilities are the mean over
all its windows, weighted by their bytes. The network is trained in numpy, by Adam on the cross-entropy,
on windows of at most ``LABELLED`` texts a language (chosen by hash), and sent to the tasks (some 20 kB).

Only the text is an input. A null text or one without letters is ``und`` with score 0; with no labelled
text at all every text is. Texts of one language only give that language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagekin.llm.common import blocks, fresh, values

#: Labelled texts a language and windows of each, at most.
LABELLED = 1500
WINDOWS_EACH = 3
WINDOW = 256
WIDTHS = (2, 3, 4)
EMBEDDED = 6
FILTERS = 20
LETTER = r"[^\W\d_]"


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed-length windows of all texts (padded with zeros), the text each is of, and its bytes."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], np.int64)
    joined = b"".join(t.ljust(n * WINDOW, b"\0") for t, n in zip(texts, counts.tolist(), strict=True))
    rows = np.frombuffer(joined, np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(texts)), counts)
    sizes = np.full(len(rows), WINDOW)
    sizes[np.cumsum(counts) - 1] = [len(t) - (n - 1) * WINDOW for t, n in zip(texts, counts.tolist(), strict=True)]
    return rows, owner, sizes


class Network:
    def __init__(self, classes: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.weights = {"embed": rng.normal(0, 0.5, (256, EMBEDDED)).astype(np.float32)}
        for w in WIDTHS:
            self.weights[f"filter{w}"] = rng.normal(0, (w * EMBEDDED) ** -0.5, (w * EMBEDDED, FILTERS)).astype(np.float32)
            self.weights[f"bias{w}"] = np.zeros(FILTERS, np.float32)
        self.weights["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, classes)).astype(np.float32)
        self.weights["out_bias"] = np.zeros(classes, np.float32)

    def _columns(self, rows: np.ndarray) -> np.ndarray:
        """Embedded bytes of each place and those after it, as many as the widest filter takes."""
        widest, span = max(WIDTHS), rows.shape[1] - max(WIDTHS) + 1
        seen = self.weights["embed"][rows]
        found = np.empty((len(rows), span, widest * EMBEDDED), np.float32)
        for k in range(widest):
            found[:, :, k * EMBEDDED:(k + 1) * EMBEDDED] = seen[:, k:k + span]
        return found

    def _all_filters(self) -> np.ndarray:
        """All filters in one matrix; narrower ones have zeros at the end."""
        widest = max(WIDTHS) * EMBEDDED
        return np.concatenate([np.pad(self.weights[f"filter{w}"], ((0, widest - w * EMBEDDED), (0, 0)))
                               for w in WIDTHS], 1)

    def features(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        columns = self._columns(rows)
        values = (columns.reshape(-1, columns.shape[2]) @ self._all_filters()).reshape(*columns.shape[:2], -1)
        return columns, values, values.max(1)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        bias = np.concatenate([self.weights[f"bias{w}"] for w in WIDTHS])
        found = [self.features(part)[2] for part in np.array_split(rows, max(1, len(rows) // 256))]
        return self._softmax(np.maximum(np.concatenate(found) + bias, 0))

    def _softmax(self, hidden: np.ndarray) -> np.ndarray:
        scores = hidden @ self.weights["out"] + self.weights["out_bias"]
        scores = np.exp(scores - scores.max(1, keepdims=True))
        return scores / scores.sum(1, keepdims=True)

    def gradients(self, rows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        columns, values, top = self.features(rows)
        bias = np.concatenate([self.weights[f"bias{w}"] for w in WIDTHS])
        hidden = np.maximum(top + bias, 0)
        wrong = self._softmax(hidden)
        wrong[np.arange(len(rows)), labels] -= 1
        wrong /= len(rows)
        grads = {"out": hidden.T @ wrong, "out_bias": wrong.sum(0)}
        back = (wrong @ self.weights["out"].T) * (hidden > 0)
        place = values.argmax(1)  # only the largest response of a filter passes the gradient on
        chosen = columns[np.arange(len(rows))[:, None], place]  # rows, filters, columns
        filters = np.einsum("rf,rfc->cf", back, chosen)
        spread = back[:, :, None] * self._all_filters().T[None]
        embed = np.zeros_like(self.weights["embed"])
        for k in range(max(WIDTHS)):
            np.add.at(embed, rows[np.arange(len(rows))[:, None], place + k], spread[:, :, k * EMBEDDED:(k + 1) * EMBEDDED])
        grads["embed"] = embed
        for n, w in enumerate(WIDTHS):
            grads[f"filter{w}"] = filters[: w * EMBEDDED, n * FILTERS:(n + 1) * FILTERS]
            grads[f"bias{w}"] = back[:, n * FILTERS:(n + 1) * FILTERS].sum(0)
        return grads

    def fit(self, rows: np.ndarray, labels: np.ndarray, steps: int = 500, size: int = 96, rate: float = 0.01) -> Network:
        """Every language has an equal share of each step."""
        rng = np.random.default_rng(5)
        pools = [np.flatnonzero(labels == c) for c in np.unique(labels)]
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, steps + 1):
            chosen = np.concatenate([rng.choice(p, max(1, size // len(pools))) for p in pools])
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in self.gradients(rows[chosen], labels[chosen]).items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                self.weights[k] = self.weights[k] - np.float32(pace) * (mean[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-7)
        return self


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in re.finditer(LETTER, text))


def fitted(labelled: DataFrame, seed: int = 11) -> tuple[list[str], dict[str, np.ndarray]]:
    """Languages and weights from ``text`` and ``lang`` of the rows given; null ones are left out."""
    rows = labelled.filter("text is not null and lang is not null").select("text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], {}
    share = F.lit(0)
    for lang in langs:  # a hash of the text draws a few more than asked for, whichever the number of rows
        share = F.when(F.col("lang") == lang, int(min(1.0, 1.3 * LABELLED / counts[lang]) * 1_000_000) + 1).otherwise(share)
    drawn = rows.filter(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1_000_000)) < share)
    # of a long text a few stretches are enough to learn from
    pieces = F.array(*[F.substring("text", F.greatest(F.lit(1), (F.length("text") * k / WINDOWS_EACH).cast("int")), WINDOW)
                       for k in range(WINDOWS_EACH)])
    # a very frequent text can be drawn more often than wanted: the same rows are left in every run
    ordered = drawn.orderBy(F.xxhash64("text", F.lit(seed)), "lang")
    taken = ordered.select("lang", pieces.alias("pieces")).limit(2 * LABELLED * len(langs)).collect()
    known = [(langs.index(r["lang"]), p) for r in sorted(taken) for p in set(r["pieces"]) if has_letter(p)]
    data = [(c, *row) for c, p in known for row in [(p.encode("utf-8")[:WINDOW].ljust(WINDOW, b"\0"),)]]
    if not data:
        return langs, Network(len(langs), seed).weights
    network = Network(len(langs), seed).fit(
        np.frombuffer(b"".join(d[1] for d in data), np.uint8).reshape(-1, WINDOW), np.array([d[0] for d in data]))
    return langs, network.weights


def predicted(docs: DataFrame, model: tuple[list[str], dict[str, np.ndarray]], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; columns of these names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        langs, weights = sent.value
        network = Network(max(1, len(langs)))
        network.weights = weights
        for texts in columns:
            found = []
            for group in blocks(values(texts), lambda t: len(t or "") + 64, 1_000_000):
                known = [i for i, t in enumerate(group) if langs and t and has_letter(t)]
                answer = [{"lang_pred": "und", "score": 0.0} for _ in group]
                if known:
                    rows, owner, sizes = windows([group[i].encode("utf-8", "replace") for i in known])
                    sums = np.zeros((len(known), len(langs)))
                    np.add.at(sums, owner, network.probabilities(rows) * sizes[:, None])
                    sums /= sums.sum(1, keepdims=True)
                    for k, i in enumerate(known):
                        best = int(sums[k].argmax())
                        answer[i] = {"lang_pred": langs[best], "score": float(min(1.0, sums[k, best]))}
                found += answer
            yield pa.array(found, kind)

    own = fresh(docs, "_predicted")
    found = docs.withColumn(own, predict(text))
    return found.withColumns({"lang_pred": F.col(f"{own}.lang_pred"), "score": F.col(f"{own}.score")}).drop(own)
