"""Benchmark items inside documents, as exact or edited copies.

Texts are compared as runs of letters, digits and bytes beyond ASCII, A-Z lower-cased, with one space
between runs. An item is found in a document if some part of it has an edit distance of at most
``1 - similar`` times the item's length.

Candidates for items of ``SHORT`` bytes and more come from the CGK embedding: a walk over the string that at each
step writes the current byte and moves on by a random bit of (step, byte), so strings of small edit distance give
outputs of small Hamming distance. The window at every word start is walked as is every word start of an item; in a
run that holds characters of a script without spaces, every code point is a word start. A sample of the output bytes
is the hash; equal hashes are candidates. ``REPEATS`` walks with other bits and samples, over all the words of an
item, find copies; two words of a long item must point to the same place. A walk reads about 16 bytes and is a seed:
walks as long as the item fall out of step at each edit, so that at a fifth of edits hundreds to thousands of them
would be needed (README: measured). The search is not exact near the limit of edits (README: recall; tests hold
floors). Exact copies that begin at a word start are found. Windows whose first sampled bytes fit no item are not
walked further.

Shorter items leave too few seeds, and are searched exactly: cut into pieces, at least so many of them as there are
more pieces than allowed edits occur unchanged, at places that differ by the edits at most. This finds every copy,
wherever it begins; its work grows with the number of short items.

Each candidate's item-sized window is verified by exact edit distance.

Items go to the tasks in blocks of bounded size, one after the other: while a block is searched in the whole
documents, only that block is in memory, and only the hits are kept. A null or empty text holds no item; an item
without letters or digits is never found; repeated items are found each, and repeated documents too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagekin.llm.common import blocks, dropped, fresh, new_folder, values, written

SIMILAR = 0.8
#: Walks, their most steps, and the share of the steps that is sampled.
REPEATS = 5
STEPS = 32
SAMPLED = 3 / 8
#: Items of so many words are verified where two of their words agree on a place (one, if no more can be walked),
#: shorter ones where one does.
FEW = 20
#: Items of fewer bytes are searched exactly, by pieces of at most so many bytes.
SHORT = 96
PIECE = 4
#: Occurrences of pieces that are looked at together.
MATCHES = 4_000_000
#: Bytes of items in a block.
ITEM_BYTES = 4_000_000
U = np.uint64
PLAIN = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))


def normalized(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts one after the other, a zero byte before each and zeros at the end; where each begins."""
    joined = b"\0" + b"\0".join(t.translate(PLAIN) for t in texts) + b"\0" * (STEPS + 1)
    codes = np.frombuffer(joined, np.uint8)
    space = codes == 32
    # a space is kept between two words only
    runs = space & np.concatenate(([False], space[:-1]))
    after = np.concatenate(([False], codes[:-1] == 0))
    keep = ~(runs | (space & after))
    codes = codes[keep]
    last = (codes == 32) & np.concatenate((codes[1:] == 0, [True]))
    codes = codes[~last]
    ends = np.flatnonzero(codes == 0)[: len(texts) + 1]
    return codes, ends + 1


def _unspaced() -> np.ndarray:
    """Which first two bytes of a code point stand for scripts written without spaces, or their punctuation."""
    found = np.zeros(1 << 16, bool)
    for first, last in ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1940, 0x1ABF), (0x1B00, 0x1BFF),
                        (0x2E80, 0xA4CF), (0xA980, 0xAADF), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF00, 0xFFEF),
                        (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF)):
        for point in range(first, last + 1, 32):
            one = chr(point).encode("utf-8")
            found[one[0] << 8 | one[1]] = True
    return found


UNSPACED = _unspaced()


def word_starts(codes: np.ndarray) -> np.ndarray:
    gap = (codes == 32) | (codes == 0)
    first = ~gap & np.concatenate(([True], gap[:-1]))
    wide = np.flatnonzero(codes[:-1] >= 0xE0)
    wide = wide[UNSPACED[codes[wide].astype(np.int32) << 8 | codes[wide + 1]]]
    if len(wide):
        runs = np.flatnonzero(first)
        held = np.zeros(len(runs), bool)
        held[np.searchsorted(runs, wide, "right") - 1] = True
        begins = runs[held]
        ends = np.flatnonzero(gap)
        ends = np.append(ends, len(codes))[np.searchsorted(ends, begins)]
        inside = np.zeros(len(codes) + 1, np.int8)
        inside[begins] += 1
        inside[ends] -= 1
        first |= (np.cumsum(inside[:-1], dtype=np.int8) > 0) & (codes & 0xC0 != 0x80)
    return np.flatnonzero(first)


def walk_plan(repeat: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Random bits of (step, byte) and which steps are sampled; the first always is."""
    rng = np.random.default_rng(1000 * steps + repeat)
    chosen = np.zeros(steps, bool)
    chosen[rng.choice(steps, max(1, int(steps * SAMPLED)), replace=False)] = True
    chosen[0] = True
    return rng.integers(0, 2, (steps, 256), dtype=np.int32).astype(np.intp), chosen


def walks(codes: np.ndarray, at: np.ndarray, repeat: int, steps: int, fits=None) -> tuple[np.ndarray, np.ndarray]:
    """The starts that are left and their hashes; ``fits(samples so far, hashes)`` ends walks early."""
    bits, chosen = walk_plan(repeat, steps)
    place, value, taken = at.astype(np.intp), np.zeros(len(at), np.uint64), 0
    for step in range(steps):
        byte = codes.take(place, mode="clip")  # places are within codes: this mode only leaves out the test
        if chosen[step]:
            value = (value ^ byte) * U(0x9E3779B97F4A7C15)
            value ^= value >> U(29)
            taken += 1
            if fits is not None and taken % 2 == 0 and len(at):
                left = np.flatnonzero(fits(taken, value))
                if len(left) < len(at):
                    at, place, value, byte = (x.take(left, mode="clip") for x in (at, place, value, byte))
        place += bits[step].take(byte, mode="clip")
    return at, value


def infix_distance(item: bytes, text: bytes, most: int) -> int:
    """Least edit distance of the item to a part of the text, or ``most`` + 1 (bit-parallel, any length)."""
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(item)) - 1, 1 << len(item) - 1
    plus, minus, distance, best = full, 0, len(item), len(item)
    for c in text:
        equal = masks.get(c, 0)
        vertical = equal | minus
        carry = (((equal & plus) + plus) ^ plus) | equal
        up = minus | ~(carry | plus) & full
        down = plus & carry
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        # a match may begin anywhere in the text, so nothing is carried in
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(vertical | up) & full, up & vertical
        if distance < best:
            best = distance
    return min(best, most + 1)


def pieces(size: int, most: int) -> tuple[int, int]:
    """Length of the pieces of an item and how many of them at least a copy with ``most`` edits leaves unchanged."""
    for length in range(min(PIECE, size), 0, -1):
        if size // length > most:
            return length, size // length - most
    return 1, 1


def grams(codes: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` bytes from each place on as a number."""
    count = max(0, len(codes) - length + 1)
    found = codes[:count].astype(np.uint32)
    for k in range(1, length):
        found = found << np.uint32(8) | codes[k: k + count]
    return found


class Index:
    """The walks and pieces of a block of items."""

    def __init__(self, items: list[tuple[int | None, str | None]], similar: float, repeats: int):
        self.similar, self.repeats = similar, repeats
        codes, starts = normalized([(t or "").encode("utf-8") for _, t in items])
        self.items = [codes[a:b - 1].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
        self.ids = [i for i, _ in items]
        words = word_starts(codes)
        owner = np.searchsorted(starts, words, "right") - 1
        sizes = np.array([len(t) for t in self.items] or [0])
        offset, rest = words - starts[owner], starts[owner] + sizes[owner] - words
        steps = np.array([1 << min(STEPS, n).bit_length() - 1 if n else 0 for n in sizes.tolist()])[owner]
        able = np.bincount(owner[rest >= steps], minlength=len(items))
        self.needed = np.where(np.bincount(owner, minlength=len(items)) >= FEW, np.minimum(able, 2), 1)
        slack = self.slack = ((1 - similar) * sizes + 1e-9).astype(np.int64)
        cut: dict[int, list[tuple[int, int, int]]] = {}
        for i in np.flatnonzero((sizes > 0) & (sizes < SHORT) & (np.arange(len(sizes)) < len(items))).tolist():
            length, self.needed[i] = pieces(len(self.items[i]), int(slack[i]))
            for at in range(0, len(self.items[i]) - length + 1, length):
                part = int.from_bytes(self.items[i][at:at + length], "big")
                cut.setdefault(length, []).append((part, i, at))
        self.pieces = []
        for length, rows in cut.items():
            keys, owners, places = np.array(sorted(rows), np.int64).T
            known = np.zeros(1 << 16, bool)
            known[self._mixed(keys.astype(np.uint32))] = True
            self.pieces.append((length, known, keys.astype(np.uint32), owners, places))
        steps = np.where(sizes[owner] < SHORT, 0, steps) if len(owner) else steps
        self.tables = []
        for count in sorted(set(steps.tolist()) - {0}):
            own = np.flatnonzero((steps == count) & (rest >= count))
            for repeat in range(repeats):
                seen: dict[int, np.ndarray] = {}

                def note(taken: int, value: np.ndarray, seen=seen) -> np.ndarray:
                    seen[taken] = np.zeros(1 << 16, bool)
                    seen[taken][value >> U(48)] = True
                    return np.ones(len(value), bool)

                _, value = walks(codes, words[own], repeat, count, note)
                order = np.argsort(value, kind="stable")
                self.tables.append((count, repeat, seen, value[order], owner[own][order], offset[own][order]))

    @staticmethod
    def _mixed(keys: np.ndarray) -> np.ndarray:
        return keys * np.uint32(2654435761) >> np.uint32(16)

    def _by_pieces(self, codes: np.ndarray, starts: np.ndarray) -> list[list[int]]:
        """(document, item, first and last begin) of the short items of which enough pieces and 3-grams occur.

        Slices overlap by more than a copy; a slice with more than ``MATCHES`` pieces is halved.
        """
        wide = 2 * SHORT  # no copy of a short item is as long
        codes = np.concatenate((np.zeros(wide, np.uint8), codes, np.zeros(wide, np.uint8)))
        triples = grams(codes, 3) if self.pieces else None
        found, todo = [], [(a, a + 1_000_000) for a in range(0, len(codes), 1_000_000)]
        while todo and self.pieces:
            a, b = todo.pop()
            part, hits = codes[a:b + wide], []
            for length, known, keys, owner, offset in self.pieces:
                value = grams(part, length)
                at = np.flatnonzero(known[self._mixed(value)])
                low, high = np.searchsorted(keys, value[at]), np.searchsorted(keys, value[at], "right")
                hits.append((at, low, high - low, owner, offset))
            if sum(n.sum() for _, _, n, _, _ in hits) > MATCHES and b - a > 2 * wide:
                todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
                continue
            spread = [(np.repeat(at, n), np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum()), owner, offset)
                      for at, low, n, owner, offset in hits]
            place = np.concatenate([at for at, _, _, _ in spread])
            item = np.concatenate([owner[k] for _, k, owner, _ in spread])
            # where the item would begin, moved by ``wide`` so that no number is negative
            key = item << 42 | place + a + wide - np.concatenate([offset[k] for _, k, _, offset in spread])
            order = np.argsort(key)
            key, item, place = key[order], item[order], place[order] + a
            last = np.arange(len(key)) + self.needed[item] - 1
            near = key[np.minimum(last, len(key) - 1)] - key <= self.slack[item] if len(key) else np.zeros(0, bool)
            near &= last < len(key)
            item, place, begin = item[near], place[near], (key[near] & (1 << 42) - 1) - wide
            kept = self._with_grams(triples, item, begin, np.zeros(len(item), np.int64))
            found.append(np.stack((np.searchsorted(starts + wide, place[kept], "right") - 1, item[kept], begin[kept]), 1))
        if not found:
            return []
        rows = np.unique(np.concatenate(found), axis=0)
        rows = rows[rows[:, 0] >= 0]
        if not len(rows):
            return []
        # begins of one copy lie next to each other
        new = (rows[1:, :2] != rows[:-1, :2]).any(1) | (rows[1:, 2] - rows[:-1, 2] > self.slack[rows[1:, 1]] + 1)
        first = np.flatnonzero(np.concatenate(([True], new)))
        last = np.append(first[1:], len(rows)) - 1
        moved = starts[rows[first, 0]] + wide
        return np.stack((rows[first, 0], rows[first, 1], rows[first, 2] - moved, rows[last, 2] - moved), 1).tolist()

    def _with_grams(self, triples: np.ndarray, item: np.ndarray, begin: np.ndarray, span: np.ndarray) -> np.ndarray:
        """Which candidates, that begin from ``begin`` to ``begin + span``, hold enough 3-grams of the item, each near
        its place: an edit changes three at most, and moves the others by one."""
        kept = np.ones(len(item), bool)
        for i in np.unique(item).tolist():
            own, room = grams(np.frombuffer(self.items[i], np.uint8), 3), int(self.slack[i])
            least = len(own) - 3 * room
            rows = np.flatnonzero(item == i)
            more = 2 * room + int(span[rows].max())
            step = max(1, 200_000 // (len(own) + more + 1))
            for a in range(0, len(rows) if least > 0 else 0, step):
                some = rows[a:a + step]
                at = (begin[some] - room)[:, None] + np.arange(len(own) + more)
                there = triples[np.clip(at, 0, len(triples) - 1)]
                held = np.zeros((len(some), len(own)), bool)
                for shift in range(more + 1):
                    held |= there[:, shift:shift + len(own)] == own
                kept[some] = held.sum(1) >= least
        return kept

    def find(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text the items in it: (item id, edit distance, similarity)."""
        found: list[list[tuple]] = [[] for _ in texts]
        codes, starts = normalized([(t or "").encode("utf-8", "replace") for t in texts])
        words = word_starts(codes)
        places, owners, offsets = [], [], []
        for count, repeat, seen, keys, owner, offset in self.tables:
            for a in range(0, len(words), 1_000_000):
                part, value = walks(codes, words[a:a + 1_000_000], repeat, count,
                                    lambda taken, v, seen=seen: seen[taken][v >> U(48)])
                low, high = np.searchsorted(keys, value), np.searchsorted(keys, value, "right")
                n = high - low
                k = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                places.append(np.repeat(part, n))
                owners.append(owner[k])
                offsets.append(offset[k])
        slack = self.slack
        candidates = self._by_pieces(codes, starts)
        if places:
            place, item, offset = (np.concatenate(x) for x in (places, owners, offsets))
            doc = np.searchsorted(starts, place, "right") - 1
            begin = place - starts[doc] - offset  # where the item would begin
            agreed = self._agreeing(doc, item, offset, begin, slack)
            if len(agreed):
                first = agreed[:, 2] + starts[agreed[:, 0]]
                agreed = agreed[self._with_grams(grams(codes, 3), agreed[:, 1], first, agreed[:, 3] - agreed[:, 2])]
            candidates += agreed.tolist()
        best: dict[tuple[int, int], int] = {}
        for d, i, low, high in candidates:
            room, size = int(slack[i]), len(self.items[i])
            first, end = starts[d] + low - room, starts[d] + high + size + room
            window = codes[max(first, starts[d]): max(0, min(end, starts[d + 1] - 1))]
            distance = best.get((d, i), room + 1)
            if distance:
                best[d, i] = min(distance, self._distance(i, window.tobytes(), room))
        for (d, i), distance in sorted(best.items()):
            if distance <= slack[i]:
                found[d].append((self.ids[i], distance, 1 - distance / len(self.items[i])))
        return found


    def _distance(self, i: int, window: bytes, room: int) -> int:
        """As ``infix_distance``; a window in which too few 4-grams of the item occur needs no more work,
        since an edit changes four of them at most."""
        item = self.items[i]
        if item in window:
            return 0
        grams = {window[k:k + 4] for k in range(len(window) - 3)}
        shared = sum(item[k:k + 4] in grams for k in range(len(item) - 3))
        return room + 1 if shared < len(item) - 3 - 4 * room else infix_distance(item, window, room)

    def _agreeing(self, doc, item, offset, begin, slack) -> np.ndarray:
        """(document, item, first and last begin) where enough words of an item point to one place.

        Begins of a true copy differ by the edits allowed at most, so they share a stretch of twice that
        in one of two rows of stretches.
        """
        found = []
        for shift in (0, 1):
            wide = 2 * (slack[item] + 1)
            stretch = (begin + shift * wide // 2) // wide
            rows = np.unique(np.stack((doc, item, stretch, offset, begin), 1), axis=0)
            if not len(rows):
                continue
            group = np.flatnonzero(np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(1))))
            words = np.concatenate(([1], (rows[1:, 3] != rows[:-1, 3]).astype(int)))
            words[group] = 1
            enough = np.add.reduceat(words, group) >= self.needed[rows[group, 1]]
            found.append(np.stack((rows[group, 0], rows[group, 1], np.minimum.reduceat(rows[:, 4], group),
                                   np.maximum.reduceat(rows[:, 4], group)), 1)[enough])
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)


HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("similarity", pa.float64())]))


def _searcher(sent, similar: float, repeats: int):
    @F.arrow_udf("array<struct<item_id:long,distance:int,similarity:double>>")
    def search(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(sent.value, similar, repeats)
        for texts in columns:
            hits = []
            for group in blocks(values(texts), lambda t: len(t or "") + 1, 2_000_000):
                for one in index.find(group):
                    hits.append([{"item_id": i, "distance": d, "similarity": s} for i, d, s in one])
            yield pa.array(hits, HIT)

    # otherwise the filter that Spark puts before an explode would search every text a second time
    return search.asNondeterministic()


def _parts(benchmark: DataFrame) -> tuple[DataFrame, int]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    return items, max(1, math.ceil(total / ITEM_BYTES))


def _sent(items: DataFrame, parts: int, part: int):
    """A block of items, about ``ITEM_BYTES``; longer only by what one very long item needs."""
    chosen = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else items
    return items.sparkSession.sparkContext.broadcast([tuple(r) for r in chosen.collect()])


def _found_in_blocks(docs: DataFrame, items: DataFrame, parts: int, similar: float, repeats: int) -> DataFrame:
    """key (SHA-256 of a text), item_id, distance and similarity, once per different text and item.

    One block of items after the other is sent, searched in all texts and let go.
    """
    spark = docs.sparkSession
    items = written(items, "items")
    path = new_folder(spark, "leaks")
    for part in range(parts):
        sent = _sent(items, parts, part)
        hits = docs.select("text", _searcher(sent, similar, repeats)("text").alias("hits")).filter(F.size("hits") > 0)
        hits = hits.select(F.sha2("text", 256).alias("key"), F.explode("hits").alias("hit")).select("key", "hit.*")
        hits.write.mode("append").parquet(path)
        sent.destroy()
    dropped(items)
    # copies of a text have the same hits; equal items of one id are found once each
    return spark.read.schema("key string, item_id long, distance int, similarity double").parquet(path)


def contaminated(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, repeats: int = REPEATS) -> DataFrame:
    """doc_id, item_id, distance and similarity of every document and item in it."""
    items, parts = _parts(benchmark)
    if parts == 1:
        hits = docs.select("doc_id", _searcher(_sent(items, 1, 0), similar, repeats)("text").alias("hits"))
        return hits.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")
    # an item that is listed twice is found twice: counted apart, hits of the copies of a text fall together
    once = items.groupBy("item_id", "text").agg(F.count("*").alias("times"))
    numbered = written(once.withColumn("no", F.monotonically_increasing_id()), "numbered")
    found = _found_in_blocks(docs, numbered.select(F.col("no").alias("item_id"), "text"), parts, similar, repeats)
    found = found.distinct().join(numbered.select(F.col("no"), F.col("item_id").alias("listed"), "times"),
                                  F.col("item_id") == F.col("no"))
    found = found.select("key", F.col("listed").alias("item_id"), "distance", "similarity",
                         F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    own = docs.select("doc_id", F.sha2("text", 256).alias("key"))
    return own.join(found, "key").select("doc_id", "item_id", "distance", "similarity")


def clean(docs: DataFrame, benchmark: DataFrame, similar: float = SIMILAR, repeats: int = REPEATS) -> DataFrame:
    """The documents that hold no item, with their columns."""
    items, parts = _parts(benchmark)
    if parts == 1:
        return docs.filter(F.size(_searcher(_sent(items, 1, 0), similar, repeats)("text")) == 0)
    found = _found_in_blocks(docs, items, parts, similar, repeats).select("key").distinct()
    key = fresh(docs, "_text_key")
    return docs.withColumn(key, F.sha2("text", 256)).join(
        found.withColumnRenamed("key", key), key, "left_anti").drop(key)
