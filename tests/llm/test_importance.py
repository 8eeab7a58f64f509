"""The draw against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stagekin.llm import importance, queries

LONG = " ".join(f"w{k}" for k in range(5_000))
ROWS = [(k, f"some words of document {k % 4} " * (k % 9)) for k in range(60)] + [
    (100, None), (101, ""), (102, "?!"), (103, LONG), (104, "z" * 3000 + " 一é A-B " + "y" * 600), (None, LONG), (105, LONG), (105, LONG),
    (105, LONG + " more")]
TARGET = [(1, "some words"), (2, None), (3, "w1 w2 w3 W4, and w5")]


def features(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)
    return words, [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def plain(docs, target):
    source = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    wanted = Counter(bucket(f) for _, t in target for f in features(t)[1])
    s_all, t_all = sum(source.values()) + 10_000, sum(wanted.values()) + 10_000
    found = []
    for i, text in docs:
        words, all_features = features(text)
        total = sum(math.floor(1000 * math.log((wanted[b] + 1) * s_all / ((source[b] + 1) * t_all)))
                    for b in map(bucket, all_features))
        weight = total // len(all_features) if all_features else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        found.append([i, len(all_features), weight, score, None, len(words)])
    able = sorted((r for r in found if r[5] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0], r[2], r[1]))
    for k, row in enumerate(able[: 25 * len(able) // 100], 1):
        row[4] = k
    return sorted((tuple(r[:5]) for r in found), key=repr)


def drawn(docs, target):
    found = importance.drawn(docs, target)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_nulls_long_words_and_repeated_rows(spark):
    docs = spark.createDataFrame([(*row, 1, "x") for row in ROWS], "doc_id long, text string, weight int, part string")
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    assert drawn(docs, target) == plain(ROWS, TARGET)
    assert drawn(docs, target.limit(0)) == plain(ROWS, [])
    assert drawn(docs.limit(0), target) == []


def test_ranks_run_over_many_partitions(spark):
    rows = [(k, " ".join(f"w{(k * j) % 17}" for j in range(20 + k % 5))) for k in range(4_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    target = spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")
    assert drawn(docs, target) == plain(rows, [(1, "w1 w2 w3")])


def test_the_documents(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    target = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op13_importance(spark, folder).collect()), key=repr)
    assert got == plain(docs, target)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=30))
def test_checksums(parts):
    stream = np.frombuffer(b"".join(parts) + b".", np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    found = importance.checksums(stream, np.cumsum(sizes) - sizes, sizes)
    assert found.tolist() == [zlib.crc32(p) for p in parts]


def test_longer_runs():
    (n, found), (none, empty) = importance.buckets(["a b c d", "?"], most=3)
    want = ["a", "b", "c", "d", "a b", "b c", "c d", "a b c", "b c d"]
    assert n == 4 and found.tolist() == [bucket(f) for f in want] and (none, len(empty)) == (0, 0)
