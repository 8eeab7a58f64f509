"""The near-duplicate stage of the pipeline: five words and 0.80, against all pairs."""

import random

import corpus_pipeline


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))}


def test_near_copies_of_the_stage(spark):
    rng = random.Random(6)
    rows = []
    for k in range(40):
        words = [f"w{rng.randrange(10_000)}" for _ in range(200)]
        more = [f"x{rng.randrange(10_000)}" for _ in range(rng.randint(20, 60))]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + more))]
    sets = [shingles(t) for _, t in rows]
    copies = {b for a in range(len(rows)) for b in range(a + 1, len(rows))
              if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert 0 < len(copies) < 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()}
    assert kept == set(range(len(rows))) - copies
