"""The filter audit against every order applied document by document."""

from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stagekin.llm import filter_audit, queries

LONG = " ".join(f"word{k}" for k in range(400))
DOCS = [(1, LONG, "en"), (2, LONG, "en"), (3, LONG, None), (3, LONG, None), (0, None, ""), (4, "", "en"), (5, LONG.upper(), "de"),
        (6, "a b " * 300, "de"), (7, "tag #x " * 200, "de"), (None, LONG, "en"), (None, "", None), (8, "É一" * 9000, "en"),
        (9, LONG + " $", "en"), (10, LONG + " $", "en")]
LABELS = [(1, 1, 0), (1, 0, 1), (2, None, 1), (5, 1, None), (None, 1, 1), (9, 1, 1), (10, 1, 1), (99, 1, 1)]
NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failed(row, docs):
    i, text, _ = row
    text = text or ""
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]
    copy = any(o is not None and i is not None and o < i and (t or "") == text for o, t, _ in docs)
    return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in "#$%&*|" for c in text), "E": copy}


def plain(docs, labels):
    found = {}
    fails = [failed(row, docs) for row in docs]
    good = [any(i is not None and i == row[0] and q == 1 for i, q, _ in labels) for row in docs]
    toxic = [any(i is not None and i == row[0] and t == 1 for i, _, t in labels) for row in docs]
    for part in {p or "" for _, _, p in docs}:
        rows = [k for k, (_, _, p) in enumerate(docs) if (p or "") == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(rows)
            for step, f in enumerate(order, 1):
                gone = [k for k in left if fails[k][f]]
                left = [k for k in left if not fails[k][f]]
                share[f] += len(gone)
                found[part, "".join(order), step] = [
                    len(left), len(gone), sum(fails[k][f] for k in rows) - len(gone),
                    sum(fails[k][f] and sum(fails[k].values()) == 1 for k in rows), sum(good[k] for k in gone),
                    sum(toxic[k] for k in gone)]
        for (p, order, step), values in found.items():
            if p == part:
                values.append(share[order[step - 1]])
    return found


def audit(docs, labels):
    return filter_audit.audited(docs, labels, filter_audit.text_rules(F.coalesce("text", F.lit(""))), copies="E")


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(*row, 1, "x") for row in DOCS], "doc_id long, text string, lang string, mask int, part string")
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_nulls_copies_and_clashing_columns(tables):
    found = {(r.part, r.filter_order, r.step): [r[c] for c in NAMES] for r in audit(*tables).collect()}
    assert found == plain(DOCS, LABELS) and len(found) == 3 * 600


def test_no_rows(tables):
    docs, labels = tables
    assert audit(docs.limit(0), labels).count() == 0
    assert audit(docs, labels.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_without_the_table_wide_filter(tables):
    docs, labels = tables
    found = filter_audit.audited(docs, labels, {"X": F.col("doc_id") > 5}).collect()
    assert {(r.part, r.step, r.removed, r.kept, r.shapley) for r in found} == {("", 1, 0, 4, 0), ("de", 1, 2, 1, 2), ("en", 1, 3, 4, 3)}
    with pytest.raises(ValueError):
        filter_audit.audited(docs, labels, {})


def test_the_documents(spark, folder):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    rows = queries.op11_filter_audit(spark, folder).collect()
    assert {(r.part, r.filter_order, r.step): [r[c] for c in NAMES] for r in rows} == plain(docs, labels)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6).flatmap(lambda n: st.tuples(
    st.just(n), st.lists(st.tuples(st.integers(0, 2 ** n - 1), st.integers(0, 9)), max_size=20))))
def test_states_of_all_subsets(case):
    n, rows = case
    masks = np.array([m for m, _ in rows], np.int64)
    counts = np.array([[c] for _, c in rows], np.int64).reshape(-1, 1)
    states = filter_audit.survivors(masks, counts, n)
    assert states[:, 0].tolist() == [sum(c for m, c in rows if not m & s) for s in range(2 ** n)]
