"""Audit of how filters interact: what each removes in every order in which they can be applied.

A document is reduced to a mask of the filters it fails, and documents are counted by part and mask
(at most 2^n masks for n filters). The subsets of filters are then walked in Gray-code order, toggling
one filter at a time: every mask cell counts its active failures, a cell that gets its first one leaves
the survivors and one that loses its last comes back. The survivors of all subsets (32 states for five
filters) are kept; a step of any order is the difference of two of them.

A filter can test a row by itself or be the table-wide one that fails every copy of a text with a smaller
id. Copies are found without joining rows back: rows of equal text, part, mask and labels are counted
before the shuffle with their smallest id, so a text that a third of all rows share is a few rows a task.
Texts are compared by their 256-bit digests.

Null text counts as empty, null part as the empty string. A null id has no label, is never the smaller
one and fails no comparison of ids. Repeated rows count each by itself; rows of equal id and text are
not copies of each other. With several labels of an id, one that says 1 is enough. Texts are read whole,
however long. Without rows there are no parts and no result. Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPACE = r"[\x20\x09-\x0D]+"
#: Orders grow with the factorial of the number of filters.
MOST_FILTERS = 8
COUNTS = ("n", "good", "toxic")


def text_rules(text: Column, least_words: int = 200, distinct: int = 50, capitals: int = 3,
               marks: str = "[#$%&*|]") -> dict[str, Column]:
    """Failure conditions A to D of a text without nulls; shares in hundredths."""
    words = F.array_remove(F.split(text, SPACE), "")
    return {
        "A": F.size(words) < least_words,
        "B": 100 * F.size(F.array_distinct(words)) < distinct * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > capitals * F.length(text),
        "D": text.rlike(marks),
    }


def _mask(rules: dict[str, Column], names: str) -> Column:
    mask = F.lit(0)
    for k, name in enumerate(names):
        if name in rules:
            mask = mask + F.when(rules[name], 1 << k).otherwise(0)
    return mask


def cells(docs: DataFrame, labels: DataFrame, rules: dict[str, Column], copies: str | None, part: str = "lang",
          text: str = "text") -> DataFrame:
    """part, mask, n, good and toxic: documents counted by part and the filters that they fail.

    Bit k of a mask is the k-th filter in alphabetical order; ``copies`` names the table-wide one.
    """
    names = "".join(sorted([*rules, *([copies] if copies else [])]))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(body, 256)).alias("digest"), _mask(rules, names).alias("mask"))
    said = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(said, "id", "left").fillna(0, ["good", "toxic"])
    group = ["part", "mask", "good", "toxic"]
    if not copies:
        counted = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    else:
        # by id first: the join has dealt the rows by it, and equal rows become one
        one = rows.groupBy("id", "digest", *group).agg(F.count(F.lit(1)).alias("m"))
        same = one.groupBy("digest", *group).agg(
            F.sum("m").alias("all"), F.sum(F.when(F.col("id").isNotNull(), F.col("m")).otherwise(0)).alias("known"),
            F.min("id").alias("least"), F.min_by("m", "id").alias("least_n"))
        first = F.min("least").over(Window.partitionBy("digest"))  # a row a part and label of a text
        later = F.col("known") - F.when(F.col("least") == first, F.col("least_n")).otherwise(0)
        told = same.withColumn("later", later)
        bit = 1 << names.index(copies)
        counted = told.select(*group, F.explode(F.array(
            F.struct(F.lit(bit).alias("add"), F.col("later").alias("k")),
            F.struct(F.lit(0).alias("add"), (F.col("all") - F.col("later")).alias("k")))).alias("c")).select(
            "part", (F.col("mask") + F.col("c.add")).alias("mask"), "good", "toxic", F.col("c.k").alias("n")).filter("n > 0")
    return counted.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"),
        F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def survivors(masks: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """What stays under each subset of n filters: a row of ``counts`` summed a subset, by a Gray-code walk."""
    left = counts.sum(0)
    states = np.empty((1 << n, counts.shape[1]), np.int64)
    states[0] = left
    failing = np.zeros(len(masks), np.int64)  # active filters that a cell fails
    subset = 0
    for step in range(1, 1 << n):
        bit = (step & -step).bit_length() - 1
        subset ^= 1 << bit
        hit = masks >> bit & 1 == 1
        if subset >> bit & 1:
            left = left - counts[hit & (failing == 0)].sum(0)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            left = left + counts[hit & (failing == 0)].sum(0)
        states[subset] = left
    return states


def steps(states: np.ndarray, names: str) -> dict[str, list]:
    """Every step of every order as differences of states."""
    n, every = len(names), len(states) - 1
    found: dict[str, list] = {c: [] for c in ("filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                                              "good_lost", "toxic_lost", "shapley")}
    share = [0] * n
    for order in permutations(range(n)):
        before = 0
        for at, k in enumerate(order):
            after = before | 1 << k
            lost = (states[before] - states[after]).tolist()
            fails = int(states[0, 0] - states[1 << k, 0])
            share[k] += lost[0]
            values = ("".join(names[i] for i in order), at + 1, int(states[after, 0]), lost[0], fails - lost[0],
                      int(states[every ^ 1 << k, 0] - states[every, 0]), lost[1], lost[2], k)
            for column, value in zip(found.values(), values, strict=True):
                column.append(value)
            before = after
    found["shapley"] = [share[k] for k in found["shapley"]]
    assert len(found["step"]) == n * factorial(n)
    return found


def audited(docs: DataFrame, labels: DataFrame, rules: dict[str, Column], copies: str | None = None,
            part: str = "lang", text: str = "text") -> DataFrame:
    """A row a part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    ``rules`` maps single letters to failure conditions over ``docs``; ``copies`` is the letter of the table-wide
    filter. A part's cells, at most 2^n rows, meet in one task.
    """
    names = "".join(sorted([*rules, *([copies] if copies else [])]))
    if len(names) > MOST_FILTERS or len(set(names)) < len(names) or not names:
        raise ValueError(f"1 to {MOST_FILTERS} filters with a letter each")

    def walk(table: pa.Table) -> pa.Table:
        counts = np.stack([table.column(c).to_numpy() for c in COUNTS], 1)
        found = steps(survivors(table.column("mask").to_numpy(), counts, len(names)), names)
        value = table.column("part")[0].as_py()
        columns = [pa.array([value] * len(found["step"]), pa.string())]
        for name, column in found.items():
            columns.append(pa.array(column, {"filter_order": pa.string(), "step": pa.int32()}.get(name, pa.int64())))
        return pa.table(columns, names=["part", *found])

    schema = "part string, filter_order string, step int, " + ", ".join(
        f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return cells(docs, labels, rules, copies, part, text).groupBy("part").applyInArrow(walk, schema)
