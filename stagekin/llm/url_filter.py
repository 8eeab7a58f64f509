"""Allow and block rules on urls, found by a trie over reversed host labels and path segments.

A rule (host, path, verdict) fits its host and all subdomains where the url's path starts with the
rule's path. The rule with the longest host decides, then the one with the longest path; of two
rules with the same host and path the blocking one. Urls that no rule fits get ``default``.
Null urls and urls without ``://`` have empty host and path, which no rule with a host fits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagekin.llm.common import fresh, sent_if_small, written

Rule = tuple[str, str, str]
#: Rules in at most so many characters are sent to every task as a trie; more are joined.
TRIE_CHARS = 8_000_000


class Trie:
    """Nodes are [children by label, tails by text, sorted tail lengths]; a host node holds a path trie.

    The last piece of a rule's path may stop inside a segment of the url, so it is kept as a tail
    of its node; all earlier pieces are whole segments.
    """

    def __init__(self, rules: list[Rule]):
        self.root: dict = {"labels": {}, "paths": None}
        for host, path, verdict in sorted(rules, key=lambda r: (r[0], r[1], r[2] == "block")):
            node = self.root
            for label in reversed(host.split(".")):
                node = node["labels"].setdefault(label, {"labels": {}, "paths": None})
            node["paths"] = node["paths"] or {"segments": {}, "tails": {}}
            at = node["paths"]
            *whole, tail = path.split("/")
            for segment in whole:
                at = at["segments"].setdefault(segment, {"segments": {}, "tails": {}})
            at["tails"][tail] = (host + path, verdict)
        self._measure(self.root)

    @classmethod
    def of(cls, root: dict) -> Trie:
        trie = cls([])
        trie.root = root
        return trie

    def _measure(self, root: dict) -> None:
        todo = [root]
        while todo:
            node = todo.pop()
            if "tails" in node:
                node["lengths"] = sorted({len(t) for t in node["tails"]}, reverse=True)
            todo += [*node.get("labels", {}).values(), *node.get("segments", {}).values()]
            if node.get("paths"):
                todo.append(node["paths"])

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """Rule and verdict, or None."""
        node, best, segments = self.root, None, path.split("/")
        for label in reversed(host.split(".")):
            node = node["labels"].get(label)
            if node is None:
                break
            if node["paths"]:
                best = self._longest(node["paths"], segments) or best
        return best

    @staticmethod
    def _longest(at: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            for length in at["lengths"]:
                if found := len(segment) >= length and at["tails"].get(segment[:length]):
                    best = found
                    break
            at = at["segments"].get(segment)
            if at is None:
                break
        return best


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path: what follows the first ``://``, each up to its end marks."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judged(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule and verdict; columns of these names are replaced.

    The trie is sent to the tasks only if the rules have at most ``TRIE_CHARS`` characters.
    """
    if sum(len(h) + len(p) for h, p, _ in rules) > TRIE_CHARS:
        return judged_by_join(df, df.sparkSession.createDataFrame(rules, "host string, path string, verdict string"),
                              url, default)
    sent = df.sparkSession.sparkContext.broadcast(Trie(rules).root)

    @F.pandas_udf("rule string, verdict string")
    def look_up(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = Trie.of(sent.value)
        for hosts, paths in parts:
            found = [trie.find(h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    host, path = url_parts(F.col(url))
    own = fresh(df, "_judged")
    found = df.withColumns({"host": host, "path": path}).withColumn(own, look_up("host", "path"))
    return found.withColumns({"rule": F.col(f"{own}.rule"), "verdict": F.col(f"{own}.verdict")}).drop(own)


def judged_by_join(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The same for rule tables of any size: host suffixes and path prefixes of the distinct
    (host, path) pairs meet the rules in an equality join, and the longest one is kept.

    Only prefixes as long as the path of some rule of that host are made, so a very long path costs no more
    than the rules. Repeated urls are judged once and each gets the verdict; a small table of the lengths is written
    when the query is built.
    """
    host, path = url_parts(F.col(url))
    parsed = df.withColumns({"host": host, "path": path})
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumnsRenamed(
        {"host": "_rule_host", "path": "_rule_path"})
    own = fresh(df, "_judged")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = sent_if_small(written(rules.select("_rule_host", F.length("_rule_path").alias("_n")).distinct(), "rule-lengths"))
    tried = parsed.select("host", "path").distinct().withColumn("_rule_host", F.explode(suffixes)).join(
        lengths, "_rule_host").filter("_n <= length(path)").withColumn("_rule_path", F.expr("substring(path, 1, _n)"))
    rank = F.length("_rule_host").cast("long") * (1 << 32) + F.length("_rule_path")
    best = tried.join(rules, ["_rule_host", "_rule_path"]).groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("_rule_host", "_rule_path").alias("rule"), "verdict"), rank).alias(own))
    found = parsed.drop("rule", "verdict").join(best, ["host", "path"], "left")
    return found.withColumns({"rule": F.col(f"{own}.rule"),
                              "verdict": F.coalesce(f"{own}.verdict", F.lit(default))}).drop(own)
