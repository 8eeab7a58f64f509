"""Versioned tables made of parts; a commit writes only what it changes.

A table is a list of parts, each a folder of Parquet files: the rows that one commit wrote for one
*cell*. Rows of a keyed table belong to the cell of a hash of their key, rows of a log to the day of
their time. A commit adds parts, and replaces all parts of the cells it rewrites; the parts of other
cells are carried over by name. The version is one small file naming all parts with their row counts
and the range of an id or a time, so readers leave out parts without opening them; it is moved into
place under its number only if no other writer has taken it, and all tables of a job appear together.

``transact`` repeats a job on the newest version if another writer changed what the job had read;
writers of different cells, and of logs, pass each other. Keys and references are checked before the
version appears. A stream stores the number of its last batch in the version, so that a repeated
batch changes nothing. ``compact`` merges small parts.

The driver holds one line a part: days, or seasons times buckets, times the commits since the last
merge. Building a commit runs its jobs; nothing is visible before the last step.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stagekin.schemas import TABLES
from stagekin.sources.tables import empty_table

#: Buckets of a keyed table that is written for the first time; ``deal`` gives a grown table more.
BUCKETS = 16
#: Tables that are written or checked at the same time.
AT_ONCE = 4


@dataclass(frozen=True)
class Layout:
    """How a table is dealt into cells, and what holds for its rows."""

    by: tuple[str, ...]  #: columns whose hash is the cell; of a log the time whose day it is
    span: str  #: column whose least and greatest value a part keeps
    daily: bool = False
    key: tuple[str, ...] = ()  #: unique where no column is null
    parent: tuple[str, str, str] | None = None  #: column, table and column it refers to
    folders: tuple[str, ...] = ()  #: more partition columns, for pruning by value

    @property
    def cell(self) -> str:
        return "day" if self.daily else "bucket"


LAYOUTS = {
    "stage_profiles": Layout(("pcs_url",), "id", key=("pcs_url",), folders=("season",)),
    "stage_climbs": Layout(("stage_id",), "stage_id", key=("stage_id", "climb_order"), parent=("stage_id", "stage_profiles", "id")),
    "stage_results": Layout(("stage_id",), "stage_id", key=("stage_id", "rank"), parent=("stage_id", "stage_profiles", "id")),
    "race_startlists": Layout(("race_slug", "season"), "season", key=("race_slug", "season", "rider_url"), folders=("season",)),
    "page_state": Layout(("url",), "fetched_at", key=("url",)),
    "raw_pages": Layout(("fetched_at",), "fetched_at", daily=True),
    "sync_failures": Layout(("occurred_at",), "occurred_at", daily=True),
    "sync_runs": Layout(("finished_at",), "finished_at", daily=True),
}


class Conflict(Exception):
    """Another writer changed what this commit had read."""


class Broken(Exception):
    """A commit would break a key or a reference."""


@dataclass(frozen=True)
class Part:
    path: str  #: below the table's folder
    cell: str
    rows: int
    low: int | str | None
    high: int | str | None


@dataclass(frozen=True)
class Table:
    buckets: int = 0
    parts: tuple[Part, ...] = ()

    def of(self, cells: set[str]) -> set[Part]:
        return {p for p in self.parts if p.cell in cells}


@dataclass(frozen=True)
class Change:
    """Rows to add to a table in place of all rows of the cells ``replaces`` (None: of every cell).

    ``whole``: the rows depend on all of the table, for instance on its highest id. ``buckets``: their new number,
    if every cell is replaced.
    """

    name: str
    rows: DataFrame
    replaces: set[str] | None = field(default_factory=set)
    whole: bool = False
    buckets: int | None = None


@dataclass(frozen=True)
class Snapshot:
    """One version: what it holds never changes."""

    spark: SparkSession
    root: str
    version: int = 0
    tables: dict[str, Table] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def table(self, name: str) -> Table:
        return self.tables.get(name) or Table(0 if LAYOUTS[name].daily else BUCKETS)

    def cells(self, name: str, keys: DataFrame) -> set[str]:
        """The cells of a keyed table in which rows with these keys are; at most one row a cell is collected."""
        by = LAYOUTS[name].by
        typed = keys.select(*[F.col(c).cast(TABLES[name][c].dataType) for c in by])  # a hash depends on the type
        cell = _bucket(by, self.table(name).buckets)
        return {str(row[0]) for row in typed.select(cell.alias("cell")).distinct().collect()}

    def highest(self, name: str) -> int:
        return max((p.high for p in self.table(name).parts if p.high is not None), default=0)

    def load(self, name: str, cells: set[str] | None = None,
             between: tuple[datetime, datetime] | None = None) -> DataFrame:
        """A table, or its rows in some cells, or those of a log with a time in [low, high)."""
        layout, parts = LAYOUTS[name], self.table(name).parts
        if cells is not None:
            parts = [p for p in parts if p.cell in cells]
        if between:
            low, high = (t.isoformat(sep=" ") for t in between)
            parts = [p for p in parts if p.low is not None and p.low < high and p.high >= low]
        rows = _read(self.spark, self.root, name, [p.path for p in parts])
        if between:
            inside = (F.col(layout.span) >= F.lit(low).cast("timestamp")) & (F.col(layout.span) < F.lit(high).cast("timestamp"))
            low, high = between
            days = (F.col("day") >= F.lit(low.date())) & (F.col("day") <= F.lit(high.date())) if layout.daily else F.lit(True)
            rows = rows.filter(days & inside)
        return rows.select(*TABLES[name].names)


def _bucket(columns: tuple[str, ...], buckets: int):
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, root: str, name: str, paths: list[str]) -> DataFrame:
    """Parts with their partition columns."""
    layout = LAYOUTS[name]
    schema = f"segment string, {layout.cell} {'date' if layout.daily else 'int'}"
    if not paths:
        nothing = empty_table(spark, name)
        return nothing.withColumns({c: F.lit(None).cast(t) for c, t in (x.split() for x in schema.split(", "))})
    base = f"{root}/{name}"
    full = TABLES[name].simpleString()[len("struct<"):-1].replace(":", " ")
    return spark.read.schema(f"{full}, {schema}").option("basePath", base).parquet(*[f"{base}/{p}" for p in paths])


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _files(spark, path)
    return files.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    target, files = _files(spark, path)
    files.delete(target, True)


def version(spark: SparkSession, root: str) -> int:
    """The newest version; 0 before the first commit."""
    target, files = _files(spark, f"{root}/_manifest")
    if not files.exists(target):
        return 0
    names = [status.getPath().getName() for status in files.listStatus(target)]
    return max((int(n[2:-5]) for n in names if n.startswith("v=") and n.endswith(".json")), default=0)


def snapshot(spark: SparkSession, root: str, number: int | None = None) -> Snapshot:
    number = version(spark, root) if number is None else number
    if not number:
        return Snapshot(spark, root)
    target, files = _files(spark, f"{root}/_manifest/v={number:012d}.json")
    stream = files.open(target)
    try:
        told = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    tables = {name: Table(t["buckets"], tuple(Part(*p) for p in t["parts"])) for name, t in told["tables"].items()}
    return Snapshot(spark, root, number, tables, told["batches"])


_claiming = threading.Lock()


def _claimed(after: Snapshot) -> bool:
    """Moves the version file to its number; False if that number is taken.

    The move of the file system refuses an existing target. A local one checks and moves in two steps, which the
    lock covers for the writers of this process.
    """
    spark, jvm = after.spark, after.spark._jvm
    told = {"tables": {n: {"buckets": t.buckets, "parts": [[p.path, p.cell, p.rows, p.low, p.high] for p in t.parts]}
                       for n, t in after.tables.items()}, "batches": after.batches}
    source, files = _files(spark, f"{after.root}/_manifest/.new-{uuid.uuid4().hex}")
    stream = files.create(source, False)
    try:
        stream.write(bytearray(json.dumps(told).encode("utf-8")))
    finally:
        stream.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{after.root}/_manifest/v={after.version:012d}.json")
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    plain = spark.sparkContext._gateway.new_array(kind, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
    with _claiming:
        try:
            context.rename(source, target, plain)
            return True
        except Exception:
            if not files.exists(target):
                raise
            files.delete(source, False)
            return False


def _write(base: Snapshot, change: Change, segment: str) -> tuple[Part, ...]:
    """Writes the rows of a change as a new segment: its parts."""
    spark, name = base.spark, change.name
    layout, buckets = LAYOUTS[name], change.buckets or base.table(name).buckets
    rows = change.rows.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name]])
    cell = F.to_date(layout.by[0]) if layout.daily else _bucket(layout.by, buckets)
    folders = [*layout.folders, layout.cell]
    # Rebalancing gives files of even size: it merges small ones and splits a hot partition.
    rows = rows.withColumn(layout.cell, cell).hint("rebalance", *folders)
    rows.write.partitionBy(*folders).parquet(f"{base.root}/{name}/{segment}")
    written = _read(spark, base.root, name, [segment])
    files = written.groupBy(F.col("_metadata.file_path").alias("file"), F.col(layout.cell).cast("string").alias("cell")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(layout.span).alias("low"), F.max(layout.span).alias("high"))
    place = F.regexp_extract("file", f"/({segment}/.*)/[^/]*$", 1).alias("path")  # once a file, not once a row
    low, high = F.min("low"), F.max("high")
    if TABLES[name][layout.span].dataType.typeName() == "timestamp":
        low, high = (F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS") for x in (low, high))
    found = files.groupBy(place, "cell").agg(F.sum("rows").alias("rows"), low.alias("low"), high.alias("high"))
    return tuple(Part(r.path, r.cell or "", r.rows, r.low, r.high) for r in found.collect())


def _merged(base: Snapshot, changes: list[Change], added: list[tuple[Part, ...]]) -> dict[str, Table]:
    tables = dict(base.tables)
    for change, parts in zip(changes, added, strict=True):
        before = replace(base.table(change.name), parts=tables.get(change.name, Table()).parts)
        kept = () if change.replaces is None else tuple(p for p in before.parts if p.cell not in change.replaces)
        tables[change.name] = Table(change.buckets or before.buckets, kept + parts)
    return tables


def _check(after: Snapshot, change: Change, parts: tuple[Part, ...]) -> None:
    """Keys of the cells that were written are unique in them, and new rows refer to rows that are there."""
    layout, name = LAYOUTS[change.name], change.name
    if not parts:
        return
    if layout.key:
        rows = after.load(name, {p.cell for p in parts}).select(*layout.key).dropna()
        double = rows.groupBy(*layout.key).count().filter("count > 1").first()
        if double:
            raise Broken(f"{name}: {double['count']} rows of {tuple(double)[:-1]}")
    if layout.parent:
        column, parent, key = layout.parent
        new = _read(after.spark, after.root, name, [p.path for p in parts]).select(F.col(column).alias(key)).dropna().distinct()
        lost = new.join(after.load(parent).select(key).hint("merge"), key, "left_anti").first()
        if lost:
            raise Broken(f"{name}: no row of {parent} has {key} {lost[0]}")


def _at_once(task: Callable, *arguments: list) -> list:
    """The task for each change, a few at a time: the last tasks of one table leave cores for the next."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(task, *arguments))


def _passed(base: Snapshot, now: Snapshot, changes: list[Change], added: list[tuple[Part, ...]]) -> bool:
    """Whether nothing that the changes were made from has changed since."""
    for change, parts in zip(changes, added, strict=True):
        before, after = base.table(change.name), now.table(change.name)
        if change.whole or change.replaces is None:
            if set(before.parts) != set(after.parts):
                return False
        cells = set(change.replaces or ())
        if LAYOUTS[change.name].key:
            cells |= {p.cell for p in parts}
        if before.of(cells) != after.of(cells):
            return False
        parent = LAYOUTS[change.name].parent
        if parent and not set(base.table(parent[1]).parts) <= set(now.table(parent[1]).parts):
            return False
    return True


def publish(base: Snapshot, changes: list[Change], batch: tuple[str, int] | None = None) -> int:
    """Writes the changes made from ``base`` and claims the next version; ``Conflict`` if they no longer fit."""
    spark = base.spark
    segments = [f"segment={uuid.uuid4().hex}" for _ in changes]
    try:
        added = _at_once(lambda change, segment: _write(base, change, segment), changes, segments)
        now = base
        while True:
            batches = {**now.batches, **({batch[0]: batch[1]} if batch else {})}
            after = Snapshot(spark, base.root, now.version + 1, _merged(now, changes, added), batches)
            if now is base:
                _at_once(lambda change, parts: _check(after, change, parts), changes, added)
            if _claimed(after):
                return after.version
            now = snapshot(spark, base.root)
            if batch and now.batches.get(batch[0], -1) >= batch[1]:
                raise Conflict(f"batch {batch} is there already")
            if not _passed(base, now, changes, added):
                raise Conflict(f"version {now.version} changed what version {base.version} was read for")
    except Exception:
        for change, segment in zip(changes, segments, strict=True):
            remove(spark, f"{base.root}/{change.name}/{segment}")
        raise


def transact(spark: SparkSession, root: str, build: Callable[[Snapshot], list[Change]],
             batch: tuple[str, int] | None = None, attempts: int = 10) -> int:
    """The version in which the changes that ``build`` makes from a snapshot are; repeated after a conflict.

    ``batch`` (stream, number): nothing is done if that stream has committed this number or a later one.
    """
    for attempt in range(attempts):
        base = snapshot(spark, root)
        if batch and base.batches.get(batch[0], -1) >= batch[1]:
            return base.version
        try:
            return publish(base, build(base), batch)
        except Conflict:
            if attempt == attempts - 1:
                raise
    raise ValueError("no attempts")


def rehearse(spark: SparkSession, root: str, build: Callable[[Snapshot], list[Change]], sample: int = 5) -> dict:
    """Computes all changes and writes nothing: rows and a few of them, by table."""
    found = {}
    for change in build(snapshot(spark, root)):
        seen = Observation()
        rows = change.rows.observe(seen, F.count(F.lit(1)).alias("rows"))
        rows.write.format("noop").mode("overwrite").save()
        found[change.name] = (seen.get["rows"], change.rows.limit(sample).collect())
    return found


def load(spark: SparkSession, root: str, name: str, between: tuple[datetime, datetime] | None = None) -> DataFrame:
    return snapshot(spark, root).load(name, between=between)


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Whole tables in place of what is there."""
    return publish(snapshot(spark, root), [Change(name, rows, None) for name, rows in tables.items()])


def append(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Rows added to logs; no other part is read or written."""
    return publish(snapshot(spark, root), [Change(name, rows) for name, rows in tables.items()])


def compact(spark: SparkSession, root: str, name: str, least_parts: int = 2) -> int:
    """Merges the parts of cells that have grown to ``least_parts`` in a folder; rows stay as they are."""
    def build(base: Snapshot) -> list[Change]:
        folders: dict[str, int] = {}
        cells = set()
        for part in base.table(name).parts:
            folder = part.path.split("/", 1)[1]
            folders[folder] = folders.get(folder, 0) + 1
            if folders[folder] >= least_parts:
                cells.add(part.cell)
        return [Change(name, base.load(name, cells), cells)] if cells else []

    return transact(spark, root, build)


def deal(spark: SparkSession, root: str, name: str, buckets: int) -> int:
    """Deals a keyed table into another number of buckets; rows stay as they are."""
    return transact(spark, root, lambda base: [Change(name, base.load(name), None, buckets=buckets)])


def vacuum(spark: SparkSession, root: str, versions: int = 10, hours: float = 24) -> int:
    """Deletes segments that none of the newest ``versions`` names and older version files; the number of both.

    Segments younger than ``hours`` stay, since a writer may be about to publish them.
    """
    newest = version(spark, root)
    kept = range(max(1, newest - versions + 1), newest + 1)
    named = {f"{name}/{part.path.split('/')[0]}" for number in kept
             for name, table in snapshot(spark, root, number).tables.items() for part in table.parts}
    oldest = time.time() - hours * 3600
    gone = [f"_manifest/v={number:012d}.json" for number in range(1, kept.start)
            if exists(spark, f"{root}/_manifest/v={number:012d}.json")] if newest else []
    for name in LAYOUTS:
        target, files = _files(spark, f"{root}/{name}")
        for status in files.listStatus(target) if files.exists(target) else ():
            path = f"{name}/{status.getPath().getName()}"
            if path not in named and status.getModificationTime() / 1000 < oldest:
                gone.append(path)
    for path in gone:
        remove(spark, f"{root}/{path}")
    return len(gone)
