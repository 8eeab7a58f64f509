"""Near-duplicate vectors of a label: spherical k-means cells, blocked cosine products within them.

Vectors of equal label and length link if their cosine, in double precision, is at least ``similar``.
Vectors that are null, zero or hold null or non-finite numbers, and rows without a label, link with
nothing. Equal vectors are one node with a count, so copies of any number cost one vector.

Centres are fitted on at most ``SAMPLE`` vectors (by hash, so the same ones each time); every vector is
assigned. A vector is compared with its own cell and with each cell of a higher number that a linked
vector could be in: with w the unit normal between the two centres, x.w is at most tan(a) times the
component of the deviation along w, for a the angle of ``similar``, and never more than sin(a), which is
allowed for whatever the data: no link is missed. (``spreads`` allows for less, so many times 1/sqrt(d), the
spread of that component where the deviations are alike in all d directions; fewer comparisons, but not exact.)

Cells are dealt, in order of the angle to their centre, into tiles bounded by vectors and bytes. The angles
of two linked vectors to any third differ by a at most, so two tiles meet only if their ranges of angles are
that close, and a vector probes only the tiles of another cell that its own angle to that centre allows. A
cell of any size is many bounded tasks; a task emits counts per vector and a spanning forest of its links,
not the links. Where vectors lie in all directions alike, neither bound excludes much: the work of a label
then grows with the square of its distinct vectors, in blocks of two tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagekin.llm.common import batch, dropped, sent_if_small, written
from stagekin.llm.components import components, smallest_reachable

SIMILAR = 0.93
SAMPLE = 20_000
SPREADS = math.inf
#: Vectors aimed at for a cell, centres at most (they go to every task), vectors a tile and probes a block, bytes a tile.
CELL = 500
CENTRES = 4096
TILE = 1000
TILE_BYTES = 4_000_000
#: Rounding allowed for in angles.
SLACK = 1e-6
#: A node with more than one row in so many of the table is looked up without a shuffle; there are no more such nodes.
HEAVY = 1000
NODE = "node long, label long, weight long, vector binary"


def _clean(rows: pa.RecordBatch) -> list[bytes | None]:
    """The vectors as bytes of doubles; null for those that link with nothing."""
    found: list[bytes | None] = []
    for value in rows.column(1):
        one = np.array(value.values.to_numpy(zero_copy_only=False) if value.is_valid else [], np.float64)
        ok = len(one) and value.values.null_count == 0 and np.isfinite(one).all() and np.any(one)
        found.append((one + 0.0).tobytes() if ok else None)  # -0.0 becomes 0.0, so equal vectors have equal bytes
    return found


def _unit(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(1, keepdims=True)  # squares of very small or large numbers stay finite
    vectors = vectors / scale
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def spherical_centres(sample: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Unit centres of unit vectors; a cell that runs empty keeps its centre."""
    centres = sample[np.random.default_rng(seed).choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        home = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def _nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (vec_id, node) and nodes (node, label, weight, vector); node is null where nothing links."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("vector", pa.binary())])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield batch(schema, rows.column(0), rows.column(2), _clean(rows))

    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding",
                           F.col("label").cast("long").alias("label"))
    rows = typed.mapInArrow(clean, "vec_id long, label long, vector binary")
    linkable = F.col("label").isNotNull() & F.col("vector").isNotNull()
    rows = written(rows.withColumn("node", F.when(linkable, F.xxhash64("label", "vector"))), "vectors")
    nodes = rows.filter("node is not null").groupBy("node").agg(
        F.min("label").alias("label"), F.count(F.lit(1)).alias("weight"), F.min("vector").alias("vector"))
    return rows.select("vec_id", "node"), written(nodes, "nodes")


def _cells(nodes: DataFrame, similar: float, spreads: float) -> DataFrame:
    """nodes with ``cell``, ``angle`` to its centre, ``probes`` (further cells to look in) and ``angles`` to theirs."""
    stats = nodes.groupBy(F.octet_length("vector").alias("bytes")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("labels"))
    common = stats.orderBy(F.desc("n"), "bytes").first()
    if common is None:
        return nodes.selectExpr("*", "0 as cell", "0D as angle", "cast(array() as array<int>) as probes",
                                "cast(array() as array<double>) as angles")
    width = common["bytes"]
    k = max(1, min(CENTRES, math.ceil(common["n"] / (common["labels"] * CELL))))
    same = nodes.filter(F.octet_length("vector") == width)
    share = min(1.0, 1.1 * SAMPLE / common["n"])
    drawn = F.abs(F.xxhash64("node", F.lit("sample")) % 1_000_000) < int(share * 1_000_000) + 1
    sample = [r[0] for r in same.filter(drawn).select("vector").limit(SAMPLE).collect()]
    sample = _unit(np.frombuffer(b"".join(sorted(sample)), np.float64).reshape(len(sample), -1))
    centres = spherical_centres(sample, min(k, len(sample)))
    k, dims = centres.shape
    sent = nodes.sparkSession.sparkContext.broadcast(centres)
    sine = math.sqrt(1 - similar * similar)
    reach = min(sine, sine / similar * spreads / math.sqrt(dims)) + 1e-9
    schema = pa.schema([("node", pa.int64()), ("label", pa.int64()), ("weight", pa.int64()), ("vector", pa.binary()),
                        ("cell", pa.int32()), ("angle", pa.float64()), ("probes", pa.list_(pa.int32())),
                        ("angles", pa.list_(pa.float64()))])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = sent.value
        apart = np.sqrt(np.maximum(2 - 2 * middle @ middle.T, 1e-18))
        for rows in batches:
            raw = [v.as_py() for v in rows.column("vector")]
            cell = np.full(len(raw), -1, np.int32)  # vectors of another length are a cell of their own
            angle, probes, angles = np.zeros(len(raw)), [[] for _ in raw], [[] for _ in raw]
            fits = np.flatnonzero([len(v) == width for v in raw])
            for part in np.array_split(fits, -(-len(fits) // 1000)) if len(fits) else ():
                unit = _unit(np.frombuffer(b"".join([raw[i] for i in part]), np.float64).reshape(len(part), -1))
                cosine = unit @ middle.T
                home = cosine.argmax(1)
                best = cosine[np.arange(len(part)), home]
                turn = np.arccos(np.clip(cosine, -1, 1))
                cell[part], angle[part] = home, turn[np.arange(len(part)), home]
                far = (best[:, None] - cosine) <= reach * apart[home]
                far &= np.arange(k) > home[:, None]
                for i, row, to in zip(part, far, turn, strict=True):
                    probes[i], angles[i] = np.flatnonzero(row), to[row]
            yield batch(schema, *rows.columns, cell, angle, probes, angles)

    return nodes.select("node", "label", "weight", "vector").mapInArrow(
        assign, NODE + ", cell int, angle double, probes array<int>, angles array<double>")


def _compare(similar: float):
    schema = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("n", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        """Counts (other is null) and spanning edges among the first and the second side of a block."""
        side = table.column("side").to_numpy()
        ids, weight = table.column("node").to_numpy(), table.column("weight").to_numpy()
        raw = table.column("vector").to_pylist()
        sizes = np.array([len(v) for v in raw])
        us, vs, node, count = [], [], [], []
        for width in np.unique(sizes):
            a = np.flatnonzero((side == 0) & (sizes == width))
            b = np.flatnonzero((side == 1) & (sizes == width))
            within = len(b) == 0
            b = a if within else b
            if not len(a):
                continue
            one = _unit(np.frombuffer(b"".join([raw[i] for i in a]), np.float64).reshape(len(a), -1))
            two = one if within else _unit(np.frombuffer(b"".join([raw[i] for i in b]), np.float64).reshape(len(b), -1))
            linked = one @ two.T >= similar
            if within:
                np.fill_diagonal(linked, False)
            i, j = np.nonzero(np.triu(linked) if within else linked)
            us.append(ids[a[i]])
            vs.append(ids[b[j]])
            node.append(ids[a])
            count.append(linked @ weight[b])
            if not within:
                node.append(ids[b])
                count.append(linked.T @ weight[a])
        if not us:
            return schema.empty_table()
        nodes, root = smallest_reachable(np.concatenate(us), np.concatenate(vs))
        away = nodes != root
        node, count = np.concatenate(node), np.concatenate(count).astype(np.int64)
        some = count > 0
        return pa.table([np.concatenate((node[some], nodes[away])),
                         pa.array(np.concatenate((np.zeros(some.sum(), np.int64), root[away])),
                                  mask=np.arange(some.sum() + away.sum()) < some.sum()),
                         np.concatenate((count[some], np.zeros(away.sum(), np.int64)))], schema=schema)

    return compare


def _tiled(cells: DataFrame) -> DataFrame:
    """Cells with a tile: neighbours by label, cell and angle to the centre, at most ``TILE`` vectors each and, beyond
    one vector, ``TILE_BYTES``."""
    most, most_bytes = TILE, TILE_BYTES
    parts = max(1, math.ceil(cells.count() / (8 * most)))
    order = ("label", "cell", "angle", "node")
    schema = pa.schema([("node", pa.int64()), ("tile", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tile, size, held, last = TaskContext.get().partitionId() << 32, 0, 0, None
        for rows in batches:
            found = []
            for *key, width in zip(*(rows.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if size and (size >= most or held + width > most_bytes or key != last):
                    tile, size, held = tile + 1, 0, 0
                size, held, last = size + 1, held + width, key
                found.append(tile)
            yield batch(schema, rows.column(0), found)

    dealt = cells.select("node", "label", "cell", "angle", F.octet_length("vector").alias("bytes"))
    dealt = dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    tiles = dealt.select("node", "label", "cell", "bytes").mapInArrow(deal, "node long, tile long")
    return cells.join(tiles, "node")


def neighbours(nodes: DataFrame, similar: float = SIMILAR, spreads: float = SPREADS) -> DataFrame:
    """Rows (node, other, n): counts of linked vectors where ``other`` is null, else spanning edges."""
    turn = math.acos(similar) + SLACK
    placed = written(_cells(nodes, similar, spreads), "cells")
    cells = written(_tiled(placed), "tiles")
    dropped(placed)
    tiles = sent_if_small(written(cells.groupBy("label", "cell", "tile").agg(
        F.min("angle").alias("low"), F.max("angle").alias("high")), "tile-list"))
    second = tiles.withColumnsRenamed({"tile": "tile2", "low": "low2", "high": "high2"})
    meet = (F.col("low2") - F.col("high") <= turn) & (F.col("low") - F.col("high2") <= turn)
    pairs = tiles.join(second, ["label", "cell"]).filter((F.col("tile") <= F.col("tile2")) & meet).select(
        F.xxhash64("tile", "tile2", F.lit("pair")).alias("block"), "tile", "tile2")
    # what vectors of other cells probe of a tile, in blocks of bounded size
    sent = cells.select("node", "label", F.explode(F.arrays_zip("probes", "angles")).alias("to")).select(
        "node", "label", F.col("to.probes").alias("cell"), F.col("to.angles").alias("angle"))
    reached = (F.col("angle") >= F.col("low") - turn) & (F.col("angle") <= F.col("high") + turn)
    hits = written(sent.join(tiles, ["label", "cell"]).filter(reached).select("node", "tile"), "hits")
    loads = sent_if_small(written(hits.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("chunks")), "loads"))
    chunk = F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("chunks"))
    block = F.xxhash64("tile", "chunk", F.lit("probe")).alias("block")
    probes = hits.join(loads, "tile").withColumn("chunk", chunk).select(block, "node", F.lit(1).alias("side"))
    receivers = loads.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    firsts = pairs.select("block", "tile", F.lit(0).alias("side")).unionByName(
        pairs.filter("tile < tile2").select("block", F.col("tile2").alias("tile"), F.lit(1).alias("side"))).unionByName(
        receivers.select(block, "tile", F.lit(0).alias("side")))
    dealt = firsts.join(cells.select("node", "tile"), "tile").select("block", "node", "side").unionByName(probes)
    full = dealt.join(cells.select("node", "weight", "vector"), "node")
    found = written(full.groupBy("block").applyInArrow(_compare(similar), "node long, other long, n long"), "neighbours")
    for used in (cells, tiles, hits, loads):
        dropped(used)
    return found


def deduplicated(vectors: DataFrame, similar: float = SIMILAR, spreads: float = SPREADS) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    n_links counts the other rows linked directly; component_id is the smallest vec_id reachable, itself
    included. Repeated rows of a vec_id are linked to each other like any equal vectors. A row with a null
    vec_id is counted, but never names a component that has other ids.
    """
    rows, nodes = _nodes(vectors)
    found = neighbours(nodes, similar, spreads)
    counts = found.filter("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.filter("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")))
    least = rows.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("m"))
    rooted = least.join(roots.withColumnRenamed("component", "root"), "node", "left").select(
        "node", "m", F.coalesce("root", "node").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("m").alias("c")), "root")
    known = written(nodes.select("node", "weight").join(counts, "node", "left").join(named, "node").select(
        "node", "weight", "c", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("links")), "known")
    # rows that link with nothing need no lookup; those of the few very frequent vectors get it without a shuffle
    alone = rows.filter("node is null").select("*", F.lit(None).cast("long").alias("c"), F.lit(0).cast("long").alias("links"))
    often = F.col("weight") * HEAVY > rows.count()
    heavy = F.broadcast(known.filter(often).drop("weight"))
    rest = known.filter(~often).drop("weight")
    linkable = rows.filter("node is not null")
    full = linkable.join(heavy, "node").unionByName(
        linkable.join(heavy.select("node"), "node", "left_anti").join(rest, "node")).unionByName(alone)
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("c"))
    return full.select(
        "vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
