"""Documents whose sets of word shingles have a Jaccard similarity of at least 0.85, joined exactly.

The incidence matrix (documents by shingles) is multiplied with its transpose in blocks, and overlap
counts are kept where they reach the bound. Which blocks can hold a link follows from the sizes:

* Two sets link if inter >= 0.85 union, so sets of at most y shingles differ in at most d(y) of them.
  Sizes are dealt into classes; a set takes part in its own and, if a larger partner there is
  possible, in the next. In a class whose sets can differ in d shingles, the hash range is cut into
  k > d + 1 segments, and the key of a segment is a hash of the shingles in it: linked sets agree in
  at least k - d segments, less those that are empty in both. The lower the similarity, the more
  segments a difference gets, so that sets that share a common passage only agree in fewer.
* A set that shares fewer keys with others than that cannot link and is dropped, twice over. Sets
  that share only a common passage go here, since few segments hold nothing but that passage.
* The others are joined by their shared keys into candidate groups, ordered by size and dealt into
  tiles of a bounded number of shingles. For two tiles whose sizes allow a link, the product of their
  incidence with the keys that both hold counts the shared keys of each pair of sets; only sets of a
  pair that shares as many as a link needs are sent on, and the product of their incidence with the
  shingles decides. Each task emits a spanning forest of the links found, not the links.

Equal sets are one node throughout (a 64-bit hash of the set), so any number of copies costs one. The
work of a group of different but similar sets grows with the square of its number of tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagekin.llm.common import batch, blocks, dropped, fresh, sent_if_small, short_batches, text_bytes, values, written
from stagekin.llm.components import components, smallest_reachable
from stagekin.llm.shingles import U, mix, shingle_sets

#: Least similarity in hundredths; bounds below follow from it.
SIMILAR = 85
WIDTH = 4
#: Ratio of the sizes of a class; agreeing segments asked for beyond the differences.
CLASS_RATIO = 1.7
AGREEING = 3
#: Sets that share this part of their shingles or less have too few equal keys on average.
UNLIKE = 0.6
#: Bytes of text for a task of the key search; shingles and documents in a tile.
BUCKET_BYTES = 6_000_000
TILE_SHINGLES = 100_000
#: At most 256: a place in a tile is a byte.
TILE_SETS = 200
#: Products of the sparse matrices held at a time.
PRODUCTS = 500_000
KEYS = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])
SHARED = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("size_class", pa.int32()), ("needs", pa.int32())])
SETS = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])


def most_differences(y: int, similar: int = SIMILAR) -> int:
    """Most shingles in which two linked sets of at most y can differ: a in the smaller only, b >= a in the
    larger only, with 100 (y - b) >= similar (y + a)."""
    room = (100 - similar) * y
    twice = room // (100 + similar)
    return 2 * twice + (room - (100 + similar) * twice >= 100)


@lru_cache
def extra_segments(similar: int) -> float:
    """Segments beyond one for each difference, as a part of the differences.

    With m shingles a segment on average, two sets that share the part f agree in exp(-(1 - f) m) of the segments,
    empty ones included, and linked ones in 1 - m * differences a shingle at least; m is where both are equal.
    """
    rate = 2 * (100 - similar) / (100 + similar)
    if not rate:
        return 0.0
    low, high = 0.0, 1 / rate
    for _ in range(50):
        m = (low + high) / 2
        low, high = (m, high) if math.exp((UNLIKE - 1) * m) < 1 - m * rate else (low, m)
    return max(1 / (low * rate) - 1, 0.0) if low else 3.0


def class_floors(top: int) -> np.ndarray:
    floors = [1]
    while floors[-1] <= top:
        floors.append(max(floors[-1] + 1, int(floors[-1] * CLASS_RATIO)))
    return np.array(floors, np.int64)


def segment_keys(one: np.ndarray, size_class: int, floors: np.ndarray, similar: int = SIMILAR) -> tuple[np.ndarray, int]:
    """Keys of the segments of a sorted set in a class, and how many of them a link must share.

    Where empty segments could be all that agree, they get keys too.
    """
    d = most_differences(int(floors[size_class + 1]) - 1, similar)
    k = d + AGREEING + int(d * extra_segments(similar))
    segment = ((one >> U(32)) * U(k)) >> U(32)
    at = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    sums = np.add.reduceat(mix(one + U(12345)), at)
    keys = mix(sums + segment[at] * U(0x9E3779B97F4A7C15) + U(size_class))
    empty = k - len(at)
    if k - d - empty >= 1:
        return keys, k - d - empty
    none = np.setdiff1d(np.arange(k, dtype=np.uint64), segment[at])
    return np.concatenate((keys, mix(none * U(0x9E3779B97F4A7C15) + U(size_class)))), 1


def set_key(one: np.ndarray) -> int:
    """A signed 64-bit hash of a set; 0 for the empty one."""
    if not len(one):
        return 0
    return int(mix(np.add.reduce(mix(one), keepdims=True) * U(3) + U(len(one))).view(np.int64)[0])


def _typed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))


def set_sizes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash, n_shingles and node (the hash of the set) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()),
                        ("node", pa.int64())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            sizes, nodes = [], []
            for texts in blocks(values(rows.column(1)), lambda t: len(t or "") + 1, 2_000_000):
                for one in shingle_sets(texts, width):
                    sizes.append(len(one))
                    nodes.append(set_key(one))
            yield batch(schema, rows.column(0), rows.column(2), sizes, nodes)

    return _typed(docs).mapInArrow(measure, "doc_id long, text_hash long, n_shingles long, node long")


def shared_keys(docs: DataFrame, width: int, similar: int) -> DataFrame:
    """key, node, size_class and needs for all keys that two nodes or more have.

    Keys travel as arrays, one per task and bucket of the key range. A task sends equal sets once, so a
    set of very many copies weighs at most a row a task.
    """
    buckets = max(1, math.ceil(text_bytes(docs, "text") / BUCKET_BYTES))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rows in batches:
            for texts in blocks(values(rows.column(0)), lambda t: len(t or "") + 1, 2_000_000):
                found = []
                for one in shingle_sets(texts, width):
                    node = set_key(one)
                    if not len(one) or node in seen:
                        continue
                    seen.add(node)
                    floors = class_floors(int(len(one) * CLASS_RATIO) + 2)
                    own = int(np.searchsorted(floors, len(one), "right")) - 1
                    for c in (own, own + 1):
                        if c == own or 100 * len(one) >= similar * floors[c]:
                            keys, needs = segment_keys(one, c, floors, similar)
                            row = np.empty(len(keys), [("key", "<u8"), ("node", "<i8"), ("c", "<u2"), ("needs", "<u2")])
                            row["key"], row["node"], row["c"], row["needs"] = keys, node, c, min(needs, 65535)
                            found.append(row)
                if not found:
                    continue
                all_keys = np.concatenate(found)
                bucket = (((all_keys["key"] >> U(32)) * U(buckets)) >> U(32)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                all_keys, bucket = all_keys[order], bucket[order]
                cut = np.searchsorted(bucket, np.arange(buckets + 1))
                some = np.flatnonzero(np.diff(cut))
                yield batch(KEYS, some.astype(np.int32), [all_keys[cut[b]:cut[b + 1]].tobytes() for b in some])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = [("key", "<u8"), ("node", "<i8"), ("c", "<u2"), ("needs", "<u2")]
        packed = bytearray()
        for some in batches:
            for p in some.column(1):
                packed += p.as_buffer()
        rows = np.frombuffer(packed, kind)
        order = np.argsort(rows["key"], kind="stable")
        key = rows["key"][order]
        more = np.zeros(len(key) + 1, bool)
        more[1:-1] = key[1:] == key[:-1]
        rows = rows[order[more[1:] | more[:-1]]]  # keys of a single row are most of them
        del packed, order, key, more
        rows = rows[np.lexsort((rows["node"], rows["key"]))]
        if not len(rows):
            return
        new = np.concatenate(([True], (rows["key"][1:] != rows["key"][:-1]) | (rows["node"][1:] != rows["node"][:-1])))
        rows = rows[new]
        first = np.concatenate(([True], rows["key"][1:] != rows["key"][:-1]))
        rows = rows[~(first & np.append(first[1:], True))]
        for k in range(0, len(rows), 500_000):
            part = rows[k:k + 500_000]
            yield batch(SHARED, part["key"].view(np.int64) if part["key"].flags.c_contiguous else
                        np.ascontiguousarray(part["key"]).view(np.int64), part["node"], part["c"].astype(np.int32),
                        part["needs"].astype(np.int32))

    keys = docs.select("text").mapInArrow(make, "bucket int, payload binary")
    found = keys.repartition(buckets, "bucket").mapInArrow(
        search, "key long, node long, size_class int, needs int")
    return written(found, "shared-keys")


def _enough(shared: DataFrame) -> DataFrame:
    """Without nodes that share fewer keys of a class than a link needs, then without keys of one node."""
    able = shared.groupBy("node", "size_class").agg(F.count(F.lit(1)).alias("_n")).join(
        shared.select("node", "size_class", "needs").distinct(), ["node", "size_class"]).filter("_n >= needs")
    kept = shared.join(able.select("node", "size_class"), ["node", "size_class"], "left_semi")
    common = kept.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key")
    found = written(kept.join(common, "key", "left_semi"), "shared-keys")
    dropped(shared)
    return found


def _tiles(nodes: DataFrame) -> DataFrame:
    """nodes (node, component, n) with a tile and a place in it: neighbours by component and size, within the
    bounds of a tile.

    Ranges of (component, n) go to tasks; each numbers its own tiles, so no task sees them all.
    """
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("tile", pa.int64()), ("place", pa.int32())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tile, sets, shingles = TaskContext.get().partitionId() << 32, 0, 0
        for rows in batches:
            found, places = [], []
            for n in rows.column(1).to_pylist():
                if sets and (sets >= TILE_SETS or shingles + n > TILE_SHINGLES):
                    tile, sets, shingles = tile + 1, 0, 0
                found.append(tile)
                places.append(sets)
                sets, shingles = sets + 1, shingles + n
            yield batch(schema, rows.column(0), rows.column(1), found, places)

    parts = max(1, math.ceil(nodes.count() / (10 * TILE_SETS)))
    dealt = nodes.repartitionByRange(parts, "component", "n", "node").sortWithinPartitions("component", "n", "node")
    return written(dealt.select("node", "n").mapInArrow(deal, "node long, n long, tile long, place int"), "tiles")


def _sharing(members: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Which pairs of places of two tiles share as many keys as both sets need.

    ``members``: for each key its sets on both sides, each as needs * 256 + place.
    """
    shared = np.zeros(1 << 16, np.int64)
    needs = np.zeros((2, 256), np.int64)
    for some in blocks(members, lambda m: len(m[0]) * len(m[1]), PRODUCTS):
        left = np.concatenate([a for a, _ in some])
        right = np.concatenate([b for _, b in some])
        needs[0, left & 255], needs[1, right & 255] = left >> 8, right >> 8
        width = np.repeat([len(b) for _, b in some], [len(a) for a, _ in some])  # partners of each set on the left
        first = np.repeat(np.cumsum([0, *[len(b) for _, b in some[:-1]]]), [len(a) for a, _ in some])
        ends = np.cumsum(width)
        partner = right[np.repeat(first - ends + width, width) + np.arange(ends[-1])]
        shared += np.bincount(np.repeat(left & 255, width) << 8 | partner & 255, minlength=1 << 16)
    shared = shared.reshape(256, 256)
    return (shared >= np.maximum(needs[0][:, None], needs[1])) & (shared > 0)


def _close(shared: DataFrame, tiles: DataFrame, similar: int) -> DataFrame:
    """tile, tile2 and node: the sets that a product of two tiles must see."""
    member = (F.col("needs") * 256 + F.col("place")).cast("int")  # at most a tile's sets a key
    at = written(shared.join(tiles, "node").groupBy("key", "size_class", "tile").agg(
        F.collect_list(member).alias("members")), "tile-keys")
    spans = tiles.groupBy("tile").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    spans = sent_if_small(written(spans, "spans"))
    at = at.join(spans, "tile")
    other = at.withColumnsRenamed({"tile": "tile2", "members": "members2", "low": "low2", "high": "high2"})
    fits = (100 * F.col("high") >= similar * F.col("low2")) & (100 * F.col("high2") >= similar * F.col("low"))
    both = at.join(other, ["key", "size_class"]).filter((F.col("tile") <= F.col("tile2")) & fits)
    schema = pa.schema([("tile", pa.int64()), ("tile2", pa.int64()), ("of", pa.int64()), ("place", pa.int32())])

    def count(table: pa.Table) -> pa.Table:
        tile, tile2 = table.column("tile")[0].as_py(), table.column("tile2")[0].as_py()
        classes = table.column("size_class").to_numpy()
        sides = []
        for name in ("members", "members2"):
            lists = table.column(name).combine_chunks()
            flat, cut = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            sides.append(np.split(flat, (cut - cut[0])[1:-1]))
        enough = np.zeros((256, 256), bool)
        for c in np.unique(classes):
            enough |= _sharing([(sides[0][k], sides[1][k]) for k in np.flatnonzero(classes == c)])
        if tile == tile2:
            np.fill_diagonal(enough, False)
        left, right = np.flatnonzero(enough.any(1)), np.flatnonzero(enough.any(0))
        if tile == tile2:
            left, right = np.union1d(left, right), left[:0]
        n = len(left) + len(right)
        return pa.table([np.full(n, tile), np.full(n, tile2), np.repeat([tile, tile2], [len(left), len(right)]),
                         np.concatenate((left, right)).astype(np.int32)], schema=schema)

    pairs = both.select("tile", "tile2", "size_class", "members", "members2").groupBy("tile", "tile2").applyInArrow(
        count, "tile long, tile2 long, of long, place int")
    place = tiles.select(F.col("tile").alias("of"), "place", "node")
    return written(pairs.join(place, ["of", "place"]).select("tile", "tile2", "node"), "close")


def _block_links(pairs: np.ndarray, parts: list[np.ndarray], similar: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links among sets: rows of the product of the incidence matrix, a few at a time.

    As many rows are multiplied at once as have about ``PRODUCTS`` products.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    columns = np.unique(np.concatenate(parts), return_inverse=True)[1]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(parts)), sizes)
    order = np.argsort(columns, kind="stable")
    post = owner[order]  # documents of each column
    first = np.searchsorted(columns[order], np.arange(columns.max() + 2))
    u, v = [], []
    work = np.add.reduceat((first[1:] - first[:-1])[columns], starts[:-1])  # products of each row
    for rows in blocks(range(len(parts)), lambda k: int(work[k]) + len(parts), PRODUCTS):
        a, b = rows[0], rows[-1] + 1
        mine = columns[starts[a]:starts[b]]
        lengths = first[mine + 1] - first[mine]
        row = np.repeat(owner[starts[a]:starts[b]] - a, lengths)
        ends = np.cumsum(lengths)
        col = post[np.repeat(first[mine] - ends + lengths, lengths) + np.arange(ends[-1])]
        overlap = np.bincount(row * len(parts) + col, minlength=(b - a) * len(parts)).reshape(b - a, len(parts))
        total = sizes[a:b, None] + sizes[None, :]
        i, j = np.nonzero((100 + similar) * overlap >= similar * total)
        u.append(i[i + a < j] + a)
        v.append(j[i + a < j])
    u, v = np.concatenate(u), np.concatenate(v)
    nodes, root = smallest_reachable(u, v)
    away = nodes != root
    return pairs[nodes[away]], pairs[root[away]]


def links(docs: DataFrame, sizes: DataFrame, width: int = WIDTH, similar: int = SIMILAR) -> DataFrame:
    """Edges (u, v) that connect all linked nodes; ``sizes``: the rows of ``set_sizes``."""
    shared = _enough(_enough(shared_keys(docs, width, similar)))
    stars = shared.join(shared.groupBy("key").agg(F.min("node").alias("v")), "key").select(F.col("node").alias("u"), "v")
    # most keys of a set have the same smallest node: told once, not once a key and partition
    groups = components(stars.distinct())
    reps = sizes.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"))
    chosen = written(groups.join(reps, "node").select("node", "component", "n", "doc_id"), "candidates")
    tiles = _tiles(chosen.select("node", "component", "n"))
    close = _close(shared, tiles, similar)
    dropped(shared)
    dropped(tiles)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task sends equal sets once
        for rows in batches:
            for texts in blocks(values(rows.column(0)), lambda t: len(t or "") + 1, 2_000_000):
                sets = {set_key(s): s for s in shingle_sets(texts, width)}
                new = [node for node in sets if node not in seen]
                seen.update(new)
                yield batch(SETS, new, [sets[n].tobytes() for n in new])

    wanted = chosen.join(close.select("node").distinct(), "node", "left_semi").select("doc_id")
    ids = sent_if_small(written(wanted.distinct(), "candidate-ids"))
    typed = _typed(docs)
    picked = typed.join(ids, typed["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    sets = written(picked.select("text").mapInArrow(extract, "node long, shingles binary"), "sets")
    edge = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def multiply(table: pa.Table) -> pa.Table:
        nodes, index = np.unique(table.column("node").to_numpy(), return_index=True)
        shingles = table.column("shingles")
        u, v = _block_links(nodes, [np.frombuffer(shingles[int(i)].as_py(), np.uint64) for i in index], similar)
        return pa.table([u, v], schema=edge)

    found = written(sets.join(close, "node").groupBy("tile", "tile2").applyInArrow(multiply, "u long, v long"), "links")
    for used in (chosen, close, ids, sets):
        dropped(used)
    return found


def joined(docs: DataFrame, width: int = WIDTH, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links; also text_hash and ``group``,
    which tells components apart where ids are null.

    Texts without words link with nothing: their component is their own doc_id, their group null. A null
    doc_id is never the smallest of a component that has others. Repeated rows have equal sets and share a
    component.
    """
    with short_batches(docs.sparkSession):
        sizes = written(set_sizes(docs, width), "set-sizes")
        edges = links(docs, sizes, width, similar)
        connected = components(edges)
    dropped(edges)
    least = sizes.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("m"))
    rooted = least.join(connected.withColumnRenamed("component", "group"), "node", "left").select(
        "node", "m", F.coalesce("group", "node").alias("group"))
    named = rooted.join(rooted.groupBy("group").agg(F.min("m").alias("c")), "group").select("node", "group", "c")
    component = F.when(F.col("n_shingles") > 0, F.col("c")).otherwise(F.col("doc_id"))
    return sizes.join(named, "node", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), "text_hash", "group")


def one_of_each(docs: DataFrame, width: int = WIDTH, similar: int = SIMILAR) -> DataFrame:
    """``docs`` with one row of each component, that of its component_id; rows without words all stay."""
    found = written(joined(docs, width, similar), "joined")
    named = found.filter("group is not null and doc_id <=> component_id")
    # rows of that id with another text can be in the component too, and a row can be there more than once
    chosen = named.groupBy("group").agg(F.min("text_hash").alias("text_hash"), F.first("doc_id").alias("doc_id"))
    rows = named.groupBy("group", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    chosen = written(chosen.join(rows, ["group", "text_hash"]).select("doc_id", "text_hash", "n"), "chosen")
    own_id, own_hash = fresh(docs, "_id"), fresh(docs, "_hash")
    keyed = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_hash: F.xxhash64("text")})

    def rows_of(ids: DataFrame) -> DataFrame:
        same = keyed[own_id].eqNullSafe(ids["doc_id"]) & (keyed[own_hash] == ids["text_hash"])
        return keyed.join(ids, same, "left_semi").select(*docs.columns)

    lone = chosen.filter("n = 1").unionByName(
        found.filter("group is null").select("doc_id", "text_hash", F.lit(1).cast("long").alias("n")))
    kept = rows_of(lone)
    if chosen.filter("n > 1").isEmpty():
        return kept
    repeated = rows_of(chosen.filter("n > 1")).withColumn(own_hash, F.xxhash64("text"))
    return kept.unionByName(repeated.dropDuplicates(["doc_id", own_hash]).drop(own_hash))
