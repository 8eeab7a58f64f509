"""Vectors that differ in few of their directions, against all pairs."""

import numpy as np

from stagekin.llm import embedding_dedup


def test_links_across_cells_where_few_directions_vary(spark):
    rng = np.random.default_rng(8)
    angle = rng.uniform(0, 2 * np.pi, 1600)
    vectors = np.zeros((1600, 64), np.float32)
    vectors[:, 3], vectors[:, 40] = np.cos(angle), np.sin(angle)
    exact = vectors.astype(np.float64)
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    linked = exact @ exact.T >= 0.93
    np.fill_diagonal(linked, False)
    table = spark.createDataFrame([(k, v, 1) for k, v in enumerate(vectors.tolist())],
                                  "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.deduplicated(table).collect()}
    assert got == dict(enumerate(linked.sum(1).tolist()))


def test_many_cells_and_tiles_against_all_pairs(spark, monkeypatch):
    """Clusters, vectors in all directions, one vector with a third of all rows, and rows that link with nothing."""
    monkeypatch.setattr(embedding_dedup, "CELL", 60)
    monkeypatch.setattr(embedding_dedup, "TILE", 40)
    monkeypatch.setattr(embedding_dedup, "TILE_BYTES", 8 * 16 * 25)
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 16))
    near = middle[rng.integers(0, 12, 700)] + rng.normal(size=(700, 16)) * 0.25
    vectors = np.concatenate((near, rng.normal(size=(300, 16)), np.repeat(near[:1], 500, 0)))
    label = np.where(np.arange(1500) % 3 == 0, 1, 2)
    label[1000:] = label[0]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(linked, False)
    root = np.arange(1500)
    for _ in range(1500):
        low = np.minimum(root, np.where(linked, root, 1500).min(1))
        if (low == root).all():
            break
        root = low
    rows = [(k, v, int(label[k])) for k, v in enumerate(vectors.tolist())]
    rows += [(2000 + k, None, 1) for k in range(40)] + [(3000 + k, vectors[0].tolist(), None) for k in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.deduplicated(table).collect()}
    assert len(got) == len(rows)
    count = linked.sum(1).tolist()
    assert all(got[k] == (count[k], int(root[k]), bool(root[k] == k)) for k in range(1500))
    assert all(got[k] == (0, k, True) for k in got if k >= 2000)
