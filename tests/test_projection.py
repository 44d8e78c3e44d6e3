"""The projection against brute force: neighbours in the plane are neighbours by cosine."""

import numpy as np
import pytest

from loomgraph.operators import layout, projection
from loomgraph.plans import registry, tables


def kept(v, at, k=10):
    """Share of each point's k nearest by cosine that are among its k nearest in the plane."""
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near, far = u @ u.T, ((at[:, None] - at[None]) ** 2).sum(2)
    np.fill_diagonal(near, -np.inf)
    np.fill_diagonal(far, np.inf)
    return np.mean([len(set(a) & set(b)) / k for a, b in zip(np.argsort(-near, 1)[:, :k], np.argsort(far, 1)[:, :k], strict=True)])


def places(df):
    rows = sorted(df.collect(), key=lambda r: r["id"])
    return [r["id"] for r in rows], np.array([(r["x"], r["y"]) for r in rows])


def test_projection_query_beats_components(spark, sf):
    rows = tables.vectors(spark, sf)
    v = np.array([r["vector"] for r in rows.orderBy("id").collect()], float)
    ids, at = places(registry.QUERIES["project_embeddings"](spark, sf))
    _, flat = places(layout.flattened(rows))
    assert len(ids) == len(v) and np.isfinite(at).all() and kept(v, at) > 2 * kept(v, flat)


@pytest.mark.parametrize("block", [4096, 64])
def test_clusters_stay_together(spark, monkeypatch, block):
    monkeypatch.setattr(projection, "BLOCK", block)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(12, 24))
    v = np.array([centre[i % 12] + 0.35 * rng.normal(size=24) for i in range(240)])
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None)], "id long, vector array<double>")
    ids, at = places(projection.projected(rows, rounds=6, epochs=20))
    assert ids == list(range(240))
    far = ((at[:, None] - at[None]) ** 2).sum(2) + np.eye(240) * 1e9
    assert np.mean(np.argsort(far, 1)[:, :5] % 12 == (np.arange(240) % 12)[:, None]) > 0.95
    if block > 240:
        again = places(projection.projected(rows, rounds=6, epochs=20))[1]
        assert np.allclose(at, again)
        _, flat = places(layout.flattened(rows.where("vector IS NOT NULL")))
        assert kept(v, at) > 1.3 * kept(v, flat)


def test_bands_hold_no_more_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(projection, "BLOCK", 40)
    points = spark.createDataFrame([(i, 0.0 if i < 150 else float(i), 1.0) for i in range(400)], "id long, x double, y double")
    bands = {r["band"]: r["count"] for r in projection.banded(points, 0.3, 400).groupBy("band").count().collect()}
    assert sum(bands.values()) == 400 and len(bands) >= 10 and max(bands.values()) <= 80  # dealt by hash where all lie in one place


def test_few_points(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<double>")
    assert [tuple(r) for r in projection.projected(rows).collect()] == [(1, 0.0, 0.0)]
    assert projection.projected(rows.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(5)], "id long, vector array<double>")
    ids, at = places(projection.projected(same, rounds=6, epochs=3))
    assert ids == list(range(5)) and np.isfinite(at).all() and len(set(map(tuple, at))) == 5


def test_memberships_and_curve():
    far = np.array([[0.0, 0.1, 0.3, 0.9], [0.2, 0.2, 0.2, 0.2]])
    w = projection.memberships(far)
    assert abs(w[0].sum() - 2) < 1e-6 and w[0, 1] == 1 and (np.diff(w[0, 1:]) < 0).all() and (w[1] == 1).all()
    a, b = projection.closeness_curve(0.1)
    assert abs(a - 1.577) < 0.01 and abs(b - 0.895) < 0.01
