"""Crossings and density grids against brute force."""

import math
import random

import pandas as pd
import pytest

from loomgraph.functions.frames import cut
from loomgraph.operators import analytics


def crossed(p, q):
    turn = lambda a, b, c: (c[1] - a[1]) * (b[0] - a[0]) > (b[1] - a[1]) * (c[0] - a[0])
    a, b, c, d = p[3:5], p[5:7], q[3:5], q[5:7]
    return len({p[1], p[2], q[1], q[2]}) == 4 and turn(a, c, d) != turn(b, c, d) and turn(a, b, c) != turn(a, b, d)


@pytest.mark.parametrize(("crowd", "deepest"), [(256, 14), (3, 14), (1, 2)])
def test_crossings_in_crowded_places(spark, monkeypatch, crowd, deepest):
    monkeypatch.setattr(analytics, "CROWD", crowd)
    monkeypatch.setattr(analytics, "DEEPEST", deepest)
    rng = random.Random(7)
    segments = []
    for i in range(90):
        wide = 0.05 if i % 2 else 10.0  # half lie in one corner; ends on a raster, so that borders of cells are met
        x, y = (round(rng.random() * 8) / 8 * wide for _ in "xy")
        segments.append((i, f"a{rng.randrange(60)}", f"b{rng.randrange(60)}", x, y, x + round(rng.uniform(-4, 4)) / 8 * wide, y + round(rng.uniform(-4, 4)) / 8 * wide))
    segments += [(90, "p", "q", 1.0, 1.0, 1.0, 1.0), (91, "long", "one", -1.0, -1.0, 12.0, 11.0)]
    want = sum(crossed(p, q) for i, p in enumerate(segments) for q in segments[i + 1 :])
    rows = spark.createDataFrame([*segments, (92, "x", "y", None, 1.0, 2.0, 3.0)], "id int, a string, b string, ax double, ay double, bx double, by double")
    assert analytics.crossings(rows).collect()[0][0] == want > 20
    assert analytics.crossings(rows.limit(0)).collect()[0][0] == 0


@pytest.mark.parametrize("lot", [131_072, 50])
def test_segments_as_long_as_the_crowd_have_few_copies(spark, monkeypatch, lot):
    """Segments that cover a good part of a crowd aren't copied into ever smaller cells; a cell of many meets in lots."""
    monkeypatch.setattr(analytics, "CROWD", 20)
    monkeypatch.setattr(analytics, "LOT", lot, raising=False)
    kept = []
    monkeypatch.setattr(analytics, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    rng = random.Random(3)
    segments = [(i, f"a{rng.randrange(300)}", f"b{i}", *(round(rng.uniform(0, 9), 2) for _ in range(4))) for i in range(300)] + [(300, None, "b", 1.0, 1.0, 8.0, 8.0), (None, "a", "b", 1.0, 1.0, 8.0, 8.0)]
    far = [(400 + i, f"f{i}", f"g{i}", 90 + i / 100, 90.0, 91 - i / 100, 91.0) for i in range(60)]
    rows = spark.createDataFrame(segments + far, "id int, a string, b string, ax double, ay double, bx double, by double")
    sure = [s for s in segments + far if s[0] is not None and s[1] is not None]
    assert analytics.crossings(rows).collect()[0][0] == sum(crossed(p, q) for i, p in enumerate(sure) for q in sure[i + 1 :]) > 5000
    assert max(df.count() for df in kept) <= 2 * len(sure)


def parted(p, q):
    """Whether the ends of q lie on either side of p's line, by the arithmetic of the queries' SQL."""
    return ((q[1] - p[1]) * (p[2] - p[0]) > (p[3] - p[1]) * (q[0] - p[0])) != ((q[3] - p[1]) * (p[2] - p[0]) > (p[3] - p[1]) * (q[2] - p[0]))


@pytest.mark.parametrize(
    ("p", "q"),
    [
        ((1.0, 1.89, -5.0, 7.890000000000001), (0.74, 2.15, -0.2599999999999998, 3.1500000000000004)),
        ((0.08, 3.06, 0.08000000000000007, 3.0600000000000005), (0.8, 2.16, -3.2, 7.16)),
        ((2.89, 1.95, 1.8900000000000006, -2.05), (0.83, 2.98, 8.829999999999998, -1.0199999999999996)),
        ((0.0, 0.0, 4.0, 4.0), (1.0, 3.0, 3.0, 1.0)),
        ((0.0, 0.0, 4.0, 4.0), (2.0, 2.0, 5.0, 3.0)),
    ],
)
def test_ends_on_lines_count_as_in_sql(p, q):
    """Where an end lies on the other's line up to rounding, a pair counts as the SQL has it, whichever of them comes first."""
    want = int(parted(p, q) and parted(q, p))
    for one, two in ((p, q), (q, p)):
        rows = pd.DataFrame([(0, "a", "b", *one), (1, "c", "d", *two)], columns=["id", "a", "b", "ax", "ay", "bx", "by"])
        assert analytics.crossing_pairs(rows.assign(lot=0, own_x=True, own_y=True)) == want


@pytest.mark.parametrize("bins", [None, 16])
def test_density_grid(spark, bins):
    rng = random.Random(2)
    points = [(rng.gauss(0, 2), rng.gauss(5, 1), rng.randrange(9)) for _ in range(80)] * 2
    size, h = 9, 0.8
    at = [[min(p[c] for p in points) - 0.1 * (max(p[c] for p in points) - min(p[c] for p in points)) + g / (size - 1) * 1.2 * (max(p[c] for p in points) - min(p[c] for p in points)) for g in range(size)] for c in (0, 1)]
    total = sum(math.log1p(n) for *_, n in points)
    want = {(i, j): sum(math.log1p(n) * math.exp(-((x - at[0][i]) ** 2 + (y - at[1][j]) ** 2) / (2 * h * h)) for x, y, n in points) / total for i in range(size) for j in range(size)}
    rows = spark.createDataFrame([*points, (None, 1.0, 3)], "x double, y double, n int")
    got = {(r["gx"], r["gy"]): r["density"] for r in analytics.weighted_grid(rows, size, h, "n", bins=bins).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < (5e-3 if bins else 1e-9)


def test_density_grid_of_odd_points(spark):
    one = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert {r["density"] for r in analytics.weighted_grid(one, 3, 1.0).collect()} == {1.0}
    assert {r["density"] for r in analytics.weighted_grid(one.limit(0), 3, 1.0, bins=4).collect()} == {0.0}
