import json
import math

from loomgraph.operators import analytics
from loomgraph.streaming import trace


def test_depth_never_falls_below_zero(spark):
    steps = [-1, -1, 1, 1, -1, -1, -1, 1, 1]
    rows = spark.createDataFrame([("t", i, s) for i, s in enumerate(steps)], "thread string, seq int, step int")
    want, d = [], 0
    for s in steps:
        d = max(0, d + s)
        want.append(d)
    assert [r["depth"] for r in analytics.call_depths(rows).orderBy("seq").collect()] == want


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    events = [{"seq": i, "ts": f"2024-01-01T00:0{i % 6}:00", "thread": 1, "qname": f"f{i % 3}", "step": 1 if i % 4 else -1} for i in range(40)]
    for k in range(4):
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps(e) for e in events[k::4]))
    q = trace.to_memory(trace.visit_counts(trace.events(spark, str(tmp_path), 1)), "counted")
    q.processAllAvailable()
    q.stop()
    want = {}
    for e in events:
        if e["step"] == 1:
            want[e["qname"]] = want.get(e["qname"], 0) + 1
    assert {r["qname"]: r["visits"] for r in spark.table("counted").collect()} == want
    q = trace.to_memory(trace.windowed_counts(trace.events(spark, str(tmp_path))), "windowed")
    q.processAllAvailable()
    q.stop()
    assert sum(r["visits"] for r in spark.table("windowed").collect()) == sum(want.values())


def test_predictions_and_places(spark):
    p = spark.createDataFrame([("a", 2, 0), ("b", 0, 1), ("zz", 3, 2), ("a", 1, 3)], "qname string, approx_calls int, ord int")
    known = spark.createDataFrame([("a",), ("b",)], "qname string")
    good, dropped = analytics.split_predictions(p, known)
    assert [(r["qname"], r["approx_calls"]) for r in good.collect()] == [("a", 1)] and {r[0] for r in dropped.collect()} == {"b", "zz"}
    pts = spark.createDataFrame([("a", 0.0, 0.0), ("b", 10.0, 5.0)], "id string, x double, y double")
    assert {r["id"]: (r["x"], r["y"]) for r in analytics.spread_xy(pts).collect()} == {"a": (-25.0, -12.5), "b": (25.0, 12.5)}
    depth = spark.createDataFrame([("a", 0), ("b", 2)], "node string, depth int")
    assert {r["node"]: r["height"] for r in analytics.fallback_heights(depth).collect()} == {"a": 10.0, "b": 0.0}
    e = spark.createDataFrame([("a", "b")], "src string, dst string")
    moved = {r["node"]: r["x"] for r in analytics.pulled(pts.withColumnRenamed("id", "node"), e, rounds=1).collect()}
    assert moved == {"a": 0.0, "b": 6.5}
    bands = spark.createDataFrame([("f", 1.0), ("f", 3.0)], "file string, y double")
    assert [tuple(r) for r in analytics.bands(bands).collect()] == [("f", 1.0, 3.0)]


def test_degenerate_analytics(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<double>")
    assert analytics.semantic_density(v).collect()[0]["density"] == 0.5
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(4)], "id long, vector array<double>")
    assert {r["density"] for r in analytics.semantic_density(same).collect()} == {0.5}
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert analytics.spearman(flat, "a", "b").collect()[0]["rho"] == 0
    imp = analytics.importance(spark.createDataFrame([(1, 1.0, 5), (2, 1.0, 9)], "id int, density double, source_lines int"))
    assert {r["importance"] for r in imp.collect()} == {0.0}
    one = spark.createDataFrame([("r", None, 0.0, 0.0, 0.5, False), ("c", "r", 3.0, 4.0, 1.0, False), ("o", None, 9.0, 9.0, 0.0, True)], "node string, parent string, x double, y double, importance double, is_orphan boolean")
    got = {r["node"]: r["height"] for r in analytics.relative_heights(one).collect()}
    assert math.isclose(got["r"], 5 * math.tan(math.radians(10))) and got["c"] == 0 and got["o"] == 0.1
