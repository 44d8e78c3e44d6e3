"""Projection of vectors to a plane that keeps neighbourhoods.

A graph of each point's nearest others is weighted by bandwidths of the points' own, and a layout of the plane is found by stochastic
gradient steps: edges pull, points drawn at random push. The points are dealt into bands of the plane as it is; in a round every band
takes some epochs on its own against the places that the ends of its edges elsewhere had at the round's start. Bands turn from
round to round, so that no border stays. No task holds more than about ``BLOCK`` points and their edges, and what goes to all
tasks are ``DRAWN`` places that points are pushed away from.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import cut
from .analytics import top_neighbours
from .layout import flattened

#: Points of a band, places that a round draws to push from, bins that bands are cut from, pushes for each pull, steps of an epoch.
BLOCK, DRAWN, BINS, PUSHES, STEPS = 4096, 2048, 1024, 5, 8
#: Longest move by one edge; half the width of the first layout; turn between rounds.
LONGEST, HALF, TURN = 4.0, 10.0, math.pi * (3 - math.sqrt(5))


def closeness_curve(least: float, reach: float = 1.0) -> tuple[float, float]:
    """(a, b) with which 1 / (1 + a d^2b) is nearest, in squares, to 1 up to ``least`` and exp(-(d - least) / reach) beyond."""
    d = np.linspace(0, 3 * reach, 301)[1:]
    want = np.where(d < least, 1.0, np.exp(-(d - least) / reach))
    p = np.array([0.0, 0.0])  # logarithms of both, so that they stay positive
    damp = 1e-2
    error = lambda p: want - 1 / (1 + np.exp(p[0]) * d ** (2 * np.exp(p[1])))
    e = error(p)
    for _ in range(200):
        a, b = np.exp(p)
        s = a * d ** (2 * b)
        slope = s / (1 + s) ** 2
        j = np.stack([slope, slope * 2 * b * np.log(d)], 1)
        step = np.linalg.solve(j.T @ j + damp * np.eye(2), -j.T @ e)
        new = error(p + step)
        if (new * new).sum() < (e * e).sum():
            p, e, damp = p + step, new, damp / 3
        else:
            damp *= 3
    return float(np.exp(p[0])), float(np.exp(p[1]))


def memberships(far: np.ndarray) -> np.ndarray:
    """Weights of each row's neighbours at distances ``far``: exp(-(d - nearest) / width), with the row's width such that they sum to
    log2 of their number. The nearest that isn't in the same place has weight 1."""
    k = far.shape[1]
    nearest = np.where(far > 0, far, np.inf).min(1, keepdims=True)
    over = np.maximum(0, far - np.where(np.isfinite(nearest), nearest, 0))
    low, high = np.zeros((len(far), 1)), np.full((len(far), 1), np.inf)
    width, want = np.ones((len(far), 1)), math.log2(max(k, 2))
    for _ in range(64):
        total = np.exp(-over / width).sum(1, keepdims=True)
        low, high = np.where(total < want, width, low), np.where(total < want, high, width)
        width = np.where(np.isfinite(high), (low + high) / 2, width * 2)
    return np.exp(-over / np.maximum(width, 1e-3 * np.maximum(far.mean(1, keepdims=True), 1e-12)))


def neighbour_graph(vectors: DataFrame, k: int, id: str = "id", vector: str = "vector") -> DataFrame:
    """(a, b, weight), both ways: two points are neighbours as far as either or both say so (w + v - w v)."""
    near = top_neighbours(vectors, k, id, vector).select("id", F.struct(F.round(1 - F.col("similarity"), 12).alias("far"), "other").alias("n"))
    kind = near.schema["id"].dataType.simpleString()

    def weigh(frames):
        for frame in frames:
            for size, rows in frame.groupby(frame["near"].map(len)):  # fewer only where there are fewer points
                far = np.maximum(0, np.array([[n["far"] for n in r] for r in rows["near"]], float).reshape(len(rows), size))
                yield pd.DataFrame({"a": rows["id"].repeat(size).to_numpy(), "b": [n["other"] for r in rows["near"] for n in r], "weight": memberships(far).ravel()})

    # a row has k neighbours
    own = near.groupBy("id").agg(F.array_sort(F.collect_list("n")).alias("near")).mapInPandas(weigh, f"a {kind}, b {kind}, weight double")
    pairs = own.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("s"), F.when(F.count("*") > 1, F.max("weight") * F.min("weight")).otherwise(0.0).alias("p"))
    pairs = pairs.select("a", "b", (F.col("s") - F.col("p")).alias("weight"))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def banded(points: DataFrame, angle: float, n: int) -> DataFrame:
    """``points`` (id, x, y; n rows) with ``band``: stripes across ``angle`` of about ``BLOCK`` points each. Where one bin of the
    histogram has more, the points in it are dealt out by hash."""
    if n <= BLOCK:
        return points.withColumn("band", F.lit(0).cast("bigint"))
    at = F.col("x") * math.cos(angle) + F.col("y") * math.sin(angle)
    low, high = points.agg(F.min(at), F.max(at)).first()
    bin_ = F.least(F.lit(BINS - 1), F.floor((at - low) / ((high - low) or 1.0) * BINS)).cast("int")
    counts = {r["bin"]: r["n"] for r in points.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n")).collect()}  # BINS rows at most
    first, lots, band, held = [], [], -1, BLOCK
    for b in range(BINS):
        size = counts.get(b, 0)
        parts = max(1, -(-size // BLOCK))
        if held + size > BLOCK:
            band += 1
            held = 0
        first.append(band)
        lots.append(parts)
        held += size
        if parts > 1:
            band, held = band + parts - 1, BLOCK
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), bin_ + 1)
    return points.withColumn("band", (pick(first) + F.pmod(F.xxhash64("id"), pick(lots))).cast("bigint"))


def epochs_of(at: np.ndarray, head: np.ndarray, tail: np.ndarray, held: np.ndarray, weight: np.ndarray, drawn: np.ndarray, total: int, rates: np.ndarray, curve: tuple[float, float], rng: np.random.Generator) -> np.ndarray:
    """Places ``at`` after an epoch for each of ``rates``. An edge leads from point ``head`` to point ``tail``, or, where that is
    -1, to the place in ``held``; it takes part in an epoch with a chance of its weight. What pushes is one of the ``total`` points: a band's own as they move, the others
    as ``drawn``."""
    a, b = curve
    n = len(at)

    def moved(who: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(who, by[:, c], n) for c in (0, 1)], 1)

    for rate in rates:
        live = np.flatnonzero(rng.random(len(head)) < weight)
        rng.shuffle(live)
        for part in np.array_split(live, STEPS):
            h, t = head[part], tail[part]
            inside = t >= 0
            way = at[h] - np.where(inside[:, None], at[t], held[part])
            square = (way * way).sum(1)
            safe = np.maximum(square, 1e-12)
            pull = np.where(square > 0, -2 * a * b * safe ** (b - 1) / (1 + a * safe**b), 0.0)
            by = np.clip(pull[:, None] * way, -LONGEST, LONGEST) * rate
            step = moved(h, by) - moved(t[inside], by[inside])
            who = np.repeat(h, PUSHES)
            own, far = rng.integers(0, n, len(who)), rng.integers(0, len(drawn), len(who))
            way = at[who] - np.where((rng.random(len(who)) * total < n)[:, None], at[own], drawn[far])
            square = (way * way).sum(1)
            push = 2 * b / ((1e-3 + square) * (1 + a * square**b))
            step += moved(who, np.where(square[:, None] > 0, np.clip(push[:, None] * way, -LONGEST, LONGEST), 0.0) * rate)
            at = at + step
    return at


def mover(drawn: list[tuple[float, float]], total: int, rates: np.ndarray, seed: int, r: int, curve: tuple[float, float]):
    """A round of one band: its points (id, x, y, band) and the edges that leave them (a, b, weight, bx, by)."""

    def move(own: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        own, there = own.sort_values("id", ignore_index=True), there.sort_values(["a", "b"])
        if not len(own):
            return own[["id", "x", "y"]]
        place = pd.Series(np.arange(len(own)), index=own["id"])
        head, tail = place.reindex(there["a"]).to_numpy(int), place.reindex(there["b"]).fillna(-1).to_numpy(int)
        rng = np.random.default_rng([seed, r, int(own["band"].iloc[0])])
        at = epochs_of(own[["x", "y"]].to_numpy(float), head, tail, there[["bx", "by"]].to_numpy(float), there["weight"].to_numpy(float), np.array(drawn), total, rates, curve, rng)
        return pd.DataFrame({"id": own["id"], "x": np.round(at[:, 0], 9), "y": np.round(at[:, 1], 9)})

    return move


def projected(vectors: DataFrame, id: str = "id", vector: str = "vector", k: int = 15, least: float = 0.15, rounds: int = 12, epochs: int = 20, seed: int = 42) -> DataFrame:
    """(id, x, y): each vector's place in a plane where neighbours by cosine are near each other; null vectors have none.

    id: unique. The same rows, parameters and seed give the same places up to rounding of the first layout, which is the first
    two principal components. One point lies at 0, 0.
    """
    rows = cut(vectors.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector")).where("vector IS NOT NULL AND id IS NOT NULL"))
    n = rows.count()
    if n < 2:
        return rows.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    kind, curve = rows.schema["id"].dataType.simpleString(), closeness_curve(least)
    edges = cut(neighbour_graph(rows, min(k, n - 1)))
    flat = flattened(rows)
    wide = flat.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 1.0
    # equal vectors start a little apart, by their ids
    shake = lambda c: (F.pmod(F.xxhash64("id", F.lit(c), F.lit(seed)), F.lit(1 << 20)) / (1 << 20) - 0.5) * 1e-2
    now = cut(flat.select("id", *(F.round(F.col(c) / wide * HALF + shake(c), 6).alias(c) for c in "xy")))
    share = (1 << 30) * min(DRAWN, n) // n
    if n <= BLOCK:  # one band has no edges elsewhere, so it can go on for longer
        rounds, epochs = -(-rounds // 6), 6 * epochs

    for r in range(rounds):
        chance = F.pmod(F.xxhash64("id", F.lit(r), F.lit(seed)), F.lit(1 << 30)) < share if share < 1 << 30 else F.lit(True)
        drawn = sorted((p["x"], p["y"]) for p in now.where(chance).select("x", "y").collect()) or [(0.0, 0.0)]  # about DRAWN places
        rates = 1 - (r * epochs + np.arange(epochs)) / (rounds * epochs)
        points = cut(banded(now, r * TURN, n)) if n > BLOCK else banded(now, 0.0, n)
        ends = now.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
        there = edges.join(ends, "b").join(points.select(F.col("id").alias("a"), "band"), "a").select(F.col("band").alias("e_band"), "a", "b", "weight", "bx", "by")

        now = cut(points.groupBy("band").cogroup(there.groupBy("e_band")).applyInPandas(mover(drawn, n, rates, seed, r, curve), f"id {kind}, x double, y double"))
    return now
