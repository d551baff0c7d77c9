"""Hulls, smallest rectangles, corner order and projective maps against plain versions."""

import random
from math import atan2, cos, degrees, hypot, sin

import numpy as np
from pyspark.sql import functions as F

from boxsift.functions import geometry as G


def cross(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def plain_hull(points):
    """Points that no pair of others has on both sides of it: corners of the hull by brute force."""
    ps = sorted(set(points))
    if len(ps) < 3:
        return set(ps)
    on = set()
    for a in ps:
        for b in ps:
            if a != b and all(cross(a, b, c) > 0 or (cross(a, b, c) == 0 and min(a, b) <= c <= max(a, b)) for c in ps if c not in (a, b)):
                on |= {a, b}
    return on


def plain_area(points):
    """Least area over all directions of pairs, each looked at by itself."""
    ps = sorted(set(points))
    best = float("inf")
    for a in ps:
        for b in ps:
            d = (b[0] - a[0], b[1] - a[1]) if a != b else (1, 0)
            n = hypot(*d)
            along, across = [(x * d[0] + y * d[1]) / n for x, y in ps], [(y * d[0] - x * d[1]) / n for x, y in ps]
            best = min(best, (max(along) - min(along)) * (max(across) - min(across)))
    return best


def clouds():
    rng = random.Random(2)
    out = [[(5, 5)], [(1, 1), (4, 5)], [(0, 0), (2, 2), (5, 5), (9, 9)], [(0, 0), (0, 7), (0, 3)], [(0, 0), (10, 0), (10, 4), (0, 4), (5, 2), (0, 0)], [(0, 10), (10, 0), (20, 10), (10, 20)]]
    out += [[(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randint(3, 24))] for _ in range(150)]
    return out


def test_smallest_rectangle(spark):
    rows = [(k, [list(p) for p in ps]) for k, ps in enumerate(clouds())]
    df = spark.createDataFrame(rows, "k int, p array<array<int>>")
    got = df.select("k", G.hull(F.col("p")).alias("h"), G.smallest_rectangle(F.col("p")).alias("r")).collect()
    for g in got:
        ps = [tuple(p) for p in rows[g["k"]][1]]
        assert {(q["x"], q["y"]) for q in g["h"]} == plain_hull(ps), ps
        r = g["r"]
        assert abs(r["width"] * r["height"] - plain_area(ps)) < 1e-5 and -45 < r["angle"] <= 45
        u = (r["ux"] / r["length"], r["uy"] / r["length"])
        assert abs(degrees(atan2(u[1], u[0])) - r["angle"]) < 1e-9
        for x, y in ps:  # every point lies inside
            dx, dy = x - r["center_x"], y - r["center_y"]
            assert abs(dx * u[0] + dy * u[1]) <= r["width"] / 2 + 1e-6 and abs(dy * u[0] - dx * u[1]) <= r["height"] / 2 + 1e-6


def test_choice_of_sides(spark):
    """The width is the side within 45 degrees of the level, however the corners run; equal areas take the level one."""
    turned = lambda a, w, h: [[round(1000 * (x * cos(a) - y * sin(a))), round(1000 * (x * sin(a) + y * cos(a)))] for x, y in ((0, 0), (w, 0), (w, h), (0, h))]
    cases = [(turned(0, 4, 2), 4, 2, 0.0), (turned(0, 2, 4), 2, 4, 0.0), (turned(0.3, 4, 2), 4, 2, degrees(0.3)), (turned(-0.6, 2, 4), 2, 4, degrees(-0.6)), (turned(1.2, 4, 2), 2, 4, degrees(1.2) - 90)]
    cases += [([*p[k:], *p[:k]], w, h, a) for p, w, h, a in cases for k in (1, 2, 3)] + [(p[::-1], w, h, a) for p, w, h, a in cases]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, p array<array<int>>")
    for r in df.select("k", G.smallest_rectangle(F.col("p")).alias("r")).collect():
        _, w, h, a = cases[r["k"]]
        assert abs(r["r"]["width"] - 1000 * w) < 3 and abs(r["r"]["height"] - 1000 * h) < 3 and abs(r["r"]["angle"] - a) < 0.1


def test_rectangle_corners(spark):
    df = spark.createDataFrame([([[0, 0], [40, 30], [34, 38], [-6, 8]],)], "p array<array<int>>")
    out = df.select(G.smallest_rectangle(F.col("p")).alias("r")).select(G.rectangle_corners(F.col("r"), F.col("r.width"), F.col("r.height")).alias("c")).first()["c"]
    assert sorted(map(tuple, out)) == sorted([(0, 0), (40, 30), (34, 38), (-6, 8)])


def test_corner_order(spark):
    rng = random.Random(3)
    quads = [[[0, 0], [10, 1], [9, 8], [1, 9]], [[5, 0], [10, 5], [5, 10], [0, 5]]] + [[[rng.randrange(50), rng.randrange(50)] for _ in range(4)] for _ in range(60)]
    df = spark.createDataFrame([(k, q) for k, q in enumerate(quads)], "k int, q array<array<int>>")
    for r in df.select("k", G.ordered_corners(F.col("q")).alias("o")).collect():
        q = np.array(quads[r["k"]])
        s, d = q.sum(1), q[:, 1] - q[:, 0]
        assert r["o"] == q[[s.argmin(), d.argmin(), s.argmax(), d.argmax()]].tolist()


def test_projective(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        jig = lambda x, y: [x + rng.randrange(-20, 20), y + rng.randrange(-20, 20)]
        rows.append((k, [jig(100, 100), jig(300, 100), jig(300, 250), jig(100, 250)], [[0, 0], [rng.randrange(40, 300), 0], [199, 149], [0, 149]]))
    rows.append((60, [[0, 0], [1, 0], [1, 1], [0, 1]], [[0, 0], [1, 0], [1, 1], [0, 1]]))
    df = spark.createDataFrame(rows, "k int, s array<array<int>>, t array<array<int>>")
    there = df.withColumns({"m": G.projective(F.col("s"), F.col("t")), "i": G.projective(F.col("t"), F.col("s"))})
    out = there.select("*", G.mapped(F.col("m"), F.col("s")).alias("st"), G.mapped(F.col("i"), G.mapped(F.col("m"), F.col("s"))).alias("back")).collect()
    for r in out:
        assert np.allclose(r["st"], r["t"], atol=1e-6) and np.allclose(r["back"], r["s"], atol=1e-6)
        m, i = np.array(r["m"]), np.array(r["i"])
        assert np.allclose((m @ i) / (m @ i)[2, 2], np.eye(3), atol=1e-6)
    flat = spark.createDataFrame([([[0, 0], [0, 0], [0, 0], [0, 0]], [[0, 0], [1, 0], [1, 1], [0, 1]])], "s array<array<int>>, t array<array<int>>")
    assert flat.select(G.projective(F.col("s"), F.col("t"))).first()[0] is None
