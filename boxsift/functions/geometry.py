"""Geometry of integer pixel boxes as Column builders. A box is a struct or a mapping with x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxsift.functions.rows import bound


def box_of_points(points: Column) -> dict[str, Column]:
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return {"x1": F.array_min(xs), "y1": F.array_min(ys), "x2": F.array_max(xs), "y2": F.array_max(ys)}


def columns_of(prefix: str) -> dict[str, Column]:
    return {k: F.col(f"{prefix}.{k}") for k in ("x1", "y1", "x2", "y2")}


def center(b) -> tuple[Column, Column]:
    return (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2


def distance(a, b) -> Column:
    """Between centers."""
    (ax, ay), (bx, by) = center(a), center(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def expanded(b, dx, dy) -> dict[str, Column]:
    return {"x1": b["x1"] - dx, "y1": b["y1"] - dy, "x2": b["x2"] + dx, "y2": b["y2"] + dy}


def contains_point(b, x: Column, y: Column) -> Column:
    return (b["x1"] <= x) & (x <= b["x2"]) & (b["y1"] <= y) & (y <= b["y2"])


def intersects(a, b) -> Column:
    """Touching counts."""
    return ~((a["x2"] < b["x1"]) | (a["x1"] > b["x2"]) | (a["y2"] < b["y1"]) | (a["y1"] > b["y2"]))


def iou(a, b) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    area = lambda r: F.greatest(F.lit(1), (r["x2"] - r["x1"]) * (r["y2"] - r["y1"]))
    inter = w * h
    return F.when((w <= 0) | (h <= 0), F.lit(0.0)).otherwise(inter / (area(a) + area(b) - inter))


def centers_close(a, b, limit: int = 24) -> Column:
    """Compares sums of coordinates, so limit is twice the pixels."""
    return (F.abs((a["x1"] + a["x2"]) - (b["x1"] + b["x2"])) <= limit) & (F.abs((a["y1"] + a["y2"]) - (b["y1"] + b["y2"])) <= limit)


def clipped(b, width: Column, height: Column) -> dict[str, Column]:
    """Inside the image and one pixel wide and high at least."""
    x1 = F.least(F.greatest(F.lit(0), b["x1"]), width - 1)
    y1 = F.least(F.greatest(F.lit(0), b["y1"]), height - 1)
    return {"x1": x1, "y1": y1, "x2": F.least(F.greatest(x1 + 1, b["x2"]), width), "y2": F.least(F.greatest(y1 + 1, b["y2"]), height)}


def angle(points: Column) -> Column:
    """Of the smallest rectangle around a convex quadrangle, in (-45, 45]; 0 for fewer than four corners.

    The rectangle lies along one of the edges: the one whose direction spans the smallest area.
    """
    following = F.concat(F.slice(points, 2, 3), F.slice(points, 1, 1))

    def along(edge: Column) -> Column:
        dx, dy = edge["next"][0] - edge["here"][0], edge["next"][1] - edge["here"][1]
        n = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-9))
        span = lambda f: F.array_max(F.transform(points, f)) - F.array_min(F.transform(points, f))
        area = span(lambda p: (p[0] * dx + p[1] * dy) / n) * span(lambda p: (p[1] * dx - p[0] * dy) / n)
        turned = F.pmod(F.degrees(F.atan2(dy.cast("double"), dx.cast("double"))), F.lit(90.0))
        return F.struct(F.round(area, 6).alias("area"), F.when(turned > 45, turned - 90).otherwise(turned).alias("angle"))

    edges = F.zip_with(points, following, lambda here, following: F.struct(here.alias("here"), following.alias("next")))
    level = is_level(points)  # most boxes: no search
    return F.when((F.size(points) < 4) | level, F.lit(0.0)).otherwise(F.array_min(F.transform(edges, along))["angle"])


def corners_of(b) -> Column:
    """The corners of an upright box, as arrays (x, y)."""
    return F.array(*[F.array(b[x], b[y]) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))])


def is_level(points: Column) -> Column:
    """Whether four corners are those of the box around them, from the upper left on."""
    p = lambda k, c: F.get(F.get(points, F.lit(k)), F.lit(c))
    return (F.size(points) == 4) & (p(0, 1) == p(1, 1)) & (p(1, 0) == p(2, 0)) & (p(2, 1) == p(3, 1)) & (p(3, 0) == p(0, 0))


def hull(points: Column) -> Column:
    """Corners (x, y as long) of the convex hull of arrays (x, y), in turn; points on its edges are none.

    A point that joins a chain takes out those behind which the chain no longer turns the same way. Along a convex chain
    these are the last ones, so the fold filters instead of popping.
    """
    distinct = F.array_sort(F.array_distinct(F.transform(points, lambda p: F.struct(p[0].cast("long").alias("x"), p[1].cast("long").alias("y")))))
    kind = "array<struct<x:bigint,y:bigint>>"

    def turns(a: Column, b: Column, c: Column) -> Column:
        return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]) > 0

    def join(chain: Column, p: Column) -> Column:
        return F.concat(F.filter(chain, lambda q, k: (k == 0) | turns(F.get(chain, k - 1), q, p)), F.array(p)).cast(kind)

    def both(t: Column) -> Column:
        half = lambda ps: F.aggregate(ps, F.array().cast(kind), join)
        ends = lambda c: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))
        ring = bound({"low": half(t["p"]), "high": half(F.reverse(t["p"]))}, lambda h: F.concat(ends(h["low"]), ends(h["high"])))
        return F.when(F.size(t["p"]) < 3, t["p"]).otherwise(ring)

    return bound({"p": distinct}, both)


def width_along(dx: Column, dy: Column) -> tuple[Column, Column]:
    """Which of a rectangle's sides is its width: the one within half a right angle of the level, turned to point right.

    Image libraries differ here, some from version to version; this is the one place that decides.
    """
    flat, steep = F.abs(dy) < F.abs(dx), F.abs(dy) > F.abs(dx)
    x, y = F.when(steep | (~flat & (dx * dy < 0)), dy).otherwise(dx), F.when(steep | (~flat & (dx * dy < 0)), -dx).otherwise(dy)
    right = x > 0
    return F.when(right, x).otherwise(-x), F.when(right, y).otherwise(-y)


def smallest_rectangle(points: Column) -> Column:
    """Struct (angle, width, height, center_x, center_y, ux, uy, length) of the smallest rectangle around arrays (x, y).

    It lies along an edge of the hull. Of equal areas the one closest to level counts, then the one that
    turns up. The width lies along (ux, uy) / length; angle is its direction in degrees, in (-45, 45].
    """

    def along(h: Column, k: Column, p: Column) -> Column:
        q = F.get(h, F.pmod(k + 1, F.size(h)))
        ux, uy = width_along(q["x"] - p["x"], q["y"] - p["y"])
        level = uy == 0
        return bound({"x": F.when(level, 1).otherwise(ux), "y": F.when(level, 0).otherwise(uy)}, lambda u: spanned(h, u))

    def spanned(h: Column, u: Column) -> Column:
        across = F.transform(h, lambda p: p["x"] * u["x"] + p["y"] * u["y"])
        down = F.transform(h, lambda p: p["y"] * u["x"] - p["x"] * u["y"])
        return bound({"u": u, "a": across, "b": down}, measured)

    def measured(t: Column) -> Column:
        u = t["u"]
        a1, a2, b1, b2 = F.array_min(t["a"]), F.array_max(t["a"]), F.array_min(t["b"]), F.array_max(t["b"])
        square = (u["x"] * u["x"] + u["y"] * u["y"]).cast("double")
        tilt = u["y"].cast("double") / u["x"]
        area = (a2 - a1).cast("double") * (b2 - b1) / square
        return F.struct(area.alias("area"), F.abs(tilt).alias("off"), tilt.alias("tilt"), u["x"].alias("ux"), u["y"].alias("uy"), square.alias("square"), a1.alias("a1"), a2.alias("a2"), b1.alias("b1"), b2.alias("b2"))

    def reduced(t: Column) -> Column:
        """In terms of the shortest whole-number vector along the width, so equal rectangles come out equal."""
        r, rest = t["r"], lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], s["b"]).alias("b")))
        common = F.aggregate(F.sequence(F.lit(1), F.lit(48)), F.struct(r["ux"].cast("long").alias("a"), F.abs(r["uy"]).cast("long").alias("b")), rest)["a"]
        return bound({"r": r, "g": F.when(r["uy"] == 0, r["ux"].cast("long")).otherwise(common)}, lambda b: bound({**{k: (b["r"][k] / b["g"]) for k in ("ux", "uy", "a1", "a2", "b1", "b2")}, "tilt": b["r"]["tilt"], "square": b["r"]["square"] / b["g"] / b["g"]}, told))

    def told(r: Column) -> Column:
        n = F.sqrt(r["square"])
        a, b = (r["a1"] + r["a2"]) / 2 / r["square"], (r["b1"] + r["b2"]) / 2 / r["square"]
        return F.struct(
            F.degrees(F.atan(r["tilt"])).alias("angle"),
            ((r["a2"] - r["a1"]) / n).alias("width"),
            ((r["b2"] - r["b1"]) / n).alias("height"),
            (r["ux"] * a - r["uy"] * b).alias("center_x"),
            (r["uy"] * a + r["ux"] * b).alias("center_y"),
            r["ux"].alias("ux"),
            r["uy"].alias("uy"),
            n.alias("length"),
        )

    def turned(p: Column) -> Column:
        best = bound({"h": hull(p)}, lambda t: F.array_min(F.transform(t["h"], lambda p, k: along(t["h"], k, p))))
        return bound({"r": best}, reduced)

    def framed(t: Column) -> Column:
        """Where the corners of the level box around them are among the points, that box is the hull: no search."""
        return F.when(F.size(F.array_except(corners_of(t), t["p"])) == 0, upright(t)).otherwise(turned(t["p"]))

    return bound({"p": points}, lambda t: bound({"p": t["p"], **box_of_points(t["p"])}, framed))


def upright(b) -> Column:
    """A level box as smallest_rectangle gives it."""
    x1, y1, x2, y2 = (b[c].cast("double") for c in ("x1", "y1", "x2", "y2"))
    fields = {"angle": F.lit(0.0), "width": x2 - x1, "height": y2 - y1, "center_x": (x1 + x2) / 2, "center_y": (y1 + y2) / 2, "ux": F.lit(1.0), "uy": F.lit(0.0), "length": F.lit(1.0)}
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def rectangle_corners(r: Column, width: Column, height: Column) -> Column:
    """Corners of a rectangle of these sides about the center and along the width of r, rounded half to even."""

    def corner(sx: int, sy: int) -> Column:
        x = r["center_x"] + sx * (width / 2) * r["ux"] / r["length"] - sy * (height / 2) * r["uy"] / r["length"]
        y = r["center_y"] + sx * (width / 2) * r["uy"] / r["length"] + sy * (height / 2) * r["ux"] / r["length"]
        return F.array(F.rint(x).cast("int"), F.rint(y).cast("int"))

    return F.array(*[corner(sx, sy) for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1))])


def ordered_corners(points: Column) -> Column:
    """Four corners from the upper left on: least and greatest sum are the first and third, least and greatest y - x the
    second and fourth; the first of equals."""
    ranked = lambda f: F.transform(points, lambda p, k: F.struct(f(p).alias("v"), k.alias("k"), p.alias("p")))
    total, slope = ranked(lambda p: p[0] + p[1]), ranked(lambda p: p[1] - p[0])
    last = lambda ps: F.array_max(F.transform(ps, lambda s: F.struct(s["v"].alias("v"), (-s["k"]).alias("k"), s["p"].alias("p"))))["p"]
    return F.array(F.array_min(total)["p"], F.array_min(slope)["p"], last(total), last(slope))


def is_quadrangle(points: Column) -> Column:
    """Whether no three of four corners lie on a line, so that a projective map takes them to a rectangle."""
    p = lambda k, c: F.get(F.get(points, F.lit(k)), F.lit(c)).cast("long")
    area = lambda i, j, k: (p(j, 0) - p(i, 0)) * (p(k, 1) - p(i, 1)) - (p(j, 1) - p(i, 1)) * (p(k, 0) - p(i, 0))
    return (area(0, 1, 2) != 0) & (area(0, 1, 3) != 0) & (area(0, 2, 3) != 0) & (area(1, 2, 3) != 0)


def projective(source: Column, target: Column) -> Column:
    """Three rows of three: the map that takes four source corners to four target corners, arrays (x, y); null if there is none.

    Eight equations by Gauss and Jordan, the row of the greatest value in the column at hand ahead, as a fold over columns.
    """
    s = lambda k, c: F.get(F.get(source, F.lit(k)), F.lit(c)).cast("double")
    t = lambda k, c: F.get(F.get(target, F.lit(k)), F.lit(c)).cast("double")
    zero, one = F.lit(0.0), F.lit(1.0)
    rows = []
    for k in range(4):
        x, y, u, v = s(k, 0), s(k, 1), t(k, 0), t(k, 1)
        rows += [F.array(x, y, one, zero, zero, zero, -x * u, -y * u, u), F.array(zero, zero, zero, x, y, one, -x * v, -y * v, v)]

    def solve(m: Column, c: Column) -> Column:
        """m with column c cleared in all rows but one, which moves to the end; after eight columns all are in order."""
        size = lambda row: F.abs(F.get(row, c))
        # Rows that have served as pivots are the last c of them.
        free = F.transform(F.slice(m, 1, 8 - c), lambda row, k: F.struct(size(row).alias("v"), (-k).alias("k")))
        return bound({"m": m, "at": -F.array_max(free)["k"]}, lambda b: scaled(b, c))

    def scaled(b: Column, c: Column) -> Column:
        pivot = F.get(b["m"], b["at"])
        return bound({"m": b["m"], "at": b["at"], "p": F.transform(pivot, lambda v: F.try_divide(v, F.get(pivot, c)))}, lambda d: cleared(d, c))

    def cleared(d: Column, c: Column) -> Column:
        others = F.filter(d["m"], lambda _, k: k != d["at"])
        swept = F.transform(others, lambda row: F.transform(row, lambda v, j: v - F.get(row, c) * F.get(d["p"], j)))
        return F.concat(swept, F.array(d["p"]))

    solved = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.array(*rows).cast("array<array<double>>"), lambda m, c: solve(m, c).cast("array<array<double>>"))

    def shaped(b: Column) -> Column:
        h = [F.get(F.get(b["m"], F.lit(k)), F.lit(8)) for k in range(8)]
        ok = h[0].isNotNull()
        for v in h[1:]:
            ok = ok & v.isNotNull() & ~F.isnan(v)
        return F.when(ok, F.array(F.array(*h[:3]), F.array(*h[3:6]), F.array(h[6], h[7], one)))

    return bound({"m": solved}, shaped)


def mapped(matrix: Column, points: Column) -> Column:
    """Points (x, y) under two or three rows of three; three rows divide by the last."""

    def one(p: Column) -> Column:
        row = lambda k: F.get(matrix, F.lit(k))[0] * p[0] + F.get(matrix, F.lit(k))[1] * p[1] + F.get(matrix, F.lit(k))[2]
        scale = F.when(F.size(matrix) == 3, row(2)).otherwise(1.0)
        return F.array(F.try_divide(row(0), scale), F.try_divide(row(1), scale))

    return F.transform(points, one)


def clipped_points(points: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """Points inside the image: from 0 to its last pixel, or from 0 on where its size is not known."""
    held = lambda v, side: F.greatest(F.lit(0), v) if side is None else F.when(side.isNull(), F.greatest(F.lit(0), v)).otherwise(F.least(F.greatest(F.lit(0), v), side - 1))
    return F.transform(points, lambda p: F.array(held(p[0], width), held(p[1], height)))
