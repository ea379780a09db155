"""Shapes and fields: signed distances, coverage and compositing, scanline spans, distance transform, field thresholds, colour cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from samplegrid.functions import color
from samplegrid.operators.window import edges


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def _length(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def sdf_circle(x, y, r) -> Column:
    """Signed distances to shapes about (0, 0): below zero inside."""
    return _length(_c(x), _c(y)) - _c(r)


def sdf_box(x, y, half_w, half_h) -> Column:
    qx, qy = F.abs(_c(x)) - _c(half_w), F.abs(_c(y)) - _c(half_h)
    zero = F.lit(0.0)
    return _length(F.greatest(qx, zero), F.greatest(qy, zero)) + F.least(F.greatest(qx, qy), zero)


def sdf_line(x, y, ax, ay, bx, by, thickness) -> Column:
    """A line from a to b with square ends, `thickness` wide."""
    x, y, ax, ay, bx, by = map(_c, (x, y, ax, ay, bx, by))
    n = _length(bx - ax, by - ay)
    dx, dy = (bx - ax) / n, (by - ay) / n
    px, py = x - (ax + bx) * 0.5, y - (ay + by) * 0.5
    return sdf_box(px * dx + py * dy, py * dx - px * dy, n * 0.5, _c(thickness) * 0.5)


def sdf_triangle(x, y, *corners) -> Column:
    """Three corners ax, ay, bx, by, cx, cy in either order."""
    x, y, c = _c(x), _c(y), [_c(v) for v in corners]
    points = [(c[0], c[1]), (c[2], c[3]), (c[4], c[5])]
    edge = [(q[0] - p[0], q[1] - p[1]) for p, q in zip(points, [*points[1:], points[0]], strict=True)]
    turn = edge[0][0] * edge[2][1] - edge[0][1] * edge[2][0]
    nearest, side = [], []
    for (px, py), (ex, ey) in zip(points, edge, strict=True):
        vx, vy = x - px, y - py
        t = F.least(F.greatest((vx * ex + vy * ey) / (ex * ex + ey * ey), F.lit(0.0)), F.lit(1.0))
        nearest.append((vx - ex * t) * (vx - ex * t) + (vy - ey * t) * (vy - ey * t))
        side.append(turn * (vx * ey - vy * ex))
    return -F.sqrt(F.least(*nearest)) * F.signum(F.least(*side))


def sdf_ellipse(x, y, rx, ry, how: str = "squashed") -> Column:
    """Approximations for radii rx, ry: squashed (a scaled circle), radial (along the ray from the middle), or blend of both outside."""
    x, y, rx, ry = map(_c, (x, y, rx, ry))
    k = _length(x / rx, y / ry)
    squashed = (k - 1.0) * F.least(rx, ry)
    if how == "squashed":
        return squashed
    radial = _length(x, y) * (F.lit(1.0) - F.lit(1.0) / F.nullif(k, F.lit(0.0)))
    return radial if how == "radial" else F.when(F.coalesce(radial, F.lit(-1.0)) < 0, squashed).otherwise((squashed + radial) / 2)


def sdf_ellipse_exact(x, y, rx, ry, steps: int = 60) -> Column:
    """The distance to the nearest point of the ellipse, below zero inside.

    With p in the first quadrant and a >= b the radii along it, the nearest point is (a^2 px / (u + a^2 - b^2), b^2 py / u) for the one u > 0 at which that
    lies on the ellipse. It is between b py and the length of (a px, b py), and is found by halving the interval of its logarithm, which keeps all
    digits of a small u. Points on the long axis are taken as a hair's breadth beside it."""
    x, y, rx, ry = map(_c, (x, y, rx, ry))
    flat = rx >= ry
    a, b = F.greatest(rx, ry), F.least(rx, ry)
    px, py = F.abs(F.when(flat, x).otherwise(y)), F.greatest(F.abs(F.when(flat, y).otherwise(x)), b * 1e-12)
    ax, by, k = a * px, b * py, a * a - b * b

    def closer(t: Column) -> Column:
        """Half of the interval, which holds the point where the sum of squares is 1."""
        m = F.sqrt(t["lo"] * t["hi"])
        low = (ax / (m + k)) * (ax / (m + k)) + (by / m) * (by / m) > 1
        return F.struct(F.when(low, m).otherwise(t["lo"]).alias("lo"), F.when(low, t["hi"]).otherwise(m).alias("hi"))

    start = F.struct(by.alias("lo"), _length(ax, by).alias("hi"))
    u = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda t, _: closer(t), lambda t: F.sqrt(t["lo"] * t["hi"]))
    d = F.get(F.transform(F.array(u), lambda u: _length(px - a * ax / (u + k), py - b * by / u)), F.lit(0))
    return F.when(_length(x / rx, y / ry) < 1, -d).otherwise(d)


def sdf_curve(x, y, curve) -> Column:
    """The distance to a line through the points of curve, an array of (x, y, r), whose half width goes evenly from one point's r to the next one's, with round
    ends: the least distance to its parts, each the hull of two circles. Of a part whose one circle holds the other, it is the larger one's."""
    x, y = _c(x), _c(y)

    def part(p: Column, q: Column) -> Column:
        dx, dy, dr = q["x"] - p["x"], q["y"] - p["y"], p["r"] - q["r"]
        length = _length(dx, dy)
        # across and along the part, in its own length; the sides of the hull lean by dr over the length
        across, along = F.abs((x - p["x"]) * dy - (y - p["y"]) * dx) / length, ((x - p["x"]) * dx + (y - p["y"]) * dy) / length
        lean = F.sqrt(F.greatest(length * length - dr * dr, F.lit(0.0)))
        place = (lean * along - dr * across) / length
        first, second = _length(x - p["x"], y - p["y"]) - p["r"], _length(x - q["x"], y - q["y"]) - q["r"]
        side = (lean * across + dr * along) / length - p["r"]
        return F.when(length <= F.abs(dr), F.least(first, second)).when(place < 0, first).when(place > lean, second).otherwise(side)

    curve = _c(curve)
    return F.array_min(F.transform(F.sequence(F.lit(0), F.size(curve) - 2), lambda i: part(F.get(curve, i), F.get(curve, i + 1))))


def sdf_polygon(x, y, corners: list[tuple]) -> Column:
    """A few corners in order, below zero inside by parity."""
    x, y = _c(x), _c(y)
    points = [(_c(a), _c(b)) for a, b in corners]
    nearest, crossed = [], F.lit(0)
    for (px, py), (qx, qy) in zip(points, [*points[1:], points[0]], strict=True):
        ex, ey, wx, wy = qx - px, qy - py, x - px, y - py
        size = ex * ex + ey * ey
        t = F.when(size > 0, F.least(F.greatest((wx * ex + wy * ey) / size, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        nearest.append((wx - ex * t) * (wx - ex * t) + (wy - ey * t) * (wy - ey * t))
        turn = ex * wy - ey * wx
        crossed = crossed + F.when((py <= y) & (qy > y) & (turn > 0) | (py > y) & (qy <= y) & (turn < 0), 1).otherwise(0)
    d = F.sqrt(F.least(*nearest))
    return F.when(crossed % 2 == 1, -d).otherwise(d)


def sdf_ring(x, y, rx, ry, start: float, sweep: float, thickness) -> Column:
    """A band of an elliptic outline, `thickness` to the inside, from the angle `start` (0 to the right, degrees) on over `sweep` degrees clockwise (below zero: the other
    way): the band cut with a wedge for less than a half turn, else the band without the wedge that closes it. The wedge goes from the middle through both ends, on a
    circle of the larger radius, and as far beyond them as covers the outline."""
    if not sweep:
        raise ValueError("a sweep of no degrees has no section")
    x, y, rx, ry = map(_c, (x, y, rx, ry))
    if sweep < 0:
        start, sweep = start + sweep, -sweep
    reach = F.greatest(rx, ry)
    ends = [(F.cos(F.lit(math.radians(a % 360))) * reach, F.sin(F.lit(math.radians(a % 360))) * reach) for a in (start, start + sweep)]
    mx, my = (ends[0][0] + ends[1][0]) / 2, (ends[0][1] + ends[1][1]) / 2
    beyond = (reach - _length(mx, my) + 1) * 2
    corners = [(0, 0), ends[0], *((ex + mx * beyond, ey + my * beyond) for ex, ey in ends), ends[1]]
    wedge = sdf_polygon(x, y, corners)
    outline = sdf_ellipse(x, y, rx, ry, "blend")
    band = sdf_subtract(outline + _c(thickness), outline)
    return sdf_intersect(band, wedge) if sweep < 180 else sdf_subtract(wedge, band)


#: Distance functions by kind; more can be added.
KINDS = {"circle": sdf_circle, "box": sdf_box, "line": sdf_line, "triangle": sdf_triangle, "ellipse": sdf_ellipse, "ellipse_exact": sdf_ellipse_exact, "curve": sdf_curve, "ring": sdf_ring}


def sdf_union(*c: Column) -> Column:
    return F.least(*c)


def sdf_subtract(a: Column, b: Column) -> Column:
    """b without a."""
    return F.greatest(-a, b)


def sdf_intersect(*c: Column) -> Column:
    return F.greatest(*c)


def coverage(distance: Column) -> Column:
    """0..255: full inside, falling to nothing one sample outside."""
    return F.floor(F.when(distance > 0, F.greatest(F.lit(1.0) - distance, F.lit(0.0))).otherwise(1.0) * 255).cast("int")


def rasterise(shapes: DataFrame, distance: Column, reach: Column, w: int, h: int) -> DataFrame:
    """(shape_id, y, x, a, deep) with a over 0: coverage, and whether it lies deeper than 1 inside, of each sample of a w by h canvas by shapes(shape_id, cx, cy, ...). distance is a Column over dx, dy
    and the shape's columns; reach bounds how far from (cx, cy) a shape goes. Each shape makes the samples of its own box: no join."""
    box = shapes.withColumn("reach", F.ceil(reach) + 1)
    for axis, side in (("y", h), ("x", w)):
        first, last = F.greatest(F.ceil(F.col(f"c{axis}") - F.col("reach")), F.lit(0)), F.least(F.floor(F.col(f"c{axis}") + F.col("reach")), F.lit(side - 1))
        box = box.where(first <= last).withColumn(axis, F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    box = box.withColumns({"dx": F.col("x") - F.col("cx"), "dy": F.col("y") - F.col("cy")})
    return box.withColumn("a", coverage(distance)).withColumn("deep", distance < -1).where("a > 0").drop("dx", "dy", "reach")


def composite(layers: DataFrame, order: str, background: int = 0) -> DataFrame:
    """(y, x, v) of layers(y, x, a, v, deep, order): later layers over earlier ones. Deep samples are set; the others, within 1 of the rim, are mixed as
    (under * (255 - a) >> 8) + (over * a >> 8). The layers of one sample are gathered in order, as each is cut to a whole number."""
    stack = layers.groupBy("y", "x").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "a", "v", "deep"))).alias("s"))
    return stack.select("y", "x", F.expr(f"aggregate(s, {background}, (u, t) -> if(t.deep, t.v, cast(shiftright(u * (255 - t.a), 8) + shiftright(t.v * t.a, 8) as int)))").alias("v"))


def fill_spans(segments: DataFrame, rule: str = "odd") -> DataFrame:
    """(shape_id, y, left, right): filled parts of each row of segments(shape_id, ax, ay, bx, by). A segment crosses the rows from round(top) to
    below round(bottom), halves up; crossings are paired by parity (odd), or from where the running winding number leaves 0 to where it is 0 again (winding)."""
    s = segments.where("floor(ay + 0.5D) <> floor(by + 0.5D)").selectExpr("*", "if(ay < by, 1, -1) dir", "cast(floor(least(ay, by) + 0.5D) as int) top", "cast(floor(greatest(ay, by) + 0.5D) as int) bottom")
    s = s.selectExpr("shape_id", "ax", "ay", "bx", "by", "dir", "explode(sequence(top, bottom - 1)) y").selectExpr("shape_id", "y", "dir", "ax + (y - ay) * (bx - ax) / (by - ay) cx")
    w = Window.partitionBy("shape_id", "y").orderBy("cx", "dir")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    inside = F.row_number().over(w) % 2 if rule == "odd" else F.sum("dir").over(so_far)
    s = s.select("shape_id", "y", "cx", "dir", inside.alias("n")).withColumn("was", F.lag("n", 1, 0).over(w))
    s = s.withColumn("left", F.last(F.when(F.col("was") == 0, F.col("cx")), True).over(so_far))
    return s.where("n = 0").select("shape_id", "y", "left", F.col("cx").alias("right"))


def gamma_table(gamma: float = 2.2) -> list[int]:
    """The brightness of each coverage 0..255, so that a half covered sample looks half as bright."""
    return [min(255, int(i ** (1 / gamma) * (255 / 255 ** (1 / gamma)))) for i in range(256)]


def _bright(c: Column, gamma: float) -> Column:
    return F.element_at(F.array(*map(F.lit, gamma_table(gamma))), (c + 1).cast("int"))


def span_ends(spans: DataFrame, gamma: float = 2.2) -> DataFrame:
    """fill_spans() with whole ends: (shape_id, y, left, left_cover, right, right_cover), where a cover is the brightness of the part of the end's sample that the span
    covers: to the right of its left end, to the left of its right end."""
    part = lambda c: F.col(c) - F.floor(c)
    return spans.select(
        "shape_id", "y", F.floor("left").cast("int").alias("left"), _bright(((1 - part("left")) * 255).cast("int"), gamma).alias("left_cover"),
        F.floor("right").cast("int").alias("right"), _bright((part("right") * 255).cast("int"), gamma).alias("right_cover"),
    )


def coverage_lines(lines: DataFrame, w: int, h: int, gamma: float = 2.2) -> DataFrame:
    """(shape_id, i, pair, y, x, a, under) of lines(shape_id, x1, y1, x2, y2) of whole numbers, one sample wide, on a w by h canvas: at step i of the longer axis the
    sample that the line is at (pair 0) and the one after it across (pair 1), the weights of the line's value and of what is under it.

    The other axis is at the least place not under the line, and how far it is beyond it, in units of both sides, tells how the two samples share the line, so each step is
    a closed form of its number. Both samples keep what the second one's cover leaves. Lines to the left or up are moved by one, for the pair."""
    p = lines.selectExpr("shape_id", "x1", "y1", "abs(x2 - x1) dx", "abs(y2 - y1) dy", "if(x2 < x1, -1, 1) sx", "if(y2 < y1, -1, 1) sy")
    p = p.selectExpr("*", "explode(sequence(0, greatest(dx, dy))) i")
    p = p.selectExpr("*", "if(dx >= dy, i, cast(ceil(i * dx / dy) as int)) mx", "if(dx >= dy, if(dx = 0, 0, cast(ceil(i * dy / dx) as int)), i) my")
    error = "(my * dx - mx * dy + (dx + dy) div 2 - if(dx > dy, dx + dy, 0)) * if(dx >= dy, -sy, sx)"
    p = p.selectExpr("*", f"cast(least(greatest({error}, -127), 127) as int) v")
    p = p.withColumns({"second": _bright(128 + F.col("v"), gamma), "first": _bright(128 - F.col("v"), gamma)})
    p = p.selectExpr("shape_id", "i", "explode(array(0, 1)) pair", "y1 + sy * my + if(sy < 0, 1, 0) y", "x1 + sx * mx + if(sx < 0, 1, 0) x", "dx > dy steep", "first", "second")
    p = p.selectExpr("shape_id", "i", "pair", "y + if(steep, pair, 0) y", "x + if(steep, 0, pair) x", "if(pair = 0, first, second) a", "255 - second under")
    return p.where(f"y >= 0 and x >= 0 and y < {h} and x < {w}")


def composite_lines(layers: DataFrame, order: list[str], background: int = 0) -> DataFrame:
    """(y, x, v) of coverage_lines() with the lines' values v: later samples over earlier ones, (under * what is there >> 8) + (a * v >> 8)."""
    stack = layers.groupBy("y", "x").agg(F.array_sort(F.collect_list(F.struct(*order, "a", "under", "v"))).alias("s"))
    return stack.select("y", "x", F.expr(f"aggregate(s, {background}, (u, t) -> cast(shiftright(u * t.under, 8) + shiftright(t.v * t.a, 8) as int))").alias("v"))


def inside(r, g, b) -> Column:
    """Whether a colour's lightness is at most a half."""
    return (F.greatest(_c(r), _c(g), _c(b)) + F.least(_c(r), _c(g), _c(b))) / 510.0 <= 0.5


def distance_transform(px: DataFrame, inside: Column) -> DataFrame:
    """(image_id, y, x, dist, gx, gy): exact distance to the nearest edge sample, 1 at least, below zero inside, and the direction to it (of
    equally near ones the smaller x, then y). Nulls in an image without edges.

    Separable: each column finds its nearest edges up and down, then each row takes the least of all its columns; a row is one
    array, so the work is its length squared and no image is gathered."""
    p = edges(px, inside).join(px.select("image_id", "y", "x", inside.alias("inside")), ["image_id", "y", "x"])
    w = Window.partitionBy("image_id", "x").orderBy("y")
    at = F.when(F.col("edge"), F.col("y"))
    p = p.withColumn("up", F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("down", F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    near = F.when(F.col("down").isNull() | (F.col("y") - F.col("up") <= F.col("down") - F.col("y")), F.col("up")).otherwise(F.col("down"))
    rows = p.withColumn("ey", near).groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "ey", "inside"))).alias("r"))
    best = "array_min(transform(filter(r, e -> e.ey is not null), e -> named_struct('d', (e.x - t.x) * (e.x - t.x) + (e.ey - y) * (e.ey - y), 'x', e.x, 'y', e.ey)))"
    rows = rows.selectExpr("image_id", "y", f"inline(transform(r, t -> named_struct('x', t.x, 'inside', t.inside, 'b', {best})))")
    rows = rows.selectExpr("*", "greatest(1D, sqrt(b.d)) n")
    return rows.selectExpr("image_id", "y", "x", "if(inside, -n, n) dist", "(b.x - x) / n gx", "(b.y - y) / n gy")


def reachable(field: DataFrame, start: DataFrame) -> DataFrame:
    """(image_id, y, x, hit) of field(image_id, y, x, dist) and start(image_id, y, x): what is seen from the starts by jumps of the whole distance, of 3 at
    least, to the left, right, top and bottom. Each round takes the places that no disc of an earlier round covers, marks them (hit) and
    the disc of one less than their distance around them, and goes on to their four ends inside the image. Rounds run until there
    is no place left, as each covers its own places for good. An image of up to WHOLE places is one group; rounds of larger ones are
    scratch tables."""
    from samplegrid.operators.scan import split_by_size
    from samplegrid.operators.signals import WHOLE

    field = field.select("image_id", "y", "x", "dist")
    short, long_ = split_by_size(field, "image_id", WHOLE)
    out = _reachable_each(short, start)
    return out if long_ is None else out.unionByName(_reachable_joined(long_, start))


def _reachable_each(field: DataFrame, start: DataFrame) -> DataFrame:
    def run(pdf, starts):
        import numpy as np

        if not len(pdf) or not len(starts):
            return type(pdf)({"image_id": [], "y": [], "x": [], "hit": []})
        h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        reach = np.nan_to_num(pdf["dist"].to_numpy(float))
        known = np.zeros((h, w), np.int64)
        known[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = np.where(reach >= 3, np.trunc(np.minimum(reach, 1 << 30)), 0)
        seen, hit = np.zeros((h, w), bool), np.zeros((h, w), bool)
        front = set(zip(starts["y"].tolist(), starts["x"].tolist(), strict=True))
        while front := [(y, x, int(known[y, x])) for y, x in front if 0 <= y < h and 0 <= x < w and known[y, x]]:
            ends = set()
            for y, x, rad in front:
                top, left = max(0, y - rad + 1), max(0, x - rad + 1)
                part = seen[top : y + rad, left : x + rad]
                part |= (np.arange(top, top + part.shape[0])[:, None] - y) ** 2 + (np.arange(left, left + part.shape[1]) - x) ** 2 <= (rad - 1) ** 2
                hit[y, x] = True
                ends.update((y, to) for to in (x - rad, x + rad) if 0 < to < w)
                ends.update((to, x) for to in (y - rad, y + rad) if 0 < to < h)
            front = {(y, x) for y, x in ends if not seen[y, x]}
        y, x = np.nonzero(seen)
        return type(pdf)({"image_id": pdf["image_id"].iloc[0], "y": y, "x": x, "hit": hit[y, x]})

    kind = field.schema["image_id"].dataType.simpleString()
    return field.groupBy("image_id").cogroup(start.select("image_id", "y", "x").groupBy("image_id")).applyInPandas(run, f"image_id {kind}, y int, x int, hit boolean")


def _reachable_joined(field: DataFrame, start: DataFrame) -> DataFrame:
    from samplegrid.operators.gather import sizes
    from samplegrid.operators.scan import cut, discard

    known = cut(field.selectExpr("image_id", "y", "x", "cast(dist as int) rad").join(sizes(field), "image_id").where("rad >= 3"))
    bounds = sizes(field)
    front, seen, seen_before = start.select("image_id", "y", "x").distinct(), None, []
    while True:
        front = cut(front.join(known, ["image_id", "y", "x"]))
        if not front.limit(1).count():
            break
        disc = front.selectExpr("*", "explode(sequence(1 - rad, rad - 1)) dy").selectExpr("*", "explode(sequence(1 - rad, rad - 1)) dx")
        disc = disc.where("dx * dx + dy * dy <= (rad - 1) * (rad - 1)").selectExpr("image_id", "y + dy y", "x + dx x", "dx = 0 and dy = 0 hit")
        disc = disc.join(bounds, "image_id").where("y >= 0 and x >= 0 and y < h and x < w").select("image_id", "y", "x", "hit")
        seen = disc if seen is None else seen.unionByName(disc)
        done, seen = seen_before, cut(seen.groupBy("image_id", "y", "x").agg(F.bool_or("hit").alias("hit")))
        discard(*done)
        seen_before = [seen]
        ends = "array(struct(y as y, x - rad as x), struct(y as y, x + rad as x), struct(y - rad as y, x as x), struct(y + rad as y, x as x))"
        ends = front.selectExpr("image_id", "w", "h", "y y0", "x x0", f"inline({ends})")
        ends = ends.where("(x = x0 or (x > 0 and x < w)) and (y = y0 or (y > 0 and y < h))").select("image_id", "y", "x").distinct()
        front = ends.join(seen, ["image_id", "y", "x"], "left_anti")
    if seen is None:
        return field.selectExpr("image_id", "y", "x", "true hit").limit(0)
    return seen


def map_texture(triangles: DataFrame, texture: DataFrame, w: int, h: int) -> DataFrame:
    """(shape_id, y, x, v) of triangles(shape_id, image_id, x1, y1, z1, u1, v1, ... v3) on a w by h canvas: the sample of the image texture(image_id, y, x, v)
    at each place of a triangle, right in perspective: 1 / z, u / z and v / z are linear across it and divided at every sample. Places
    on an edge belong to the triangle; u and v are cut to whole numbers and pinned to the image; flat triangles give nothing. Each triangle makes the samples of its
    own box. Triangles are dealt out by hash in groups of one image and some million places; an image of up to WHOLE samples goes whole to each of its
    groups, larger ones meet the places in one equi-join."""
    from samplegrid.operators.scan import split_by_size
    from samplegrid.operators.signals import WHOLE

    short, long_ = split_by_size(texture.select("image_id", "y", "x", "v"), "image_id", WHOLE)
    out = _map_texture_each(triangles, short, w, h)
    return out if long_ is None else out.unionByName(_map_texture_joined(triangles, long_, w, h))


def _map_texture_each(triangles: DataFrame, texture: DataFrame, w: int, h: int, places: int = 1 << 22) -> DataFrame:
    corners = [f"{n}{k}" for n in "xyzuv" for k in (1, 2, 3)]
    t = triangles.select("shape_id", "image_id", *(F.col(c).cast("double").alias(c) for c in corners))
    groups = max(1, -(-t.count() * w * h // places))
    t = t.withColumn("part", F.pmod(F.xxhash64("shape_id", *corners), F.lit(groups)))
    whole = texture.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("a"))
    whole = whole.select("image_id", *(F.expr(f"transform(a, t -> t.{c})").alias(c) for c in "yxv"))
    whole = t.selectExpr("image_id", "part slot").distinct().join(whole, "image_id").withColumnRenamed("image_id", "image")

    def run(shapes_, images):
        import numpy as np
        import pandas as pd

        out = [shapes_[["shape_id"]].head(0).assign(y=0, x=0, v=0)]
        if len(images):
            iy, ix, iv = (np.asarray(images[c].iloc[0]) for c in "yxv")
            th, tw = int(iy.max()) + 1, int(ix.max()) + 1
            at = np.full(th * tw, -1)
            at[iy * tw + ix] = np.arange(len(iv))
            c = {n: shapes_[n].to_numpy(float) for n in corners}
            area = (c["x2"] - c["x1"]) * (c["y3"] - c["y1"]) - (c["x3"] - c["x1"]) * (c["y2"] - c["y1"])
            box = []
            for n, side in (("y", h), ("x", w)):
                ends = c[f"{n}1"], c[f"{n}2"], c[f"{n}3"]
                first = np.maximum(np.ceil(np.minimum.reduce(ends)), 0)
                box.append((first, np.minimum(np.floor(np.maximum.reduce(ends)), side - 1) - first + 1))
            (y0, nh), (x0, nw) = box
            kept = np.flatnonzero(np.isfinite(area) & (area != 0) & (nh > 0) & (nw > 0))
            size = (nh[kept] * nw[kept]).astype(np.int64)
            # so many triangles at a time
            for some in np.split(kept, np.flatnonzero(np.diff(np.cumsum(size) >> 18)) + 1) if len(kept) else ():
                parts = []
                for i, corner, full, top, left, nh_, nw_ in zip(some.tolist(), zip(*(c[m][some].tolist() for m in corners[:6]), strict=True), *(u[some].tolist() for u in (area, y0, x0, nh, nw)), strict=True):
                    x1, x2, x3, y1, y2, y3 = corner
                    y, x = np.arange(top, top + nh_)[:, None], np.arange(left, left + nw_)
                    a = ((x2 - x) * (y3 - y) - (x3 - x) * (y2 - y)) / full
                    b = ((x3 - x) * (y1 - y) - (x1 - x) * (y3 - y)) / full
                    at_y, at_x = np.nonzero((a >= -1e-9) & (b >= -1e-9) & (1 - a - b >= -1e-9))
                    parts.append((np.full(len(at_y), i), at_y + int(top), at_x + int(left), a[at_y, at_x], b[at_y, at_x]))
                k, y, x, a, b = (np.concatenate(p) for p in zip(*parts, strict=True))
                d, g = 1 - a - b, {m: c[m][k] for m in corners[6:]}
                iz = a / g["z1"] + b / g["z2"] + d / g["z3"]
                # a little more, so that whole numbers stay what they are
                ty, tx = (
                    np.clip(np.floor((a * g[f"{m}1"] / g["z1"] + b * g[f"{m}2"] / g["z2"] + d * g[f"{m}3"] / g["z3"]) / iz + 1e-6), 0, side - 1).astype(int) for m, side in (("v", th), ("u", tw))
                )
                found = at[ty * tw + tx]
                real = found >= 0
                k, y, x = k[real], y[real].astype(np.int32), x[real].astype(np.int32)
                out.append(pd.DataFrame({"shape_id": shapes_["shape_id"].to_numpy()[k], "y": y, "x": x, "v": iv[found[real]]}))
        return pd.concat(out[1:] or out)

    kinds = [df.schema[c].dataType.simpleString() for df, c in ((triangles, "shape_id"), (texture, "v"))]
    return t.groupBy("image_id", "part").cogroup(whole.groupBy("image", "slot")).applyInPandas(run, f"shape_id {kinds[0]}, y int, x int, v {kinds[1]}")


def _map_texture_joined(triangles: DataFrame, texture: DataFrame, w: int, h: int) -> DataFrame:
    from samplegrid.operators.gather import sizes

    t = triangles.withColumn("area", F.expr("(x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)")).where("area <> 0")
    for axis, side in (("y", h), ("x", w)):
        ends = [f"{axis}{k}" for k in (1, 2, 3)]
        first, last = F.greatest(F.ceil(F.least(*ends)), F.lit(0)), F.least(F.floor(F.greatest(*ends)), F.lit(side - 1))
        t = t.where(first <= last).withColumn(axis, F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    t = t.withColumn("a", F.expr("((x2 - x) * (y3 - y) - (x3 - x) * (y2 - y)) / area")).withColumn("b", F.expr("((x3 - x) * (y1 - y) - (x1 - x) * (y3 - y)) / area")).withColumn("c", F.expr("1 - a - b"))
    t = t.where("a >= -1e-9D and b >= -1e-9D and c >= -1e-9D").withColumn("iz", F.expr("a / z1 + b / z2 + c / z3"))
    for name in "uv":
        t = t.withColumn(name, F.expr(f"(a * {name}1 / z1 + b * {name}2 / z2 + c * {name}3 / z3) / iz"))
    t = t.join(sizes(texture).withColumnsRenamed({"w": "tw", "h": "th"}), "image_id")
    # a little more, so that whole numbers stay what they are
    t = t.selectExpr("shape_id", "image_id", "y", "x", "cast(least(greatest(floor(v + 1e-6D), 0), th - 1) as int) ty", "cast(least(greatest(floor(u + 1e-6D), 0), tw - 1) as int) tx")
    return t.join(texture.selectExpr("image_id", "y ty", "x tx", "v"), ["image_id", "ty", "tx"]).select("shape_id", "y", "x", "v")


def field_threshold(h, v, t: float, shade: float | None = None, steps: bool = False) -> Column:
    """0 where the smaller of two distances is below t, else 255; with shade, a ramp of that width; with steps, 127 less for each of both
    distances that is below t."""
    h, v = _c(h), _c(v)
    if steps:
        return F.lit(255) - F.when(F.least(h, v) < t, 127).otherwise(0) - F.when(F.greatest(h, v) < t, 127).otherwise(0)
    if shade is None:
        return F.when(F.least(h, v) < t, 0).otherwise(255)
    s = ((F.lit(shade) - (F.least(h, v) - t)) * (255.0 / shade)).cast("int")
    return F.lit(255) - F.least(F.greatest(s, F.lit(0)), F.lit(255))


def color_cells(px: DataFrame, whole: bool = True) -> DataFrame:
    """(image_id, by, bx, upper, lower, u, v, bits) of each whole 4 by 4 block of px(image_id, y, x, r, g, b): the mean colour, the means of the
    lumas at or over the mean and of those under it, and a bit a sample, from 1 on by rows. whole: whole numbers in YUV888, else
    YIQ, clipped. Two passes over 16 samples, gathered a block and added up by rows, so that no other order of the table's rows gives another mean."""
    y, u, v = color.to_yuv888("r", "g", "b") if whole else color.to_yiq("r", "g", "b")
    p = px.select("image_id", F.expr("cast(y div 4 as int) by"), F.expr("cast(x div 4 as int) bx"), F.expr("cast(y % 4 * 4 + x % 4 as int) i"), y.alias("l"), u.alias("u"), v.alias("v"))
    total = lambda c: f"aggregate(s, {'0L' if whole else '0D'}, (a, t) -> a + t.{c})"
    mean = (lambda c: f"cast({total(c)} div 16 as int)") if whole else (lambda c: f"{total(c)} / 16")
    b = p.groupBy("image_id", "by", "bx").agg(F.array_sort(F.collect_list(F.struct("i", "l", "u", "v"))).alias("s")).where("size(s) = 16")
    b = b.selectExpr("image_id", "by", "bx", "s", f"{mean('l')} m", f"{mean('u')} u", f"{mean('v')} v")
    part = lambda test: (
        f"coalesce(aggregate(filter(s, t -> t.l {test} m), {'0L' if whole else '0D'}, (a, t) -> a + t.l) {'div' if whole else '/'} nullif(size(filter(s, t -> t.l {test} m)), 0), 0)"
    )
    clip = (lambda x: f"cast({x} as int)") if whole else (lambda x: f"cast(least(greatest({x}, 0), 255) as int)")
    bits = "aggregate(s, 0, (a, t) -> if(t.l >= m, a | shiftleft(1, t.i), a))"
    return b.selectExpr("image_id", "by", "bx", f"{clip(part('>='))} upper", f"{clip(part('<'))} lower", f"{clip('u')} u", f"{clip('v')} v", f"{bits} bits")


def expand_cells(cells: DataFrame, whole: bool = True) -> DataFrame:
    """(image_id, y, x, r, g, b): inverse of color_cells(), two lumas and one colour a block."""
    p = cells.selectExpr("image_id", "by", "bx", "u", "v", "upper", "lower", "bits", "explode(sequence(0, 15)) i")
    luma = F.when(F.expr("shiftright(bits, i) & 1") == 1, F.col("upper")).otherwise(F.col("lower"))
    rgb = color.from_yuv888(luma, "u", "v") if whole else tuple(color.clip(c) for c in color.from_yiq(luma.cast("double"), "u", "v"))
    return p.select("image_id", F.expr("by * 4 + i div 4 y"), F.expr("bx * 4 + i % 4 x"), *(c.alias(n) for c, n in zip(rgb, "rgb", strict=True)))


def tight_cells(px: DataFrame, dither: bool = False) -> DataFrame:
    """(image_id, by, bx, low, diff, bits) of each whole 8 by 8 block of px(image_id, y, x, r, g, b) in YIQ: the lower mean luma and the mean colour in 16
    bits (6, 6 and 4; 12 added to the last), the difference to the upper mean, and 64 bits by rows, as a long. dither: what a bit loses moves the
    bound for the next samples of its row."""
    y, u, v = color.to_yiq("r", "g", "b")
    p = px.select("image_id", F.expr("cast(y div 8 as int) by"), F.expr("cast(x div 8 as int) bx"), F.expr("cast(y % 8 * 8 + x % 8 as int) i"), y.alias("l"), u.alias("u"), v.alias("v"))
    b = p.groupBy("image_id", "by", "bx").agg(F.array_sort(F.collect_list(F.struct("i", "l", "u", "v"))).alias("s")).where("size(s) = 64")
    total = lambda c, of="s": f"aggregate({of}, 0D, (a, t) -> a + t.{c})"
    b = b.selectExpr("*", *(f"{total(c)} / 64 m{c}" for c in "luv"))
    part = lambda test: f"coalesce({total('l', f'filter(s, t -> t.l {test} ml)')} / nullif(size(filter(s, t -> t.l {test} ml)), 0), 0D)"
    b = b.selectExpr("*", f"{part('>=')} upper", f"{part('<')} lower")
    error = "if(t.i % 8 = 0, 0D, a.error)"
    step = f"""if(t.l >= ml - {error}, named_struct('bits', a.bits | shiftleft(1L, t.i), 'error', {error} + {'t.l - upper' if dither else '0D'}),
        named_struct('bits', a.bits, 'error', {error} + {'t.l - lower' if dither else '0D'}))"""
    clip = lambda x: f"cast(least(greatest({x}, 0), 255) as int)"
    low = f"shiftleft({clip('lower')} & 252, 8) | shiftleft({clip('mu')} & 252, 2) | shiftright({clip(clip('mv + 12'))} & 240, 4)"
    return b.selectExpr("image_id", "by", "bx", f"{low} low", f"{clip('upper - lower')} diff", f"aggregate(s, named_struct('bits', 0L, 'error', 0D), (a, t) -> {step}, a -> a.bits) bits")


def expand_tight_cells(cells: DataFrame) -> DataFrame:
    """(image_id, y, x, r, g, b): inverse of tight_cells()."""
    p = cells.selectExpr("image_id", "by", "bx", "shiftright(low, 8) & 252 l", "shiftright(low, 2) & 248 u", "shiftleft(low, 4) & 240 v", "diff", "bits", "explode(sequence(0, 63)) i")
    luma = F.col("l") + F.when(F.expr("shiftrightunsigned(bits, i) & 1") == 1, F.col("diff")).otherwise(0)
    rgb = tuple(color.clip(c) for c in color.from_yiq(luma.cast("double"), "u", "v"))
    return p.select("image_id", F.expr("by * 8 + i div 8 y"), F.expr("bx * 8 + i % 8 x"), *(c.alias(n) for c, n in zip(rgb, "rgb", strict=True)))
