"""Gather operators: kernels, block transforms, padding, cropping, resampling and polygons as equi-joins and sums."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sizes(px: DataFrame) -> DataFrame:
    """(image_id, w, h). Joined back by image: adaptive execution broadcasts it up to its threshold of bytes, some hundred thousand
    images, and splits a skewed image beyond that."""
    return px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def kernel_offsets(n: int) -> list[int]:
    """Distances of a kernel's n samples from its middle; even kernels leave out 0."""
    return [i - n // 2 if i < n // 2 else i - n // 2 + 1 - n % 2 for i in range(n)]


def convolve(px: DataFrame, kernel: list[list[float]]) -> DataFrame:
    """v(y, x) = sum of kernel[i][j] * v(y - oy[j], x - ox[i]) with kernel_offsets() along each side; edges reflect. The first index runs
    along x. Each sample is sent to every output that reads it, also through a reflection, and outputs sum up: one exchange
    with map-side sums, of kernel-size rows per sample, so for large separable kernels convolve() by a column, then by a row.
    Reads beyond an image that is narrower than the kernel's reach are reflected as often as it takes; of a single row or column, all
    reads are that one."""
    if not kernel or not kernel[0] or any(len(row) != len(kernel[0]) for row in kernel):
        raise ValueError("a kernel is a rectangle")
    ox, oy = kernel_offsets(len(kernel)), kernel_offsets(len(kernel[0]))
    taps = ", ".join(f"struct({b} as dy, {a} as dx, cast({w!r} as double) as w)" for a, row in zip(ox, kernel, strict=True) for b, w in zip(oy, row, strict=True))
    p = px.join(sizes(px), "image_id").selectExpr("image_id", "y", "x", "v", "w as width", "h", f"inline(array({taps}))")

    def places(c: str, d: str, n: str) -> str:
        # outputs o whose read place o - d is c, or reflects onto c
        once = f"""filter(array({c} + {d}, {d} - {c}, 2 * ({n} - 1) - {c} + {d}), (o, i) -> o >= 0 and o < {n}
            and (i = 0 or (i = 1 and o < {d}) or (i = 2 and o - {d} >= {n})))"""
        # as often as it takes: places repeat every 2 (n - 1), forwards and backwards
        turn = f"greatest(2 * ({n} - 1), 1)"
        every = f"transform(sequence(-(abs({d}) div {turn}) - 2, abs({d}) div {turn} + 2), k -> k * {turn} + {d}"
        return f"if(abs({d}) < {n}, {once}, filter(array_distinct(concat({every} + {c}), {every} - {c}))), o -> o >= 0 and o < {n}))"

    p = p.selectExpr("image_id", f"explode({places('y', 'dy', 'h')}) y", "x", "dx", "width", "v * w as vw").selectExpr("image_id", "y", f"explode({places('x', 'dx', 'width')}) x", "vw")
    return p.groupBy("image_id", "y", "x").agg(F.sum("vw").alias("v"))


def dct2(px: DataFrame, block: int = 8) -> DataFrame:
    """(image_id, by, bx, u, v, c): DCT-II of whole blocks of samples - 128, one separable sum per axis."""
    p = px.selectExpr("image_id", f"cast(y div {block} as int) by", f"cast(x div {block} as int) bx", f"y % {block} y", f"x % {block} x", "v - 128.0 s")
    p = p.join(p.groupBy("image_id", "by", "bx").agg(F.count("*").alias("n")).where(f"n = {block * block}").drop("n"), ["image_id", "by", "bx"])
    for axis, to in (("x", "v"), ("y", "u")):
        basis = ", ".join(f"struct({t} as t, {k} as k, cast({math.sqrt((1 if k == 0 else 2) / block) * math.cos((2 * t + 1) * k * math.pi / (2 * block))!r} as double) as b)" for t in range(block) for k in range(block))
        keep = [c for c in p.columns if c not in (axis, "s")]
        p = p.withColumn("row", F.explode(F.expr(f"filter(array({basis}), r -> r.t = {axis})")))
        p = p.groupBy(*keep, F.col("row.k").alias(to)).agg(F.sum(F.col("s") * F.col("row.b")).alias("s"))
    return p.select("image_id", "by", "bx", "u", "v", F.col("s").alias("c"))


def idct2(coeffs: DataFrame, block: int = 8) -> DataFrame:
    """(image_id, y, x, v): inverse of dct2(), one separable sum per axis, plus 128."""
    p = coeffs.withColumnRenamed("c", "s")
    for k, to in (("v", "x"), ("u", "y")):
        basis = ", ".join(f"struct({t} as t, {j} as k, cast({math.sqrt((1 if j == 0 else 2) / block) * math.cos((2 * t + 1) * j * math.pi / (2 * block))!r} as double) as b)" for t in range(block) for j in range(block))
        keep = [c for c in p.columns if c not in (k, "s")]
        p = p.withColumn("row", F.explode(F.expr(f"filter(array({basis}), r -> r.k = {k})")))
        p = p.groupBy(*keep, F.col("row.t").alias(to)).agg(F.sum(F.col("s") * F.col("row.b")).alias("s"))
    return p.selectExpr("image_id", f"by * {block} + y y", f"bx * {block} + x x", "s + 128 v")


def crop(px: DataFrame, x0: int, y0: int, w: int, h: int) -> DataFrame:
    """The samples of a rectangle, from (0, 0) on."""
    return px.where(f"x >= {x0} and x < {x0 + w} and y >= {y0} and y < {y0 + h}").select("image_id", (F.col("y") - y0).alias("y"), (F.col("x") - x0).alias("x"), "v")


def pad_pow2(px: DataFrame) -> DataFrame:
    """Both sides grown to powers of two: the last column is smeared right, then the last row down. The edge samples emit
    their copies, so there is no grid to join."""
    p = px.join(sizes(px), "image_id")
    grown = lambda n: f"cast(pow(2, ceil(log2({n}))) as int)"
    xs = f"explode(if(x = w - 1, sequence(x, {grown('w')} - 1), array(x))) x"
    ys = f"explode(if(y = h - 1, sequence(y, {grown('h')} - 1), array(y))) y"
    return p.selectExpr("image_id", "y", "h", xs, "v").selectExpr("image_id", ys, "x", "v")


def resize_linear(px: DataFrame, factor: int = 2) -> DataFrame:
    """Bilinear enlargement by a whole factor: output o lies at o / factor, the last samples repeat."""
    for axis, other in (("x", "y"), ("y", "x")):
        w = Window.partitionBy("image_id", other).orderBy(axis)
        p = px.select("image_id", other, axis, "v", F.coalesce(F.lead("v").over(w), F.col("v")).alias("next"))
        p = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
        px = p.select("image_id", other, (F.col(axis) * factor + F.col("k")).alias(axis), (F.col("v") + (F.col("next") - F.col("v")) * F.col("k") / factor).alias("v"))
    return px.select("image_id", "y", "x", "v")


def polygon_distance(points: DataFrame, segments: DataFrame, rule: str = "odd") -> DataFrame:
    """(id, shape_id, distance, odd, winding) of points(id, x, y) and segments(shape_id, ax, ay, bx, by): distance to the outline, less than
    0 inside by the rule (odd: an odd number of crossings; winding: a winding number that is not 0), and both numbers.

    Each shape's segments, a few to some thousands, are one row; every point meets every shape, which is the result's
    size, and no point meets its segments as rows."""
    shapes = segments.groupBy("shape_id").agg(F.collect_list(F.struct("ax", "ay", "bx", F.col("by").alias("bz"))).alias("ring"))
    # (least squared distance, signed crossings, crossings) by a fold over the segments
    length = "((g.bx - g.ax) * (g.bx - g.ax) + (g.bz - g.ay) * (g.bz - g.ay))"
    t = f"(if({length} > 0, least(greatest(((x - g.ax) * (g.bx - g.ax) + (y - g.ay) * (g.bz - g.ay)) / {length}, 0D), 1D), 0D))"
    off = lambda p, a, b: f"({p} - g.{a} - {t} * (g.{b} - g.{a}))"
    d2 = f"{off('x', 'ax', 'bx')} * {off('x', 'ax', 'bx')} + {off('y', 'ay', 'bz')} * {off('y', 'ay', 'bz')}"
    side = "((g.bx - g.ax) * (y - g.ay) - (g.bz - g.ay) * (x - g.ax))"
    turn = f"case when g.ay <= y and g.bz > y and {side} > 0 then 1 when g.ay > y and g.bz <= y and {side} < 0 then -1 else 0 end"
    p = points.join(shapes).withColumn("least", F.expr(f"array_min(transform(ring, g -> {d2}))")).withColumn("turns", F.expr(f"transform(ring, g -> {turn})"))
    p = p.selectExpr("id", "shape_id", "sqrt(least) distance", "aggregate(turns, 0, (a, k) -> a + abs(k)) % 2 = 1 odd", "cast(aggregate(turns, 0, (a, k) -> a + k) as bigint) winding")
    inside = F.col("odd") if rule == "odd" else F.col("winding") != 0
    return p.select("id", "shape_id", F.when(inside, -F.col("distance")).otherwise(F.col("distance")).alias("distance"), "odd", "winding")


def polygon_distance_near(points: DataFrame, segments: DataFrame, reach: float, rule: str = "odd") -> DataFrame:
    """polygon_distance() for the points that lie within `reach` of a shape's outline; others are left out.

    A grid of cells of `reach` a side: each segment lies in the cells of its bounds and their neighbours that it comes within reach of, a point in one cell, so
    points meet only segments nearby, by an equi-join. What crosses the ray from a point to the left is found by the bands of one cell's height that a segment passes
    through: candidates meet the shape's segments of their own band."""
    cell = lambda c: f"cast(floor(({c}) / {reach!r}D) as long)"
    s = segments.selectExpr("shape_id", "ax", "ay", "bx", "`by` bz")
    spread = s.selectExpr("*", f"explode(sequence({cell('least(ay, bz)')} - 1, {cell('greatest(ay, bz)')} + 1)) cy")
    # the part of the segment within one cell of the row of cells bounds the columns that it reaches
    low, high = f"(cy - 1) * {reach!r}D", f"(cy + 2) * {reach!r}D"
    at = lambda y: f"if(ay = bz, {{}}, ax + (least(greatest({y}, least(ay, bz)), greatest(ay, bz)) - ay) * (bx - ax) / (bz - ay))"
    ends = [at(low).format("ax"), at(high).format("bx")]
    spread = spread.selectExpr("*", f"explode(sequence({cell(f'least({ends[0]}, {ends[1]})')} - 1, {cell(f'greatest({ends[0]}, {ends[1]})')} + 1)) cx")
    length = "((bx - ax) * (bx - ax) + (bz - ay) * (bz - ay))"
    t = f"if({length} > 0, least(greatest(((x - ax) * (bx - ax) + (y - ay) * (bz - ay)) / {length}, 0D), 1D), 0D)"
    p = points.selectExpr("id", "x", "y", f"{cell('x')} cx", f"{cell('y')} cy")
    met = p.join(spread, ["cx", "cy"]).selectExpr("id", "shape_id", "x", "y", "cy", f"pow(x - ax - {t} * (bx - ax), 2) + pow(y - ay - {t} * (bz - ay), 2) d2")
    near = met.groupBy("id", "shape_id", "x", "y", "cy").agg(F.sqrt(F.min("d2")).alias("distance")).where(f"distance <= {reach!r}D")
    bands = s.where("ay <> bz").selectExpr("*", f"explode(sequence({cell('least(ay, bz)')}, {cell('greatest(ay, bz)')})) cy")
    side = "((bx - ax) * (y - ay) - (bz - ay) * (x - ax))"
    turn = f"case when ay <= y and bz > y and {side} > 0 then 1 when ay > y and bz <= y and {side} < 0 then -1 else 0 end"
    turned = near.join(bands, ["shape_id", "cy"], "left").withColumn("turn", F.coalesce(F.expr(turn), F.lit(0)))
    out = turned.groupBy("id", "shape_id", "distance").agg((F.sum(F.abs("turn")) % 2 == 1).alias("odd"), F.sum("turn").alias("winding"))
    inside = F.col("odd") if rule == "odd" else F.col("winding") != 0
    return out.select("id", "shape_id", F.when(inside, -F.col("distance")).otherwise(F.col("distance")).alias("distance"), "odd", "winding")
