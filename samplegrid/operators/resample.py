"""Resampling of rasters (image_id, y, x, v): rescaling along scanlines, rotation by gathers, projections.

A scanline is gathered as one array, which is bounded by the image's side; no image is.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from samplegrid.operators.gather import sizes
from samplegrid.operators.scan import split_by_size
from samplegrid.operators.signals import WHOLE
from samplegrid.operators.window import along, neighbours


def on_lines(px: DataFrame, axis: str, result: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """px with each line along an axis replaced by the SQL expression `result` over a, the array of its values, s, its length, and the
    columns in `keep`, which are the same on all of a line."""
    other = "y" if axis == "x" else "x"
    lines = px.groupBy("image_id", other, *keep).agg(F.expr(f"transform(array_sort(collect_list(struct({axis}, v))), t -> t.v)").alias("a"))
    lines = lines.withColumn("s", F.size("a"))
    return lines.select("image_id", other, *keep, F.posexplode(F.expr(result)).alias(axis, "v")).select("image_id", "y", "x", "v", *keep)


def halve(px: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Half the sides: whole (1, 3, 3, 1) / 8 around each pair along x, then along y; the ends repeat."""
    for axis in ("x", "y"):
        last = "2 * (s div 2) - 1"
        px = on_lines(px, axis, f"transform(sequence(0, s div 2 - 1), o -> (a[greatest(2 * o - 1, 0)] + 3 * a[2 * o] + 3 * a[2 * o + 1] + a[least(2 * o + 2, {last})]) div 8)", keep)
    return px.select("image_id", "y", "x", F.col("v").cast("int").alias("v"), *keep)


def _stepped(d: str) -> str:
    """A line of s samples as one of d, at most s: nearest samples, and the mean with the next one where a step lies in the first half of
    a target step."""
    first = lambda o: f"cast(ceil(({o}) * s / {d}) as int)"
    fold = f"aggregate(sequence({first('o')}, least({first('o + 1')} - 1, s - 1)), a[{first('o')}], (v, k) -> if((k * {d}) % s < s div 2 and k < s - 1, shiftright(v + a[k + 1], 1), v))"
    return f"transform(sequence(0, cast({d} as int) - 1), o -> {fold})"


def resize_fast(px: DataFrame, num: int, den: int) -> DataFrame:
    """Sides times num / den (down, floored): nearest samples; a step that lies in the first half of a target step takes the mean with the
    next sample. Halve first for less than a half."""
    for axis in ("x", "y"):
        px = on_lines(px, axis, _stepped(f"(s * {num} div {den})"))
    return px


def fit_size(w: str, h: str, max_w: int, max_h: int) -> tuple[Column, Column]:
    """The sides of w by h in a box: both times the smaller ratio, in single precision, cut, at least 1; none is enlarged."""
    side = lambda c, most: F.lit(most).cast("float") / F.col(c).cast("float")
    scale = F.least(F.lit(1).cast("float"), side(w, max_w).cast("float"), side(h, max_h).cast("float"))
    # a product of floats rounded to a float, as the cut is of single precision
    return tuple(F.greatest((F.col(c).cast("float") * scale).cast("float").cast("int"), F.lit(1)) for c in (w, h))


def fit_into(px: DataFrame, max_w: int, max_h: int) -> DataFrame:
    """Every image of px(image_id, y, x, v), whole numbers, at the size that fits it into max_w by max_h; small ones stay as they are.

    Each image is halved while both sides are at least three times their target, then brought to the exact size by resize_fast()'s steps. Images of all sizes
    go together: a round halves those that need it still, so there are as many rounds as the largest has halvings."""
    tw, th = fit_size("w", "h", max_w, max_h)
    plan = sizes(px).select("image_id", "w", "h", tw.alias("tw"), th.alias("th"))
    for c, t in (("w", "tw"), ("h", "th")):
        # halvings by which a side stays at three times its target or more, counted until it does not
        plan = plan.withColumn(f"n{c}", F.expr(f"size(filter(sequence(0, 31), k -> shiftright({c}, k) div {t} > 2))"))
    plan = plan.withColumn("rounds", F.least("nw", "nh"))
    keep = ("tw", "th", "rounds")
    most = plan.agg(F.max("rounds")).first()[0] or 0
    cur, done = px.join(plan.select("image_id", *keep, "w", "h"), "image_id"), []
    done.append(cur.where("w = tw and h = th").select("image_id", "y", "x", F.col("v").cast("int").alias("v")))
    cur = cur.where("w <> tw or h <> th").select("image_id", "y", "x", "v", *keep)
    for k in range(most + 1):
        exact = cur.where(f"rounds = {k}")
        if k:
            size = sizes(exact).join(plan.select("image_id", "tw", "th"), "image_id").where("w = tw and h = th").select("image_id")
            done.append(exact.join(size, "image_id", "left_semi").select("image_id", "y", "x", F.col("v").cast("int").alias("v")))
            exact = exact.join(size, "image_id", "left_anti")
        exact = on_lines(on_lines(exact, "x", _stepped("tw"), keep), "y", _stepped("th"), keep)
        done.append(exact.select("image_id", "y", "x", F.col("v").cast("int").alias("v")))
        if k < most:
            cur = halve(cur.where(f"rounds > {k}"), keep)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def resize_bicubic(px: DataFrame, w: int, h: int) -> DataFrame:
    """w by h samples by Catmull-Rom curves through 4 by 4 samples: output o reads from int(o * step - 1.5), pinned, at 1 less the fraction
    of o * step. Along y first, then along x. Images have 4 samples a side at least."""
    for axis, n in (("y", h), ("x", w)):
        at = f"(o * (s / cast({n} as double)))"
        left = f"least(greatest(cast({at} - 1.5 as int), 0), s - 4)"
        t = f"(1.0D - ({at} - floor({at})))"
        p = [f"a[{left} + {k}]" for k in range(4)]
        curve = f"{p[1]} + 0.5D * {t} * ({p[2]} - {p[0]} + {t} * (2D * {p[0]} - 5D * {p[1]} + 4D * {p[2]} - {p[3]} + {t} * (3D * ({p[1]} - {p[2]}) + {p[3]} - {p[0]})))"
        px = on_lines(px.withColumn("v", F.col("v").cast("double")), axis, f"transform(sequence(0, {n} - 1), o -> {curve})")
    return px


def _spline_axis(df: DataFrame, axis: str, count) -> DataFrame:
    """df with count(n) samples on each line of n along an axis, by a spline through the whole line, solved in its group."""
    other = "y" if axis == "x" else "x"

    def solve(pdf):
        import numpy as np

        a = pdf.sort_values(axis)["v"].to_numpy(float)
        n = count(len(a))
        out = spline(a, np.minimum(np.arange(n) * (len(a) / n), len(a) - 1))
        out[-1:] = a[-1]
        return type(pdf)({"image_id": pdf["image_id"].iloc[0], other: pdf[other].iloc[0], axis: np.arange(n, dtype=np.int32), "v": out})

    kind = df.schema["image_id"].dataType.simpleString()
    return df.groupBy("image_id", other).applyInPandas(solve, f"image_id {kind}, {other} int, {axis} int, v double")


def resize_spline(px: DataFrame, w: int, h: int) -> DataFrame:
    """w by h samples by a cubic spline through each whole scanline, not-a-knot ends; the last output is the last input. Each axis by its own
    ratio."""
    p = px.selectExpr("image_id", "cast(y as int) y", "cast(x as int) x", "v")
    return _spline_axis(_spline_axis(p, "x", lambda n: w), "y", lambda n: h).select("image_id", "y", "x", "v")


def spline(a, at):
    """Values at places `at` of the cubic spline through a[0], a[1], ... with third derivatives that go on over the second and the last but
    one sample. Straight or parabolic through two or three samples."""
    import numpy as np

    n = len(a)
    if n < 4:
        return np.polyval(np.polyfit(np.arange(n), a, n - 1), at)
    # second derivatives m: m[i-1] + 4 m[i] + m[i+1] = 6 * second difference; m[0] = 2 m[1] - m[2] and alike at the end
    b = 6 * np.diff(a, 2)
    m = np.zeros(n)
    diagonal, upper, lower = np.full(n - 2, 4.0), np.ones(n - 2), np.ones(n - 2)
    diagonal[0] = diagonal[-1] = 6.0
    upper[0] = lower[-1] = 0.0
    for i in range(1, n - 2):
        f = lower[i] / diagonal[i - 1]
        diagonal[i] -= f * upper[i - 1]
        b[i] -= f * b[i - 1]
    for i in reversed(range(n - 2)):
        m[i + 1] = (b[i] - (upper[i] * m[i + 2] if i < n - 3 else 0.0)) / diagonal[i]
    m[0], m[-1] = 2 * m[1] - m[2], 2 * m[-2] - m[-3]
    k = np.minimum(at.astype(int), n - 2)
    t = at - k
    u = 1 - t
    return u * a[k] + t * a[k + 1] + ((u**3 - u) * m[k] + (t**3 - t) * m[k + 1]) / 6


def reduce_field(px: DataFrame, rounds: int, how: str = "zero") -> DataFrame:
    """Fields at 1 / 2^rounds of the sides, floored, in one step: output o stands at o * side / small side, and is the value nearest to zero of the cell
    there (zero; of equal distances the smaller one), its mean (mean), its first sample (nearest), or that of a spline along each line
    (cubic). A cell begins at the cut place and has as many samples a side as the ratio, rounded up; cells overlap where sides don't divide, and
    the last samples repeat beyond the end. Sides under 2^rounds give nothing."""
    if how == "cubic":
        p = px.selectExpr("image_id", "cast(y as int) y", "cast(x as int) x", "v")
        return _spline_axis(_spline_axis(p, "x", lambda n: n >> rounds), "y", lambda n: n >> rounds).select("image_id", "y", "x", "v")
    p = px.join(sizes(px), "image_id")
    for axis, side in (("y", "h"), ("x", "w")):
        small = f"shiftright({side}, {rounds})"
        first = f"cast(o * ({side} / cast({small} as double)) as int)"
        width = 1 if how == "nearest" else f"cast(ceil({side} / cast({small} as double)) as int)"
        # outputs whose cell holds the sample; the last sample stands for all places beyond it, so it may count more than once
        near = f"sequence(greatest(cast({axis} * {small} / {side} as int) - 2 * {width}, 0), least(cast({axis} * {small} / {side} as int) + 1, {small} - 1))"
        times = f"if({axis} = {side} - 1, greatest({first} + {width} - {axis}, 0), if({axis} >= {first} and {axis} < {first} + {width}, 1, 0))"
        reads = f"inline(filter(transform({near}, o -> named_struct('to_{axis}', o, 'n{axis}', {times})), t -> t.n{axis} > 0))"
        p = p.where(f"{small} > 0").select("*", F.expr(reads))
    cell = p.groupBy("image_id", F.col("to_y").alias("y"), F.col("to_x").alias("x"))
    if how == "mean":
        return cell.agg((F.sum(F.col("v") * F.col("ny") * F.col("nx")) / F.sum(F.col("ny") * F.col("nx"))).alias("v"))
    return cell.agg(F.min(F.struct(F.abs("v").alias("d"), "v"))["v"].alias("v"))


def rescale_field(px: DataFrame, w: int, h: int, how: str = "bilinear") -> DataFrame:
    """w by h samples: nearest or bilinear at o * side / n, the last samples repeat."""
    for axis, n in (("x", w), ("y", h)):
        at = f"(o * (s / cast({n} as double)))"
        k = f"cast(floor({at}) as int)"
        mixed = f"a[{k}] * (1D - ({at} - {k})) + a[least({k} + 1, s - 1)] * ({at} - {k})"
        px = on_lines(px, axis, f"transform(sequence(0, {n} - 1), o -> {f'a[{k}]' if how == 'nearest' else mixed})")
    return px


def sample_at(px: DataFrame, targets: DataFrame, keys: list[str], how: str = "value") -> DataFrame:
    """(image_id, keys, v) of targets(image_id, keys, sx, sy, w, h): bilinear samples of px; places off the image, 0 .. w by 0 .. h, are left
    out. how sum adds the samples of equal keys up. Four reads a place meet their samples in one equi-join, and sum up."""
    x0, y0 = "least(cast(sx as int), w - 1)", "least(cast(sy as int), h - 1)"
    x1, y1 = f"({x0} + if(sx < w - 1, 1, 0))", f"({y0} + if(sy < h - 1, 1, 0))"
    fx, fy = "(sx - floor(sx))", "(sy - floor(sy))"
    reads = ", ".join(f"struct({y} as y, {x} as x, {a} * {b} as f)" for y, b in ((y0, f"(1 - {fy})"), (y1, fy)) for x, a in ((x0, f"(1 - {fx})"), (x1, fx)))
    places = targets.where("sx >= 0 and sy >= 0 and sx <= w and sy <= h").selectExpr("image_id", *keys, f"inline(array({reads}))")
    return places.join(px.select("image_id", "y", "x", "v"), ["image_id", "y", "x"]).groupBy("image_id", *keys).agg(F.sum(F.col("v") * F.col("f")).alias("v"))


def rotate(px: DataFrame, radians: float) -> DataFrame:
    """(image_id, y, x, v) of the images turned about their middle, in the bounds of their turned corners: each output looks up its source by
    the inverse turn. Places off the source are left out."""
    c, s = math.cos(radians), math.sin(radians)
    size = sizes(px).withColumn("bw", F.expr(f"cast(ceil(w * abs({c}D) + h * abs({s}D)) as int)")).withColumn("bh", F.expr(f"cast(ceil(w * abs({s}D) + h * abs({c}D)) as int)"))
    size = size.where("bw > 1 and bh > 1")
    grid = size.selectExpr("*", "explode(sequence(-(bh div 2), bh div 2 - 1)) dy").selectExpr("*", "explode(sequence(-(bw div 2), bw div 2 - 1)) dx")
    at = grid.selectExpr(
        "image_id", "w", "h", f"dx * {c}D - dy * {s}D + w / 2 sx", f"dx * {s}D + dy * {c}D + h / 2 sy",
        f"cast(dx + (w * abs({c}D) + h * abs({s}D)) / 2 as int) ox", f"cast(dy + (w * abs({s}D) + h * abs({c}D)) / 2 as int) oy",
    )
    return sample_at(px, at, ["oy", "ox"]).selectExpr("image_id", "oy y", "ox x", "v")


def rotate_shear(px: DataFrame, degrees: float) -> DataFrame:
    """(image_id, y, x, v): turned by three whole shifts of rows, columns and rows, from 0 to under 90 degrees; every sample keeps its value or
    leaves the bounds. One projection of the coordinates; cells that no sample takes are left out (0 in the picture)."""
    a = math.radians(degrees)
    tx, sy = math.tan(a / 2), math.sin(a)
    p = px.join(sizes(px), "image_id").withColumn("sw", F.expr(f"cast(h * {tx}D as int)"))
    p = p.withColumn("bw", F.expr(f"cast(floor(h * {tx}D + sw * 2 + w + 0.5D) as int)")).withColumn("bh", F.expr(f"cast(floor(bw * {sy}D + h + 0.5D) as int)"))
    p = p.selectExpr("image_id", "v", "bw", "bh", "y + bh - h y", f"x + cast(y * {tx}D as int) + bw - w - sw x")
    p = p.selectExpr("image_id", "v", "bw", "bh", "x", f"y - cast(x * {sy}D as int) y").where("x >= 0 and x < bw and y >= 0")
    p = p.selectExpr("image_id", "v", "y", f"x - cast((bh - y) * {tx}D as int) x")
    return p.where("x >= 0").select("image_id", "y", "x", "v")


def radon(px: DataFrame, angles: int | None = None) -> DataFrame:
    """(image_id, q, k, n, x, v): sums of bilinear samples along y of the image turned by k quarter turns / q, k = 1 .. q, divided by q; q is the
    smaller side, or `angles`, and n the larger side, over which a projection lies. Each angle samples the whole image, so start with few angles. An image of up
    to WHOLE samples is one group, which reads its samples by their place; larger ones meet theirs in joins."""
    short, long_ = split_by_size(px.select("image_id", "y", "x", "v"), "image_id", WHOLE)
    out = _radon_each(short, angles)
    return out if long_ is None else out.unionByName(_radon_joined(long_, angles))


def _radon_each(px: DataFrame, angles: int | None) -> DataFrame:
    def run(pdf):
        import numpy as np

        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        w, h = int(x.max()) + 1, int(y.max()) + 1
        v, there = np.zeros((h, w)), np.zeros((h, w), bool)
        v[y, x], there[y, x] = np.nan_to_num(pdf["v"].to_numpy(float)), True
        q, out = min(w, h) if angles is None else angles, []
        ox, oy = np.arange(w) - w / 2, (np.arange(h) - h / 2)[:, None]
        for k in range(1, q + 1):
            a = math.pi / 2 * k / q
            sx, sy = ox * math.cos(a) - oy * math.sin(a) + w / 2, ox * math.sin(a) + oy * math.cos(a) + h / 2
            inside = (sx >= 0) & (sy >= 0) & (sx <= w) & (sy <= h)
            fx, fy = sx - np.floor(sx), sy - np.floor(sy)
            x0, y0 = (np.where(inside, np.minimum(s.astype(int), n - 1), 0) for s, n in ((sx, w), (sy, h)))
            x1, y1 = x0 + (inside & (sx < w - 1)), y0 + (inside & (sy < h - 1))
            read = (1 - fx) * (1 - fy) * v[y0, x0] + fx * (1 - fy) * v[y0, x1] + (1 - fx) * fy * v[y1, x0] + fx * fy * v[y1, x1]
            found = (inside & (there[y0, x0] | there[y0, x1] | there[y1, x0] | there[y1, x1])).any(axis=0)
            out.append((np.full(int(found.sum()), k), np.flatnonzero(found), np.where(inside, read, 0).sum(axis=0)[found] / q))
        k, at, sums = (np.concatenate(c) for c in zip(*out, strict=True))
        return type(pdf)({"image_id": pdf["image_id"].iloc[0], "q": q, "k": k, "n": max(w, h), "x": at, "v": sums})

    kind = px.schema["image_id"].dataType.simpleString()
    return px.groupBy("image_id").applyInPandas(run, f"image_id {kind}, q int, k int, n int, x int, v double")


def _radon_joined(px: DataFrame, angles: int | None) -> DataFrame:
    size = sizes(px).withColumn("q", F.least("w", "h") if angles is None else F.lit(angles))
    grid = size.selectExpr("*", "explode(sequence(1, q)) k").selectExpr("*", f"{math.pi / 2}D * k / q a")
    grid = grid.selectExpr("image_id", "w", "h", "q", "k", "cos(a) c", "sin(a) s", "explode(sequence(0, h - 1)) oy").selectExpr("*", "explode(sequence(0, w - 1)) ox")
    at = grid.selectExpr("image_id", "w", "h", "q", "k", "ox", "(ox - w / 2) * c - (oy - h / 2) * s + w / 2 sx", "(ox - w / 2) * s + (oy - h / 2) * c + h / 2 sy")
    return sample_at(px, at.withColumn("n", F.greatest("w", "h")), ["q", "k", "n", "ox"]).selectExpr("image_id", "q", "k", "n", "ox x", "v / q v")


def best_rotation(rows: DataFrame) -> DataFrame:
    """(image_id, k, energy, radians): of radon()'s rows the angle whose sums vary most over n places, empty ones being 0; of equal ones the
    first; radians of the angle before, as rows count from 0."""
    e = rows.groupBy("image_id", "q", "k", "n").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("s2"))
    e = e.selectExpr("image_id", "q", "k", "s2 / n - (s / n) * (s / n) energy")
    best = e.groupBy("image_id", "q").agg(F.max(F.struct("energy", (-F.col("k")).alias("k"))).alias("b"))
    return best.select("image_id", (-F.col("b.k")).alias("k"), "b.energy", (F.lit(math.pi / 2) * (-F.col("b.k") - 1) / F.col("q")).alias("radians"))


def row_energy(px: DataFrame) -> DataFrame:
    """(image_id, y, energy): mean squared distance of a row's samples to their mean."""
    return px.groupBy("image_id", "y").agg(F.var_pop("v").alias("energy"))


def range_fraction(px: DataFrame, low: DataFrame, high: DataFrame) -> DataFrame:
    """(image_id, y, x, f): where v lies between the samples of low and high, 0 to 1; where these are next to equal, the fraction of the sample
    before, by rows (0 at the start). Rows carry only their last fraction on, so that an image is not one group."""
    p = px.join(low.select("image_id", "y", "x", F.col("v").alias("a")), ["image_id", "y", "x"]).join(high.select("image_id", "y", "x", F.col("v").alias("b")), ["image_id", "y", "x"])
    f = F.when(F.col("b") - F.col("a") >= 0.0001, F.least(F.greatest((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")), F.lit(0.0)), F.lit(1.0)))
    p = p.select("image_id", "y", "x", f.alias("f")).withColumn("own", F.last("f", True).over(along("x").rowsBetween(Window.unboundedPreceding, 0)))
    ends = p.groupBy("image_id", "y").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("x"))).alias("e"))
    carried = ends.select("image_id", "y", F.last("e", True).over(Window.partitionBy("image_id").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    return p.join(carried, ["image_id", "y"]).select("image_id", "y", "x", F.coalesce("own", "before", F.lit(0.0)).alias("f"))


def range_restore(fraction: DataFrame, low: DataFrame, high: DataFrame) -> DataFrame:
    """(image_id, y, x, v): low + (high - low) * f."""
    p = fraction.join(low.select("image_id", "y", "x", F.col("v").alias("a")), ["image_id", "y", "x"]).join(high.select("image_id", "y", "x", F.col("v").alias("b")), ["image_id", "y", "x"])
    return p.select("image_id", "y", "x", (F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("v"))


def quantise_levels(c: Column) -> Column:
    """A fraction as one of four levels."""
    return F.when(c < 0.25, 0.0).when(c < 0.5, 0.3).when(c < 0.75, 0.6).otherwise(1.0)


def epx2_near(px: DataFrame, max_diff: int) -> DataFrame:
    """Pixel-art doubling by steps of max_diff: neighbours agree if their steps are equal, and a quarter then takes the first one's value."""
    p = neighbours(px)
    side, ends = F.col("west").isNull() | F.col("east").isNull(), F.col("north").isNull() | F.col("south").isNull()
    p = p.select("image_id", "y", "x", "v", *(F.when(e, F.col("v")).otherwise(F.col(c)).alias(c) for c, e in (("west", side), ("east", side), ("north", ends), ("south", ends))))
    step = lambda c: (F.col(c) / max_diff).cast("int")
    pick = lambda a, b, c, d: F.when((step(a) == step(b)) & (step(a) != step(c)) & (step(b) != step(d)), F.col(b)).otherwise(F.col("v"))
    corner = [(0, 0, pick("west", "north", "south", "east")), (0, 1, pick("north", "east", "west", "south")), (1, 0, pick("south", "west", "east", "north")), (1, 1, pick("east", "south", "north", "west"))]
    quarters = F.explode(F.array(*(F.struct((F.col("y") * 2 + dy).alias("y"), (F.col("x") * 2 + dx).alias("x"), c.alias("v")) for dy, dx, c in corner)))
    return p.select("image_id", quarters.alias("q")).select("image_id", "q.y", "q.x", "q.v")


def diffuse_upscale(px: DataFrame, scale: float) -> DataFrame:
    """Enlargement by picked samples: the parts of a sample that the places fall behind add up, along each output row and on into the next one, and push a pick
    on where they make a whole. The picks depend on the sides only, so they are worked out once for each pair of sides, in single precision, and joined."""

    def carried(fractions, rows, give: float):
        """For each place of each row, whether the sum of the fractions so far is a whole, which then gives `give` back, and the sum after it. A row adds a fraction
        of its own before its first place, where nothing is given back."""
        import numpy as np

        give = np.float32(give)
        parts = np.column_stack([rows, np.broadcast_to(fractions, (len(rows), fractions.shape[-1]))]).astype(np.float32).ravel()
        own = np.arange(len(parts)) % (fractions.shape[-1] + 1) == 0
        step = lambda s, p: s + p[0] - give if s + p[0] >= 1 and not p[1] else s + p[0]
        sums = np.fromiter(accumulate(zip(parts, own.tolist(), strict=True), step, initial=np.float32(0)), np.float32, len(parts) + 1)
        each = lambda v: v.reshape(len(rows), -1)[:, 1:]
        return each(sums[:-1] + parts >= 1), each(sums[1:])

    def picks(pdf):
        import numpy as np

        w, h = int(pdf["w"].iloc[0]), int(pdf["h"].iloc[0])
        step, sides = np.float32(1) / np.float32(scale), [int(np.float32(n) * np.float32(scale)) for n in (w, h)]
        # places of the outputs, and what they are beyond a sample
        (x, fx), (y, fy) = ((p, p - np.floor(p)) for p in (np.arange(n, dtype=np.float32) * step for n in sides))
        on, _ = carried(fx, fy, 1.414)
        _, down = carried(np.repeat(fy[:, None], sides[0], 1), fy, 1.0)
        gy, gx = np.meshgrid(np.arange(sides[1]), np.arange(sides[0]), indexing="ij")
        py, px = np.minimum((y[gy] + down).astype(int), h - 1), np.minimum((x[gx] + on).astype(int), w - 1)
        return type(pdf)({"w": w, "h": h, "oy": gy.ravel(), "ox": gx.ravel(), "y": py.ravel(), "x": px.ravel()})

    size = sizes(px)
    table = size.select("w", "h").distinct().groupBy("w", "h").applyInPandas(picks, "w int, h int, oy int, ox int, y int, x int")
    return size.join(table, ["w", "h"]).join(px, ["image_id", "y", "x"]).selectExpr("image_id", "oy y", "ox x", "v")
