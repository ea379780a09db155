"""Window operators on rasters (image_id, y, x, v): one exchange per axis, frames along one line at a time.

The grid must be dense: frames count rows, not coordinates; densify() fills one. A line is one group: a window's rows are
sorted in one task, and a huge image is spread over its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from samplegrid.functions.scalar import zigzag


def along(axis: str) -> WindowSpec:
    """Lines along an axis: along('x') orders the samples of a row, along('y') those of a column."""
    other = "y" if axis == "x" else "x"
    return Window.partitionBy("image_id", other).orderBy(axis)


def densify(px: DataFrame, missing: float = 0) -> DataFrame:
    """px with a row for each coordinate up to the image's largest x and y; absent samples are `missing`."""
    ends = px.groupBy("image_id").agg(F.max("x").alias("w"), F.max("y").alias("h"))
    rows = ends.select("image_id", "w", F.explode(F.sequence(F.lit(0), "h")).alias("y"))
    grid = rows.select("image_id", "y", F.explode(F.sequence(F.lit(0), "w")).alias("x"))
    out = grid.join(px, ["image_id", "y", "x"], "left")
    return out.select("image_id", "y", "x", F.coalesce("v", F.lit(missing)).cast(px.schema["v"].dataType).alias("v"))


def padded_sum(axis: str, value: str, before: int, after: int) -> Column:
    """Sum of the samples from p - before to p + after along an axis; the edge samples are repeated outward."""
    w = along(axis)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank, n = F.row_number().over(w) - 1, F.count("*").over(whole)
    left, right = F.greatest(F.lit(0), F.lit(before) - rank), F.greatest(F.lit(0), rank + after - n + 1)
    return F.sum(value).over(w.rowsBetween(-before, after)) + F.first(value).over(whole) * left + F.last(value).over(whole) * right


def box_axis(px: DataFrame, axis: str, radius: int) -> DataFrame:
    """Floored mean of 2r + 1 samples along an axis; the edge samples are repeated outward."""
    return px.select("image_id", "y", "x", F.floor(padded_sum(axis, "v", radius, radius) / (2 * radius + 1)).cast("int").alias("v"))


def box_blur(px: DataFrame, radius: int, mode: str = "exact") -> DataFrame:
    """shift: the radius grows to a power of two, and the sum of 2r + 1 samples is divided by 2r, which brightens a little; values
    are clipped after the second pass."""
    if mode == "exact":
        return box_axis(box_axis(px, "x", radius), "y", radius)
    radius = 1 << max(0, radius - 1).bit_length()
    for axis in ("x", "y"):
        px = px.select("image_id", "y", "x", F.floor(padded_sum(axis, "v", radius, radius) / (2 * radius)).alias("v"))
    return px.select("image_id", "y", "x", F.least("v", F.lit(255)).cast("int").alias("v"))


def morph_axis(px: DataFrame, axis: str, radius: int, op: str) -> DataFrame:
    """Maximum (dilate) or minimum (erode) of the 2r samples from p - r + 1 to p + r: the window is not centred."""
    f = {"dilate": F.max, "erode": F.min}[op]
    return px.select("image_id", "y", "x", f("v").over(along(axis).rowsBetween(-(radius - 1), radius)).alias("v"))


def morph(px: DataFrame, op: str, radius: int, axis: str = "both") -> DataFrame:
    """dilate, erode, open (erode, then dilate) or close; columns first, then rows, or one axis."""
    steps = {"open": ("erode", "dilate"), "close": ("dilate", "erode")}.get(op, (op,))
    for step in steps:
        for a in ("y", "x") if axis == "both" else (axis,):
            px = morph_axis(px, a, radius, step)
    return px


def neighbours(px: DataFrame) -> DataFrame:
    """px with west, east, north, south; off the image: null."""
    wx, wy = along("x"), along("y")
    px = px.select("*", F.lag("v").over(wx).alias("west"), F.lead("v").over(wx).alias("east"))
    return px.select("*", F.lag("v").over(wy).alias("north"), F.lead("v").over(wy).alias("south"))


def _loco(px: DataFrame) -> DataFrame:
    """px with difference, to the median-edge prediction of west, north and north-west, pinned to a byte and cut; null in the
    first row and column."""
    p = px.select("*", F.lag("v").over(along("y")).alias("north"))
    p = p.select("*", F.lag("v").over(along("x")).alias("west"), F.lag("north").over(along("x")).alias("corner"))
    low, high = F.least("west", "north"), F.greatest("west", "north")
    guess = F.when(F.col("corner") >= high, low).when(F.col("corner") <= low, high).otherwise(F.col("west") + F.col("north") - F.col("corner"))
    guess = F.least(F.greatest(guess, F.lit(0)), F.lit(255)).cast("int")
    return p.withColumn("difference", F.when(F.col("corner").isNotNull(), F.col("v") - guess))


def loco_residual(px: DataFrame) -> DataFrame:
    """(image_id, y, x, residual): half the zig-zagged difference to the prediction; the first row and column keep their values."""
    residual = F.when(F.col("difference").isNull(), F.col("v")).otherwise(zigzag(F.col("difference").cast("int")) / 2.0)
    return _loco(px).select("image_id", "y", "x", residual.cast("double").alias("residual"))


def zero_residuals(px: DataFrame) -> DataFrame:
    """(image_id, zeros, average) of the predicted samples: residuals under 0.01, and the mean difference before folding."""
    p = _loco(px).where("difference is not null")
    zeros = F.sum(F.when(F.abs(zigzag(F.col("difference").cast("int")) / 2.0) < 0.01, 1).otherwise(0))
    return p.groupBy("image_id").agg(zeros.alias("zeros"), F.avg("difference").alias("average"))


def edges(px: DataFrame, inside: Column) -> DataFrame:
    """Whether a sample is inside and has an outside 4-neighbour; off the image counts as the sample itself."""
    p = neighbours(px.select("image_id", "y", "x", inside.cast("int").alias("v")))
    least = F.least(*(F.coalesce(c, "v") for c in ("west", "east", "north", "south")))
    return p.select("image_id", "y", "x", ((F.col("v") == 1) & (least == 0)).alias("edge"))


def axis_distance(px: DataFrame, axis: str, inside: Column) -> DataFrame:
    """Signed distance along a line to the nearest change of side, never 0, negative inside; lines without a change
    have line length + position + 1."""
    w = along(axis)
    p = px.select("image_id", "y", "x", inside.cast("int").alias("i"), F.row_number().over(w).alias("p"))
    p = p.select("*", F.when(F.lag("i").over(w) != F.col("i"), F.col("p")).alias("start"), F.when(F.lead("i").over(w) != F.col("i"), F.col("p")).alias("end"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    back = F.col("p") - F.last("start", True).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1
    ahead = F.first("end", True).over(w.rowsBetween(0, Window.unboundedFollowing)) - F.col("p") + 1
    distance = F.least(F.coalesce(back, ahead, F.count("*").over(whole) + F.col("p")), F.coalesce(ahead, back, F.count("*").over(whole) + F.col("p")))
    return p.select("image_id", "y", "x", F.when(F.col("i") == 1, -distance).otherwise(distance).cast("long").alias("distance"))


def haar_gradients(px: DataFrame) -> DataFrame:
    """Eight times the sum of each pair of a row, in the left half, and eight times 255 + the difference, in the right half."""
    w = along("x")
    p = px.select("*", F.lead("v").over(w).alias("next"), (F.row_number().over(w) - 1).alias("p"), F.expr("cast(count(*) over (partition by image_id, y) div 2 as int)").alias("half"))
    p = p.where("p % 2 = 0 and next is not null").withColumn("k", F.expr("cast(p div 2 as int)"))
    both = F.array(
        F.struct(F.col("k").alias("x"), ((F.col("v") + F.col("next")) * 8).alias("v")),
        F.struct((F.col("k") + F.col("half")).alias("x"), ((F.col("v") - F.col("next") + 255) * 8).alias("v")),
    )
    return p.select("image_id", "y", F.inline(both))


def epx2(px: DataFrame) -> DataFrame:
    """Pixel-art doubling: a quarter takes a neighbour's value where two adjacent neighbours agree and the others differ.
    On the first and last column both horizontal neighbours are the sample itself; rows alike."""
    p = neighbours(px)
    side = F.col("west").isNull() | F.col("east").isNull()
    ends = F.col("north").isNull() | F.col("south").isNull()
    p = p.select("image_id", "y", "x", "v", *(F.when(e, F.col("v")).otherwise(F.col(c)).alias(c) for c, e in (("west", side), ("east", side), ("north", ends), ("south", ends))))
    pick = lambda a, b, c, d: F.when((F.col(a) == F.col(b)) & (F.col(a) != F.col(c)) & (F.col(b) != F.col(d)), F.col(b)).otherwise(F.col("v"))
    corner = [(0, 0, pick("west", "north", "south", "east")), (0, 1, pick("north", "east", "west", "south")), (1, 0, pick("south", "west", "east", "north")), (1, 1, pick("east", "south", "north", "west"))]
    quarters = F.explode(F.array(*(F.struct((F.col("y") * 2 + dy).alias("y"), (F.col("x") * 2 + dx).alias("x"), c.alias("v")) for dy, dx, c in corner)))
    return p.select("image_id", quarters.alias("q")).select("image_id", "q.y", "q.x", "q.v")


def unsharp_threshold(px: DataFrame, scale: int = 3, exposure: int = 0, invert: bool = False) -> DataFrame:
    """0 or 255 by the local mean of 2^(scale+1) samples a side, two floored passes, pinned to 16..240; edges repeat."""
    radius = 1 << scale
    p = px.withColumn("m", F.col("v").cast("long"))
    for axis in ("y", "x"):
        p = p.select("image_id", "y", "x", "v", F.floor(padded_sum(axis, "m", radius, radius - 1) / (2 * radius)).alias("m"))
    black = F.col("v") - exposure < F.least(F.greatest("m", F.lit(16)), F.lit(240))
    return p.select("image_id", "y", "x", F.when(black, 255 if invert else 0).otherwise(0 if invert else 255).alias("v"))


def block_stats(px: DataFrame, step: int = 4) -> DataFrame:
    """Minimum, maximum and mean of the 5 by 5 samples around every step-th sample of every step-th row, at y and x divided by the
    step; the edge samples count again beyond the edge, and a last part of less than a step is left out."""
    for axis in ("x", "y"):
        w = along(axis)
        low, high, total = ("v", "v", "v") if axis == "x" else ("low", "high", "total")
        columns = [F.min(low).over(w.rowsBetween(-2, 2)).alias("low"), F.max(high).over(w.rowsBetween(-2, 2)).alias("high"), padded_sum(axis, total, 2, 2).alias("total")]
        n = F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        px = px.select("image_id", "y", "x", *columns, *(["nx"] if axis == "y" else []), n.alias(f"n{axis}"))
    px = px.where(f"x % {step} = 0 and y % {step} = 0 and x div {step} < nx div {step} and y div {step} < ny div {step}")
    return px.selectExpr("image_id", f"cast(y div {step} as int) y", f"cast(x div {step} as int) x", "low", "high", "round(total / 25, 6) mean")


def normalise(px: DataFrame, high: float = 255.0) -> DataFrame:
    """(v - min) * high / (max - min) within an image; 0 where an image has one value. Extremes are grouped and joined back: adaptive
    execution broadcasts them up to its threshold of bytes, some hundred thousand images, and splits skewed images beyond it."""
    ends = px.groupBy("image_id").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    out = px.join(ends, "image_id")
    return out.select("image_id", "y", "x", F.when(F.col("b") > F.col("a"), (F.col("v") - F.col("a")) * high / (F.col("b") - F.col("a"))).otherwise(0.0).alias("v"))


def lifting(px: DataFrame, axis: str, steps: list[tuple[int, float]], scale: float) -> DataFrame:
    """Forward lifting along an axis: each step (parity, a) adds a * (left + right) to the samples of that parity, ends
    mirrored; then even samples are divided and odd ones multiplied by `scale`; even ones go to the first half."""
    w = along(axis)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = px.select("image_id", "y", "x", F.col("v").cast("double").alias("v"), (F.row_number().over(w) - 1).alias("p"), F.count("*").over(whole).alias("n"))
    for parity, a in steps:
        left, right = F.lag("v").over(w), F.lead("v").over(w)
        sides = F.coalesce(left, right, F.lit(0.0)) + F.coalesce(right, left, F.lit(0.0))
        p = p.withColumn("v", F.when(F.col("p") % 2 == parity, F.col("v") + sides * a).otherwise(F.col("v")))
    v = F.when(F.col("p") % 2 == 0, F.col("v") / scale).otherwise(F.col("v") * scale)
    to = F.expr("cast(if(p % 2 = 0, p div 2, (n + 1) div 2 + p div 2) as int)")
    other = "y" if axis == "x" else "x"
    return p.select("image_id", other, to.alias(axis), v.alias("v"))


#: Lifting steps (parity, factor) and scales of the biorthogonal wavelets.
CDF97 = ([(1, -1.586134342), (0, -0.05298011854), (1, 0.8829110762), (0, 0.4435068522)], 1.149604398)
CDF53 = ([(1, -0.5), (0, 0.25)], 1.0)


def inverse_lifting(px: DataFrame, axis: str, steps: list[tuple[int, float]], scale: float) -> DataFrame:
    w = along(axis)
    other = "y" if axis == "x" else "x"
    n = F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    p = px.select("image_id", other, (F.row_number().over(w) - 1).alias("q"), n.alias("n"), F.col("v").cast("double").alias("v"))
    half = "(n + 1) div 2"
    p = p.select("image_id", other, F.expr(f"cast(if(q < {half}, 2 * q, 2 * (q - {half}) + 1) as int)").alias(axis), "v")
    p = p.withColumn("v", F.when(F.col(axis) % 2 == 0, F.col("v") * scale).otherwise(F.col("v") / scale))
    for parity, a in reversed(steps):
        left, right = F.lag("v").over(w), F.lead("v").over(w)
        sides = F.coalesce(left, right, F.lit(0.0)) + F.coalesce(right, left, F.lit(0.0))
        p = p.withColumn("v", F.when(F.col(axis) % 2 == parity, F.col("v") - sides * a).otherwise(F.col("v")))
    return p.select("image_id", "y", "x", "v")
