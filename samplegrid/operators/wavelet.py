"""Several-level wavelets on rasters (image_id, y, x, v), storage order, band gains and quantisers.

decompose() adds w and h, the sides of the image, which must be powers of two times 2^levels (pad_pow2() makes them so). Each level works on
what is left of the last one and is written to a scratch table, so a level costs its own samples, and all levels together one third more
than the first. All windows of a level lie in one image: repartition("image_id") before many small images.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from samplegrid.operators.gather import sizes
from samplegrid.operators.scan import cut
from samplegrid.operators.window import CDF53, CDF97

#: Gains of the presets, by bracket of storage order, the last one repeated.
SOFT, SHARP = (1.0, 1 / 2, 1 / 3), (1.0, 2.0, 3.0, 2.0, 1.0)
#: Divisors of luma and colour by bracket, the last one repeated.
QUANT_Y, QUANT_C = (12.0, 9.0, 4.0, 2.3, 1.5, 1.0), (10.0, 5.0, 2.0, 1.0)
KINDS = {"cdf97": CDF97, "cdf53": CDF53}


def _line(axis: str):
    keys = [c for c in ("image_id", "z", "y", "x") if c != axis]
    return lambda df: Window.partitionBy(*(k for k in keys if k in df.columns)).orderBy(axis)


def lift(df: DataFrame, axis: str, n: Column, kind: str = "cdf97") -> DataFrame:
    """One forward level along an axis of lines with n samples at 0 .. n - 1: low half first, then high half."""
    w = _line(axis)(df)
    p = F.col(axis)
    left, right = F.lag("v").over(w), F.lead("v").over(w)
    if kind == "haar":  # lines of up to 4 samples stay
        mean = F.when(p % 2 == 0, (F.col("v") + right) / 2).otherwise((left + F.col("v")) / 2)
        lifted = F.when(p % 2 == 0, mean).otherwise(F.col("v") - mean)
        df = df.withColumn("v", F.when(n > 4, lifted).otherwise(F.col("v")))
        to = F.when((p % 2 == 0) | (n <= 4), F.when(n > 4, F.shiftright(p, 1)).otherwise(p)).otherwise(F.shiftright(n, 1) + F.shiftright(p, 1))
        return df.withColumn(axis, to.cast("int"))
    sides = F.coalesce(left, right, F.lit(0.0)) + F.coalesce(right, left, F.lit(0.0))
    if kind == "int53":  # whole numbers, floored halves and quarters
        df = df.withColumn("v", F.when(p % 2 == 1, F.col("v") - F.floor(sides / 2)).otherwise(F.col("v")))
        df = df.withColumn("v", F.when(p % 2 == 0, F.col("v") + F.floor(sides / 4)).otherwise(F.col("v")))
    else:
        steps, scale = KINDS[kind]
        for parity, a in steps:
            df = df.withColumn("v", F.when(p % 2 == parity, F.col("v") + sides * a).otherwise(F.col("v")))
        df = df.withColumn("v", F.when(p % 2 == 0, F.col("v") / scale).otherwise(F.col("v") * scale))
    return df.withColumn(axis, F.when(p % 2 == 0, F.shiftright(p, 1)).otherwise(F.shiftright(n + 1, 1) + F.shiftright(p, 1)).cast("int"))


def unlift(df: DataFrame, axis: str, n: Column, kind: str = "cdf97") -> DataFrame:
    """Inverse of lift()."""
    q, half = F.col(axis), F.shiftright(n + 1, 1)
    back = F.when(q < half, q * 2).otherwise((q - half) * 2 + 1)
    df = df.withColumn(axis, (F.when(n > 4, back).otherwise(q) if kind == "haar" else back).cast("int"))
    w = _line(axis)(df)
    p = F.col(axis)
    left, right = F.lag("v").over(w), F.lead("v").over(w)
    if kind == "haar":
        odd = F.when(p % 2 == 0, F.col("v") + right).otherwise(left + F.col("v"))
        return df.withColumn("v", F.when(n <= 4, F.col("v")).when(p % 2 == 1, odd).otherwise(F.col("v") * 2 - odd))
    sides = F.coalesce(left, right, F.lit(0.0)) + F.coalesce(right, left, F.lit(0.0))
    if kind == "int53":
        df = df.withColumn("v", F.when(p % 2 == 0, F.col("v") - F.floor(sides / 4)).otherwise(F.col("v")))
        return df.withColumn("v", F.when(p % 2 == 1, F.col("v") + F.floor(sides / 2)).otherwise(F.col("v")))
    steps, scale = KINDS[kind]
    df = df.withColumn("v", F.when(p % 2 == 0, F.col("v") * scale).otherwise(F.col("v") / scale))
    for parity, a in reversed(steps):
        df = df.withColumn("v", F.when(p % 2 == parity, F.col("v") - sides * a).otherwise(F.col("v")))
    return df


def _half(side: str, level: int) -> Column:
    return F.shiftright(side, level)


def _inside(level: int) -> Column:
    return (F.col("y") < _half("h", level)) & (F.col("x") < _half("w", level))


def decompose(px: DataFrame, levels: int, kind: str = "cdf97", scheme: str = "half", shift: float = 0.0) -> DataFrame:
    """(image_id, y, x, v, w, h): `levels` times columns, then rows of what is left. scheme half: only rows of the low half take the second
    pass; full: all rows. shift is taken off the samples first."""
    cur = px.join(sizes(px), "image_id").select("image_id", "y", "x", (F.col("v") - shift).cast("double").alias("v"), "w", "h")
    done = []
    for i in range(levels):
        if i:
            done.append(cur.where(~_inside(i)))
            cur = cur.where(_inside(i))
        cur = lift(cur, "y", _half("h", i), kind)
        rows = lift(cur if scheme == "full" else cur.where(F.col("y") < _half("h", i + 1)), "x", _half("w", i), kind)
        cur = cut(rows if scheme == "full" else rows.unionByName(cur.where(F.col("y") >= _half("h", i + 1))))
    for d in done:
        cur = cur.unionByName(d)
    return cur


def reconstruct(coeffs: DataFrame, levels: int, kind: str = "cdf97", scheme: str = "half", shift: float = 0.0, scale: int = 0) -> DataFrame:
    """(image_id, y, x, v): inverse of decompose(). scale k restores the image at 1 / 2^k of its sides, from the coarse levels alone."""
    cur = coeffs.where(_inside(scale))
    low = cur.where(_inside(levels))
    for i in reversed(range(scale, levels)):
        level = low.unionByName(cur.where(_inside(i) & ~_inside(i + 1)))
        rows = unlift(level if scheme == "full" else level.where(F.col("y") < _half("h", i + 1)), "x", _half("w", i), kind)
        level = rows if scheme == "full" else rows.unionByName(level.where(F.col("y") >= _half("h", i + 1)))
        low = cut(unlift(level, "y", _half("h", i), kind))
    return low.select("image_id", "y", "x", (F.col("v") + shift).alias("v"))


def storage_order(coeffs: DataFrame, levels: int) -> DataFrame:
    """coeffs with level (levels: what is left) and order_pos: the coarsest part by rows, then of each level, coarse to fine, the block to the
    right by columns and the one below by rows. Closed form, so nothing is sorted."""
    level = F.lit(0)
    for i in range(1, levels + 1):
        level = F.when(_inside(i), i).otherwise(level)
    df = coeffs.withColumn("level", level)
    w, h = "shiftright(w, level)", "shiftright(h, level)"
    before = f"shiftright({w}, 1) * shiftright({h}, 1)"
    pos = f"""case when level = {levels} then y * {w} + x
        when y < shiftright({h}, 1) then {before} + (x - shiftright({w}, 1)) * shiftright({h}, 1) + y
        else 2 * {before} + (y - shiftright({h}, 1)) * {w} + x end"""
    return df.withColumn("order_pos", F.expr(pos))


def bracket() -> Column:
    """r for the places from N / 2^(r + 1) to N / 2^r in storage order, of N samples; places are powers of two apart."""
    return F.length(F.bin((F.col("w") * F.col("h")).cast("long"))) - 1 - F.length(F.bin(F.col("order_pos").cast("long")))


def by_bracket(factors: tuple[float, ...]) -> Column:
    table = F.array(*(F.lit(float(f)) for f in factors))
    return F.element_at(table, (F.least(bracket(), F.lit(len(factors) - 1)) + 1).cast("int"))


def band_gain(px: DataFrame, factors: tuple[float, ...], levels: int, brackets: int | None = None) -> DataFrame:
    """px with each bracket of its 9/7 coefficients times its factor: the first `brackets` (levels + 1) brackets."""
    brackets = levels + 1 if brackets is None else brackets
    c = storage_order(decompose(px, levels, shift=127.5), levels)
    gain = F.when((F.col("order_pos") > 0) & (bracket() < brackets), by_bracket(factors)).otherwise(1.0)
    return reconstruct(c.withColumn("v", F.col("v") * gain).drop("level", "order_pos"), levels, shift=127.5)


def soft_focus(px: DataFrame, levels: int) -> DataFrame:
    return band_gain(px, SOFT, levels, levels)


def sharpen(px: DataFrame, levels: int) -> DataFrame:
    return band_gain(px, SHARP, levels, levels)


def quantise(coeffs: DataFrame, factors: tuple[float, ...] = QUANT_Y, expand: bool = False) -> DataFrame:
    """storage_order()'s rows with v divided, or multiplied, by the factor of its bracket; the first place is kept, as are brackets of a
    factor of 1. Brackets are cut at powers of two throughout."""
    f = F.when(F.col("order_pos") > 0, by_bracket(factors)).otherwise(1.0)
    return coeffs.withColumn("v", F.col("v") * f if expand else F.col("v") / f)


def decompose_morton(px: DataFrame, levels: int) -> DataFrame:
    """(image_id, y, x, v, w, h) with y = 0: the image as one line in Morton order, lifted `levels` times; band i of levels is divided by
    levels - i. An image's line is one group; places beyond the number of its samples are not lifted and belong to the last band."""
    from samplegrid.functions.scalar import morton2

    line = px.join(sizes(px), "image_id").select("image_id", F.lit(0).alias("y"), morton2("x", "y").cast("int").alias("x"), F.col("v").cast("double").alias("v"), (F.col("w") * F.col("h")).alias("w"), F.lit(1).alias("h"))
    # in the Morton order of sides that are not equal places are left out, and the last ones lie beyond the samples' number
    beyond = F.col("x") >= F.col("w")
    cur, done = line.where(~beyond), [line.where(beyond).withColumn("v", F.col("v") / levels)]
    for i in range(levels):
        cur = cut(lift(cur, "x", _half("w", i)))
        done.append(cur.where(F.col("x") >= _half("w", i + 1)).withColumn("v", F.col("v") / (levels - i)))
        cur = cur.where(F.col("x") < _half("w", i + 1))
    for d in done:
        cur = cur.unionByName(d)
    return cur


def decompose3d(px: DataFrame, levels: int, kind: str = "cdf97") -> DataFrame:
    """px(image_id, z, y, x, v, w, h, d), a block of d frames of w by h: `levels` rounds of columns and rows on each frame, then as many rounds
    along z on all samples; the half scheme of decompose()."""
    cur = px.select("image_id", "z", "y", "x", F.col("v").cast("double").alias("v"), "w", "h", "d")
    for axis_level in range(levels):
        inside = cur.where(_inside(axis_level))
        rest = cur.where(~_inside(axis_level))
        inside = lift(inside, "y", _half("h", axis_level), kind)
        rows = lift(inside.where(F.col("y") < _half("h", axis_level + 1)), "x", _half("w", axis_level), kind)
        cur = cut(rows.unionByName(inside.where(F.col("y") >= _half("h", axis_level + 1))).unionByName(rest))
    for i in range(levels):
        low = lift(cur.where(F.col("z") < _half("d", i)), "z", _half("d", i), kind)
        cur = cut(low.unionByName(cur.where(F.col("z") >= _half("d", i))))
    return cur


def axis_gradients(px: DataFrame, axis: str) -> DataFrame:
    """One 9/7 level along an axis on every line, undone on the lines of the first half: a view of an axis's gradients."""
    other, side = ("y", "h") if axis == "x" else ("x", "w")
    n = F.col("w" if axis == "x" else "h")
    p = px.join(sizes(px), "image_id").select("image_id", "y", "x", F.col("v").cast("double").alias("v"), "w", "h")
    p = cut(lift(p, axis, n))
    first = unlift(p.where(F.col(other) < F.shiftright(side, 1)), axis, n)
    return first.unionByName(p.where(F.col(other) >= F.shiftright(side, 1))).select("image_id", "y", "x", "v")
