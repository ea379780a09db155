"""Colour spaces as functions (c1, c2, c3) -> (Column, Column, Column): expressions only, no UDF."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Triple = tuple[Column, Column, Column]


def single(x: float) -> float:
    """The double next to a number of single precision."""
    return struct.unpack("f", struct.pack("f", x))[0]


#: out = matrix * (in - before) + after, row by row.
AFFINE = {
    "from_ycbcr24": ([(1.164, -0.0017, 1.596), (1.164, -0.3914, -0.813), (1.164, 2.0178, 0.001)], (16, 128, 128), (0, 0, 0)),
    "ycbcr": ([(0.257, 0.504, 0.098), (-0.148, -0.291, 0.439), (0.439, -0.368, -0.071)], (0, 0, 0), (16, 128, 128)),
    "from_yuv": ([(1.164, 0, 1.596), (1.164, -0.392, -0.813), (1.164, 2.017, 0)], (16, 128, 128), (0, 0, 0)),
    "lpqg": ([(0.25, 0.5, 0.25), (0.5, 0.5, -1), (1, -1, 0)], (0, 0, 0), (0, 0, 0)),
    "from_lpqg": ([(1, 0.25, 0.625), (1, 0.25, -0.375), (1, -0.75, 0.125)], (0, 0, 0), (0, 0, 0)),
    "exp_of_bgr": ([(0.0638407, 0.291612, 0.144547), (0.435098, -0.270198, -0.1649), (-0.0527391, -0.382359, 0.435098)], (0, 0, 0), (64, 128, 128)),
    "from_exp": ([(2, -0.1, 1.596), (2, -0.392, -0.813), (2, 2.017, 0.1)], (64, 128, 128), (0, 0, 0)),
    "xyz_of_linear": ([(0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.072175), (0.0193339, 0.119192, 0.9503041)], (0, 0, 0), (0, 0, 0)),
    "linear_of_xyz": ([(3.2404542, -1.5371385, -0.4985374), (-0.969266, 1.8760108, 0.041556), (0.0556434, -0.2040259, 1.0572252)], (0, 0, 0), (0, 0, 0)),
    "lms": ([(0.210576, 0.855098, -0.0396983), (-0.417076, 1.17726, 0.0786283), (0, 0, 0.516835)], (0, 0, 0), (0, 0, 0)),
    "from_lms": ([(1.94735469, -1.41445123, -0.36476327), (0.68990272, 0.34832189, 0), (0, 0, 1.93485343)], (0, 0, 0), (0, 0, 0)),
    "kla": ([(0.54933, 0.60238, 0.57912), (0.80429, -0.19322, -0.56194), (0.22661, -0.77447, -0.59063)], (0, 0, 0), (64, 128, 128)),
    "from_kla": ([(1.06209, 0.30672, 0.74957), (-1.15012, 1.50733, -2.56183), (1.91561, -1.85882, 1.95371)], (64, 128, 128), (0, 0, 0)),
    "oklab_lms": ([(0.412165612, 0.536275208, 0.0514575653), (0.211859107, 0.6807189584, 0.107406579), (0.0883097947, 0.2818474174, 0.6302613616)], (0, 0, 0), (0, 0, 0)),
    "oklab_of_roots": ([(0.2104542553, 0.793617785, -0.0040720468), (1.9779984951, -2.428592205, 0.4505937099), (0.0259040371, 0.7827717662, -0.808675766)], (0, 0, 0), (0, 0, 0)),
    "roots_of_oklab": ([(1, 0.3963377774, 0.2158037573), (1, -0.1055613458, -0.0638541728), (1, -0.0894841775, -1.291485548)], (0, 0, 0), (0, 0, 0)),
    "linear_of_lms": ([(4.0767245293, -3.3072168827, 0.2307590544), (-1.2681437731, 2.6093323231, -0.341134429), (-0.0041119885, -0.7034763098, 1.7068625689)], (0, 0, 0), (0, 0, 0)),
}
#: Fixed: these coefficients are of single precision.
for _name in ("oklab_lms", "oklab_of_roots"):
    AFFINE[_name] = ([tuple(map(single, row)) for row in AFFINE[_name][0]], *AFFINE[_name][1:])


def affine(name: str, *c) -> Triple:
    matrix, before, after = AFFINE[name]
    c = [F.col(x) if isinstance(x, str) else x for x in c]
    c = [x.cast("double") - b for x, b in zip(c, before, strict=True)]
    return tuple(c[0] * float(m[0]) + c[1] * float(m[1]) + c[2] * float(m[2]) + a for m, a in zip(matrix, after, strict=True))


def clip(c: Column) -> Column:
    """Clamped to 0..255, then cut to a whole number."""
    return F.least(F.greatest(c, F.lit(0)), F.lit(255)).cast("int")


def _cols(*c) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in c]


def to_ycbcr24(r, g, b) -> Triple:
    return tuple(clip(c) for c in affine("ycbcr", r, g, b))


def from_ycbcr24(y, cb, cr) -> Triple:
    return tuple(clip(c) for c in affine("from_ycbcr24", y, cb, cr))


def to_ycbcr16(r, g, b) -> Column:
    """6 bits of luma, 5 of each chroma, in one whole number."""
    y, cb, cr = to_ycbcr24(r, g, b)
    return F.shiftright(y, 2) * 1024 + F.shiftright(cb, 3) * 32 + F.shiftright(cr, 3)


def from_ycbcr16(c) -> Triple:
    """The low bits are zero; other factors than in 24 bits, as published."""
    (c,) = _cols(c)
    y, cb, cr = F.shiftright(c, 10).bitwiseAND(F.lit(63)) * 4, F.shiftright(c, 5).bitwiseAND(F.lit(31)) * 8, c.bitwiseAND(F.lit(31)) * 8
    return tuple(clip(x) for x in affine("from_yuv", y, cb, cr))


def to_yuv(r, g, b) -> Triple:
    return affine("ycbcr", r, g, b)


def from_yuv(y, u, v) -> Triple:
    return affine("from_yuv", y, u, v)


def to_ycocg24(r, g, b) -> Triple:
    """Lifting on whole numbers with arithmetic shifts; the chroma halves are stored with an offset of 127."""
    r, g, b = (c.cast("int") for c in _cols(r, g, b))
    half = b + F.shiftright(r - b, 1)
    return clip(half + F.shiftright(g - half, 1)), clip(F.shiftright(r - b, 1) + 127), clip(F.shiftright(g - half, 1) + 127)


def from_ycocg24(y, co, cg) -> Triple:
    y, co, cg = (c.cast("int") for c in _cols(y, co, cg))
    low = y - (cg - 127)
    b = low - (co - 127)
    return clip(b + 2 * (co - 127)), clip(low + 2 * (cg - 127)), clip(b)


def to_ycocg(r, g, b) -> Triple:
    r, g, b = (c.cast("double") for c in _cols(r, g, b))
    mid = (r + b) / 2
    return (mid + g) / 2, (r - b) / 2 + 127, (g - mid) / 2 + 127


def from_ycocg(y, co, cg) -> Triple:
    y, co, cg = _cols(y, co, cg)
    mid = y - (cg - 127)
    return mid + (co - 127), mid + 2 * (cg - 127), mid - (co - 127)


def to_yiq(r, g, b) -> Triple:
    r, g, b = (c.cast("double") for c in _cols(r, g, b))
    y = r * 0.30 + g * 0.59 + b * 0.11
    return y, ((b - y) * -0.27 + (r - y) * 0.74) * 0.8393 + 127, ((b - y) * 0.41 + (r - y) * 0.48) * 0.9567 + 127


def from_yiq(y, i, q) -> Triple:
    y, i, q = _cols(y, i, q)
    i, q = (i - 127) * 1.1914, (q - 127) * 1.0452
    return y + i * 0.9469 + q * 0.6236, y - i * 0.2748 - q * 0.6357, y - i * 1.1 + q * 1.7


def to_lpq(r, g, b) -> Triple:
    r, g, b = (c.cast("double") for c in _cols(r, g, b))
    return (r + g + b) / 3, (r + g) / 2 - b, r - g


def from_lpq(light, p, q) -> Triple:
    light, p, q = _cols(light, p, q)
    b = light - p * 2 / 3
    r = (light * 3 - b + q) / 2
    return r, r - q, b


def to_yuv888(r, g, b) -> Triple:
    """Whole numbers: a weighted sum plus 128, shifted right by 8."""
    r, g, b = (c.cast("int") for c in _cols(r, g, b))
    shift = lambda c, k: F.shiftright(c + 128, 8) + k
    return shift(r * 66 + g * 129 + b * 25, 16), shift(r * -38 + g * -74 + b * 112, 128), shift(r * 112 + g * -94 + b * -18, 128)


def from_yuv888(y, u, v) -> Triple:
    y, u, v = (c.cast("int") for c in _cols(y, u, v))
    y, u, v = (y - 16) * 298 + 128, u - 128, v - 128
    return tuple(clip(F.shiftright(c, 8)) for c in (y + v * 409, y - u * 100 - v * 208, y + u * 516))


def yuv_to_rgb565(y, u, v) -> Column:
    """5, 6 and 5 bits as a signed short; luma over 220 is white. In doubles."""
    y, u, v = _cols(y, u, v)
    luma, u, v = (y - 16) * 1.164, u - 127.5, v - 127.5
    r, g, b = (clip(c) for c in (luma + v * 1.596, luma - u * 0.392 - v * 0.813, luma + u * 2.017))
    packed = F.floor(r / 8) * 2048 + F.floor(g / 4) * 32 + F.floor(b / 8)
    return F.when(y > 220, F.lit(-1)).otherwise(packed).cast("int") - F.when((y <= 220) & (packed > 32767), 65536).otherwise(0)


def rgb565_to_yuv(c) -> Triple:
    (c,) = _cols(c)
    bits = F.pmod(c, F.lit(65536)).cast("int")
    r, g, b = F.shiftright(bits, 11) * 8, F.shiftright(bits, 5) % 64 * 4, bits % 32 * 8
    return r * 0.257 + g * 0.504 + b * 0.098 + 16, b * 0.439 - r * 0.148 - g * 0.291 + 127.5, r * 0.439 - g * 0.368 - b * 0.071 + 127.5


def to_exp(r, g, b) -> Triple:
    """The terms are summed from blue to red, which decides some cuts."""
    return tuple(clip(c) for c in affine("exp_of_bgr", b, g, r))


def from_exp(x, y, z) -> Triple:
    return tuple(clip(c) for c in affine("from_exp", x, y, z))


#: Perceived weight of red, green and blue; what counts as noise.
HSP, NOISE = (0.299, 0.587, 0.114), 0.03


def to_hsp(r, g, b) -> Triple:
    """Hue, saturation and perceived brightness, 0..255. Hue is 0 for greys and at low saturation, both are for very dark."""
    raw = [c.cast("double") for c in _cols(r, g, b)]
    rgb = [c / 255.0 for c in raw]
    bright = F.sqrt(rgb[0] * rgb[0] * HSP[0] + rgb[1] * rgb[1] * HSP[1] + rgb[2] * rgb[2] * HSP[2])
    grey = (F.abs(raw[0] - raw[1]) < NOISE) & (F.abs(raw[0] - raw[2]) < NOISE)

    def hue(k: int) -> Column:
        # the largest channel's turn, less or more a sixth of the distance of its neighbours on the circle
        top, after, before = rgb[k], rgb[(k + 1) % 3], rgb[(k + 2) % 3]
        back = F.lit(2 * k / 6 if k else 1.0) - (before - after) * (1 / 6) / F.nullif(top - after, F.lit(0.0))
        ahead = F.lit(2 * k / 6) + (after - before) * (1 / 6) / F.nullif(top - before, F.lit(0.0))
        return F.when(before >= after, back).otherwise(ahead)

    largest = F.greatest(*rgb)
    h = F.when(rgb[0] >= largest, hue(0)).when(rgb[1] >= largest, hue(1)).otherwise(hue(2))
    s = F.when(grey | (bright < NOISE), 0.0).otherwise(1.0 - F.least(*rgb) / F.nullif(largest, F.lit(0.0)))
    h = F.when(grey | (s < NOISE), 0.0).otherwise(h)
    return clip(h * 255), clip(s * 255), clip(bright * 255)


def from_hsp(h, s, p) -> Triple:
    """Doubles, which may exceed 255. Each sixth of the circle orders the channels from the largest to the smallest."""
    h, s, p = (c.cast("double") / 255.0 for c in _cols(h, s, p))
    m = 1.0 - s
    out = [F.lit(None).cast("double")] * 3
    for k, (top, middle, low) in reversed(list(enumerate([(0, 1, 2), (1, 0, 2), (1, 2, 0), (2, 1, 0), (2, 0, 1), (0, 2, 1)]))):
        f = (h - k / 6) * 6.0 if k % 2 == 0 else (-h + (k + 1) / 6) * 6.0
        part = f * (1.0 / F.nullif(m, F.lit(0.0)) - 1.0) + 1.0
        least = p / F.sqrt(HSP[top] / m / m + part * part * HSP[middle] + HSP[low])
        pure = F.sqrt(p * p / (f * f * HSP[middle] + HSP[top]))
        most = F.when(m > 0, least / F.nullif(m, F.lit(0.0))).otherwise(pure)
        own = {top: most, middle: F.when(m > 0, least + f * (most - least)).otherwise(pure * f), low: F.when(m > 0, least).otherwise(0.0)}
        out = [F.when(h < (k + 1) / 6 if k < 5 else F.lit(True), own[i]).otherwise(out[i]) for i in range(3)]
    return tuple(c * 255 for c in out)


def to_hcl(r, g, b) -> Triple:
    """Hue in degrees, chroma and luma 0..1."""
    r, g, b = (c.cast("double") for c in _cols(r, g, b))
    luma, most, chroma = (r * 0.30 + g * 0.59 + b * 0.11) / 255.0, F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    span = F.nullif(chroma, F.lit(0.0))
    hue = F.when(most == r, F.pmod((g - b) / span, F.lit(6.0))).when(most == g, (b - r) / span + 2).otherwise((r - g) / span + 4)
    return F.when(chroma > 0, hue * 60).otherwise(0.0), F.when(chroma > 0, chroma / 255).otherwise(0.0), luma


def from_hcl(hue, chroma, luma) -> Triple:
    """Chroma and luma 0..255 (asymmetric, as published); without chroma a double grey, else clipped."""
    hue, chroma, luma = (c.cast("double") for c in _cols(hue, chroma, luma))
    c, light = chroma * (1 / 255), luma * (1 / 255)
    turn = F.pmod(hue / 60, F.lit(6.0))
    second, none = c * (F.lit(1.0) - F.abs(turn % 2 - 1)), F.lit(0.0)
    parts = [none, none, none]
    for k, order in reversed(list(enumerate([(c, second, none), (second, c, none), (none, c, second), (none, second, c), (second, none, c), (c, none, second)]))):
        parts = [F.when(turn < k + 1, own).otherwise(other) for own, other in zip(order, parts, strict=True)]
    base = light - (parts[0] * 0.30 + parts[1] * 0.59 + parts[2] * 0.11)
    return tuple(F.when(c <= 0, light * 255).otherwise(clip((x + base) * 255)) for x in parts)


def linear(c: Column) -> Column:
    """sRGB 0..1 to linear light."""
    return F.when(c >= 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92)


def gamma(c: Column) -> Column:
    """Linear light to sRGB 0..1; below zero stays below zero."""
    return F.when(c >= 0.0031308, F.pow(c, F.lit(1 / 2.4)) * 1.055 - 0.055).otherwise(c * 12.92)


def linear_of_byte(c: Column) -> Column:
    """sRGB 0..255, cut to a whole number, to linear light."""
    return linear(c.cast("int") / 255.0)


def byte_of_linear(c: Column) -> Column:
    """Linear light, pinned to 0..1 and cut to 4096 steps, to whole sRGB 0..255."""
    # fixed value: just under 0.055, so that light of 1 gives 255
    v = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 4096) / 4096.0
    return F.when(v <= 0.0031308, F.floor(v * 12.92 * 255 + 0.5)).otherwise(F.floor((F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.05499999999999989) * 255)).cast("int")


def to_xyz(r, g, b) -> Triple:
    return affine("xyz_of_linear", *(linear(c / 255) for c in _cols(r, g, b)))


def from_xyz(x, y, z) -> Triple:
    return tuple(clip(gamma(c) * 255) for c in affine("linear_of_xyz", x, y, z))


def to_lms(x, y, z) -> Triple:
    return affine("lms", x, y, z)


def from_lms(a, b, c) -> Triple:
    """As published: the sign of the third term makes x differ from the exact inverse."""
    return affine("from_lms", a, b, c)


def to_xyb(x, y, z) -> Triple:
    a, b, c = affine("lms", x, y, z)
    return a - b, a + b, c


def from_xyb(x, y, b) -> Triple:
    x, y, b = _cols(x, y, b)
    return affine("from_lms", (x + y) / 2, (y - x) / 2, b)


def to_yjk(r, g, b) -> Triple:
    """Asymmetric, as published: from_yjk takes 127.5 from the chroma, which this does not add."""
    r, g, b = (c.cast("double") for c in _cols(r, g, b))
    y = b / 2 + r / 4 + g / 8
    return y, r - y, g - y


def from_yjk(y, j, k) -> Triple:
    y, j, k = _cols(y, j, k)
    j, k = j - 127.5, k - 127.5
    return y + j, y + k, y * 1.25 - j / 2 - k / 4


def to_oklab(r, g, b) -> Triple:
    """From linear light."""
    return affine("oklab_of_roots", *(F.pow(c, F.lit(1 / 3)) for c in affine("oklab_lms", r, g, b)))


def from_oklab(light, a, b) -> Triple:
    """To linear light, 5 decimal places."""
    return tuple(F.round(c, 5) for c in affine("linear_of_lms", *(c * c * c for c in affine("roots_of_oklab", light, a, b))))


def srgb_to_oklab(r, g, b) -> Triple:
    """From sRGB bytes."""
    return to_oklab(*(linear_of_byte(c) for c in _cols(r, g, b)))


def oklab_to_srgb(light, a, b) -> Triple:
    """To whole sRGB bytes, by the 4096 steps."""
    return tuple(byte_of_linear(c) for c in from_oklab(light, a, b))


def srgb_to_oklab_bytes(r, g, b) -> Triple:
    light, x, y = srgb_to_oklab(r, g, b)
    return clip(light * 255.0), clip((x + 1) * 127.5), clip((y + 1) * 127.5)


def oklab_bytes_to_srgb(light, a, b) -> Triple:
    light, a, b = _cols(light, a, b)
    return oklab_to_srgb(light / 255.0, a / 127.5 - 1, b / 127.5 - 1)


def oklab_to_rgb(light, a, b) -> Triple:
    """To clipped bytes by the exact curve."""
    return tuple(clip(gamma(c) * 255.0) for c in from_oklab(light, a, b))


def to_oklch(light, a, b) -> Triple:
    """Hue in radians; 0 where chroma is next to none."""
    light, a, b = _cols(light, a, b)
    chroma = F.sqrt(a * a + b * b)
    return light, chroma, F.when(chroma > 0.000004, F.atan2(b, a)).otherwise(0.0)


def from_oklch(light, c, h) -> Triple:
    """Hue in turns (asymmetric, as published); below zero it is missing."""
    light, c, h = _cols(light, c, h)
    turn = h * 6.283185307179586
    return light, F.when(h < 0, 0.0).otherwise(c * F.cos(turn)), F.when(h < 0, 0.0).otherwise(c * F.sin(turn))


def to_kla(r, g, b) -> Triple:
    return affine("kla", r, g, b)


def from_kla(x, y, z) -> Triple:
    return tuple(clip(c) for c in affine("from_kla", x, y, z))


def pack_argb(a, r, g, b) -> Column:
    """One number in a long: alpha, red, green, blue from the high byte down."""
    a, r, g, b = (c.cast("long") for c in _cols(a, r, g, b))
    return F.shiftleft(a, 24) + F.shiftleft(r, 16) + F.shiftleft(g, 8) + b


def unpack_argb(c) -> tuple[Column, Column, Column, Column]:
    c = _cols(c)[0].cast("long")
    return tuple(F.shiftright(c, s).bitwiseAND(F.lit(255)).cast("int") for s in (24, 16, 8, 0))


def scaled(a, b, c) -> Triple:
    """0..1 to whole 0..255."""
    return tuple(clip(x * 255) for x in _cols(a, b, c))


def brightness(r, g, b) -> Column:
    return affine("ycbcr", r, g, b)[0].cast("int")


def invert_brightness(r, g, b, space: str = "yiq") -> Triple:
    """255 minus the luma of yiq, ycocg or hsp, same chroma."""
    if space == "hsp":
        h, s, p = to_hsp(r, g, b)
        # bound by a lambda, as the inverse uses each of them many times
        held = F.array(F.struct(h.alias("h"), s.alias("s"), (F.lit(255) - p).alias("p")))
        back = F.transform(held, lambda x: F.struct(*(clip(c).alias(n) for c, n in zip(from_hsp(x["h"], x["s"], x["p"]), "rgb", strict=True))))[0]
        return tuple(back[n] for n in "rgb")
    to, back = {"yiq": (to_yiq, from_yiq), "ycocg": (to_ycocg, from_ycocg)}[space]
    y, c1, c2 = to(r, g, b)
    return tuple(clip(c) for c in back(F.lit(255.0) - y, c1, c2))


#: Fixed value: the sum of the weights 1, 1/2 ... 1/8 that the pickers divide by.
HARMONIC = 2.59285714285714


def pick_colours(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, dark_r .. light_b, dark_y .. light_v): the dark and the light colour of each block of at least 8 colours r, g, b in the order of
    brightness, then of `order`: whole averages of the first and last 4, and harmonic means of the first and last 8 in YUV.
    A block is a few pixels, gathered in one row."""
    ranked = df.withColumns({"bright": brightness("r", "g", "b"), **dict(zip("yuv", to_yuv("r", "g", "b"), strict=True))})
    blocks = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bright", *order, *"rgbyuv"))).alias("p")).where("size(p) >= 8")
    out = []
    for name, p in (("dark", "p"), ("light", "reverse(p)")):
        out += [F.expr(f"aggregate(slice({p}, 1, 4), 0L, (a, x) -> a + x.{c}) div 4").alias(f"{name}_{c}") for c in "rgb"]
        weighted = "aggregate(zip_with(slice({p}, 1, 8), sequence(1, 8), (x, i) -> x.{c} / i), 0D, (a, x) -> a + x) / {h}"
        out += [F.expr(weighted.format(p=p, c=c, h=f"{HARMONIC}D")).alias(f"{name}_{c}") for c in "yuv"]
    return blocks.select(*keys, *out)
