"""One query per operator of the survey, and DuckDB SQL that states the same from its own terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplegrid.functions import color, scalar
from samplegrid.operators import gather, packed, symbols, window
from samplegrid.plans import fixtures as fx
from samplegrid.plans.registry import ORACLE, QUERIES, add
from samplegrid.plans.registry import clip_sql as _clip
from samplegrid.plans.registry import color_query as _color

# colour: exact whole numbers, or doubles rounded to 6 places


_Y, _U, _V = "16 + (0.257e0*r + 0.504e0*g + 0.098e0*b)", "128 + (-0.148e0*r - 0.291e0*g + 0.439e0*b)", "128 + (0.439e0*r - 0.368e0*g - 0.071e0*b)"
_YIQ = "(0.3e0*r + 0.59e0*g + 0.11e0*b)"
_X, _XY, _Z = (
    "(" + " + ".join(f"{w}e0 * (case when {c}/255.0e0 >= 0.04045e0 then pow(({c}/255.0e0 + 0.055e0)/1.055e0, 2.4e0) else {c}/255.0e0/12.92e0 end)" for w, c in zip(row, "rgb", strict=True)) + ")"
    for row in ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.072175), (0.0193339, 0.119192, 0.9503041))
)
_color("c1_ycbcr24", color.to_ycbcr24, (_clip(_Y), _clip(_U), _clip(_V)), None)
_color("c2_ycocg24", color.to_ycocg24, (_clip("b + ((r-b)>>1) + ((g - b - ((r-b)>>1))>>1)"), _clip("((r-b)>>1) + 127"), _clip("((g - b - ((r-b)>>1))>>1) + 127")), None)
_color("c3_ycocg", color.to_ycocg, ("(r + 2.0e0*g + b)/4", "(r-b)/2.0e0 + 127", "(g - (r+b)/2.0e0)/2 + 127"))
_color("c4_yiq", color.to_yiq, (_YIQ, f"(-0.27e0*(b-{_YIQ}) + 0.74e0*(r-{_YIQ}))*0.8393e0 + 127", f"(0.41e0*(b-{_YIQ}) + 0.48e0*(r-{_YIQ}))*0.9567e0 + 127"), 9)
_color("c5_lpq", color.to_lpq, ("(r+g+b)/3.0e0", "(r+g)/2.0e0 - b", "r - g"))
_color("c5_lpqg", lambda *c: color.affine("lpqg", *c), ("0.25e0*r + 0.5e0*g + 0.25e0*b", "0.5e0*r + 0.5e0*g - b", "r - g"))
_color("c6_yuv", color.to_yuv, (_Y, _U, _V))
_color("c6_yuv888", color.to_yuv888, ("16 + ((66*r + 129*g + 25*b + 128)>>8)", "128 + ((-38*r - 74*g + 112*b + 128)>>8)", "128 + ((112*r - 94*g - 18*b + 128)>>8)"), None)
_color(
    "c6_yuv888_inverse", color.from_yuv888,
    tuple(_clip(s) for s in ("(298*(r-16) + 409*(b-128) + 128)>>8", "(298*(r-16) - 100*(g-128) - 208*(b-128) + 128)>>8", "(298*(r-16) + 516*(g-128) + 128)>>8")), None,
)
_LUMA = "1.164e0*(r - 16)"
_color(
    "c7_rgb565", lambda *c: (color.yuv_to_rgb565(*c), *(F.round(x * 1000) for x in color.rgb565_to_yuv(F.col("r") * 256 + F.col("b") - 32768))),
    (
        f"case when r > 220 then -1 else ((({_clip(f'{_LUMA} + 1.596e0*(b - 127.5e0)')}::int >> 3) * 2048 + ({_clip(f'{_LUMA} - 0.392e0*(g - 127.5e0) - 0.813e0*(b - 127.5e0)')}::int >> 2) * 32"
        f" + ({_clip(f'{_LUMA} + 2.017e0*(g - 127.5e0)')}::int >> 3)) + 32768) % 65536 - 32768 end",
        *(
            f"round(1000e0*({terms}))".replace("R", "((w >> 8) & 248)").replace("G", "((w >> 3) & 252)").replace("B", "((w << 3) & 248)").replace("w", "((r*256 + b + 32768) % 65536)")
            for terms in ("0.257e0*R + 0.504e0*G + 0.098e0*B + 16", "0.439e0*B - 0.148e0*R - 0.291e0*G + 127.5e0", "0.439e0*R - 0.368e0*G - 0.071e0*B + 127.5e0")
        ),
    ), None,
)
_color(
    "c7_rgb565_inverse", lambda *c: tuple(F.round(x * 1000) for x in color.rgb565_to_yuv(F.col("r") * 256 + F.col("b") - 32768)),
    tuple(
        f"round(1000e0*({terms}))".replace("R", "((w >> 8) & 248)").replace("G", "((w >> 3) & 252)").replace("B", "((w << 3) & 248)").replace("w", "((r*256 + b + 32768) % 65536)")
        for terms in ("0.257e0*R + 0.504e0*G + 0.098e0*B + 16", "0.439e0*B - 0.148e0*R - 0.291e0*G + 127.5e0", "0.439e0*R - 0.368e0*G - 0.071e0*B + 127.5e0")
    ), None,
)
_color("c8_exp", color.to_exp, tuple(_clip(s) for s in ("0.0638407e0*b + 0.291612e0*g + 0.144547e0*r + 64", "0.435098e0*b - 0.270198e0*g - 0.1649e0*r + 128", "-0.0527391e0*b - 0.382359e0*g + 0.435098e0*r + 128")), None)
_color("c11_xyz", color.to_xyz, (_X, _XY, _Z))
_LMS = (f"(0.210576e0*{_X} + 0.855098e0*{_XY} - 0.0396983e0*{_Z})", f"(-0.417076e0*{_X} + 1.17726e0*{_XY} + 0.0786283e0*{_Z})", f"(0.516835e0*{_Z})")
_color("c12_lms", lambda *c: color.to_lms(*color.to_xyz(*c)), _LMS)
_color("c12_xyb", lambda *c: color.to_xyb(*color.to_xyz(*c)), (f"{_LMS[0]} - {_LMS[1]}", f"{_LMS[0]} + {_LMS[1]}", _LMS[2]))
_color("c13_yjk", color.to_yjk, ("b/2.0e0 + r/4.0e0 + g/8.0e0", "r - (b/2.0e0 + r/4.0e0 + g/8.0e0)", "g - (b/2.0e0 + r/4.0e0 + g/8.0e0)"))
_ROOT = [
    "pow(" + " + ".join(f"{w}::float::double*{c}/255" for w, c in zip(row, "rgb", strict=True)) + ", 1/3.0e0)"
    for row in ((0.412165612, 0.536275208, 0.0514575653), (0.211859107, 0.6807189584, 0.107406579), (0.0883097947, 0.2818474174, 0.6302613616))
]
_OKLAB = tuple(
    "(" + " + ".join(f"({w}::float::double)*{c}" for w, c in zip(row, _ROOT, strict=True)) + ")"
    for row in ((0.2104542553, 0.793617785, -0.0040720468), (1.9779984951, -2.428592205, 0.4505937099), (0.0259040371, 0.7827717662, -0.808675766))
)
_oklab = lambda *c: color.to_oklab(*(F.col(x) / 255 for x in c))
_color("c14_oklab", _oklab, _OKLAB)
_chroma = f"sqrt({_OKLAB[1]}*{_OKLAB[1]} + {_OKLAB[2]}*{_OKLAB[2]})"
# the hue where it means something: next to no chroma it is noise, and half a turn may have either sign
_color(
    "c15_oklch",
    lambda *c: (lambda o: (F.round(o[0], 4), F.round(o[1], 4), F.when(o[1] > 0.001, F.round(F.abs(o[2]), 4)).otherwise(0.0)))(color.to_oklch(*_oklab(*c))),
    (f"round({_OKLAB[0]}, 4)", f"round({_chroma}, 4)", f"case when {_chroma} > 0.001e0 then round(abs(atan2({_OKLAB[2]}, {_OKLAB[1]})), 4) else 0.0 end"),
)
# the hue by its cosine and sine, as the angle wraps
_color(
    "c15_oklch_hue", lambda *c: tuple(F.round(f(color.to_oklch(*_oklab(*c))[2]), 4) for f in (F.cos, F.sin)),
    tuple(f"round(case when {_chroma} > 0.000004e0 then {f}(atan2({_OKLAB[2]}, {_OKLAB[1]})) else {none} end, 4)" for f, none in (("cos", "1e0"), ("sin", "0e0"))),
)
_color("c16_linear", lambda *c: tuple(color.linear(F.col(x) / 255) for x in c), tuple(f"case when {x}/255.0e0 >= 0.04045e0 then pow(({x}/255.0e0 + 0.055e0)/1.055e0, 2.4e0) else {x}/255.0e0/12.92e0 end" for x in "rgb"))
_color("c17_kla", color.to_kla, ("0.54933e0*r + 0.60238e0*g + 0.57912e0*b + 64", "0.80429e0*r - 0.19322e0*g - 0.56194e0*b + 128", "0.22661e0*r - 0.77447e0*g - 0.59063e0*b + 128"))
_color("c18_clip", lambda *c: tuple(color.clip(F.col(x) * 2 - 100.5) for x in c), tuple(_clip(f"{x}*2 - 100.5e0") for x in "rgb"), None)

add(
    "src4_pack_argb",
    lambda s, d: fx.rgb_lines(s, d).select("k1", "k2", color.pack_argb(F.lit(255), "r", "g", "b").alias("argb")).select("k1", "k2", "argb", *(c.alias(n) for c, n in zip(color.unpack_argb("argb"), ("alpha", "red", "green", "blue"), strict=True))),
    f"with {fx.RGB_LINES} select k1, k2, 255::bigint * 16777216 + r * 65536 + g * 256 + b argb, 255 alpha, r red, g green, b blue from c",
)

# scalars and keys

add(
    "e1_zigzag",
    lambda s, d: fx.rgb_lines(s, d).select("k1", "k2", scalar.zigzag(F.col("r") - F.col("g")).alias("z")).select("k1", "k2", "z", scalar.unzigzag("z").alias("back")),
    f"with {fx.RGB_LINES} select k1, k2, case when r >= g then 2*(r-g) else 2*(g-r) - 1 end z, (r-g)::bigint back from c",
)
add(
    "e2_pin",
    lambda s, d: fx.rgb_lines(s, d).select("k1", "k2", scalar.pin("r", 16, 240).alias("p"), scalar.next_pow2("g").alias("n")),
    f"with {fx.RGB_LINES} select k1, k2, least(greatest(r, 16), 240) p, case when g < 2 then 1 else pow(2, ceil(log2(g)))::bigint end n from c",
)
_N = "length(bin(r + 1))"
add(
    "e3_code_lengths",
    lambda s, d: fx.rgb_lines(s, d).select("k1", "k2", *(scalar.code_len(c, F.col("r") + 1).cast("long").alias(c) for c in scalar.CODES)),
    f"""with {fx.RGB_LINES}, n as (select *, {_N}::bigint n, (r + 1)::bigint v from c)
        select k1, k2, 2*n - 1 elias_gamma, n - 1 + 2*length(bin(n)) - 1 elias_delta, 9*greatest(ceil(n/8), 1)::bigint chunked_bytes, 2*n - 1 unary_length, v//8 + 1 + 3 golomb,
               2*length(bin((v>>8) + 1)) - 1 + 8 exp_golomb, case when v < 127 then 8 when v < 16511 then 16 else 24 end::bigint byte_block,
               case when v = 0 then 1 when v <= 32 then 8 when v <= 8223 then 16 else 24 end::bigint short_block, 8*ceil((n + 1)/7)::bigint leb128 from n""",
)
add(
    "e6_catmull_rom",
    lambda s, d: fx.rgb_lines(s, d).select("k1", "k2", F.round(scalar.catmull_rom(F.col("k2") / 8, "r", "g", "b", "r"), 6).alias("v")),
    f"with {fx.RGB_LINES}, t as (select *, k2/8.0e0 x from c) select k1, k2, round(g + 0.5e0*x*(b - r + x*(2*r - 5*g + 4*b - r + x*(3*(g - b) + r - r))), 6) v from t",
)
_bits = lambda c, gap, at, n=16: " + ".join(f"((({c} >> {k}) & 1)::bigint << {k * gap + at})" for k in range(n))
add(
    "o1_morton2",
    lambda s, d: fx.rgb_lines(s, d).select("k1", "k2", scalar.morton2("r", "g").alias("m")).select("k1", "k2", "m", scalar.unmorton2("m")[0].alias("x"), scalar.unmorton2("m")[1].alias("y")),
    f"with {fx.RGB_LINES} select k1, k2, {_bits('r', 2, 0)} + {_bits('g', 2, 1)} m, r::bigint x, g::bigint y from c",
)
add("o1_morton3", lambda s, d: fx.rgb_lines(s, d).select("k1", "k2", scalar.morton3("r", "g", "b").alias("m")), f"with {fx.RGB_LINES} select k1, k2, {_bits('r', 3, 0, 10)} + {_bits('g', 3, 1, 10)} + {_bits('b', 3, 2, 10)} m from c")


def _hilbert_sql() -> str:
    """The same walk, one common table expression a bit."""
    steps, last = [], "h0"
    for k in range(8):
        s = 128 >> k
        steps.append(f"g{k} as (select k1, k2, x, y, d, ((x & {s}) > 0)::int rx, ((y & {s}) > 0)::int ry from {last})")
        steps.append(f"h{k + 1} as (select k1, k2, case when ry = 1 then x when rx = 1 then 255 - y else y end x, case when ry = 1 then y when rx = 1 then 255 - x else x end y, d + {s * s}::bigint * xor(3*rx, ry) d from g{k})")
        last = f"h{k + 1}"
    return f"with {fx.RGB_LINES}, h0 as (select k1, k2, r x, g y, 0::bigint d from c), {', '.join(steps)} select k1, k2, d from {last}"


add("o2_hilbert", lambda s, d: fx.rgb_lines(s, d).select("k1", "k2", scalar.hilbert(256, "r", "g").alias("d")), _hilbert_sql())

# windows over rasters


def _px(query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: query(fx.emb_raster(s, d))


_EMB = f"with {fx.EMB_RASTER}"
_WX, _WY = "partition by image_id, y order by x", "partition by image_id, x order by y"


def _box_sql(source: str, axis: str, r: int, value: str = "v") -> str:
    """Mean over clamped positions, by a self-join on the line."""
    other = "y" if axis == "x" else "x"
    return f"""(select a.image_id, a.y, a.x, (sum(b.{value}) // {2 * r + 1})::int v from (select *, max({axis}) over (partition by image_id, {other}) m, unnest(range(-{r}, {r} + 1)) d from {source}) a
        join {source} b on a.image_id = b.image_id and a.{other} = b.{other} and b.{axis} = least(greatest(a.{axis} + a.d, 0), a.m) group by a.image_id, a.y, a.x)"""


add("w1_box_blur", _px(lambda p: window.box_blur(p, 3)), f"{_EMB}, q as {_box_sql('px', 'x', 3)}, z as {_box_sql('q', 'y', 3)} select image_id, y, x, v from z")


def _morph_sql(op: str) -> str:
    f = {"dilate": "max", "erode": "min"}[op]
    frame = "rows between 2 preceding and 3 following"
    return f"{_EMB}, c as (select image_id, y, x, {f}(v) over ({_WY} {frame}) v from px) select image_id, y, x, {f}(v) over ({_WX} {frame}) v from c"


for _op in ("dilate", "erode"):
    add(f"w2_{_op}", _px(lambda p, op=_op: window.morph(p, op, 3)), _morph_sql(_op))
_F2 = "rows between 2 preceding and 3 following"
add(
    "w2_open",
    _px(lambda p: window.morph(p, "open", 3)),
    f"""{_EMB}, a as (select image_id, y, x, min(v) over ({_WY} {_F2}) v from px), b as (select image_id, y, x, min(v) over ({_WX} {_F2}) v from a),
        c as (select image_id, y, x, max(v) over ({_WY} {_F2}) v from b) select image_id, y, x, max(v) over ({_WX} {_F2}) v from c""",
)
_LOCO = """a as (select px.*, w.v w, n.v n, c.v c from px left join px w on w.image_id = px.image_id and w.y = px.y and w.x = px.x - 1
        left join px n on n.image_id = px.image_id and n.x = px.x and n.y = px.y - 1 left join px c on c.image_id = px.image_id and c.x = px.x - 1 and c.y = px.y - 1),
        r as (select *, v - least(greatest(case when c >= greatest(w, n) then least(w, n) when c <= least(w, n) then greatest(w, n) else w + n - c end, 0), 255) d from a)"""
add("w3_loco", _px(window.loco_residual), f"{_EMB}, {_LOCO} select image_id, y, x, (case when c is null then v when d >= 0 then d else -d - 0.5 end)::double residual from r")
add(
    "a11_zero_residuals",
    _px(lambda p: window.zero_residuals(p).withColumn("average", F.round("average", 6))),
    f"{_EMB}, {_LOCO} select image_id, count(*) filter (d = 0) zeros, round(avg(d), 6) average from r where c is not null group by image_id",
)
add(
    "w7_haar",
    _px(window.haar_gradients),
    f"""{_EMB}, p as (select a.*, b.v w from px a join px b on a.image_id = b.image_id and a.y = b.y and b.x = a.x + 1 where a.x % 2 = 0)
        select image_id, y, (x // 2)::int x, (v + w) * 8 v from p union all select image_id, y, 32 + (x // 2)::int, (255 + v - w) * 8 from p""",
)
add(
    "w8_axis_distance",
    _px(lambda p: window.axis_distance(p, "x", F.col("v") > 127)),
    f"""{_EMB}, i as (select *, v > 127 i from px), c as (select *, i <> lag(i) over ({_WX}) s from i), k as (select image_id, y, x from c where s),
        d as (select i.image_id, i.y, i.x, any_value(i.i) i, min(case when k.x <= i.x then i.x - k.x + 1 else k.x - i.x end) d from i left join k on k.image_id = i.image_id and k.y = i.y group by all)
        select image_id, y, x, ((case when i then -1 else 1 end) * coalesce(d, 64 + x + 1))::bigint distance from d""",
)
add(
    "w9_epx2",
    _px(window.epx2),
    f"""{_EMB}, n as (select px.*, case when x = 0 or x = 63 then v else lag(v) over ({_WX}) end l, case when x = 0 or x = 63 then v else lead(v) over ({_WX}) end r,
            lag(v) over ({_WY}) t0, lead(v) over ({_WY}) b0 from px), q as (select *, case when t0 is null or b0 is null then v else t0 end t, case when t0 is null or b0 is null then v else b0 end b from n)
        select image_id, 2*y y, 2*x x, case when l = t and l <> b and t <> r then t else v end v from q
        union all select image_id, 2*y, 2*x + 1, case when t = r and t <> l and r <> b then r else v end from q
        union all select image_id, 2*y + 1, 2*x, case when b = l and b <> r and l <> t then l else v end from q
        union all select image_id, 2*y + 1, 2*x + 1, case when r = b and r <> t and b <> l then b else v end from q""",
)
add(
    "f2_edges",
    _px(lambda p: window.edges(p, F.col("v") > 127)),
    f"""{_EMB} select a.image_id, a.y, a.x, a.v > 127 and coalesce(bool_or(b.v <= 127), false) edge from px a
        left join px b on a.image_id = b.image_id and abs(a.x - b.x) + abs(a.y - b.y) = 1 and b.y between a.y - 1 and a.y + 1 group by a.image_id, a.y, a.x, a.v""",
)


def _mean_sql(source: str, axis: str, r: int, value: str) -> str:
    """Floored mean of the 2r samples from p - r on, positions clamped, by a self-join on the line; v is carried."""
    other = "y" if axis == "x" else "x"
    return f"""(select a.image_id, a.y, a.x, any_value(a.v) v, (sum(b.{value}) // {2 * r})::bigint m from (select *, max({axis}) over (partition by image_id, {other}) z, unnest(range(-{r}, {r})) d from {source}) a
        join {source} b on a.image_id = b.image_id and a.{other} = b.{other} and b.{axis} = least(greatest(a.{axis} + a.d, 0), a.z) group by a.image_id, a.y, a.x)"""


for _scale, _exposure, _invert in ((3, 0, False), (5, 8, True)):
    add(
        "f3_unsharp_threshold" if _scale == 3 else "f3_unsharp_inverted",
        _px(lambda p, a=(_scale, _exposure, _invert): window.unsharp_threshold(p, *a)),
        f"""{_EMB}, q as {_mean_sql('px', 'y', 1 << _scale, 'v')}, z as {_mean_sql('q', 'x', 1 << _scale, 'm')}
            select image_id, y, x, case when (v - {_exposure} < least(greatest(m, 16), 240)) <> {_invert} then 0 else 255 end v from z""",
    )
add(
    "a7_block_stats",
    _px(window.block_stats),
    f"""{_EMB}, m as (select image_id, max(x) w, max(y) h from px group by image_id), o as (select image_id, y, x, w, h, unnest(range(-2, 3)) dy from px join m using (image_id)
            where x % 4 = 0 and y % 4 = 0 and x // 4 < (w + 1) // 4 and y // 4 < (h + 1) // 4), t as (select *, unnest(range(-2, 3)) dx from o)
        select t.image_id, (t.y // 4)::int y, (t.x // 4)::int x, min(b.v) low, max(b.v) high, round(avg(b.v), 6) mean from t join px b on b.image_id = t.image_id
            and b.x = least(greatest(t.x + dx, 0), w) and b.y = least(greatest(t.y + dy, 0), h) group by t.image_id, t.y, t.x""",
)
add(
    "a10_normalise",
    _px(lambda p: window.normalise(p).withColumn("v", F.round("v", 6))),
    f"{_EMB}, m as (select image_id, min(v) a, max(v) b from px group by image_id) select image_id, y, x, round(case when b > a then (v - a) * 255.0e0 / (b - a) else 0 end, 6) v from px join m using (image_id)",
)


def _lift_sql(steps, scale: float) -> str:
    out, last = [], "px"
    for k, (parity, a) in enumerate(steps):
        sides = f"coalesce(lag(v) over ({_WX}), lead(v) over ({_WX}), 0) + coalesce(lead(v) over ({_WX}), lag(v) over ({_WX}), 0)"
        out.append(f"l{k} as (select image_id, y, x, case when x % 2 = {parity} then v + ({a}e0) * ({sides}) else v end::double v from {last})")
        last = f"l{k}"
    return f"{_EMB}, {', '.join(out)} select image_id, y, (case when x % 2 = 0 then x // 2 else 32 + x // 2 end)::int x, round(case when x % 2 = 0 then v / {scale}e0 else v * {scale}e0 end, 5) v from {last}"


for _name, _kind in (("cdf97", window.CDF97), ("cdf53", window.CDF53)):
    add(f"w4_{_name}", _px(lambda p, k=_kind: window.lifting(p, "x", *k).withColumn("v", F.round("v", 5))), _lift_sql(*_kind))
add(
    "w4_cdf97_inverse",
    _px(lambda p: window.inverse_lifting(window.lifting(p, "x", *window.CDF97), "x", *window.CDF97).withColumn("v", F.round("v").cast("int"))),
    f"{_EMB} select image_id, y, x, v from px",
)

# gathers

#: By [x][y]: symmetric, asymmetric, and of two columns and four rows.
_KERNELS = {
    "j1_convolve": [[0.0625, 0.125, 0.0625], [0.125, 0.25, 0.125], [0.0625, 0.125, 0.0625]],
    "j1_convolve_asymmetric": [[0.5, -1.0, 0.25], [2.0, 3.0, -0.5], [0.125, -4.0, 1.0]],
    "j1_convolve_even": [[0.5, 1.0, -1.0, 0.25], [2.0, -0.5, 0.125, 3.0]],
}
for _name, _kernel in _KERNELS.items():
    _offsets = lambda n: [i - n // 2 if i < n // 2 else i - n // 2 + 1 - n % 2 for i in range(n)]
    _taps = ", ".join(f"({a}, {b}, {w}::double)" for a, row in zip(_offsets(len(_kernel)), _kernel, strict=True) for b, w in zip(_offsets(len(row)), row, strict=True))
    add(
        _name,
        _px(lambda p, k=_kernel: gather.convolve(p, k).withColumn("v", F.round("v", 6) + 0.0)),
        f"""{_EMB}, k(dx, dy, c) as (values {_taps}), m as (select image_id, max(x) w, max(y) h from px group by image_id),
            o as (select px.image_id, y, x, abs(y - dy) ty, abs(x - dx) tx, w, h, c from px join m using (image_id), k),
            g as (select image_id, y, x, c, case when ty > h then 2*h - ty else ty end ty, case when tx > w then 2*w - tx else tx end tx from o)
            select g.image_id, g.y, g.x, round(sum(c * b.v), 6) + 0.0 v from g join px b on b.image_id = g.image_id and b.y = ty and b.x = tx group by g.image_id, g.y, g.x""",
    )
add(
    "j6_dct2",
    _px(lambda p: gather.dct2(p).withColumn("c", F.round("c", 4) + 0.0)),
    f"""{_EMB}, n as (select image_id, y // 8 byy, x // 8 bxx from px group by all having count(*) = 64), f as (select range k from range(8)),
        s as (select px.image_id, (y // 8)::int by_, (x // 8)::int bx, y % 8 yy, x % 8 xx, v - 128.0e0 s from px join n on n.image_id = px.image_id and byy = y // 8 and bxx = x // 8)
        select image_id, by_ "by", bx, u.k::int u, w.k::int v, round(sum(s * (case when u.k = 0 then sqrt(1/8.0e0) else 0.5e0 end) * (case when w.k = 0 then sqrt(1/8.0e0) else 0.5e0 end)
            * cos((2*yy + 1) * u.k * pi() / 16) * cos((2*xx + 1) * w.k * pi() / 16)), 4) + 0.0 c from s, f u, f w group by image_id, by_, bx, u.k, w.k""",
)
add("src6_crop", _px(lambda p: gather.crop(p, 8, 4, 32, 16)), f"{_EMB} select image_id, y - 4 y, x - 8 x, v from px where x between 8 and 39 and y between 4 and 19")
add(
    "src5_pad_pow2",
    _px(gather.pad_pow2),
    f"""{_EMB}, m as (select image_id, max(y) my, pow(2, ceil(log2(max(y) + 1)))::int h from px group by image_id), g as (select image_id, my, unnest(range(h)) y from m), q as (select *, unnest(range(64)) x from g)
        select q.image_id, q.y::int y, q.x::int x, v from q join px on px.image_id = q.image_id and px.x = q.x and px.y = least(q.y, my)""",
)
add(
    "r4_resize_linear",
    _px(lambda p: gather.resize_linear(p).withColumn("v", F.round("v", 6))),
    f"""{_EMB}, m as (select image_id, max(y) h from px group by image_id), o as (select px.image_id, y, x, h, unnest([0, 1]) ky from px join m using (image_id)), q as (select *, unnest([0, 1]) kx from o)
        select q.image_id, 2*q.y + ky y, 2*q.x + kx x, round((a.v*(2 - kx)*(2 - ky) + b.v*kx*(2 - ky) + c.v*(2 - kx)*ky + d.v*kx*ky) / 4.0e0, 6) v from q
        join px a on a.image_id = q.image_id and a.y = q.y and a.x = q.x join px b on b.image_id = q.image_id and b.y = q.y and b.x = least(q.x + 1, 63)
        join px c on c.image_id = q.image_id and c.y = least(q.y + 1, h) and c.x = q.x join px d on d.image_id = q.image_id and d.y = least(q.y + 1, h) and d.x = least(q.x + 1, 63)""",
)
for _rule, _inside in (("odd", "odd"), ("winding", "winding <> 0")):
    add(
        f"j8_polygon_distance_{_rule}" if _rule == "winding" else "j8_polygon_distance",
        lambda s, d, r=_rule: gather.polygon_distance(fx.points(s, d), fx.segments(s), r).withColumn("distance", F.round("distance", 6)),
        f"""with {fx.POINTS}, {fx.SEGMENTS_SQL}, m as (select id, shape_id, x, y, ax, ay, bx, "by" bz, least(greatest(((x-ax)*(bx-ax) + (y-ay)*(bz-ay)) / ((bx-ax)*(bx-ax) + (bz-ay)*(bz-ay)), 0), 1) t,
                (bx-ax)*(y-ay) - (bz-ay)*(x-ax) side from p, s),
            c as (select *, case when ay <= y and bz > y and side > 0 then 1 when ay > y and bz <= y and side < 0 then -1 else 0 end turn from m),
            o as (select id, shape_id, sqrt(min(pow(x-ax-t*(bx-ax), 2) + pow(y-ay-t*(bz-ay), 2))) d, sum(abs(turn)) % 2 = 1 odd, sum(turn)::bigint winding from c group by id, shape_id)
            select id, shape_id, round(case when {_inside} then -d else d end, 6) distance, odd, winding from o""",
    )

_NEAR = f"""with {fx.POINTS}, {fx.SEGMENTS_SQL}, m as (select id, shape_id, x, y, ax, ay, bx, "by" bz, least(greatest(((x-ax)*(bx-ax) + (y-ay)*(bz-ay)) / ((bx-ax)*(bx-ax) + (bz-ay)*(bz-ay)), 0), 1) t,
        (bx-ax)*(y-ay) - (bz-ay)*(x-ax) side from p, s),
    c as (select *, case when ay <= y and bz > y and side > 0 then 1 when ay > y and bz <= y and side < 0 then -1 else 0 end turn from m),
    o as (select id, shape_id, sqrt(min(pow(x-ax-t*(bx-ax), 2) + pow(y-ay-t*(bz-ay), 2))) d, sum(abs(turn)) % 2 = 1 odd, sum(turn)::bigint winding from c group by id, shape_id)"""
add(
    "j8_polygon_distance_near",
    lambda s, d: gather.polygon_distance_near(fx.points(s, d), fx.segments(s), 4.5, "winding").withColumn("distance", F.round("distance", 6)),
    f"{_NEAR} select id, shape_id, round(case when winding <> 0 then -d else d end, 6) distance, odd, winding from o where d <= 4.5",
)

# symbols of whole documents


def _sy(query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: query(fx.doc_bytes(s, d))


def _docs(short, long_) -> Callable[[SparkSession, str], DataFrame]:
    """short() of whole documents, long_() of the rows of those that are too long for one."""
    return lambda s, d: packed.by_length(fx.doc_texts(s, d), short, long_)


_SYM = f"with {fx.DOC_BYTES}"
_WP = "partition by doc_id order by pos"
_rounded = lambda df, *names: df.withColumns({n: F.round(n, 4) for n in names})
add(
    "a1_histogram",
    _sy(lambda y: symbols.histogram(y).withColumn("share", F.round("share", 9))),
    f"{_SYM}, c as (select doc_id, s, count(*) cnt from sy group by all) select doc_id, s, cnt, round(cnt / sum(cnt) over (partition by doc_id), 9) share from c",
)
add(
    "a1_histogram_nybble",
    _sy(lambda y: symbols.histogram(y, "nybble").withColumn("share", F.round("share", 9))),
    f"{_SYM}, n as (select doc_id, unnest([s >> 4, s & 15]) s from sy), c as (select doc_id, s, count(*) cnt from n group by all) select doc_id, s, cnt, round(cnt / sum(cnt) over (partition by doc_id), 9) share from c",
)
for _k in (2, 3, 8):
    _g = " || ".join("lpad(lower(hex(s)), 2, '0')" if k == 0 else f"coalesce(lpad(lower(hex(lag(s, {k}) over ({_WP}))), 2, '0'), '00')" for k in reversed(range(_k)))
    _rot = ", ".join(f"substr(g, {2 * k + 1}) || substr(g, 1, {2 * k})" for k in range(_k))
    add(f"a2_ngrams_{_k}", _sy(lambda y, k=_k: symbols.ngrams(y, k)), f"{_SYM}, g as (select {_g} g from sy) select least({_rot}) g, count(*) cnt from g group by 1")
# merges two of the sorted weights a round
add(
    "a3_huffman_size",
    _sy(symbols.huffman_size),
    f"""with recursive {fx.DOC_BYTES}, c as (select doc_id, s, count(*) n from sy group by all), w as (select doc_id, list_sort(list(n)) w, 0::bigint bits from c group by doc_id
        union all select doc_id, list_sort(list_append(w[3:], w[1] + w[2])), (bits + w[1] + w[2])::bigint from w where len(w) > 1) select doc_id, bits from w where len(w) = 1""",
)
add(
    "a4_entropy",
    _sy(lambda y: _rounded(symbols.entropy(y), "bits")),
    f"{_SYM}, c as (select doc_id, s, count(*) c from sy group by all), t as (select doc_id, sum(c)::bigint n from c group by doc_id) select doc_id, n, round(sum(-c * log2(c / n)), 4) bits from c join t using (doc_id) group by doc_id, n",
)
_LEN = {
    "elias_gamma": "2*length(bin(s + 1)) - 1", "elias_delta": "length(bin(s + 1)) - 1 + 2*length(bin(length(bin(s + 1)))) - 1", "chunked_bytes": "9", "unary_length": "2*length(bin(s)) - 1",
    "golomb": "s // 8 + 4", "exp_golomb": "2*length(bin((s >> 8) + 1)) - 1 + 8", "byte_block": "case when s < 127 then 8 else 16 end", "short_block": "case when s = 0 then 1 when s <= 32 then 8 else 16 end",
    "leb128": "case when s < 64 then 8 else 16 end",
}
_SIZES = " union all ".join(f"select doc_id, '{n}' code, sum({e})::bigint bits from sy group by doc_id" for n, e in _LEN.items())
add("a5_code_size_report", _sy(symbols.code_size_report), f"{_SYM} {_SIZES}")
add("a5_best_code", _sy(symbols.best_code), f"{_SYM}, t as ({_SIZES}) select doc_id, code, bits from t qualify row_number() over (partition by doc_id order by bits, code) = 1")
add("a13_block_checksum", _sy(symbols.block_checksum), f"{_SYM} select doc_id, (pos // 257)::bigint block, sum(2 * s)::bigint checksum from sy group by all")
add(
    "e7_remap",
    _sy(symbols.remap),
    f"{_SYM} select doc_id, pos, dense_rank() over (partition by doc_id order by s) - 1 code from sy",
)
add(
    "e9_fold_pairs",
    _sy(symbols.fold_pairs),
    f"{_SYM}, p as (select doc_id, pos, s, lead(s) over ({_WP}) t from sy) select doc_id, (pos // 2)::int pos, ((s + t) // 2)::int mean, (t - (s + t) // 2 + 256) % 256 diff from p where pos % 2 = 0 and t is not null",
)
add(
    "o5_context_sort",
    _sy(symbols.context_sort),
    f"""{_SYM}, n as (select *, count(*) over (partition by doc_id) n, lag(s, 1) over ({_WP}) a, lag(s, 2) over ({_WP}) b, last(s) over (partition by doc_id order by pos rows between unbounded preceding and unbounded following) z from sy),
        y as (select doc_id, s y from n where pos = greatest(n - 2, 0)), q as (select n.doc_id, pos, s, coalesce(a, z) p1, case when pos >= 2 then b when pos = 1 or n = 1 then z else y end p2 from n join y using (doc_id))
        select doc_id, row_number() over (partition by doc_id order by p1, p2, pos) - 1 "out", s from q""",
)
add("w10_delta", _sy(symbols.delta), f"{_SYM}, p as (select doc_id, pos, s, coalesce(lag(s) over ({_WP}), 0) b from sy) select doc_id, pos, (s - b + 256) % 256 delta, xor(s, b) xor from p")
add("w10_delta_inverse", _sy(lambda y: symbols.undelta(symbols.delta(y))), f"{_SYM} select doc_id, pos, s from sy")
add(
    "w11_runs",
    _docs(packed.runs, symbols.runs),
    f"{_SYM}, g as (select *, pos - row_number() over (partition by doc_id, s order by pos) g from sy) select doc_id, min(pos) start, s, count(*) n from g group by doc_id, s, g having count(*) >= 4",
)


def _adaptive_sql(context: str, gain: int) -> str:
    return f"""{_SYM}, k as (select doc_id, pos, s, {context} k from sy), p as (select doc_id, count(*) over (partition by doc_id, k, s order by pos) - 1 a, count(*) over (partition by doc_id, k order by pos) - 1 b from k)
        select doc_id, round(sum(-log2((1 + {gain}.0e0*a) / (257 + {gain}*b))), 4) bits from p group by doc_id"""


_LAG1, _LAG2 = f"coalesce(lag(s) over ({_WP}), 0)", f"coalesce(lag(s, 2) over ({_WP}), 0)"
for _name, _context, _gain, _sql, *_packed in (
    ("order0", lambda: [], 2, "0"),
    ("order1", lambda: symbols.order(1), 2, _LAG1),
    ("order2", lambda: symbols.order(2), 20, f"{_LAG1} * 256 + {_LAG2}", packed.order_of(2)),
    ("order1_blocks", lambda: [*symbols.order(1), F.expr("pos div 4096")], 2, f"{_LAG1} * 65536 + pos // 4096"),
    ("position", lambda: [*symbols.order(1), F.col("pos") % 16], 2, f"{_LAG1} * 16 + pos % 16", packed.with_place(packed.order_of(1), mod=16)),
):
    _by_rows = lambda y, c=_context, g=_gain: _rounded(symbols.adaptive_bits(y, c(), g), "bits")
    _whole = _packed and (lambda t, c=_packed[0], g=_gain: _rounded(packed.adaptive_bits(t, c, g), "bits"))
    add(f"w12_adaptive_{_name}", _docs(_whole, _by_rows) if _whole else _sy(_by_rows), _adaptive_sql(_sql, _gain))
add(
    "w13_context_hits",
    _sy(symbols.context_hits),
    f"""{_SYM}, k as (select doc_id, pos, s, {_LAG1} a, {_LAG2} b from sy), g as (select doc_id, s, coalesce(lag(s) over (partition by doc_id, a, b order by pos), 0) g from k)
        select doc_id, count(*) n, sum((s = g)::int)::bigint hits from g group by doc_id""",
)


def _hits_sql(k: int, sy: str = "sy") -> str:
    past = ", ".join(f"coalesce(lag(s, {i + 1}) over ({_WP}), 0) k{i}" for i in range(k))
    keys = ", ".join(f"k{i}" for i in range(k))
    return f"""k as (select doc_id, pos, s, {past} from {sy}), g as (select doc_id, s, coalesce(lag(s) over (partition by doc_id, {keys} order by pos), 0) g from k)
        select doc_id, count(*) n, sum((s = g)::int)::bigint hits from g group by doc_id"""


for _k in (1, 3, 4, 5, 6, 7):
    _by_rows = lambda y, k=_k: symbols.context_hits(y, k)
    add(f"w13_context_hits_{_k}", _docs(lambda t, k=_k: packed.context_hits(t, k), _by_rows), f"{_SYM}, {_hits_sql(_k)}")
add(
    "w13_context_hits_bits",
    _docs(lambda t: packed.context_hits(t, 8, "bit"), lambda y: symbols.context_hits(symbols.bits(y), 8)),
    f"{_SYM}, e as (select doc_id, pos, s, unnest(range(8)) i from sy), bt as (select doc_id, pos * 8 + i pos, (s >> (7 - i)::int) & 1 s from e), {_hits_sql(8, 'bt')}",
)
add(
    "w14_cumulative",
    _sy(lambda y: symbols.cumulative(symbols.histogram(y).drop("share"))),
    f"{_SYM}, c as (select doc_id, s, count(*) cnt from sy group by all) select doc_id, s, cnt, (sum(cnt) over (partition by doc_id order by s) - cnt)::bigint low, (sum(cnt) over (partition by doc_id order by s))::bigint high from c",
)
add(
    "w15_sum_pyramid",
    _sy(symbols.sum_pyramid),
    f"{_SYM} select doc_id, pos, " + ", ".join(f"(sum(s) over ({_WP} rows between current row and {n - 1} following) % 256)::int sum{n}" for n in (2, 4, 8)) + " from sy",
)
_LENGTHS = tuple(2**k for k in range(1, 9))
add(
    "w15_sum_pyramid_256",
    _docs(lambda t: packed.sum_pyramid(t, _LENGTHS), lambda y: symbols.sum_pyramid(y, _LENGTHS)),
    f"{_SYM} select doc_id, pos, " + ", ".join(f"(sum(s) over ({_WP} rows between current row and {n - 1} following) % 256)::int sum{n}" for n in _LENGTHS) + " from sy",
)

add(
    "snk1_interleave",
    _sy(lambda y: symbols.interleave(y.selectExpr("doc_id div 3 image_id", "doc_id % 3 plane", "pos", "s"))),
    f"{_SYM} select doc_id // 3 image_id, doc_id % 3 plane, pos, s, row_number() over (partition by doc_id // 3 order by pos, doc_id % 3) - 1 seq from sy",
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box-blurred rasters and their brightest, darkest and mean values per image."""
    blurred = window.box_blur(fx.emb_raster(spark, sf_dir), 3)
    return blurred.groupBy("image_id").agg(F.count("*").alias("samples"), F.min("v").alias("low"), F.max("v").alias("high"), F.round(F.avg("v"), 6).alias("mean"))


add(
    "blur_summary",
    flagship,
    f"{_EMB}, q as {_box_sql('px', 'x', 3)}, z as {_box_sql('q', 'y', 3)} select image_id, count(*) samples, min(v) low, max(v) high, round(avg(v), 6) mean from z group by image_id",
)


from samplegrid.plans import colours, codes, grids, shapes  # noqa: E402, F401, I001 - they add their queries
