"""Colour conversions in the other direction, hue spaces, byte forms, brightness and colour pickers."""

from __future__ import annotations

from pyspark.sql import functions as F

from samplegrid.functions import color
from samplegrid.plans import fixtures as fx
from samplegrid.plans.registry import add, clip_sql, color_query

_col = F.col


def _clips(*terms: str) -> tuple[str, ...]:
    return tuple(map(clip_sql, terms))


_LUMA = "1.164e0*(r - 16)"
color_query(
    "c1_ycbcr24_inverse", color.from_ycbcr24,
    _clips(f"{_LUMA} - 0.0017e0*(g - 128) + 1.596e0*(b - 128)", f"{_LUMA} - 0.3914e0*(g - 128) - 0.813e0*(b - 128)", f"{_LUMA} + 2.0178e0*(g - 128) + 0.001e0*(b - 128)"), None,
)
_YCBCR = _clips("16 + (0.257e0*r + 0.504e0*g + 0.098e0*b)", "128 + (-0.148e0*r - 0.291e0*g + 0.439e0*b)", "128 + (0.439e0*r - 0.368e0*g - 0.071e0*b)")
color_query(
    "c1_ycbcr16", lambda *c: (color.to_ycbcr16(*c),),
    (f"(({_YCBCR[0]}::int >> 2) << 10) + (({_YCBCR[1]}::int >> 3) << 5) + ({_YCBCR[2]}::int >> 3)",), None,
)
_Y16, _CB16, _CR16 = "(((r*256 + g) >> 10 & 63) << 2)", "(((r*256 + g) >> 5 & 31) << 3)", "((g & 31) << 3)"
color_query(
    "c1_ycbcr16_inverse", lambda *c: color.from_ycbcr16(_col("r") * 256 + _col("g")),
    _clips(
        f"1.164e0*({_Y16} - 16) + 1.596e0*({_CR16} - 128)", f"1.164e0*({_Y16} - 16) - 0.392e0*({_CB16} - 128) - 0.813e0*({_CR16} - 128)",
        f"1.164e0*({_Y16} - 16) + 2.017e0*({_CB16} - 128)",
    ), None,
)
color_query(
    "c2_ycocg24_inverse", color.from_ycocg24,
    _clips("r - (b - 127) - (g - 127) + 2*(g - 127)", "r - (b - 127) + 2*(b - 127)", "r - (b - 127) - (g - 127)"), None,
)
color_query("c3_ycocg_inverse", color.from_ycocg, ("r - (b - 127) + (g - 127)", "r - (b - 127) + 2*(b - 127)", "r - (b - 127) - (g - 127)"))
_I, _Q = "((g - 127)*1.1914e0)", "((b - 127)*1.0452e0)"
color_query("c4_yiq_inverse", color.from_yiq, (f"r + 0.9469e0*{_I} + 0.6236e0*{_Q}", f"r - 0.2748e0*{_I} - 0.6357e0*{_Q}", f"r - 1.1e0*{_I} + 1.7e0*{_Q}"), 9)
_B = "(r - g*2/3.0e0)"
color_query("c5_lpq_inverse", color.from_lpq, (f"(3*r - {_B} + b)/2", f"(3*r - {_B} + b)/2 - b", _B))
color_query(
    "c5_lpqg_inverse", lambda *c: color.affine("from_lpqg", *c), ("r + 0.25e0*g + 0.625e0*b", "r + 0.25e0*g - 0.375e0*b", "r - 0.75e0*g + 0.125e0*b")
)
color_query("c6_yuv_inverse", color.from_yuv, (f"{_LUMA} + 1.596e0*(b - 128)", f"{_LUMA} - 0.392e0*(g - 128) - 0.813e0*(b - 128)", f"{_LUMA} + 2.017e0*(g - 128)"))
color_query(
    "c8_exp_inverse", color.from_exp,
    _clips("2*(r - 64) - 0.1e0*(g - 128) + 1.596e0*(b - 128)", "2*(r - 64) - 0.392e0*(g - 128) - 0.813e0*(b - 128)", "2*(r - 64) + 2.017e0*(g - 128) + 0.1e0*(b - 128)"), None,
)

# hue spaces

_R, _G, _BB = "(r/255.0e0)", "(g/255.0e0)", "(b/255.0e0)"
_BRIGHT = f"sqrt({_R}*{_R}*0.299e0 + {_G}*{_G}*0.587e0 + {_BB}*{_BB}*0.114e0)"
_SAT = f"(case when greatest(r, g, b) = least(r, g, b) or {_BRIGHT} < 0.03e0 then 0 else 1.0e0 - least({_R}, {_G}, {_BB})/greatest({_R}, {_G}, {_BB}) end)"
_HUE = f"""(case when r >= g and r >= b then (case when b >= g then 1.0e0 - 1/6.0e0*({_BB} - {_G})/({_R} - {_G}) else 1/6.0e0*({_G} - {_BB})/({_R} - {_BB}) end)
    when g >= b then (case when r >= b then 2/6.0e0 - 1/6.0e0*({_R} - {_BB})/({_G} - {_BB}) else 2/6.0e0 + 1/6.0e0*({_BB} - {_R})/({_G} - {_R}) end)
    else (case when g >= r then 4/6.0e0 - 1/6.0e0*({_G} - {_R})/({_BB} - {_R}) else 4/6.0e0 + 1/6.0e0*({_R} - {_G})/({_BB} - {_G}) end) end)"""
color_query("c9_hsp", color.to_hsp, _clips(f"(case when {_SAT} < 0.03e0 then 0 else {_HUE} end)*255", f"{_SAT}*255", f"{_BRIGHT}*255"), None)


def _from_hsp(h: str, s: str, p: str, channel: int) -> str:
    """One of red, green, blue: the formula of each sixth written out."""
    weight, cases, m = ("0.299e0", "0.587e0", "0.114e0"), "", f"(1.0e0 - {s})"
    for k, order in enumerate(("rgb", "grb", "gbr", "bgr", "brg", "rbg")):
        top, mid, low = ("rgb".index(c) for c in order)
        f = f"(6*({h} - {k}/6.0e0))" if k % 2 == 0 else f"(6*(-{h} + {k + 1}/6.0e0))"
        part = f"(1 + {f}*(1/{m} - 1))"
        least = f"({p}/sqrt({weight[top]}/{m}/{m} + {weight[mid]}*{part}*{part} + {weight[low]}))"
        pure = f"sqrt({p}*{p}/({weight[top]} + {weight[mid]}*{f}*{f}))"
        mixed = {top: f"{least}/{m}", mid: f"{least} + {f}*({least}/{m} - {least})", low: least}[channel]
        flat = {top: pure, mid: f"{pure}*{f}", low: "0"}[channel]
        cases += f" when {h} < {k + 1}/6.0e0 then (case when {m} > 0 then {mixed} else {flat} end)" if k < 5 else f" else (case when {m} > 0 then {mixed} else {flat} end)"
    return f"(case{cases} end)*255"


color_query("c9_hsp_inverse", color.from_hsp, tuple(_from_hsp(_R, _G, _BB, i) for i in range(3)), 5)
_CHROMA = "(greatest(r, g, b) - least(r, g, b))"
_DEGREES = f"""(case when {_CHROMA} = 0 then 0 when r >= g and r >= b then (case when g >= b then (g - b)/{_CHROMA}::double else 6 + (g - b)/{_CHROMA}::double end)
    when g >= b then (b - r)/{_CHROMA}::double + 2 else (r - g)/{_CHROMA}::double + 4 end * 60)"""
color_query("c10_hcl", color.to_hcl, (_DEGREES, f"{_CHROMA}/255.0e0", "(0.30e0*r + 0.59e0*g + 0.11e0*b)/255.0e0"))
_TURN = "(case when (r*2 - 100)/60.0e0 < 0 then (r*2 - 100)/60.0e0 + 6 when (r*2 - 100)/60.0e0 >= 6 then (r*2 - 100)/60.0e0 - 6 else (r*2 - 100)/60.0e0 end)"
_C, _L = "(g*(1/255.0e0))", "(b*(1/255.0e0))"
_SECOND = f"({_C}*(1 - abs({_TURN} - 2*floor({_TURN}/2) - 1)))"
_MIX = [f"(case {' '.join(f'when {_TURN} < {k + 1} then {row[i]}' for k, row in enumerate(_t))} end)" for _t in [[
    (_C, _SECOND, "0"), (_SECOND, _C, "0"), ("0", _C, _SECOND), ("0", _SECOND, _C), (_SECOND, "0", _C), (_C, "0", _SECOND)]] for i in range(3)]
_BASE = f"({_L} - (0.30e0*{_MIX[0]} + 0.59e0*{_MIX[1]} + 0.11e0*{_MIX[2]}))"
color_query(
    "c10_hcl_inverse", lambda r, g, b: color.from_hcl(_col(r) * 2 - 100, g, b), tuple(f"case when g = 0 then {_L}*255 else {clip_sql(f'255*({m} + {_BASE})')} end" for m in _MIX)
)

# spaces of linear light: the inputs are bytes divided by 255


def _gamma(x: str) -> str:
    return f"(case when {x} >= 0.0031308e0 then 1.055e0*pow({x}, 1/2.4e0) - 0.055e0 else 12.92e0*{x} end)"


def _rows(matrix, *c: str) -> list[str]:
    return ["(" + " + ".join(f"({w}{'e0' if isinstance(w, float) else ''})*{x}" for w, x in zip(row, c, strict=True)) + ")" for row in matrix]


_UNIT = tuple(f"({x}/255.0e0)" for x in "rgb")
_unit = lambda f: lambda *c: f(*(_col(x) / 255 for x in c))
_OF_XYZ = ((3.2404542, -1.5371385, -0.4985374), (-0.969266, 1.8760108, 0.041556), (0.0556434, -0.2040259, 1.0572252))
color_query("c11_xyz_inverse", _unit(color.from_xyz), _clips(*(f"{_gamma(x)}*255" for x in _rows(_OF_XYZ, *_UNIT))), None)
_OF_LMS = ((1.94735469, -1.41445123, -0.36476327), (0.68990272, 0.34832189, 0.0), (0.0, 0.0, 1.93485343))
color_query("c12_lms_inverse", _unit(color.from_lms), tuple(_rows(_OF_LMS, *_UNIT)), 9)
color_query("c12_xyb_inverse", _unit(color.from_xyb), tuple(_rows(_OF_LMS, f"(({_UNIT[0]} + {_UNIT[1]})/2)", f"(({_UNIT[1]} - {_UNIT[0]})/2)", _UNIT[2])), 9)
color_query("c13_yjk_inverse", color.from_yjk, ("r + (g - 127.5e0)", "r + (b - 127.5e0)", "1.25e0*r - (g - 127.5e0)/2 - (b - 127.5e0)/4"))

_TO_LMS = ((0.412165612, 0.536275208, 0.0514575653), (0.211859107, 0.6807189584, 0.107406579), (0.0883097947, 0.2818474174, 0.6302613616))
_TO_LAB = ((0.2104542553, 0.793617785, -0.0040720468), (1.9779984951, -2.428592205, 0.4505937099), (0.0259040371, 0.7827717662, -0.808675766))
_single = lambda rows: [[f"{w}::float::double" for w in row] for row in rows]
_OF_LAB = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.291485548))
_OF_LIGHT = ((4.0767245293, -3.3072168827, 0.2307590544), (-1.2681437731, 2.6093323231, -0.341134429), (-0.0041119885, -0.7034763098, 1.7068625689))


def _srgb_linear(x: str) -> str:
    return f"(case when {x}/255.0e0 >= 0.04045e0 then pow(({x}/255.0e0 + 0.055e0)/1.055e0, 2.4e0) else {x}/255.0e0/12.92e0 end)"


def _to_oklab(*c: str) -> list[str]:
    return _rows(_single(_TO_LAB), *(f"pow({x}, 1/3.0e0)" for x in _rows(_single(_TO_LMS), *c)))


def _from_oklab(*c: str) -> list[str]:
    return [f"round({x}, 5)" for x in _rows(_OF_LIGHT, *(f"pow({x}, 3)" for x in _rows(_OF_LAB, *c)))]


def _steps(x: str) -> str:
    v = f"(floor(greatest(0, least(1, {x}))*4096)/4096.0e0)"
    return f"(case when {v} <= 0.0031308e0 then floor({v}*12.92e0*255 + 0.5e0) else floor((1.055e0*pow({v}, 1/2.4e0) - 0.05499999999999989e0)*255) end)"


# small steps from grey, as most bytes are no colour there
_LAB = ("(r/255.0e0)", "((g - 128)/640.0e0)", "((b - 128)/640.0e0)")
_lab = lambda f: lambda r, g, b: f(_col(r) / 255, (_col(g) - 128) / 640, (_col(b) - 128) / 640)
color_query("c14_oklab_inverse", _lab(color.from_oklab), tuple(_from_oklab(*_LAB)), 5)
color_query("c14_srgb_oklab", color.srgb_to_oklab, tuple(_to_oklab(*map(_srgb_linear, "rgb"))))
_BYTES = _to_oklab(*map(_srgb_linear, "rgb"))
color_query("c14_oklab_bytes", color.srgb_to_oklab_bytes, _clips(f"{_BYTES[0]}*255", f"({_BYTES[1]} + 1)*127.5e0", f"({_BYTES[2]} + 1)*127.5e0"), None)
color_query("c14_oklab_bytes_inverse", color.oklab_bytes_to_srgb, tuple(map(_steps, _from_oklab("(r/255.0e0)", "(g/127.5e0 - 1)", "(b/127.5e0 - 1)"))), None)
color_query("c14_oklab_rgb", _lab(color.oklab_to_rgb), _clips(*(f"{_gamma(x)}*255" for x in _from_oklab(*_LAB))), None)
color_query("c14_oklab_srgb", _lab(color.oklab_to_srgb), tuple(map(_steps, _from_oklab(*_LAB))), None)
_POLAR = ("(r/255.0e0)", "((g/640.0e0)*cos((b - 20)/255.0e0*2*pi()))", "((g/640.0e0)*sin((b - 20)/255.0e0*2*pi()))")
_POLAR = (_POLAR[0], *(f"(case when b < 20 then 0 else {x} end)" for x in _POLAR[1:]))
_polar = lambda r, g, b: color.from_oklch(_col(r) / 255, _col(g) / 640, (_col(b) - 20) / 255)
color_query("c15_oklch_inverse", _polar, _POLAR, 7)
color_query("c15_oklch_rgb", lambda *c: color.oklab_to_rgb(*_polar(*c)), _clips(*(f"{_gamma(x)}*255" for x in _from_oklab(*_POLAR))), None)
color_query("c16_gamma", _unit(lambda *c: map(color.gamma, c)), tuple(map(_gamma, _UNIT)))
color_query("c16_linear_table", lambda *c: (color.linear_of_byte(_col(x) + 0.75) for x in c), tuple(map(_srgb_linear, "rgb")))
color_query("c16_gamma_table", _unit(lambda *c: (color.byte_of_linear(x * 1.2 - 0.1) for x in c)), tuple(_steps(f"({x}*1.2e0 - 0.1e0)") for x in _UNIT), None)
color_query(
    "c17_kla_inverse", color.from_kla,
    _clips(*_rows(((1.06209, 0.30672, 0.74957), (-1.15012, 1.50733, -2.56183), (1.91561, -1.85882, 1.95371)), "(r - 64)", "(g - 128)", "(b - 128)")), None,
)
color_query("c18_scaled", lambda *c: color.scaled(*(_col(x) / 200 - 0.1 for x in c)), _clips(*(f"({x}/200.0e0 - 0.1e0)*255" for x in "rgb")), None)

# brightness

color_query("c19_brightness", lambda *c: (color.brightness(*c),), ("trunc(16 + (0.257e0*r + 0.504e0*g + 0.098e0*b))",), None)
_PICK = ", ".join(
    [f"(sum({c}) filter ({rank} <= 4))::bigint // 4 {name}_{c}" for name, rank in (("dark", "i"), ("light", "j")) for c in "rgb"]
    + [f"round(sum({c}/{rank}) filter ({rank} <= 8) / 2.59285714285714e0, 6) {name}_{c}" for name, rank in (("dark", "i"), ("light", "j")) for c in "yuv"]
)
_PICKED = [f"{name}_{c}" for name in ("dark", "light") for c in "yuv"]
add(
    "c19_colour_pickers",
    lambda s, d: color.pick_colours(fx.rgb_lines(s, d).withColumn("block", F.expr("k1 div 16")), ["block"], ["k1", "k2"]).withColumns({c: F.round(c, 6) for c in _PICKED}),
    f"""with {fx.RGB_LINES}, y as (select k1 // 16 block, k1, k2, r, g, b, 16 + (0.257e0*r + 0.504e0*g + 0.098e0*b) y, 128 + (-0.148e0*r - 0.291e0*g + 0.439e0*b) u,
            128 + (0.439e0*r - 0.368e0*g - 0.071e0*b) v from c),
        o as (select *, row_number() over (partition by block order by trunc(y), k1, k2, r, g, b) i, row_number() over (partition by block order by trunc(y) desc, k1 desc, k2 desc, r desc, g desc, b desc) j,
            count(*) over (partition by block) n from y)
        select block, {_PICK} from o where n >= 8 group by block""",
)
_YIQ = "(0.3e0*r + 0.59e0*g + 0.11e0*b)"
_I2 = f"((((b - {_YIQ})*-0.27e0 + (r - {_YIQ})*0.74e0)*0.8393e0 + 127 - 127)*1.1914e0)"
_Q2 = f"((((b - {_YIQ})*0.41e0 + (r - {_YIQ})*0.48e0)*0.9567e0 + 127 - 127)*1.0452e0)"
color_query(
    "c20_invert_yiq", color.invert_brightness,
    _clips(f"255 - {_YIQ} + {_I2}*0.9469e0 + {_Q2}*0.6236e0", f"255 - {_YIQ} - {_I2}*0.2748e0 - {_Q2}*0.6357e0", f"255 - {_YIQ} - {_I2}*1.1e0 + {_Q2}*1.7e0"), None,
)
_MID, _CO, _CG = "((r + b)/2.0e0)", "((r - b)/2.0e0)", "((g - (r + b)/2.0e0)/2)"
color_query(
    "c20_invert_ycocg", lambda *c: color.invert_brightness(*c, space="ycocg"),
    _clips(f"255 - ({_MID} + g)/2 - {_CG} + {_CO}", f"255 - ({_MID} + g)/2 - {_CG} + 2*{_CG}", f"255 - ({_MID} + g)/2 - {_CG} - {_CO}"), None,
)
_HSP_SQL = f"""h as (select k1, k2, {clip_sql(f"(case when {_SAT} < 0.03e0 then 0 else {_HUE} end)*255")}/255.0e0 h, {clip_sql(f"{_SAT}*255")}/255.0e0 s,
    (255 - {clip_sql(f"{_BRIGHT}*255")})/255.0e0 p from c)"""
add(
    "c20_invert_hsp",
    lambda s, d: fx.rgb_lines(s, d).select("k1", "k2", *(c.alias(f"c{i}") for i, c in enumerate(color.invert_brightness("r", "g", "b", "hsp")))),
    f"with {fx.RGB_LINES}, {_HSP_SQL} select k1, k2, " + ", ".join(f"({clip_sql(_from_hsp('h', 's', 'p', i))})::int c{i}" for i in range(3)) + " from h",
)
