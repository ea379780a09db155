"""Wavelets of several levels, storage order, rescaling, rotation and projections, with SQL from their own terms."""

from __future__ import annotations

import math
from uuid import uuid4

from pyspark.sql import functions as F

from samplegrid.functions import scalar
from samplegrid.operators import gather, resample, wavelet, window
from samplegrid.operators.scan import shared_dir
from samplegrid.plans import fixtures as fx
from samplegrid.plans.registry import add
from samplegrid.sources import layout

_EMB = f"with {fx.EMB_RASTER}"
_SIZE = "sz as (select image_id, max(x) + 1 w, max(y) + 1 h from px group by image_id)"
#: The rasters with sides padded to powers of two, as v, w, h.
_POW2 = f"""{_EMB}, m as (select image_id, max(y) my, pow(2, ceil(log2(max(y) + 1)))::int h from px group by image_id), gy as (select image_id, my, h, unnest(range(h)) y from m),
    g as (select *, unnest(range(64)) x from gy), c0 as (select g.image_id, g.y::int y, g.x::int x, v::double v, 64 w, g.h from g join px on px.image_id = g.image_id and px.x = g.x and px.y = least(g.y, my))"""


def _px(name: str, query, sql: str | None = None) -> None:
    add(name, lambda s, d: query(fx.emb_raster(s, d)), sql and (sql if sql.startswith("with") else f"{_EMB}{sql}"))


def _padded(query):
    return lambda p: query(gather.pad_pow2(p))


def _round(df, digits: int = 5):
    return df.withColumn("v", F.round("v", digits) + 0.0)


class _Sql:
    """Common table expressions that go on from c0, one a lifting step; samples outside `where` stay."""

    def __init__(self, keys: str = "image_id, w, h"):
        self.keys, self.ctes, self.last = keys, [], "c0"

    def then(self, columns: str) -> None:
        name = f"s{len(self.ctes)}"
        self.ctes.append(f"{name} as (select {self.keys}, {columns} from {self.last})")
        self.last = name

    def pass_(self, axis: str, n: str, where: str, kind: str, back: bool = False, axes: tuple[str, ...] = ("y", "x")) -> None:
        others = [a for a in axes if a != axis]
        place = lambda to: ", ".join(f"(case when {where} then {to} else {a} end)::int {a}" if a == axis else a for a in axes)
        if back:
            half = f"(({n} + 1) >> 1)"
            self.then(f"{place(f'case when {axis} < {half} then 2*{axis} else 2*({axis} - {half}) + 1 end')}, v")
        w = f"partition by image_id, {', '.join(others)}, ({where}) order by {axis}"
        sides = f"(coalesce(lag(v) over ({w}), lead(v) over ({w}), 0) + coalesce(lead(v) over ({w}), lag(v) over ({w}), 0))"
        plain = ", ".join(axes)
        value = lambda parity, x: self.then(f"{plain}, case when ({where}) and {axis} % 2 = {parity} then {x} else v end v")
        if kind == "int53":
            steps = [(0, f"v - floor({sides}/4)"), (1, f"v + floor({sides}/2)")] if back else [(1, f"v - floor({sides}/2)"), (0, f"v + floor({sides}/4)")]
            for parity, x in steps:
                value(parity, x)
        elif kind == "haar":
            left, right = f"lag(v) over ({w})", f"lead(v) over ({w})"
            if back:
                self.then(f"{plain}, case when {axis} % 2 = 0 then 2*v - (v + {right}) else {left} + v end v")
            else:
                self.then(f"{plain}, case when {axis} % 2 = 0 then (v + {right})/2 else v - ({left} + v)/2 end v")
        else:
            steps, scale = wavelet.KINDS[kind]
            scaled = lambda up: self.then(f"{plain}, case when not ({where}) then v when ({axis} % 2 = 0) = {up} then v * {scale}e0 else v / {scale}e0 end v")
            if back:
                scaled("true")
            for parity, a in reversed(steps) if back else steps:
                value(parity, f"v {'-' if back else '+'} ({a}e0)*{sides}")
            if not back:
                scaled("false")
        if not back:
            self.then(f"{place(f'case when {axis} % 2 = 0 then {axis} >> 1 else (({n} + 1) >> 1) + ({axis} >> 1) end')}, v")

    def forward(self, levels: int, kind: str = "cdf97", full: bool = False) -> "_Sql":
        for i in range(levels):
            self.pass_("y", f"(h >> {i})", f"y < (h >> {i}) and x < (w >> {i})", kind)
            self.pass_("x", f"(w >> {i})", f"y < (h >> {i if full else i + 1}) and x < (w >> {i})", kind)
        return self

    def inverse(self, levels: int, kind: str = "cdf97", scale: int = 0) -> "_Sql":
        for i in reversed(range(scale, levels)):
            self.pass_("x", f"(w >> {i})", f"y < (h >> {i + 1}) and x < (w >> {i})", kind, True)
            self.pass_("y", f"(h >> {i})", f"y < (h >> {i}) and x < (w >> {i})", kind, True)
        return self

    def sql(self, select: str, head: str = _POW2) -> str:
        return f"{head}, {', '.join(self.ctes)} {select.replace('LAST', self.last)}"


# one level: the other wavelets

_C0 = f"{_EMB}, {_SIZE}, c0 as (select image_id, w, h, y, x, v::double v from px join sz using (image_id))"
_sized = lambda p: p.join(gather.sizes(p), "image_id").withColumn("v", F.col("v").cast("double"))
_VALUES = "select image_id, y, x, round(v, 5) + 0.0 v from LAST"
for _kind in ("int53", "haar"):
    _s = _Sql()
    _s.pass_("x", "w", "true", _kind)
    _px(f"w4_{_kind}", lambda p, k=_kind: _round(wavelet.lift(_sized(p), "x", F.col("w"), k)).select("image_id", "y", "x", "v"), _s.sql(_VALUES, _C0))
for _kind in ("cdf53", "int53", "haar"):
    _px(
        f"w4_{_kind}_inverse",
        lambda p, k=_kind: _round(wavelet.unlift(wavelet.lift(_sized(p), "x", F.col("w"), k), "x", F.col("w"), k)).select("image_id", "y", "x", F.col("v").cast("int").alias("v")),
        " select image_id, y, x, v from px",
    )

# levels

_px("w5_decompose", _padded(lambda p: _round(wavelet.decompose(p, 3)).select("image_id", "y", "x", "v")), _Sql().forward(3).sql(_VALUES))
_px("w5_decompose_full", _padded(lambda p: _round(wavelet.decompose(p, 3, "cdf53", "full")).select("image_id", "y", "x", "v")), _Sql().forward(3, "cdf53", True).sql(_VALUES))
_px(
    "w5_restore",
    _padded(lambda p: _round(wavelet.reconstruct(wavelet.decompose(p, 6), 6), 4).select("image_id", "y", "x", F.col("v").cast("int").alias("v"))),
    f"{_POW2} select image_id, y, x, v::int v from c0",
)
_px(
    "src9_reduced_scale",
    _padded(lambda p: _round(wavelet.reconstruct(wavelet.decompose(p, 4), 4, scale=2))),
    _Sql().forward(2).sql(_VALUES + " where y < (h >> 2) and x < (w >> 2)"),
)
def _stored(p):
    """Pictures written as coefficients, and read back at a quarter of their sides."""
    path = f"{shared_dir(p.sparkSession)}/stored-{uuid4().hex[:12]}"
    layout.write_coefficients(p, path, 4)
    return _round(layout.read_scale(p.sparkSession, path, 2))


_px("src9_stored_scale", _padded(_stored), _Sql().forward(2).sql(_VALUES + " where y < (h >> 2) and x < (w >> 2)"))


def _window(p):
    """Samples in Morton order by files and row groups, of which a window is read back."""
    path = f"{shared_dir(p.sparkSession)}/morton-{uuid4().hex[:12]}"
    layout.write_by_key(p, scalar.morton2("x", "y"), path)
    return layout.read_window(p.sparkSession, path, 9, 20, 37, 41).select("image_id", "y", "x", "v")


_px("o1_morton_window", _window, " select image_id, y, x, v from px where x between 9 and 37 and y between 20 and 41")
_FRAMES = _POW2.replace("c0 as (select g.image_id, g.y::int y, g.x::int x, v::double v, 64 w, g.h", "c0 as (select g.image_id, 64 w, 16 h, (g.h // 16)::int d, (g.y // 16)::int z, (g.y % 16)::int y, g.x::int x, v::double v")
_b = _Sql("image_id, w, h, d")
for _i in range(2):
    for _axis, _n, _where in (("y", f"(h >> {_i})", f"y < (h >> {_i}) and x < (w >> {_i})"), ("x", f"(w >> {_i})", f"y < (h >> {_i + 1}) and x < (w >> {_i})")):
        _b.pass_(_axis, _n, _where, "cdf97", axes=("z", "y", "x"))
for _i in range(2):
    _b.pass_("z", f"(d >> {_i})", f"z < (d >> {_i})", "cdf97", axes=("z", "y", "x"))
_frames = lambda p: p.join(gather.sizes(p), "image_id").selectExpr("image_id", "cast(y div 16 as int) z", "cast(y % 16 as int) y", "x", "v", "64 w", "16 h", "cast(h div 16 as int) d")
_px(
    "w5_3d",
    _padded(lambda p: _round(wavelet.decompose3d(_frames(p), 2)).select("image_id", "z", "y", "x", "v")),
    _b.sql("select image_id, z, y, x, round(v, 5) + 0.0 v from LAST", _FRAMES),
)
_MORTON = _POW2 + f""", l0 as (select image_id, 64*h w, 1 h, 0 y, ({' + '.join(f'(((x >> {k}) & 1) << {2 * k}) + (((y >> {k}) & 1) << {2 * k + 1})' for k in range(8))})::int x, v from c0)"""
_m = _Sql()
_m.last = "l0"
for _i in range(5):
    _m.pass_("x", f"(w >> {_i})", f"x < (w >> {_i})", "cdf97")
_BANDS = "case " + " ".join(f"when x >= (w >> {i + 1}) then {5 - i}" for i in range(5)) + " else 1 end"
_px(
    "w5b_morton",
    _padded(lambda p: _round(wavelet.decompose_morton(p, 5)).select("image_id", "y", "x", "v")),
    _m.sql(f"select image_id, y, x, round(v / ({_BANDS}), 5) + 0.0 v from LAST", _MORTON),
)


def _ordered(levels: int, source: str) -> str:
    """Places by sorting: level, block, then columns or rows."""
    level = f"(case {' '.join(f'when y < (h >> {i}) and x < (w >> {i}) then {i}' for i in range(levels, 0, -1))} else 0 end)"
    right = f"(y < (h >> (level + 1)) and level < {levels})"
    return f"""lv as (select *, {level} level from {source}),
        so as (select *, row_number() over (partition by image_id order by level desc, {right} desc, case when {right} then x else y end, case when {right} then y else x end) - 1 order_pos from lv)"""


_px(
    "o3_storage_order",
    _padded(lambda p: wavelet.storage_order(p.join(gather.sizes(p), "image_id"), 4).selectExpr("image_id", "y", "x", "level", "cast(order_pos as bigint) order_pos")),
    f"{_POW2}, {_ordered(4, 'c0')} select image_id, y, x, level, order_pos from so",
)


def _by_bracket(factors: tuple[float, ...], brackets: int = 99) -> str:
    """The factor of the bracket that holds the place, by comparing it with halves of the image."""
    cases = " ".join(f"when order_pos >= (w*h) >> {r + 1} then {factors[min(r, len(factors) - 1)]}::double" for r in range(min(brackets, 13)))
    return f"(case when order_pos = 0 then 1 {cases} else 1 end)"


for _expand in (False, True):
    _px(
        "o4_expand" if _expand else "o4_quantise",
        _padded(lambda p, e=_expand: _round(wavelet.quantise(wavelet.storage_order(p.join(gather.sizes(p), "image_id"), 4), wavelet.QUANT_C if e else wavelet.QUANT_Y, e), 4).select("image_id", "y", "x", "v")),
        f"{_POW2}, {_ordered(4, 'c0')} select image_id, y, x, round(v {'*' if _expand else '/'} {_by_bracket(wavelet.QUANT_C if _expand else wavelet.QUANT_Y)}, 4) + 0.0 v from so",
    )
for _name, _factors, _extra in (("w6_soft", wavelet.SOFT, 0), ("w6_sharp", wavelet.SHARP, 0), ("w6_band_gain", (0.25, 1.5), 1)):
    _g = _Sql()
    _g.then("y, x, v - 127.5e0 v")
    _g.forward(6)
    _g.ctes += [_ordered(6, _g.last)]
    _g.last = "so"
    _g.then(f"y, x, v * {_by_bracket(_factors, 6 + _extra)} v")
    _g.inverse(6)
    _px(_name, _padded(lambda p, f=_factors, e=_extra: _round(wavelet.band_gain(p, f, 6, 6 + e), 3)), _g.sql("select image_id, y, x, round(v + 127.5e0, 3) + 0.0 v from LAST"))
for _axis, _side, _other in (("x", "w", "y < (h >> 1)"), ("y", "h", "x < (w >> 1)")):
    _a = _Sql()
    _a.pass_(_axis, _side, "true", "cdf97")
    _a.pass_(_axis, _side, _other, "cdf97", True)
    _px(f"w7_gradients_{_axis}", lambda p, a=_axis: _round(wavelet.axis_gradients(p, a)), _a.sql(_VALUES, _C0))

# windows

_WX, _WY = "partition by image_id, y order by x", "partition by image_id, x order by y"
_F = "rows between 2 preceding and 3 following"
_px(
    "w2_close",
    lambda p: window.morph(p, "close", 3),
    f""", a as (select image_id, y, x, max(v) over ({_WY} {_F}) v from px), b as (select image_id, y, x, max(v) over ({_WX} {_F}) v from a),
        c as (select image_id, y, x, min(v) over ({_WY} {_F}) v from b) select image_id, y, x, min(v) over ({_WX} {_F}) v from c""",
)
for _axis, _w in (("x", _WX), ("y", _WY)):
    _px(f"w2_dilate_{_axis}", lambda p, a=_axis: window.morph(p, "dilate", 3, a), f" select image_id, y, x, max(v) over ({_w} {_F}) v from px")


def _shift_sql(source: str, axis: str) -> str:
    other = "y" if axis == "x" else "x"
    return f"""(select a.image_id, a.y, a.x, (sum(b.v) // 8)::bigint v from (select *, max({axis}) over (partition by image_id, {other}) m, unnest(range(-4, 5)) d from {source}) a
        join {source} b on a.image_id = b.image_id and a.{other} = b.{other} and b.{axis} = least(greatest(a.{axis} + a.d, 0), a.m) group by a.image_id, a.y, a.x)"""


_px("w1_shift_blur", lambda p: window.box_blur(p, 3, "shift"), f", q as {_shift_sql('px', 'x')}, z as {_shift_sql('q', 'y')} select image_id, y, x, least(v, 255)::int v from z")
_px("a10_row_energy", lambda p: resample.row_energy(p).withColumn("energy", F.round("energy", 6)), " select image_id, y, round(var_pop(v), 6) energy from px group by image_id, y")
_px(
    "w9_epx2_near",
    lambda p: resample.epx2_near(p, 40),
    f""", n as (select px.*, case when x = 0 or x = 63 then v else lag(v) over ({_WX}) end l, case when x = 0 or x = 63 then v else lead(v) over ({_WX}) end r,
            lag(v) over ({_WY}) t0, lead(v) over ({_WY}) b0 from px), q as (select *, case when t0 is null or b0 is null then v else t0 end t, case when t0 is null or b0 is null then v else b0 end b from n)
        select image_id, 2*y y, 2*x x, case when l // 40 = t // 40 and l // 40 <> b // 40 and t // 40 <> r // 40 then t else v end v from q
        union all select image_id, 2*y, 2*x + 1, case when t // 40 = r // 40 and t // 40 <> l // 40 and r // 40 <> b // 40 then r else v end from q
        union all select image_id, 2*y + 1, 2*x, case when b // 40 = l // 40 and b // 40 <> r // 40 and l // 40 <> t // 40 then l else v end from q
        union all select image_id, 2*y + 1, 2*x + 1, case when r // 40 = b // 40 and r // 40 <> t // 40 and b // 40 <> l // 40 then b else v end from q""",
)
_px("w16_diffuse_upscale", lambda p: resample.diffuse_upscale(p, 1.5))

# rescaling


def _taps_sql(source: str, axis: str, n: str, taps: str, value: str) -> str:
    """Outputs o of n along an axis: `taps` is a list of (source place, weight) over o and s, the side; value is over sum, the weighted sum."""
    other = "y" if axis == "x" else "x"
    return f"""(with l as (select image_id, {other}, max({axis}) + 1 s from {source} group by image_id, {other}), o as (select *, unnest(range(({n})::int)) o from l), t as (select *, unnest({taps}) t from o)
        select t.image_id, t.{other}, t.o::int {axis}, {value} v from t join {source} b on b.image_id = t.image_id and b.{other} = t.{other} and b.{axis} = t.t.at group by t.image_id, t.{other}, t.o)"""


_tap = lambda at, weight: f"{{'at': ({at})::int, 'c': ({weight})::double}}"
_HALF = f"[{_tap('greatest(2*o - 1, 0)', 1)}, {_tap('2*o', 3)}, {_tap('2*o + 1', 3)}, {_tap('least(2*o + 2, 2*(s // 2) - 1)', 1)}]"
_half = lambda source, axis: _taps_sql(source, axis, "s // 2", _HALF, "(sum(v*t.t.c)::bigint // 8)::int")
_px("a9_halve", resample.halve, f", q as {_half('px', 'x')}, r as {_half('q', 'y')} select image_id, y, x, v from r")
_D = "(s*3 // 4)"
_FIRST = f"ceil(o*s/{_D}::double)::int"
_NEAR = f"[{_tap(_FIRST, f'case when ({_FIRST}*{_D}) % s < s // 2 and {_FIRST} < s - 1 then 1 else 2 end')}, {_tap(f'least({_FIRST} + 1, s - 1)', f'case when ({_FIRST}*{_D}) % s < s // 2 and {_FIRST} < s - 1 then 1 else 0 end')}]"
_near = lambda source, axis: _taps_sql(source, axis, _D, _NEAR, "(sum(v*t.t.c)::bigint // 2)::int")
_px("r1_resize_fast", lambda p: resample.resize_fast(p, 3, 4).withColumn("v", F.col("v").cast("int")), f", q as {_near('px', 'x')}, r as {_near('q', 'y')} select image_id, y, x, v from r")


# pictures of several heights into one box: those that are three times as large or more are halved first
_FIT = "(cast(least(1::float, 22::float/w::float, 24::float/h::float) as float))"
_PLAN = f""", sz as (select image_id, max(x) + 1 w, max(y) + 1 h from px group by image_id), g as (select *, greatest(trunc(cast(w::float*{_FIT} as float)), 1)::int tw, greatest(trunc(cast(h::float*{_FIT} as float)), 1)::int th from sz),
    big as (select image_id from g where w // tw > 2 and h // th > 2)"""


def _to_target(source: str, axis: str, target: str) -> str:
    """The steps of _NEAR with a target side for each picture."""
    other, first = ("y" if axis == "x" else "x"), f"ceil(o*s/{target}::double)::int"
    mixed = f"({first}*{target}) % s < s // 2 and {first} < s - 1"
    return f"""(with l as (select b.image_id, b.{other}, max(b.{axis}) + 1 s, any_value(g.{target}) {target} from {source} b join g using (image_id) group by b.image_id, b.{other}), o as (select *, unnest(range({target})) o from l),
        k as (select *, unnest(range({first}, least(ceil((o + 1)*s/{target}::double)::int, s))) k, {first} f from o),
        t as (select k.image_id, k.{other}, o, s, {target}, list(b.v order by k) vs, list(n.v order by k) ns, list(k order by k) ks from k join {source} b on b.image_id = k.image_id and b.{other} = k.{other} and b.{axis} = k
            left join {source} n on n.image_id = k.image_id and n.{other} = k.{other} and n.{axis} = k + 1 group by all)
        select image_id, {other}, o::int {axis}, list_reduce(list_prepend(vs[1], range(1, len(ks) + 1)), lambda v, i: case when (ks[i]*{target}) % s < s // 2 and ks[i] < s - 1 then (v + ns[i]) >> 1 else v end)::int v from t)"""


_px(
    "r1_fit",
    lambda p: resample.fit_into(p, 22, 24),
    f"""{_PLAN}, large as (select px.* from px semi join big using (image_id)), hx as {_half('large', 'x')}, hy as {_half('hx', 'y')},
        q as (select image_id, y, x, v from px anti join big using (image_id) union all select image_id, y, x, v from hy),
        done as (select image_id from (select image_id, max(x) + 1 mw, max(y) + 1 mh from q group by image_id) m join g using (image_id) where mw = tw and mh = th), n as (select q.* from q anti join done using (image_id)),
        fx as {_to_target('n', 'x', 'tw')}, fy as {_to_target('fx', 'y', 'th')}
        select image_id, y, x, v from fy union all select q.* from q semi join done using (image_id)""",
)


def _cubic(n: int) -> str:
    at, t = f"(o*(s/{n}.0e0))", f"(1 - (o*(s/{n}.0e0) - floor(o*(s/{n}.0e0))))"
    left = f"least(greatest(trunc({at} - 1.5e0), 0), s - 4)"
    weights = (f"0.5e0*({t}*(-1 + {t}*(2 - {t})))", f"1 + 0.5e0*{t}*{t}*(3*{t} - 5)", f"0.5e0*{t}*(1 + {t}*(4 - 3*{t}))", f"0.5e0*{t}*{t}*({t} - 1)")
    return "[" + ", ".join(_tap(f"{left} + {k}", w) for k, w in enumerate(weights)) + "]"


_px(
    "r2_resize_bicubic",
    # a little more, so that exact halves are rounded alike
    lambda p: _round(resample.resize_bicubic(p, 48, 40).withColumn("v", F.col("v") + 1e-7), 4),
    f", q as {_taps_sql('px', 'y', '40', _cubic(40), 'sum(v*t.t.c)')}, r as {_taps_sql('q', 'x', '48', _cubic(48), 'sum(v*t.t.c)')} select image_id, y, x, round(v + 1e-7, 4) + 0.0 v from r",
)
_px("r3_resize_spline", lambda p: _round(resample.resize_spline(p, 96, 80)))
_px("r5_reduce_cubic", lambda p: _round(resample.reduce_field(p, 2, "cubic")))
_bilinear = lambda n: f"[{_tap(f'floor(o*(s/{n}.0e0))', f'1 - (o*(s/{n}.0e0) - floor(o*(s/{n}.0e0)))')}, {_tap(f'least(floor(o*(s/{n}.0e0)) + 1, s - 1)', f'o*(s/{n}.0e0) - floor(o*(s/{n}.0e0))')}]"
_nearest = lambda n: f"[{_tap(f'floor(o*(s/{n}.0e0))', 1)}]"
for _how, _taps in (("bilinear", _bilinear), ("nearest", _nearest)):
    _px(
        f"j5_rescale_{_how}",
        lambda p, h=_how: _round(resample.rescale_field(p, 100, 48, h)),
        f", q as {_taps_sql('px', 'x', '100', _taps(100), 'sum(v*t.t.c)')}, r as {_taps_sql('q', 'y', '48', _taps(48), 'sum(v*t.t.c)')} select image_id, y, x, round(v, 5) + 0.0 v from r",
    )
# two rounds at once: cells of the sides over their quarters, from each output's own place
_CELLS = f""", {_SIZE}, ry as (select *, h >> 2 sh, w >> 2 sw, unnest(range(h >> 2)) oy from sz), rx as (select *, unnest(range(w >> 2)) ox from ry),
    dy as (select *, unnest(range(ceil(h/sh::double)::int)) b from rx), dx as (select *, unnest(range(ceil(w/sw::double)::int)) a from dy),
    c as (select dx.image_id, oy::int y, ox::int x, v - 128 v from dx join px on px.image_id = dx.image_id and px.y = least(trunc(oy*(h/sh::double)) + b, h - 1) and px.x = least(trunc(ox*(w/sw::double)) + a, w - 1))"""
_field = lambda p: p.withColumn("v", F.col("v") - 128)
_px("j5_reduce_zero", lambda p: resample.reduce_field(_field(p), 2), f"{_CELLS} select image_id, y, x, arg_min(v, abs(v)*1000 + v) v from c group by all")
_px("j5_reduce_mean", lambda p: _round(resample.reduce_field(_field(p), 2, "mean")), f"{_CELLS} select image_id, y, x, round(avg(v), 5) + 0.0 v from c group by image_id, y, x")
_px(
    "j5_reduce_nearest",
    lambda p: resample.reduce_field(p, 2, "nearest"),
    f""", {_SIZE}, ry as (select *, unnest(range(h >> 2)) oy from sz), rx as (select *, unnest(range(w >> 2)) ox from ry)
        select rx.image_id, oy::int y, ox::int x, v from rx join px on px.image_id = rx.image_id and px.y = trunc(oy*(h/(h >> 2)::double)) and px.x = trunc(ox*(w/(w >> 2)::double))""",
)
_px(
    "r4_expand_by_4",
    lambda p: _round(gather.resize_linear(p, 4)),
    f", q as {_taps_sql('px', 'x', 's*4', _bilinear('(s*4)').replace('.0e0', '::double'), 'sum(v*t.t.c)')}, r as {_taps_sql('q', 'y', 's*4', _bilinear('(s*4)').replace('.0e0', '::double'), 'sum(v*t.t.c)')}"
    " select image_id, y, x, round(v, 5) + 0.0 v from r",
)
_stats = lambda p, c: gather.resize_linear(window.block_stats(p).select("image_id", "y", "x", F.col(c).cast("double").alias("v")), 4)
_inner = lambda p: p.join(gather.sizes(p), "image_id").where("y < h div 4 * 4").select("image_id", "y", "x", "v")
_LOHI = f""", {_SIZE}, o as (select image_id, y, x, w, h, unnest(range(-2, 3)) dy from px join sz using (image_id) where x % 4 = 0 and y % 4 = 0 and x // 4 < w // 4 and y // 4 < h // 4),
    t as (select *, unnest(range(-2, 3)) dx from o), bs as (select t.image_id, (t.y // 4)::int y, (t.x // 4)::int x, min(b.v) low, max(b.v) high from t join px b on b.image_id = t.image_id
        and b.x = least(greatest(t.x + dx, 0), w - 1) and b.y = least(greatest(t.y + dy, 0), h - 1) group by t.image_id, t.y, t.x),
    lo as (select image_id, y, x, low v from bs), hi as (select image_id, y, x, high v from bs)"""
for _n in ("lo", "hi"):
    _LOHI += f", {_n}x as {_taps_sql(_n, 'x', 's*4', _bilinear('(s*4)').replace('.0e0', '::double'), 'sum(v*t.t.c)')}, {_n}e as {_taps_sql(_n + 'x', 'y', 's*4', _bilinear('(s*4)').replace('.0e0', '::double'), 'sum(v*t.t.c)')}"
_LOHI += """, fr as (select px.image_id, px.y, px.x, lo.v a, hi.v b, case when hi.v - lo.v >= 0.0001 then least(greatest((px.v - lo.v)/(hi.v - lo.v), 0), 1) end f
        from px join loe lo on lo.image_id = px.image_id and lo.y = px.y and lo.x = px.x join hie hi on hi.image_id = px.image_id and hi.y = px.y and hi.x = px.x),
    ff as (select *, coalesce(last_value(f ignore nulls) over (partition by image_id order by y, x), 0) g from fr)"""
_px(
    "a8_range_fraction",
    lambda p: resample.range_fraction(_inner(p), _stats(p, "low"), _stats(p, "high")).withColumn("f", F.round("f", 5) + 0.0),
    _LOHI + " select image_id, y, x, round(g, 5) + 0.0 f from ff",
)
_px(
    "a8_range_restore",
    lambda p: _round(
        resample.range_restore(
            resample.range_fraction(_inner(p), _stats(p, "low"), _stats(p, "high")).withColumn("f", resample.quantise_levels(F.round("f", 9))), _stats(p, "low"), _stats(p, "high")
        )
    ),
    _LOHI + " select image_id, y, x, round(a + (b - a)*(case when round(g, 9) < 0.25 then 0 when round(g, 9) < 0.5 then 0.3e0 when round(g, 9) < 0.75 then 0.6e0 else 1 end), 5) + 0.0 v from ff",
)
_px("f4_quantise_levels", lambda p: p.select("image_id", "y", "x", resample.quantise_levels(F.col("v") / 255).alias("v")),
    " select image_id, y, x, case when v/255.0e0 < 0.25 then 0 when v/255.0e0 < 0.5 then 0.3 when v/255.0e0 < 0.75 then 0.6 else 1 end::double v from px")

# rotation and projections

_READS = """r as (select *, least(trunc(sx), w - 1)::int x0, least(trunc(sy), h - 1)::int y0, sx - floor(sx) fx, sy - floor(sy) fy from tg where sx >= 0 and sy >= 0 and sx <= w and sy <= h),
    ed as (select *, x0 + (sx < w - 1)::int x1, y0 + (sy < h - 1)::int y1 from r),
    q as (select ed.*, (1 - fx)*(1 - fy)*a.v + fx*(1 - fy)*b.v + (1 - fx)*fy*c.v + fx*fy*d.v sample from ed join px a on a.image_id = ed.image_id and a.y = y0 and a.x = x0
        join px b on b.image_id = ed.image_id and b.y = y0 and b.x = x1 join px c on c.image_id = ed.image_id and c.y = y1 and c.x = x0 join px d on d.image_id = ed.image_id and d.y = y1 and d.x = x1)"""
_A = math.radians(20)
_BW, _BH = (f"(w*abs({a}e0) + h*abs({b}e0))" for a, b in ((math.cos(_A), math.sin(_A)), (math.sin(_A), math.cos(_A))))
_px(
    "j2_rotate",
    lambda p: _round(resample.rotate(p, _A)),
    f""", {_SIZE}, bd as (select *, ceil({_BW})::int bw, ceil({_BH})::int bh from sz), gy as (select *, unnest(range(-(bh // 2), bh // 2)) dy from bd), g as (select *, unnest(range(-(bw // 2), bw // 2)) dx from gy),
        tg as (select image_id, w, h, dx*{math.cos(_A)}e0 - dy*{math.sin(_A)}e0 + w/2.0e0 sx, dx*{math.sin(_A)}e0 + dy*{math.cos(_A)}e0 + h/2.0e0 sy, trunc(dx + {_BW}/2)::int ox, trunc(dy + {_BH}/2)::int oy from g),
        {_READS} select image_id, oy y, ox x, round(sample, 5) + 0.0 v from q""",
)
_TX, _SY = math.tan(_A / 2), math.sin(_A)
_px(
    "j3_rotate_shear",
    lambda p: resample.rotate_shear(p, 20),
    f""", {_SIZE}, s1 as (select *, trunc(h*{_TX}e0)::int sw from sz), s2 as (select *, floor(h*{_TX}e0 + sw*2 + w + 0.5e0)::int bw from s1), s3 as (select *, floor(bw*{_SY}e0 + h + 0.5e0)::int bh from s2),
        a as (select image_id, v, bw, bh, y + bh - h y, x + trunc(y*{_TX}e0)::int + bw - w - sw x from px join s3 using (image_id)),
        b as (select image_id, v, bw, bh, x, y - trunc(x*{_SY}e0)::int y from a), c as (select image_id, v, y, x - trunc((bh - y)*{_TX}e0)::int x from b where x >= 0 and x < bw and y >= 0)
        select image_id, y, x, v from c where x >= 0""",
)
_ANGLES = f""", {_SIZE}, k as (select *, least(w, h) q, unnest(range(1, least(w, h) + 1)) k from sz), gy as (select *, {math.pi / 2}e0*k/q a, unnest(range(h)) oy from k), g as (select *, unnest(range(w)) ox from gy),
    tg as (select image_id, w, h, q n, k, ox, (ox - w/2.0e0)*cos(a) - (oy - h/2.0e0)*sin(a) + w/2.0e0 sx, (ox - w/2.0e0)*sin(a) + (oy - h/2.0e0)*cos(a) + h/2.0e0 sy from g), {_READS},
    s as (select image_id, k::int k, ox::int x, sum(sample)/any_value(n) v from q group by image_id, k, ox)"""
_px("j4_radon", lambda p: _round(resample.radon(p), 4).drop("q", "n"), f"{_ANGLES} select image_id, k, x, round(v, 4) + 0.0 v from s")
_px(
    "j4_best_rotation",
    lambda p: resample.best_rotation(resample.radon(p)).selectExpr("image_id", "k", "round(energy, 2) energy", "round(radians, 6) radians"),
    f"""{_ANGLES}, en as (select image_id, k, any_value(least(w, h)) q, sum(v*v)/any_value(greatest(w, h)) - pow(sum(v)/any_value(greatest(w, h)), 2) energy from s join sz using (image_id) group by image_id, k)
        select image_id, k, round(energy, 2) energy, round({math.pi / 2}e0*(k - 1)/q, 6) radians from en qualify row_number() over (partition by image_id order by energy desc, k) = 1""",
)
_px(
    "j6_idct2",
    lambda p: gather.idct2(gather.dct2(p)).withColumn("v", F.round("v").cast("int")),
    ", n as (select image_id, y // 8 by_, x // 8 bx from px group by all having count(*) = 64) select px.image_id, y::int y, x::int x, v from px join n on n.image_id = px.image_id and by_ = y // 8 and bx = x // 8",
)
