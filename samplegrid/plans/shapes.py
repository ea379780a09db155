"""Shapes, fields, cells, Fourier transforms, filters, recency and repeats, with SQL from their own terms where SQL can."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from samplegrid.operators import packed, shapes, signals, window
from samplegrid.plans import fixtures as fx
from samplegrid.plans.registry import add

_EMB = f"with {fx.EMB_RASTER}"
_SYM = f"with {fx.DOC_BYTES}"


def _px(name: str, query, sql: str | None = None) -> None:
    add(name, lambda s, d: query(fx.emb_raster(s, d)), sql and f"{_EMB}{sql}")


def _sy(name: str, query, sql: str | None = None) -> None:
    add(name, lambda s, d: query(fx.doc_bytes(s, d)), sql and f"{_SYM}{sql}")


def _docs(name: str, short, long_, sql: str) -> None:
    """short() of whole documents, long_() of the rows of those that are too long for one."""
    add(name, lambda s, d: packed.by_length(fx.doc_texts(s, d), short, long_), f"{_SYM}{sql}")


# predicates and thresholds

add(
    "f1_inside",
    lambda s, d: fx.rgb_lines(s, d).select("k1", "k2", shapes.inside("r", "g", "b").alias("inside")),
    f"with {fx.RGB_LINES} select k1, k2, (greatest(r, g, b) + least(r, g, b))/510.0e0 <= 0.5 inside from c",
)
_dist = lambda p, axis: window.axis_distance(p, axis, F.col("v") > 127).withColumnRenamed("distance", axis[0] + "d")
_both = lambda p: _dist(p, "x").join(_dist(p, "y"), ["image_id", "y", "x"])


def _run(axis: str) -> str:
    """Distances along an axis as the least one to a change."""
    other, w = ("y", "partition by image_id, y order by x") if axis == "x" else ("x", "partition by image_id, x order by y")
    return f"""c{axis} as (select *, i <> lag(i) over ({w}) s, count(*) over (partition by image_id, {other}) n from i), k{axis} as (select image_id, y, x from c{axis} where s),
        d{axis} as (select c.image_id, c.y, c.x, (case when any_value(c.i) then -1 else 1 end) * coalesce(min(case when k.{axis} <= c.{axis} then c.{axis} - k.{axis} + 1 else k.{axis} - c.{axis} end), any_value(c.n) + c.{axis} + 1) d
            from c{axis} c left join k{axis} k on k.image_id = c.image_id and k.{other} = c.{other} group by c.image_id, c.y, c.x)"""


_FIELD = f", i as (select *, v > 127 i from px), {_run('x')}, {_run('y')}, t as (select image_id, y, x, a.d h, b.d v from dx a join dy b using (image_id, y, x))"
_px("w8_axis_distance_y", lambda p: window.axis_distance(p, "y", F.col("v") > 127), f", i as (select *, v > 127 i from px), {_run('y')} select image_id, y, x, d::bigint distance from dy")
_px(
    "f5_field_threshold",
    lambda p: _both(p).select(
        "image_id", "y", "x", shapes.field_threshold("xd", "yd", 2).alias("plain"), shapes.field_threshold("xd", "yd", 1, 3.0).alias("shaded"), shapes.field_threshold("xd", "yd", 2, steps=True).alias("steps")
    ),
    f"""{_FIELD} select image_id, y, x, case when least(h, v) < 2 then 0 else 255 end plain, 255 - least(greatest(trunc((3 - (least(h, v) - 1))*85.0e0), 0), 255)::int shaded,
        255 - case when least(h, v) < 2 then 127 else 0 end - case when greatest(h, v) < 2 then 127 else 0 end steps from t""",
)
_px(
    "j11_distance_transform",
    lambda p: shapes.distance_transform(p, F.col("v") > 165).select("image_id", "y", "x", *((F.round(c, 6) + 0.0).alias(c) for c in ("dist", "gx", "gy"))),
    """, i as (select image_id, y, x, v > 165 i from px), eg as (select a.image_id, a.y, a.x from i a join i b on a.image_id = b.image_id and abs(a.x - b.x) + abs(a.y - b.y) = 1 and b.y between a.y - 1 and a.y + 1
            where a.i and not b.i group by all),
        n as (select i.image_id, i.y, i.x, any_value(i.i) i, min({'d': (i.x - e.x)*(i.x - e.x) + (i.y - e.y)*(i.y - e.y), 'x': e.x, 'y': e.y}) b from i left join eg e on e.image_id = i.image_id group by i.image_id, i.y, i.x)
        select image_id, y, x, round((case when i then -1 else 1 end)*greatest(1, sqrt(b.d)), 6) + 0.0 dist, round((b.x - x)/greatest(1, sqrt(b.d)), 6) + 0.0 gx, round((b.y - y)/greatest(1, sqrt(b.d)), 6) + 0.0 gy from n""",
)

# shapes: distances of points, and circles of customers on a canvas

_SDF = {
    "circle": (lambda: shapes.sdf_circle("x", "y", 20), "sqrt(x*x + y*y) - 20"),
    "box": (lambda: shapes.sdf_box(F.col("x") - 30, F.col("y") - 20, 12, 6), "sqrt(pow(greatest(abs(x - 30) - 12, 0), 2) + pow(greatest(abs(y - 20) - 6, 0), 2)) + least(greatest(abs(x - 30) - 12, abs(y - 20) - 6), 0)"),
    "line": (
        lambda: shapes.sdf_line("x", "y", 5, 5, 45, 35, 4),
        "sqrt(pow(greatest(abs((x - 25)*0.8e0 + (y - 20)*0.6e0) - 25, 0), 2) + pow(greatest(abs((y - 20)*0.8e0 - (x - 25)*0.6e0) - 2, 0), 2))"
        " + least(greatest(abs((x - 25)*0.8e0 + (y - 20)*0.6e0) - 25, abs((y - 20)*0.8e0 - (x - 25)*0.6e0) - 2), 0)",
    ),
    "ellipse": (lambda: shapes.sdf_ellipse(F.col("x") - 30, F.col("y") - 30, 24, 10), "(sqrt(pow((x - 30)/24, 2) + pow((y - 30)/10, 2)) - 1)*10"),
    "ellipse_blend": (
        lambda: shapes.sdf_ellipse(F.col("x") - 30.5, F.col("y") - 30.5, 24, 10, "blend"),
        """case when sqrt(pow((x - 30.5)/24, 2) + pow((y - 30.5)/10, 2)) < 1 then (sqrt(pow((x - 30.5)/24, 2) + pow((y - 30.5)/10, 2)) - 1)*10 else ((sqrt(pow((x - 30.5)/24, 2) + pow((y - 30.5)/10, 2)) - 1)*10
            + sqrt(pow(x - 30.5, 2) + pow(y - 30.5, 2))*(1 - 1/sqrt(pow((x - 30.5)/24, 2) + pow((y - 30.5)/10, 2))))/2 end""",
    ),
    # a rule of the plane: the distance to the outline, and three sides of the same turn
    "triangle": (
        lambda: shapes.sdf_triangle("x", "y", 5, 5, 60, 8, 30, 55),
        "(case when 55*(y - 5) - 3*(x - 5) >= 0 and -30*(y - 8) - 47*(x - 60) >= 0 and -25*(y - 55) + 50*(x - 30) >= 0 then -1 else 1 end)*sqrt(least("
        + ", ".join(
            f"pow(x - {ax} - {t}*({bx - ax}), 2) + pow(y - {ay} - {t}*({by - ay}), 2)"
            for ax, ay, bx, by in ((5, 5, 60, 8), (60, 8, 30, 55), (30, 55, 5, 5))
            for t in [f"least(greatest(((x - {ax})*({bx - ax}) + (y - {ay})*({by - ay}))/{(bx - ax) ** 2 + (by - ay) ** 2}.0e0, 0), 1)"]
        )
        + "))",
    ),
    "subtract": (lambda: shapes.sdf_subtract(shapes.sdf_circle("x", "y", 20), shapes.sdf_circle("x", "y", 40)), "greatest(20 - sqrt(x*x + y*y), sqrt(x*x + y*y) - 40)"),
    "union": (lambda: shapes.sdf_union(shapes.sdf_circle("x", "y", 20), shapes.sdf_circle(F.col("x") - 40, "y", 10)), "least(sqrt(x*x + y*y) - 20, sqrt(pow(x - 40, 2) + y*y) - 10)"),
    "intersect": (lambda: shapes.sdf_intersect(shapes.sdf_circle("x", "y", 30), shapes.sdf_circle(F.col("x") - 40, "y", 20)), "greatest(sqrt(x*x + y*y) - 30, sqrt(pow(x - 40, 2) + y*y) - 20)"),
}
add(
    "j9_signed_distances",
    lambda s, d: fx.points(s, d).select("id", *(F.round(f(), 6).alias(n) for n, (f, _) in _SDF.items())),
    f"with {fx.POINTS} select id, " + ", ".join(f'round({e}, 6) "{n}"' for n, (_, e) in _SDF.items()) + " from p",
)
_circles = lambda s, d: fx.points(s, d).selectExpr("id", "x cx", "y cy", "cast(id % 5 + 1 as double) r", "cast(id % 256 as int) v")
_COVER = f"""with {fx.POINTS}, k as (select id, x cx, y cy, (id % 5 + 1)::double r, (id % 256)::int v from p), gy as (select range::int y from range(64)), gx as (select range::int x from range(64)),
    d as (select k.*, gy.y, gx.x, sqrt((gx.x - cx)*(gx.x - cx) + (gy.y - cy)*(gy.y - cy)) - r d from k join gy on gy.y between cy - r - 2 and cy + r + 2 join gx on gx.x between cx - r - 2 and cx + r + 2),
    cv as (select *, floor((case when d > 0 then greatest(1 - d, 0) else 1 end)*255)::int a from d)"""
_drawn = lambda s, d: shapes.rasterise(_circles(s, d), shapes.sdf_circle("dx", "dy", F.col("r")), F.col("r") + 1, 64, 64)
add("j9_rasterise", lambda s, d: _drawn(s, d).select("id", "y", "x", "a"), f"{_COVER} select id, y, x, a from cv where a > 0")
add(
    "a12_composite",
    lambda s, d: shapes.composite(_drawn(s, d), "id"),
    f"""{_COVER}, s as (select y, x, list(struct_pack(a := a, v := v, deep := d < -1) order by id) s from cv where a > 0 group by y, x)
        select y, x, list_reduce(list_prepend(0, list_transform(range(1, len(s) + 1), lambda i: i::int)),
            lambda u, i: case when s[i].deep then s[i].v else ((u*(255 - s[i].a)) >> 8) + ((s[i].v*s[i].a) >> 8) end) v from s""",
)
_TRIANGLES = [("c_custkey * 7 % 64", "c_custkey * 13 % 60"), ("c_custkey * 29 % 64 + 0.25", "c_custkey * 5 % 60 + 0.75"), ("c_custkey * 17 % 64 + 0.5", "c_custkey * 31 % 60 + 0.25"), ("c_custkey * 3 % 64", "c_custkey * 23 % 60 + 0.5")]
_RING = [(*a, *b) for a, b in zip(_TRIANGLES, [*_TRIANGLES[1:], _TRIANGLES[0]], strict=True)]


def _segments(s, d):
    sides = ", ".join(f"struct(cast({a} as double) as ax, cast({b} as double) as ay, cast({c} as double) as bx, cast({e} as double) as by)" for a, b, c, e in _RING)
    return fx.table(s, d, "customer").selectExpr("c_custkey shape_id", f"inline(array({sides}))")


_SIDES = " union all ".join(f"select c_custkey shape_id, ({a})::double ax, ({b})::double ay, ({c})::double bx, ({e})::double bz from customer" for a, b, c, e in _RING)
for _rule, _n in (("odd", "row_number() over k % 2"), ("winding", "sum(dir) over k")):
    add(
        f"j10_fill_spans_{_rule}",
        lambda s, d, r=_rule: shapes.fill_spans(_segments(s, d), r).withColumns({c: F.round(c, 6) for c in ("left", "right")}),
        # a span is what lies between two crossings at which nothing is open
        f"""with g as ({_SIDES}), y as (select *, unnest(range(floor(least(ay, bz) + 0.5)::int, floor(greatest(ay, bz) + 0.5)::int)) y from g),
            c as (select shape_id, y::int y, case when ay < bz then 1 else -1 end dir, ax + (y - ay)*(bx - ax)/(bz - ay) cx from y),
            w as (select *, row_number() over k i, {_n} n from c window k as (partition by shape_id, y order by cx, dir rows between unbounded preceding and current row)),
            o as (select *, count(*) filter (n = 0) over (partition by shape_id, y order by i rows between unbounded preceding and 1 preceding) span from w)
            select shape_id, y, round(min(cx), 6) "left", round(max(cx), 6) "right" from o group by shape_id, y, span having bool_or(n = 0)""",
    )

_GAMMA = "gm as (select list_transform(range(256), lambda i: least(255, trunc(pow(i, 1/2.2e0)*(255/pow(255, 1/2.2e0))))::int) t)"
add(
    "j10_span_ends",
    lambda s, d: shapes.span_ends(shapes.fill_spans(_segments(s, d))),
    f"""with {_GAMMA}, g as ({_SIDES}), y as (select *, unnest(range(floor(least(ay, bz) + 0.5)::int, floor(greatest(ay, bz) + 0.5)::int)) y from g),
        c as (select shape_id, y::int y, ax + (y - ay)*(bx - ax)/(bz - ay) cx, case when ay < bz then 1 else -1 end dir from y),
        o as (select *, row_number() over (partition by shape_id, y order by cx, dir) i from c), s as (select shape_id, y, min(cx) l, max(cx) r from o group by shape_id, y, (i + 1) // 2)
        select shape_id, y, floor(l)::int "left", t[trunc((1 - (l - floor(l)))*255)::int + 1] left_cover, floor(r)::int "right", t[trunc((r - floor(r))*255)::int + 1] right_cover from s, gm""",
)
_line = lambda s, d: fx.table(s, d, "customer").selectExpr(
    "c_custkey shape_id", "cast(c_custkey * 7 % 64 as int) x1", "cast(c_custkey * 13 % 60 as int) y1", "cast(c_custkey * 29 % 64 as int) x2", "cast(c_custkey * 31 % 60 as int) y2"
)
# the walk itself: a step along the longer axis each time, one across where the line would be left behind
_WALK = f"""with recursive {_GAMMA}, l as (select c_custkey shape_id, (c_custkey*7 % 64)::int x1, (c_custkey*13 % 60)::int y1, (c_custkey*29 % 64)::int x2, (c_custkey*31 % 60)::int y2 from customer),
    b as (select shape_id, abs(x2 - x1) dx, abs(y2 - y1) dy, case when x2 < x1 then -1 else 1 end sx, case when y2 < y1 then -1 else 1 end sy, x1, y1 from l),
    r as (select shape_id, dx, dy, sx, sy, x1 + case when sx < 0 then 1 else 0 end x, y1 + case when sy < 0 then 1 else 0 end y, 0 e, 0 i from b
        union all select shape_id, dx, dy, sx, sy, x + case when e > -dx then sx else 0 end, y + case when e < dy then sy else 0 end,
            e + case when e > -dx then -dy else 0 end + case when e < dy then dx else 0 end, i + 1 from r where i < greatest(dx, dy)),
    v as (select *, least(greatest((e + (dx + dy) // 2 - case when dx > dy then dx + dy else 0 end)*case when dx >= dy then -sy else sx end, -127), 127) v from r),
    k as (select shape_id, i, y, x, dx > dy steep, t[129 - v] a, t[129 + v] b from v, gm), q as (select *, unnest([0, 1]) pair from k),
    z as (select shape_id, i, pair, y + case when steep then pair else 0 end y, x + case when steep then 0 else pair end x, case pair when 0 then a else b end a, 255 - b under from q),
    ln as (select * from z where y between 0 and 63 and x between 0 and 63)"""
add("j10_lines", lambda s, d: shapes.coverage_lines(_line(s, d), 64, 64), f"{_WALK} select shape_id, i, pair, y, x, a, under from ln")
add(
    "j10_lines_drawn",
    lambda s, d: shapes.composite_lines(shapes.coverage_lines(_line(s, d), 64, 64).withColumn("v", F.expr("cast(shape_id % 256 as int)")), ["shape_id", "i", "pair"]),
    f"""{_WALK}, s as (select y, x, list(struct_pack(a := a, u := under, v := (shape_id % 256)::int) order by shape_id, i, pair) s from ln group by y, x)
        select y, x, list_reduce(list_prepend(0, list_transform(range(1, len(s) + 1), lambda i: i::int)), lambda u, i: ((u*s[i].u) >> 8) + ((s[i].v*s[i].a) >> 8)) v from s""",
)

# curves, rings and the exact ellipse

_CURVE = "array(struct(5D as x, 6D as y, 2D as r), struct(40D as x, 10D as y, 6D as r), struct(50D as x, 45D as y, 1D as r), struct(51D as x, 46D as y, 5D as r))"
_KNOTS = [(5, 6, 2), (40, 10, 6), (50, 45, 1), (51, 46, 5)]


def _hull(p: tuple, q: tuple) -> str:
    """The distance to two circles' hull, from turned coordinates."""
    n2, dr = (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2, p[2] - q[2]
    circle = lambda c: f"(sqrt(pow(x - {c[0]}, 2) + pow(y - {c[1]}, 2)) - {c[2]})"
    if n2 <= dr * dr:
        return f"least({circle(p)}, {circle(q)})"
    n, k = f"sqrt({n2}.0e0)", f"sqrt({n2 - dr * dr}.0e0)"
    u, v = f"abs((x - {p[0]})*{q[1] - p[1]} - (y - {p[1]})*{q[0] - p[0]})/{n}", f"((x - {p[0]})*{q[0] - p[0]} + (y - {p[1]})*{q[1] - p[1]})/{n}"
    along = f"({k}*{v} - {dr}*{u})"
    return f"case when {along} < 0 then {circle(p)} when {along} > {n}*{k} then {circle(q)} else ({k}*{u} + {dr}*{v})/{n} - {p[2]} end"


def _ring_sql(rx: float, ry: float, start: float, sweep: float, thick: float) -> str:
    k, l = f"sqrt(pow(x/{rx}e0, 2) + pow(y/{ry}e0, 2))", "sqrt(x*x + y*y)"  # noqa: E741
    ellipse = f"(case when {k} < 1 then ({k} - 1)*{min(rx, ry)} else (({k} - 1)*{min(rx, ry)} + {l}*(1 - 1/{k}))/2 end)"
    r = max(rx, ry)
    a, b = ((r * math.cos(math.radians(t)), r * math.sin(math.radians(t))) for t in (start, start + sweep))
    mid = ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)
    far = (r - math.hypot(*mid) + 1) * 2
    ring = [(0.0, 0.0), a, (a[0] + mid[0] * far, a[1] + mid[1] * far), (b[0] + mid[0] * far, b[1] + mid[1] * far), b]
    sides = list(zip(ring, [*ring[1:], ring[0]], strict=True))
    near = ", ".join(
        f"pow(x - ({p[0]}e0) - {t}*({q[0] - p[0]}e0), 2) + pow(y - ({p[1]}e0) - {t}*({q[1] - p[1]}e0), 2)"
        for p, q in sides for t in [f"least(greatest(((x - ({p[0]}e0))*({q[0] - p[0]}e0) + (y - ({p[1]}e0))*({q[1] - p[1]}e0))/{(q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2}e0, 0), 1)"]
    )
    crossings = " + ".join(f"(({p[1]}e0 <= y) <> ({q[1]}e0 <= y) and x < ({p[0]}e0) + (y - ({p[1]}e0))*({q[0] - p[0]}e0)/({q[1] - p[1]}e0))::int" for p, q in sides)
    wedge = f"(case when ({crossings}) % 2 = 1 then -1 else 1 end*sqrt(least({near})))"
    band = f"greatest(-({ellipse} + {thick}), {ellipse})"
    return f"greatest({band}, {wedge})" if sweep < 180 else f"greatest(-{wedge}, {band})"


add(
    "j9_pressure_curve",
    lambda s, d: fx.points(s, d).select("id", F.round(shapes.sdf_curve("x", "y", F.expr(_CURVE)), 6).alias("distance")),
    f"with {fx.POINTS} select id, round(least({', '.join(_hull(p, q) for p, q in zip(_KNOTS, _KNOTS[1:]))}), 6) distance from p",  # noqa: B905
)
_RINGS = {"near_quarter": (20.0, 12.0, 30.0, 75.0, 4.0), "most": (12.0, 22.0, 100.0, 250.0, 5.0)}
add(
    "j9_partial_ring",
    lambda s, d: fx.points(s, d).selectExpr("id", "x - 30.25D x", "y - 31.125D y").select("id", *(F.round(shapes.sdf_ring("x", "y", *v), 6).alias(n) for n, v in _RINGS.items())),
    f"with {fx.POINTS}, q as (select id, x - 30.25e0 x, y - 31.125e0 y from p) select id, " + ", ".join(f"round({_ring_sql(*v)}, 6) {n}" for n, v in _RINGS.items()) + " from q",
)
# the least distance to the outline's points by narrowing the angle, ten times by a tenth, from the best of a thousand
add(
    "j9_ellipse_exact",
    lambda s, d: fx.points(s, d).selectExpr("id", "x - 30.25D x", "y - 31.125D y").select("id", F.round(shapes.sdf_ellipse_exact("x", "y", 24, 10), 5).alias("distance")),
    f"""with recursive {fx.POINTS}, q as (select id, abs(x - 30.25e0) x, abs(y - 31.125e0) y from p), n as (select id, x, y, 0 k, pi()/4 a, pi()/4 w from q
            union all select id, x, y, k + 1, arg_min(t, pow(x - 24*cos(t), 2) + pow(y - 10*sin(t), 2)), any_value(w)/4 from (select *, unnest([a + w*i/12.0e0 for i in range(-12, 13)]) t from n where k < 18) group by id, x, y, k)
        select id, round(case when pow(x/24, 2) + pow(y/10, 2) < 1 then -1 else 1 end*sqrt(pow(x - 24*cos(a), 2) + pow(y - 10*sin(a), 2)), 5) distance from n where k = 18""",
)

# colour cells

_RGB = ", x as (select image_id, y, x, v r, 255 - v g, (v*7) % 256 b from px)"
_rgb = lambda p: p.selectExpr("image_id", "y", "x", "v r", "255 - v g", "v * 7 % 256 b")
_WHOLE = ", yuv as (select image_id, y, x, 16 + ((66*r + 129*g + 25*b + 128)>>8) l, 128 + ((-38*r - 74*g + 112*b + 128)>>8) u, 128 + ((112*r - 94*g - 18*b + 128)>>8) v from x)"
_I = "(r*0.30e0 + g*0.59e0 + b*0.11e0)"
_REAL = f""", yuv as (select image_id, y, x, {_I} l, ((b - {_I})*-0.27e0 + (r - {_I})*0.74e0)*0.8393e0 + 127 u, ((b - {_I})*0.41e0 + (r - {_I})*0.48e0)*0.9567e0 + 127 v from x)"""
_cells = lambda p, w: shapes.color_cells(_rgb(p), w)


def _cells_sql(whole: bool) -> str:
    div = (lambda a, b: f"(({a})::bigint // {b})") if whole else (lambda a, b: f"({a}/{b})")
    cut = (lambda x: f"({x})::int") if whole else (lambda x: f"trunc(least(greatest({x}, 0), 255))::int")
    return f"""{_RGB}{_WHOLE if whole else _REAL}, m as (select image_id, y // 4 by_, x // 4 bx, {div('sum(l)', 16)} m, {div('sum(u)', 16)} u, {div('sum(v)', 16)} v from yuv group by all having count(*) = 16)
        select m.image_id, by_::int "by", m.bx::int bx, {cut(f"coalesce({div('sum(l) filter (l >= m)', 'count(*) filter (l >= m)')}, 0)")} upper,
            {cut(f"coalesce({div('sum(l) filter (l < m)', 'nullif(count(*) filter (l < m), 0)')}, 0)")} lower, {cut('any_value(m.u)')} u, {cut('any_value(m.v)')} v,
            sum(case when l >= m then 1 << (y % 4 * 4 + x % 4) else 0 end)::int bits
        from m join yuv on yuv.image_id = m.image_id and yuv.y // 4 = by_ and yuv.x // 4 = m.bx group by m.image_id, by_, m.bx"""


for _whole in (True, False):
    _px("a6_color_cells" if _whole else "a6_color_cells_real", lambda p, w=_whole: _cells(p, w), _cells_sql(_whole))
_clip = lambda s: f"trunc(least(greatest({s}, 0), 255))::int"
_px(
    "a6_expand_cells",
    lambda p: shapes.expand_cells(_cells(p, True)),
    _cells_sql(True).replace("\n        select m.image_id", ", c as (select m.image_id", 1)
    + f""") , o as (select image_id, (c."by"*4 + i // 4)::int y, (c.bx*4 + i % 4)::int x, (case when (bits >> i) & 1 = 1 then upper else lower end - 16)*298 + 128 l, u - 128 u, v - 128 v
        from (select *, unnest(range(16))::int i from c) c)
        select image_id, y, x, {_clip('(l + 409*v) >> 8')} r, {_clip('(l - 100*u - 208*v) >> 8')} g, {_clip('(l + 516*u) >> 8')} b from o""",
)

_TIGHT = f"""{_RGB}{_REAL}, m as (select image_id, y // 8 by_, x // 8 bx, sum(l)/64 m, sum(u)/64 u, sum(v)/64 v from yuv group by all having count(*) = 64),
    c as (select m.image_id, by_::int "by", m.bx::int bx, coalesce(avg(l) filter (l >= m), 0) upper, coalesce(avg(l) filter (l < m), 0) lower, any_value(m.u) u, any_value(m.v) v,
        sum(case when l >= m and y % 8 * 8 + x % 8 < 63 then 1::bigint << (y % 8 * 8 + x % 8) else 0 end)::bigint bits, bool_or(l >= m and y % 8 = 7 and x % 8 = 7) top
        from m join yuv on yuv.image_id = m.image_id and yuv.y // 8 = by_ and yuv.x // 8 = m.bx group by m.image_id, by_, m.bx)"""
_px(
    "a6_tight_cells",
    lambda p: shapes.tight_cells(_rgb(p)),
    f"""{_TIGHT} select image_id, "by", bx, (({_clip('lower')} & 252) << 8) + (({_clip('u')} & 252) << 2) + (({_clip('v + 12')} & 240) >> 4) low, {_clip('upper - lower')} diff,
        case when top then bits - 9223372036854775807 - 1 else bits end bits from c""",
)
_px("a6_tight_cells_dithered", lambda p: shapes.tight_cells(_rgb(p), True))

# signals

_DFT = ", z as (select image_id, y, x, v::double v from px), k as (select range::int k from range(64))"
_px(
    "j7_dft",
    lambda p: signals.dft(p).withColumns({c: F.round(c, 4) + 0.0 for c in ("re", "im")}),
    f"{_DFT} select image_id, y, k, round(sum(v*cos(-2*pi()*((k*x) % 64)/64)), 4) + 0.0 re, round(sum(v*sin(-2*pi()*((k*x) % 64)/64)), 4) + 0.0 im from z, k group by image_id, y, k",
)
_px(
    "j7_dft_inverse",
    lambda p: signals.dft(signals.dft(p), True).select("image_id", "y", "x", F.round("re").cast("int").alias("v")),
    " select image_id, y, x, v from px",
)
_px("j7_fft_filter", lambda p: signals.fft_filter(p, 8, "low").withColumn("v", F.round("v", 4)))
_T = signals.butterworth_terms(4, 44)
_events = lambda s, d: fx.table(s, d, "events").selectExpr("user_id", "ts", "event_id", "value v")
add(
    "st1_butterworth",
    lambda s, d: signals.butterworth(_events(s, d), "user_id", ["ts", "event_id"], _T).select("user_id", "event_id", F.round("filtered", 6).alias("filtered")),
    f"""with recursive e as (select user_id, event_id, value v, row_number() over (partition by user_id order by ts, event_id) i from events),
        f as (select user_id, 0::bigint i, 0::bigint event_id, 0::double x1, 0::double x2, 0::double y1, 0::double y2 from e where i = 1
            union all select e.user_id, e.i, e.event_id, e.v, f.x1, {_T[0]}e0*e.v + {_T[1]}e0*f.x1 + {_T[2]}e0*f.x2 - ({_T[3]}e0)*f.y1 - ({_T[4]}e0)*f.y2, f.y1 from f join e on e.user_id = f.user_id and e.i = f.i + 1)
        select user_id, event_id, round(y1, 6) filtered from f where i > 0""",
)
_digest = lambda df: df.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("rank").alias("total"), F.sum(F.expr("rank * (pos % 97 + 1)")).alias("weighted"))


def _recency_sql(symbols: str, fresh: str) -> str:
    """r(doc_id, pos, rank) of symbols(doc_id, pos, s): the different symbols since the last use are those places in between whose own last use lies
    before it; `fresh` is the rank of a new symbol."""
    return f""", p as (select *, coalesce(lag(pos) over (partition by doc_id, s order by pos), -1) x from {symbols}),
        g as (select doc_id, pos, x, unnest(range(x + 1, pos)) j from p where x >= 0),
        k as (select g.doc_id, g.pos, count(*) rank from g join p q on q.doc_id = g.doc_id and q.pos = g.j where q.x < g.x group by g.doc_id, g.pos),
        f as (select doc_id, pos, s, row_number() over (partition by doc_id order by pos) - 1 known from p where x < 0),
        n as (select f.doc_id, f.pos, {fresh} rank from f),
        r as (select p.doc_id, p.pos, coalesce(k.rank, n.rank, 0) rank from p left join k using (doc_id, pos) left join n using (doc_id, pos))"""


_DIGEST = " select doc_id, count(*) n, sum(rank)::bigint total, sum(rank * (pos % 97 + 1))::bigint weighted from r group by doc_id"
_WIDE = ", t as (select doc_id, pos, s * 256 + lead(s) over (partition by doc_id order by pos) s from sy), d as (select doc_id, pos // 2 pos, s from t where pos % 2 = 0 and s is not null)"
_docs("o9_recency_rank", lambda t: _digest(packed.recency_rank(t)), lambda y: _digest(signals.recency_rank(y)), _recency_sql("sy", "s + known") + _DIGEST)
_docs("o9_recency_rank_wide", lambda t: _digest(packed.recency_rank(t, 2)), lambda y: _digest(signals.recency_rank(y, 2)), _WIDE + _recency_sql("d", "s + known") + _DIGEST)
_sy("o9_bump_rank", lambda y: _digest(signals.bump_rank(y)))
_GREATER = "s + (select count(*) from f o where o.doc_id = f.doc_id and o.pos < f.pos and o.s > f.s)"
_docs(
    "w12_geometric_recency",
    lambda t: packed.recency_bits(t, signals.list_weights()).withColumn("bits", F.round("bits", 4)),
    lambda y: signals.recency_bits(y).withColumn("bits", F.round("bits", 4)),
    _recency_sql("sy", _GREATER)
    + f""", l as (select range i, coalesce([28672, 3585, 449, 57, 7][range + 1], 1) w from range(257))
        select doc_id, round(sum(log2((select sum(w) from l)) - log2(w)), 4) bits from r join l on i = rank group by doc_id""",
)
_sy("o6_rotation_sort", lambda y: signals.rotation_sort(y).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.expr("cast(s as bigint) * (out % 97 + 1)")).alias("weighted")))
_docs("o6_rotation_unsort", lambda t: packed.rotation_unsort(packed.rotation_sort(t)), lambda y: signals.rotation_unsort(signals.rotation_sort(y)), " select doc_id, pos, s from sy")
_docs(
    "j12_repeats",
    lambda t: packed.repeats(t, (16, 64)),
    lambda y: signals.repeats(y, (16, 64)),
    """, t as (select doc_id, hex(encode(text)) h from documents where text <> ''), p as (select doc_id, h, unnest(range(length(h) // 2)) pos from t), l as (select *, unnest([16, 64]) len from p),
        k as (select doc_id, pos, len, hash(substr(h, 2*pos + 1, 2*len)) g from l where 2*(pos + len) <= length(h)),
        m as (select doc_id, pos, len, min(pos) over (partition by doc_id, len, g order by pos range between 8172 preceding and 1 preceding) "match" from k)
        select doc_id, pos, len, "match" from m where "match" is not null""",
)
_docs(
    "j15_longest_match",
    lambda t: packed.longest_match(t, 64),
    lambda y: signals.longest_match(y, 64),
    f""", g as (select doc_id, pos, s*65536 + lead(s, 1) over ({"partition by doc_id order by pos"}) * 256 + lead(s, 2) over ({"partition by doc_id order by pos"}) g, pos // 64 cell from sy),
        b as (select doc_id, g, pos before, unnest([cell, cell + 1]) cell from g where g is not null), q as (select g.doc_id, g.pos, g.pos - before d from g join b using (doc_id, g, cell) where before < pos and pos - before <= 64),
        r as (select *, pos - row_number() over (partition by doc_id, d order by pos) k from q), m as (select *, max(pos) over (partition by doc_id, d, k) - pos + 3 len from r)
        select doc_id, pos::bigint pos, len::bigint len, d::bigint distance from m qualify row_number() over (partition by doc_id, pos order by len desc, d) = 1""",
)
# jumps over the blurred pictures as if they were distances, from the middle of each
_jumps = lambda p: window.box_blur(p, 3).selectExpr("image_id", "y", "x", "v / 24 dist")
_px(
    "j13_reachable",
    lambda p: shapes.reachable(_jumps(p), _jumps(p).groupBy("image_id").agg(F.expr("cast(max(y) div 2 as int) y"), F.expr("cast(max(x) div 2 as int) x"))),
)
_CORNERS = [("c_custkey * 7 % 64", "c_custkey * 13 % 60", "1 + c_custkey % 5"), ("c_custkey * 29 % 64 + 0.25", "c_custkey * 5 % 60 + 0.75", "2 + c_custkey % 3"), ("c_custkey * 17 % 64 + 0.5", "c_custkey * 31 % 60 + 0.25", "1.5")]
_UV = [("0", "0"), ("63", "c_custkey % 40"), ("c_custkey % 64", "39")]
_FIELDS = [(f"{n}{k}", e) for k, (corner, uv) in enumerate(zip(_CORNERS, _UV, strict=True), 1) for n, e in zip("xyzuv", (*corner, *uv), strict=True)]
add(
    "j14_map_texture",
    lambda s, d: shapes.map_texture(
        fx.table(s, d, "customer").selectExpr("c_custkey shape_id", "cast(c_custkey % 10 as bigint) image_id", *(f"cast({e} as double) {n}" for n, e in _FIELDS)), fx.emb_raster(s, d), 64, 64
    ),
    f"""{_EMB}, t as (select c_custkey shape_id, (c_custkey % 10)::bigint image_id, {", ".join(f"({e})::double {n}" for n, e in _FIELDS)} from customer),
        ar as (select *, (x2 - x1)*(y3 - y1) - (x3 - x1)*(y2 - y1) area from t), gy as (select range::int y from range(64)), gx as (select range::int x from range(64)),
        g as (select *, ((x2 - x)*(y3 - y) - (x3 - x)*(y2 - y))/area a, ((x3 - x)*(y1 - y) - (x1 - x)*(y3 - y))/area b from ar join gy on y between least(y1, y2, y3) and greatest(y1, y2, y3)
            join gx on x between least(x1, x2, x3) and greatest(x1, x2, x3) where area <> 0),
        n as (select *, 1 - a - b c from g), z as (select *, a/z1 + b/z2 + c/z3 iz from n where a >= -1e-9 and b >= -1e-9 and c >= -1e-9), m as (select image_id, max(x) tw, max(y) th from px group by image_id),
        f as (select shape_id, z.image_id, y, x, least(greatest(floor((a*v1/z1 + b*v2/z2 + c*v3/z3)/iz + 1e-6), 0), th)::int ty, least(greatest(floor((a*u1/z1 + b*u2/z2 + c*u3/z3)/iz + 1e-6), 0), tw)::int tx from z join m on m.image_id = z.image_id)
        select shape_id, f.y, f.x, px.v from f join px on px.image_id = f.image_id and px.y = ty and px.x = tx""",
)
