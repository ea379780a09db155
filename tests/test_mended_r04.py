"""What was wrong or too large in rasters, against loops."""

import random

import pytest

import __spark_entry__
from samplegrid.operators import resample, shapes, wavelet

SF = "/root/testdata/sf0.001"


def image(spark, rows):
    return spark.createDataFrame([(0, y, x, v) for y, row in enumerate(rows) for x, v in enumerate(row)], "image_id long, y int, x int, v int")


def test_morton_line_of_unequal_sides(spark):
    """Of 2 by 8 samples the last ones have places beyond 16, which are not lifted."""
    rng = random.Random(5)
    rows = [[rng.randrange(256) for _ in range(2)] for _ in range(8)]
    spread = lambda v, at: sum((v >> k & 1) << (2 * k + at) for k in range(8))
    line = {spread(x, 0) + spread(y, 1): float(v) for y, row in enumerate(rows) for x, v in enumerate(row)}
    steps, scale = wavelet.KINDS["cdf97"]
    low, want = {k: v for k, v in line.items() if k < 16}, {k: v / 2 for k, v in line.items() if k >= 16}
    assert len(want) == 8
    for i in range(2):
        places = sorted(low)
        for parity, a in steps:
            old = dict(low)
            for n, k in enumerate(places):
                if k % 2 == parity:
                    left, right = old[places[n - 1]] if n else None, old[places[n + 1]] if n + 1 < len(places) else None
                    low[k] = old[k] + ((right if left is None else left) + (left if right is None else right)) * a
        half = (16 >> i) + 1 >> 1
        moved = {k // 2 + (half if k % 2 else 0): low[k] * scale if k % 2 else low[k] / scale for k in places}
        want |= {k: v / (2 - i) for k, v in moved.items() if k >= half}
        low = {k: v for k, v in moved.items() if k < half}
    want |= low
    got = {r.x: r.v for r in wavelet.decompose_morton(image(spark, rows), 2).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_color_cells_in_any_order(spark):
    """Sums of a cell are those by rows, in whatever order its samples come."""
    rng = random.Random(2)
    cells = [(k, i // 4, i % 4, rng.randrange(40)) for k in range(400) for i in range(16)]
    make = lambda rows: spark.createDataFrame(rows, "image_id long, y int, x int, v int").coalesce(1).selectExpr("image_id", "y", "x", "v r", "255 - v g", "v * 7 % 256 b")
    rows = lambda some: sorted(map(tuple, shapes.color_cells(make(some), False).collect()))
    want = rows(cells)
    for seed in range(3):
        random.Random(seed).shuffle(cells)
        assert rows(cells) == want


def pictures(spark):
    rng = random.Random(11)
    rows = [(k, y, x, rng.randrange(256)) for k, (w, h) in enumerate(((5, 9), (12, 7), (1, 4), (1, 1), (16, 16))) for y in range(h) for x in range(w) if k != 1 or rng.random() < 0.8]
    return spark.createDataFrame(rows, "image_id long, y int, x int, v int").cache()


def near(a, b):
    return len(a) == len(b) and all(p[:-1] == q[:-1] and abs(p[-1] - q[-1]) < 1e-9 for p, q in zip(a, b, strict=True))


def test_projections_by_image_equal_joins(spark, monkeypatch):
    """With gaps in one image; and those of large images come by joins as before."""
    px, rows = pictures(spark), lambda df: sorted(map(tuple, df.collect()))
    want = rows(resample._radon_joined(px, None))
    assert near(rows(resample.radon(px)), want) and near(rows(resample.radon(px, 3)), rows(resample._radon_joined(px, 3)))
    monkeypatch.setattr(resample, "WHOLE", 60)
    assert near(rows(resample.radon(px)), want)


@pytest.mark.parametrize("name", ["j4_radon", "j4_best_rotation"])
def test_projections_make_no_row_of_each_read(spark, name):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "explode(sequence" not in plan


def test_reachable_by_image_equals_rounds(spark, monkeypatch):
    from samplegrid.operators import scan, signals

    field = pictures(spark).selectExpr("image_id", "y", "x", "v / 30 dist")
    start = spark.createDataFrame([(0, 4, 2), (0, 1, 1), (1, 3, 3), (4, 8, 8), (4, 30, 2), (9, 1, 1)], "image_id long, y int, x int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(shapes._reachable_joined(field, start))
    cut, tables = scan.cut, []
    monkeypatch.setattr(scan, "cut", lambda df: tables.append(df) or cut(df))
    assert rows(shapes.reachable(field, start)) == want and len(want) > 20
    assert len(tables) == 1  # and not two a round
    monkeypatch.setattr(signals, "WHOLE", 60)
    assert rows(shapes.reachable(field, start)) == want


def test_textures_by_groups_equal_joins(spark, monkeypatch):
    """Flat triangles, some off the canvas, images that are missing or have gaps, groups of few places."""
    from samplegrid.operators import signals

    rng = random.Random(4)
    corner = lambda: [rng.choice([rng.uniform(-5, 25), float(rng.randrange(20))]) for _ in range(6)]
    some = [(k, rng.choice([0, 1, 4, 4, 4, 8]), *corner(), *(rng.uniform(1, 5) for _ in range(3)), *(rng.uniform(-3, 20) for _ in range(6))) for k in range(60)]
    some += [(60, 4, *([1.0, 2.0, 3.0] * 2), *([1.0] * 9)), (61, 4, 90.0, 95.0, 92.0, 90.0, 91.0, 99.0, *([1.0] * 9))]
    names = ", ".join(f"{n}{k} double" for n in "xyzuv" for k in (1, 2, 3))
    triangles, texture = spark.createDataFrame(some, f"shape_id long, image_id long, {names}"), pictures(spark)
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(shapes._map_texture_joined(triangles, texture, 20, 18))
    assert rows(shapes.map_texture(triangles, texture, 20, 18)) == want and len(want) > 500
    assert rows(shapes._map_texture_each(triangles, texture, 20, 18, 2000)) == want
    monkeypatch.setattr(signals, "WHOLE", 60)
    assert rows(shapes.map_texture(triangles, texture, 20, 18)) == want


def test_textures_make_no_row_of_each_place(spark):
    plan = __spark_entry__.queries()["j14_map_texture"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "explode(sequence" not in plan
