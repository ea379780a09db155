"""Scans over blocks, decaying and bounded models, ranks by joins, event time, stored layouts, curves and rings, against loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplegrid.functions import scalar
from samplegrid.operators import gather, models, resample, scan, shapes, signals, symbols
from samplegrid.plans import fixtures
from samplegrid.sources import images, layout

SF = "/root/testdata/sf0.001"


def symbols_of(spark, *docs):
    return spark.createDataFrame([(d, i, v) for d, doc in enumerate(docs) for i, v in enumerate(doc)], "doc_id long, pos int, s int")


def image(spark, rows):
    return spark.createDataFrame([(0, y, x, v) for y, row in enumerate(rows) for x, v in enumerate(row)], "image_id long, y int, x int, v int")


def grid(df, column="v"):
    return {(r.y, r.x): r[column] for r in df.collect()}


def test_scans_equal_loops(spark):
    """Series of one element to several levels of blocks, by blocks of 4."""
    rng = random.Random(1)
    steps = {k: [rng.choice([-3, -1, 1, 2]) for _ in range(n)] for k, n in enumerate((1, 4, 5, 150))}
    df = spark.createDataFrame([(k, i, v) for k, s in steps.items() for i, v in enumerate(s)], "k int, i long, v long")
    df = df.selectExpr("k", "i", "named_struct('c', v, 'lo', -2L, 'hi', 4L, 'tag', i * 10) f")
    got = {(r.k, r.i): (r.before, r.f.tag) for r in scan.states_before(df, ["k"], scan.clamped(1), 4).collect()}
    want = {}
    for k, s in steps.items():
        x = 1
        for i, v in enumerate(s):
            want[k, i] = (x, i * 10)
            x = min(max(x + v, -2), 4)
    assert got == want
    assert scan.states_before(df.limit(0), ["k"], scan.clamped(1), 4).count() == 0


def test_dominance_equals_loop(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randrange(20)) for k, n in ((0, 1), (1, 300), (2, 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, i long, x long")
    got = {(r.k, r.i): r.smaller for r in scan.earlier_smaller(df, ["k"], 4, 3).collect()}
    assert got == {(k, i): sum(1 for k2, i2, x2 in rows if k2 == k and i2 < i and x2 < x) for k, i, x in rows}


def brute_rolling(doc, gain=16, alphabet=257):
    count, bits = [1] * alphabet, 0.0
    for i, s in enumerate(doc):
        bits -= math.log2(count[s] / sum(count))
        taken = doc[i - 1] if i else 0
        count = [c + gain if k == taken else max(1, c - 1) for k, c in enumerate(count)]
    return bits


def test_rolling_and_late_models_by_loop(spark):
    rng = random.Random(4)
    # the last one lets counts decay to the floor and come back
    docs = [[5], [0, 0, 1, 0], [rng.choice(b"aab") for _ in range(200)], [7] * 3 + [rng.choice(range(20, 24)) for _ in range(60)] + [7] * 4 + [0, 7, 0, 7]]
    sy = symbols_of(spark, *docs)
    got = {r.doc_id: r.bits for r in models.rolling_bits(sy).collect()}
    assert got == {d: pytest.approx(brute_rolling(doc)) for d, doc in enumerate(docs)}
    late = {r.doc_id: r.bits for r in models.late_bits(sy, 3).collect()}
    for d, doc in enumerate(docs):
        count, bits = [1] * 257, 0.0
        for i, s in enumerate(doc):
            bits -= math.log2(count[s] / sum(count))
            count[doc[i - 1] if i else 0] += 3
        assert late[d] == pytest.approx(bits)


def test_bit_chain_by_loop(spark):
    rng = random.Random(6)
    # runs of one byte drive a chance to its bounds
    docs = [[rng.randrange(256) for _ in range(40)], [0] * 2500 + [255] * 1500 + [0] * 900, [170] * 3000, [1]]
    want = {}
    for d, doc in enumerate(docs):
        places = [(b >> (7 - k)) & 1 for b in doc for k in range(8)]
        at, history, bits, before = {}, 0, 0.0, 0
        for s in places:
            k = at.get(history, 5000)
            weights = [10001 + max(0, 5000 - k) * 25, 10001 + max(0, k - 5000) * 25]
            bits -= math.log2(weights[s] / (sum(weights) + 1))
            at[history] = min(max(k + (1 if before else -1), 0), 10000)
            history, before = (history << 1 | before) & 65535, s
        want[d] = pytest.approx(bits)
    assert {r.doc_id: r.bits for r in models.bit_chain_bits(symbols_of(spark, *docs), 64).collect()} == want


def test_butterworth_of_a_long_series(spark):
    """Blocks of 8 over 1000 values, and golden terms: a low pass at a quarter of the rate is (1, 2, 1) / (2 + sqrt 2), the rest by hand."""
    terms = signals.butterworth_terms(11, 44)
    assert terms == pytest.approx((1 / (2 + math.sqrt(2)), 2 / (2 + math.sqrt(2)), 1 / (2 + math.sqrt(2)), 0, (2 - math.sqrt(2)) / (2 + math.sqrt(2))))
    rng = random.Random(3)
    terms = signals.butterworth_terms(2, 44, "high", 0.4)
    rows = [(k, t, rng.uniform(-5, 5)) for k, n in ((0, 1000), (1, 1), (2, 17)) for t in range(n)]
    got = {(r.k, r.t): r.filtered for r in signals.butterworth(spark.createDataFrame(rows, "k int, t int, v double"), "k", ["t"], terms, 2.5, 8).collect()}
    for k in range(3):
        own = [v for k2, _, v in rows if k2 == k]
        want, _ = signals._filtered(own, terms, (2.5,) * 4)
        assert [got[k, t] for t in range(len(own))] == pytest.approx(want, abs=1e-9)


def test_keystream_golden(spark):
    """The register by its definition: seven bits and a carry, from the seed on."""
    state, want = [0, 1, 1, 0, 0, 1, 0, 1], []  # 0x65, high bit first
    for _ in range(300):
        byte = 0
        for k in range(8):
            if state[0]:
                byte |= 1 << k
                state[3] ^= 1
                state[7] ^= 1
            state = [*state[1:], 0]
        want.append(byte)
    got = {r.pos: r.s for r in symbols.whiten(symbols_of(spark, [0] * 300), 0x65).collect()}
    assert [got[i] for i in range(300)] == want


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_butterworth_stream_in_event_time(spark, tmp_path):
    """A stream out of order by less than the delay gives the batch's results; a row behind the watermark is dropped."""
    terms = signals.butterworth_terms(4, 44)
    rng = random.Random(7)
    schema = "u int, ts timestamp, n int, v double"
    rows = [(u, t, t * 10 + u, float((t * 37 + u * 11) % 50)) for t in range(60) for u in range(2)]
    mixed = sorted(rows, key=lambda r: (r[1] // 6, rng.random()))  # shuffled within six seconds
    at = lambda df: df.selectExpr("u", "timestamp_seconds(ts + 1000) ts", "n", "v")
    for k in range(4):
        at(spark.createDataFrame(mixed[k * 30 : k * 30 + 30], "u int, ts long, n int, v double")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    late, flush = (0, 3, 999, 1000.0), (9, 10_000, 0, 0.0)
    for row in (late, flush):
        at(spark.createDataFrame([row], "u int, ts long, n int, v double")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        out = signals.butterworth_stream(stream, "u", ["ts", "n"], terms, 5.0, delay="6 seconds")
        query = out.writeStream.format("memory").queryName("ordered").option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {(r.u, r.n): r.filtered for r in spark.table("ordered").collect() if r.u < 9}
    batch = signals.butterworth(at(spark.createDataFrame(rows, "u int, ts long, n int, v double")), "u", ["ts", "n"], terms, 5.0)
    want = {(r.u, r.n): r.filtered for r in batch.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_rotation_sort_by_joins(spark):
    rng = random.Random(5)
    docs = [list(b"banana"), [3], [1, 1, 1, 1], [rng.choice(b"ab") for _ in range(90)], list(b"abcabcabcabd"), list(b"zyx")]
    sy = symbols_of(spark, *docs)
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(signals.rotation_sort(sy))
    for whole in (0, 5):
        assert key(signals.rotation_sort(sy, whole)) == want
        assert key(signals.rotation_unsort(signals.rotation_sort(sy), whole)) == key(sy)


def test_recency_over_many_blocks(spark):
    rng = random.Random(8)
    doc = [rng.choice(range(40)) if rng.random() < 0.9 else 200 + i % 50 for i in range(3000)]
    known, want = [], []
    for v in doc:
        want.append(known.index(v) if v in known else v + len(known))
        if v in known:
            known.remove(v)
        known.insert(0, v)
    assert [r["rank"] for r in signals.recency_rank(symbols_of(spark, doc)).orderBy("pos").collect()] == want


# images


def test_fit_into_a_box(spark):
    """Sizes as the box asks for, and the samples of one picture by the stepwise rule."""
    rng = random.Random(9)
    noise = lambda w, h: [[rng.randrange(256) for _ in range(w)] for _ in range(h)]
    pictures = {0: noise(300, 200), 1: noise(150, 150), 2: noise(90, 100), 3: noise(800, 30), 4: noise(33, 800)}
    px = spark.createDataFrame([(k, y, x, v) for k, p in pictures.items() for y, row in enumerate(p) for x, v in enumerate(row)], "image_id long, y int, x int, v int")
    out = resample.fit_into(px, 100, 100).collect()
    sides = {}
    for r in out:
        w, h = sides.get(r.image_id, (0, 0))
        sides[r.image_id] = (max(w, r.x + 1), max(h, r.y + 1))
    assert sides == {0: (100, 66), 1: (100, 100), 2: (90, 100), 3: (100, 3), 4: (4, 100)}
    assert len(out) == sum(w * h for w, h in sides.values())

    def half(a):
        n = len(a) // 2
        return [(a[max(2 * o - 1, 0)] + 3 * a[2 * o] + 3 * a[2 * o + 1] + a[min(2 * o + 2, 2 * n - 1)]) // 8 for o in range(n)]

    def steps(a, d):
        out, e, o, v = {}, 0, 0, a[0]
        for k in range(len(a) - 1):
            if e < len(a) >> 1:
                v = (v + a[k + 1]) >> 1
            e += d
            out[o] = v
            if e >= len(a):
                e, o, v = e - len(a), o + 1, a[k + 1]
        out[o] = v
        return [out[i] for i in range(d)]

    turn = lambda p: [list(c) for c in zip(*p, strict=True)]
    both = lambda p, f, g: turn([g(c) for c in turn([f(row) for row in p])])
    want = {0: both(both(pictures[0], half, half), lambda a: steps(a, 100), lambda a: steps(a, 66)), 1: both(pictures[1], lambda a: steps(a, 100), lambda a: steps(a, 100)), 2: pictures[2]}
    # 300 by 200 into 100 by 66: both are three times the target, so it is halved once
    got = {(r.image_id, r.y, r.x): r.v for r in out}
    for k, p in want.items():
        assert all(got[k, y, x] == v for y, row in enumerate(p) for x, v in enumerate(row)), k


def test_headers_of_odd_files(spark):
    import struct

    jpeg = lambda segments: b"\xff\xd8" + segments + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", 333, 460) + bytes(9)
    files = {
        "down.bmp": (b"BM" + bytes(16) + struct.pack("<ii", 100, -101) + bytes(30), ("bmp", 100, -101)),
        "big.jpg": (jpeg(b"".join(b"\xff\xe2\xff\xff" + bytes(65533) for _ in range(20))), ("jpeg", 460, 333)),
        "many.jpg": (jpeg(b"\xff\xe1\x00\x04ab" * 300), ("jpeg", 460, 333)),
        "zero.jpg": (b"\xff\xd8\xff\xe1\x00\x00" + bytes(40), ("jpeg", None, None)), "none.jpg": (b"\xff\xd8", ("jpeg", None, None)),
        "cut.bmp": (b"BM" + bytes(18), ("bmp", None, None)), "cut.png": (bytes.fromhex("89504E470D0A1A0A") + bytes(9), ("png", None, None)), "empty": (b"", (None, None, None)),
    }
    df = spark.createDataFrame([(n, data) for n, (data, _) in files.items()], "path string, content binary")
    assert {r.path: (r.format, r.width, r.height) for r in images.headers(df).collect()} == {n: want for n, (_, want) in files.items()}
    assert images.headers(df.selectExpr("path", "cast(null as binary) content")).where("format is not null").count() == 0


def test_convolution_of_narrow_images(spark):
    rows, kernel = [[1, 2, 4], [8, 16, 32]], [[0.5, 1.0, 2.0, 4.0, 8.0, 0.25, 3.0]] * 9
    got = grid(gather.convolve(image(spark, rows), kernel))
    fold = lambda i, n: 0 if n == 1 else min(i % (2 * n - 2), (2 * n - 2) - i % (2 * n - 2))
    want = {}
    for y in range(2):
        for x in range(3):
            want[y, x] = sum(kernel[a][b] * rows[fold(y - oy, 2)][fold(x - ox, 3)] for a, ox in enumerate(gather.kernel_offsets(9)) for b, oy in enumerate(gather.kernel_offsets(7)))
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert grid(gather.convolve(image(spark, [[5]]), [[1.0, 2.0, 3.0]])) == {(0, 0): 30.0}


def test_best_rotation_of_a_tall_image(spark):
    """The spread of sums over the larger side, empty places being 0."""
    rows = [[(x * 5 + y * 3) % 17 for x in range(6)] for y in range(20)]
    sums = resample.radon(image(spark, rows))
    by_angle = {}
    for r in sums.collect():
        by_angle.setdefault(r.k, [0.0] * 20)[r.x] = r.v
    want = {k: np.var(v) for k, v in by_angle.items()}
    best = resample.best_rotation(sums).first()
    assert best.energy == pytest.approx(max(want.values())) and want[best.k] == max(want.values()) and {r.n for r in sums.collect()} == {20}


def test_reduced_fields_of_odd_sides(spark):
    rows = [[(x * 7 + y * 13) % 29 - 14 for x in range(11)] for y in range(9)]
    w, h = 11 >> 1, 9 >> 1
    cells = {
        (y, x): [rows[min(int(y * 9 / h) + b, 8)][min(int(x * 11 / w) + a, 10)] for b in range(math.ceil(9 / h)) for a in range(math.ceil(11 / w))] for y in range(h) for x in range(w)
    }
    px = image(spark, rows)
    assert grid(resample.reduce_field(px, 1, "mean")) == {k: pytest.approx(sum(c) / len(c)) for k, c in cells.items()}
    assert grid(resample.reduce_field(px, 1)) == {k: min(c, key=lambda v: (abs(v), v)) for k, c in cells.items()}
    assert grid(resample.reduce_field(px, 1, "nearest")) == {k: c[0] for k, c in cells.items()}
    assert resample.reduce_field(px, 4).count() == 0


# shapes


def test_spans_of_double_windings(spark):
    """Crossings up, up, down, down at 0, 2, 4, 6 are one span by winding, two by parity."""
    sides = [(1, 0.0, 0.0, 0.0, 2.0), (1, 2.0, 0.0, 2.0, 2.0), (1, 4.0, 2.0, 4.0, 0.0), (1, 6.0, 2.0, 6.0, 0.0)]
    df = spark.createDataFrame(sides, "shape_id int, ax double, ay double, bx double, by double")
    assert sorted((r.y, r.left, r.right) for r in shapes.fill_spans(df, "winding").collect()) == [(0, 0.0, 6.0), (1, 0.0, 6.0)]
    assert sorted((r.left, r.right) for r in shapes.fill_spans(df).where("y = 0").collect()) == [(0.0, 2.0), (4.0, 6.0)]


def test_deep_samples_are_set(spark):
    disc = spark.createDataFrame([(1, 10.0, 10.0, 200)], "id int, cx double, cy double, v int")
    out = grid(shapes.composite(shapes.rasterise(disc, shapes.sdf_circle("dx", "dy", 5), F.lit(6), 32, 32), "id", 40))
    assert out[10, 10] == 200 and out[10, 13] == 200 and out[10, 14] == 199 and out[13, 14] == 199 and out[13, 13] == 199 + (math.hypot(3, 3) < 4)


def test_reachable_through_a_long_corridor(spark):
    field = spark.createDataFrame([(1, y, x, 3.0) for y in range(2) for x in range(100)], "image_id long, y int, x int, dist double")
    got = shapes.reachable(field, spark.createDataFrame([(1, 1, 1)], "image_id long, y int, x int"))
    assert got.agg(F.max("x")).first()[0] >= 97


def test_exact_ellipse_by_search(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(-40, 40), rng.uniform(-40, 40), rng.choice([20.0, 5.0, 9.0]), rng.choice([20.0, 5.0, 0.5])) for _ in range(150)]
    rows += [(x, 0.0, 20.0, 5.0) for x in (0.0, 3.0, 18.74, 18.76, 19.9, 25.0)] + [(0.0, y, 20.0, 5.0) for y in (1.0, 5.0, 9.0)] + [(0.0, 0.0, 7.0, 7.0), (3.0, 4.0, 5.0, 9.0)]
    got = spark.createDataFrame(rows, "x double, y double, a double, b double").select("x", "y", "a", "b", shapes.sdf_ellipse_exact("x", "y", "a", "b").alias("d")).collect()
    for r in got:
        t = np.linspace(0, 2 * np.pi, 4001)
        width = t[1]
        for _ in range(6):
            best = t[np.argmin(np.hypot(r.x - r.a * np.cos(t), r.y - r.b * np.sin(t)))]
            t = np.linspace(best - width, best + width, 401)
            width /= 100
        d = np.hypot(r.x - r.a * np.cos(t), r.y - r.b * np.sin(t)).min()
        assert abs(r.d) == pytest.approx(d, abs=1e-6) and (r.d < 0) == ((r.x / r.a) ** 2 + (r.y / r.b) ** 2 < 1), r


def test_curve_is_the_hull_of_its_circles(spark):
    """The distance to many circles along the parts, with radii that change evenly along them."""
    curve = [(0.0, 0.0, 2.0), (30.0, 5.0, 6.0), (35.0, 30.0, 1.0)]
    rng = random.Random(3)
    rows = [(rng.uniform(-10, 45), rng.uniform(-10, 40)) for _ in range(100)]
    knots = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(r).alias("r")) for x, y, r in curve))
    for r in spark.createDataFrame(rows, "x double, y double").select("x", "y", shapes.sdf_curve("x", "y", knots).alias("d")).collect():
        t = np.linspace(0, 1, 4001)
        least = min((np.hypot(r.x - (a[0] + (b[0] - a[0]) * t), r.y - (a[1] + (b[1] - a[1]) * t)) - (a[2] + (b[2] - a[2]) * t)).min() for a, b in zip(curve, curve[1:], strict=False))
        assert r.d == pytest.approx(least, abs=1e-3)
    inside = spark.range(1).select(shapes.sdf_curve(F.lit(1.0), F.lit(0.0), F.array(*(F.struct(F.lit(x).alias("x"), F.lit(0.0).alias("y"), F.lit(r).alias("r")) for x, r in ((0.0, 9.0), (2.0, 3.0)))))).first()[0]
    assert inside == pytest.approx(-8.0)


def test_ring_covers_its_sweep(spark):
    """Of a circle's band, the angles of the sweep only."""
    rows = [(a, 18.0 * math.cos(math.radians(a)), 18.0 * math.sin(math.radians(a))) for a in range(0, 360, 5)]
    df = spark.createDataFrame(rows, "a int, x double, y double")
    for start, sweep in ((30, 60), (300, 100), (100, 250), (90, -60), (0, 200)):
        got = {r.a for r in df.select("a", shapes.sdf_ring("x", "y", 20, 20, start, sweep, 4).alias("d")).where("d < -0.2").collect()}
        low, high = (start, start + sweep) if sweep > 0 else (start + sweep, start)
        assert got == {a for a in range(0, 360, 5) if any(low + 1 < a + k < high - 1 for k in (0, 360))}, (start, sweep)
    with pytest.raises(ValueError):
        shapes.sdf_ring("x", "y", 20, 20, 0, 0, 4)


def test_lines_of_every_direction(spark):
    """A walk along the longer axis; each step's two samples share the line."""
    rng = random.Random(2)
    lines = [(k, rng.randrange(5, 40), rng.randrange(5, 40), rng.randrange(5, 40), rng.randrange(5, 40)) for k in range(60)] + [(60, 9, 9, 9, 9), (61, 9, 9, 20, 9), (62, 9, 20, 9, 9)]
    got = {}
    for r in shapes.coverage_lines(spark.createDataFrame(lines, "shape_id int, x1 int, y1 int, x2 int, y2 int"), 64, 64).collect():
        got.setdefault(r.shape_id, set()).add((r.i, r.pair, r.y, r.x, r.a, r.under))
    table = shapes.gamma_table()
    for k, x1, y1, x2, y2 in lines:
        dx, dy, sx, sy = abs(x2 - x1), abs(y2 - y1), -1 if x2 < x1 else 1, -1 if y2 < y1 else 1
        x, y, e, want, i = x1 + (sx < 0), y1 + (sy < 0), 0, set(), 0
        while True:
            v = max(-127, min(127, (e + (dx + dy) // 2 - (dx + dy if dx > dy else 0)) * (-sy if dx >= dy else sx)))
            want |= {(i, 0, y, x, table[128 - v], 255 - table[128 + v]), (i, 1, y + (dx > dy), x + (dx <= dy), table[128 + v], 255 - table[128 + v])}
            if i == max(dx, dy):
                break
            right, down = e > -dx, e < dy
            e, x, y, i = e - dy * right + dx * down, x + sx * right, y + sy * down, i + 1
        assert (x, y) == (x2 + (sx < 0), y2 + (sy < 0)) and got[k] == want, k


def test_near_polygon_distances(spark):
    """Equal to all pairs within reach, and without a cross join."""
    rng = random.Random(4)
    points = spark.createDataFrame([(i, rng.uniform(-5, 70), rng.uniform(-5, 70)) for i in range(400)], "id int, x double, y double")
    for reach, rule in ((2.0, "odd"), (11.5, "winding")):
        near = gather.polygon_distance_near(points, fixtures.segments(spark), reach, rule)
        key = lambda r: (r.id, r.shape_id, round(r.distance, 9), r.odd, r.winding)
        want = gather.polygon_distance(points, fixtures.segments(spark), rule).where(F.abs("distance") <= reach)
        assert sorted(map(key, near.collect())) == sorted(map(key, want.collect()))
        assert "Cartesian" not in near._jdf.queryExecution().toString() and "NestedLoop" not in near._jdf.queryExecution().toString()


# layouts


def test_stored_levels_are_pruned(spark, tmp_path):
    from samplegrid.operators import wavelet

    px = gather.pad_pow2(fixtures.emb_raster(spark, SF).where("image_id < 3"))
    path = f"file://{tmp_path}/store"
    layout.write_coefficients(px, path, 3)
    for scale in (0, 2, 3):
        want = wavelet.reconstruct(wavelet.decompose(px, 3), 3, scale=scale)
        assert {(r.image_id, r.y, r.x): round(r.v, 6) for r in layout.read_scale(spark, path, scale).collect()} == {(r.image_id, r.y, r.x): round(r.v, 6) for r in want.collect()}
    plan = layout.read_coefficients(spark, path, 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(level" in plan and "(level" in plan
    files = layout.read_coefficients(spark, path, 2).select("_metadata.file_path").distinct().collect()
    assert {f[0].rpartition("level=")[2].partition("/")[0] for f in files} == {"2", "3"}
    with pytest.raises(ValueError):
        layout.read_scale(spark, path, 4)


def test_morton_windows_skip_files(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = f"{tmp_path}/z"
    df = spark.range(128 * 128).selectExpr("cast(id % 128 as int) x", "cast(id div 128 as int) y", "id v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    layout.write_by_key(df.repartition(3), scalar.morton2("x", "y"), f"file://{path}")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = layout.read_window(spark, f"file://{path}", 5, 60, 40, 90)
    assert {(r.x, r.y) for r in got.collect()} == {(x, y) for x in range(5, 41) for y in range(60, 91)}
    ranges = layout.morton_ranges(5, 60, 40, 90)
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False)) and "Or(Or(" in got._jdf.queryExecution().toString()
    ends = []
    for f in glob.glob(f"{path}/*.parquet"):
        k = pq.read_table(f, columns=["key"])["key"].to_numpy()
        assert (np.diff(k) > 0).all()
        ends.append((k[0], k[-1]))
    ends.sort()
    assert len(ends) > 1 and all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert layout.read_range(spark, f"file://{path}", 100, 200).count() == 101
