"""Values worked out by hand or by plain loops from the operators' rules, inverse pairs and laws."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from samplegrid.functions import color, scalar
from samplegrid.operators import gather, resample, shapes, signals, symbols, wavelet, window
from samplegrid.plans import fixtures, queries

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def image(spark, rows, image_id=0):
    return spark.createDataFrame([(image_id, y, x, v) for y, row in enumerate(rows) for x, v in enumerate(row)], "image_id long, y int, x int, v int")


def grid(df, value="v"):
    return {(r.y, r.x): r[value] for r in df.collect()}


def symbols_of(spark, *docs):
    return spark.createDataFrame([(d, i, s) for d, doc in enumerate(docs) for i, s in enumerate(doc)], "doc_id long, pos int, s int")


NOISE = [[(x * 37 + y * 91 + x * y * 13) % 256 for x in range(12)] for y in range(9)]


def test_fold_pairs(spark):
    rows = symbols.fold_pairs(symbols_of(spark, [10, 20, 200, 3, 7])).orderBy("pos").collect()
    assert [(r.mean, r.diff) for r in rows] == [(15, 5), (101, (3 - 101) % 256)]


def test_block_checksum_and_erasure(spark):
    sy = symbols_of(spark, [1, -1, 2, 5])
    sums = symbols.block_checksum(sy, 2)
    assert {r.block: r.checksum for r in sums.collect()} == {0: 3, 1: 14}
    kept = symbols.erase_bad_blocks(sy, sums.withColumn("checksum", F.expr("if(block = 1, checksum + 1, checksum)")), 2)
    assert [r.s for r in kept.orderBy("pos").collect()] == [1, -1, 0, 0]


def test_block_stats_count_edges_again(spark):
    got = {(r.y, r.x): (r.low, r.high, r["mean"]) for r in window.block_stats(image(spark, NOISE)).collect()}
    assert got.keys() == {(y, x) for y in range(2) for x in range(3)}
    for (y, x), v in got.items():
        taps = [NOISE[min(max(4 * y + dy, 0), 8)][min(max(4 * x + dx, 0), 11)] for dy in range(-2, 3) for dx in range(-2, 3)]
        assert v == (min(taps), max(taps), pytest.approx(sum(taps) / 25, abs=1e-6))


def test_loco_residual_by_loop(spark):
    want = {}
    for y, row in enumerate(NOISE):
        for x, v in enumerate(row):
            if y == 0 or x == 0:
                want[y, x] = v
                continue
            a, b, c = row[x - 1], NOISE[y - 1][x], NOISE[y - 1][x - 1]
            guess = min(a, b) if c >= max(a, b) else max(a, b) if c <= min(a, b) else a + b - c
            d = v - min(max(guess, 0), 255)
            want[y, x] = (2 * d if d >= 0 else -2 * d - 1) / 2
    assert grid(window.loco_residual(image(spark, NOISE)), "residual") == want


def test_haar_gradients(spark):
    assert grid(window.haar_gradients(image(spark, [[10, 4, 1, 2]]))) == {(0, 0): 112, (0, 1): 24, (0, 2): 8 * 261, (0, 3): 8 * 254}


def test_kernel_offsets():
    assert [gather.kernel_offsets(n) for n in range(1, 6)] == [[0], [-1, 1], [-1, 0, 1], [-2, -1, 1, 2], [-2, -1, 0, 1, 2]]


@pytest.mark.parametrize("kernel", [[[1.0], [2.0], [3.0]], [[1.0, 2.0, 3.0]], [[0.5, -1.0], [2.0, 4.0]], [[1.0, 0.0, 2.0, 0.0], [3.0, 5.0, -1.0, 1.0], [0.0, 1.0, 0.0, 2.0]]])
def test_convolution_by_loop(spark, kernel):
    ox, oy = gather.kernel_offsets(len(kernel)), gather.kernel_offsets(len(kernel[0]))
    fold = lambda p, n: -p if p < 0 else 2 * (n - 1) - p if p >= n else p
    want = {(y, x): sum(kernel[i][j] * NOISE[fold(y - oy[j], 9)][fold(x - ox[i], 12)] for i in range(len(ox)) for j in range(len(oy))) for y in range(9) for x in range(12)}
    assert grid(gather.convolve(image(spark, NOISE), kernel)) == pytest.approx(want)
    with pytest.raises(ValueError):
        gather.convolve(image(spark, NOISE), [[1.0], [1.0, 2.0]])


def test_cumulative_golden(spark):
    """256 ones, one more at 1 and five more at 30, 50 set to 10."""
    counts = dict.fromkeys(range(256), 1)
    counts[1], counts[30], counts[50] = 2, 6, 10
    cum = symbols.cumulative(spark.createDataFrame([(0, s, c) for s, c in counts.items()], "doc_id int, s int, cnt long"))
    assert symbols.range_sum(cum, 0, 51).first().total == 66 and symbols.range_sum(cum, 1, 51).first().total == 65
    found = symbols.find_symbol(cum, spark.createDataFrame([(0, 128)], "doc_id int, value long"))
    assert found.first().s == 113


def test_code_lengths_golden(spark):
    want = {
        "fibonacci": {0: 2, 1: 3, 2: 4, 3: 4, 4: 5, 11: 6, 12: 7}, "elias_omega": {1: 1, 2: 3, 3: 3, 4: 6, 8: 7, 16: 11}, "truncated": {0: 2, 2: 2, 3: 3, 4: 3},
        "stout": {0: 5, 1: 5, 255: 3 + 4 + 1 + 8}, "even_rodeh": {3: 3, 4: 4, 8: 8, 200: 16}, "leb128_signed": {0: 8, -1: 8, 63: 8, 64: 16, -64: 8, -65: 16},
    }
    for name, table in want.items():
        for v, n in table.items():
            assert one(spark, scalar.code_len(name, F.lit(v), 5))[0] == n, (name, v)
    big = 2**61 + 1
    assert one(spark, scalar.unzigzag(scalar.zigzag(F.lit(big))), scalar.unzigzag(scalar.zigzag(F.lit(-big)))) == (big, -big)


def test_hue_spaces_round_trip(spark):
    for rgb in [(127, 20, 30), (10, 200, 90), (40, 60, 250), (255, 255, 0), (9, 9, 9), (250, 3, 240)]:
        lit = [F.lit(v) for v in rgb]
        back = one(spark, *color.from_hsp(*color.to_hsp(*lit)))
        assert max(abs(a - b) for a, b in zip(back, rgb, strict=True)) < 9  # bytes of hue are coarse
        h, c, light = color.to_hcl(*lit)
        back = one(spark, *color.from_hcl(h, c * 255, light * 255))
        assert max(abs(a - b) for a, b in zip(back, rgb, strict=True)) <= 1
    assert one(spark, *color.to_hsp(F.lit(255), F.lit(0), F.lit(0)))[:2] == (255, 255)  # red is a whole turn
    assert max(abs(a - b) for a, b in zip(one(spark, *color.from_ycbcr16(color.to_ycbcr16(F.lit(127), F.lit(20), F.lit(30)))), (127, 20, 30), strict=True)) <= 16  # five bits


def test_recency_by_loop(spark):
    rng = random.Random(3)
    docs = [[rng.choice(b"abcde  x") for _ in range(300)], [7], [200, 200, 3]]
    sy = symbols_of(spark, *docs)

    def ranks(doc, listed):
        known, out = list(range(257)) if listed else [], []
        for v in doc:
            out.append(known.index(v) if v in known else v + len(known))
            if v in known:
                known.remove(v)
            known.insert(0, v)
        return out

    for listed in (False, True):
        got = signals.recency_rank(sy, listed=listed).orderBy("doc_id", "pos").collect()
        assert [r["rank"] for r in got] == [i for doc in docs for i in ranks(doc, listed)]
    wide = signals.recency_rank(sy, 2).where("doc_id = 2").collect()
    assert [(r.pos, r["rank"]) for r in wide] == [(0, 200 * 256 + 200)]
    for d, doc in enumerate(docs):
        at, want = list(range(256)), []
        for v in doc:
            i = at.index(v)
            want.append(i)
            if i:
                at[i - 1], at[i] = at[i], at[i - 1]
        assert [r["rank"] for r in signals.bump_rank(sy).where(f"doc_id = {d}").orderBy("pos").collect()] == want
    assert signals.recency_bits(sy).count() == 3


def test_context_sort_round_trip_of_short_documents(spark):
    sy = symbols_of(spark, [5], [1, 2], [3, 3, 3], list(b"abracadabra"))
    back = symbols.context_unsort(symbols.context_sort(sy), symbols.context_lead(sy))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, sy.collect()))


def test_huffman_lengths(spark):
    rows = queries.QUERIES["a3_huffman_lengths"](spark, SF).collect()
    sizes = {r.doc_id: r.bits for r in queries.QUERIES["a3_huffman_size"](spark, SF).collect()}
    assert all(r.bits == sizes[r.doc_id] and r.kraft == 1 for r in rows if r.bits)


def test_zero_runs_restart(spark):
    got = symbols.zero_runs(symbols_of(spark, [0] * 600, [1, 0, 2])).orderBy("doc_id").collect()
    # 252 zeros, a zero, 252 zeros, a zero, 94 zeros
    assert [(r.literals, r.runs, r.bytes) for r in got] == [(2, 3, 8), (2, 1, 4)]


def test_spline_passes_through_cubics(spark):
    x = np.arange(9.0)
    at = np.array([0.0, 0.3, 4.5, 7.9, 8.0])
    cubic = lambda t: t**3 - 4 * t**2 + 3 * t - 2
    assert resample.spline(cubic(x), at) == pytest.approx(cubic(at))
    knots = np.random.default_rng(1).random(20)
    assert resample.spline(knots, np.arange(20.0)) == pytest.approx(knots)
    out = grid(resample.resize_spline(image(spark, [[int(v) for v in 10 * x]] * 4), 18, 4))
    assert out[0, 2] == pytest.approx(10) and out[3, 17] == 80


def test_diffuse_upscale_by_loop(spark):
    one32 = np.float32
    err = acc = one32(0)
    inverse, want = one32(1) / one32(1.5), {}
    for y in range(13):
        sy = one32(y) * inverse
        err, acc = err + (sy - int(sy)), acc + (sy - int(sy))
        for x in range(18):
            sx = one32(x) * inverse
            err = err + (sx - int(sx))
            if err >= 1:
                sx, err = sx + one32(1), err - one32(1.414)
            acc = acc + (sy - int(sy))
            if acc >= 1:
                acc = acc - one32(1)
            want[y, x] = NOISE[min(int(sy + acc), 8)][min(int(sx), 11)]
    assert grid(resample.diffuse_upscale(image(spark, NOISE), 1.5)) == want


def test_fast_rescale_by_loop(spark):
    """The stepwise rule on a line, for ratios over a half and under it."""
    for num, den in ((3, 4), (2, 5)):
        row = NOISE[4]
        n, d = len(row), len(row) * num // den
        out, e, o, v = {}, 0, 0, row[0]
        for k in range(n - 1):
            if e < n >> 1:
                v = (v + row[k + 1]) >> 1
            e += d
            out[o] = v
            if e >= n:
                e, o, v = e - n, o + 1, row[k + 1]
        out[o] = v
        got = grid(resample.on_lines(image(spark, [row]), "x", "transform(a, v -> v)"))
        assert [got[0, i] for i in range(n)] == row
        px = resample.resize_fast(image(spark, [row] * den), num, den)
        assert {x: v for (y, x), v in grid(px).items() if y == 0} == {k: v for k, v in out.items() if k < d}


def test_fft_filter_keeps_slow_waves(spark):
    rows = [[int(128 + 60 * math.sin(2 * math.pi * (x + y) / 32) + 30 * (-1) ** x) for x in range(32)] for y in range(32)]
    low = grid(signals.fft_filter(image(spark, rows), 4, "low"))
    a = np.array([[low[y, x] for x in range(32)] for y in range(32)])
    wave = np.array([[math.sin(2 * math.pi * (x + y) / 32) for x in range(32)] for y in range(32)])
    assert np.corrcoef(a.ravel(), wave.ravel())[0, 1] > 0.99 and a.min() == 0 and a.max() == pytest.approx(255)


def test_wavelets_restore(spark):
    px = gather.pad_pow2(fixtures.emb_raster(spark, SF).where("image_id < 2"))
    for kind, scheme in (("cdf97", "full"), ("cdf53", "half"), ("int53", "half"), ("haar", "half")):
        back = wavelet.reconstruct(wavelet.decompose(px, 2, kind, scheme), 2, kind, scheme)
        assert back.join(px.withColumnRenamed("v", "o"), ["image_id", "y", "x"]).where("abs(v - o) > 1e-6").count() == 0
    assert wavelet.reconstruct(wavelet.decompose(px, 3), 3, scale=3).count() == 2 * 64


def test_densify_and_color_grid(spark):
    from samplegrid.sources.images import color_grid

    px = image(spark, [[1, 2], [3, 4]]).where("x + y < 2")
    assert grid(window.densify(px)) == {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): 0} or grid(window.densify(px))[1, 1] == 0
    colours = color_grid(spark, 3)
    assert colours.count() == 27 and {r.r for r in colours.collect()} == {0, 128, 255}


def test_reachable_spans_and_shapes(spark):
    square = [(1, 0.0, 0.0, 4.0, 0.0), (1, 4.0, 0.0, 4.0, 3.0), (1, 4.0, 3.0, 0.0, 3.0), (1, 0.0, 3.0, 0.0, 0.0)]
    spans = shapes.fill_spans(spark.createDataFrame(square, "shape_id int, ax double, ay double, bx double, by double")).collect()
    assert sorted((r.y, r.left, r.right) for r in spans) == [(0, 0.0, 4.0), (1, 0.0, 4.0), (2, 0.0, 4.0)]
    assert one(spark, shapes.coverage(F.lit(-3.0)), shapes.coverage(F.lit(0.5)), shapes.coverage(F.lit(2.0))) == (255, 127, 0)


def test_tight_cells_by_loop(spark):
    rows = [[(x * 29 + y * 53 + x * y) % 256 for x in range(8)] for y in range(8)]
    px = image(spark, rows).selectExpr("image_id", "y", "x", "v r", "v g", "v b")
    luma = [0.30 * v + 0.59 * v + 0.11 * v for row in rows for v in row]
    mean = sum(luma) / 64
    up, low = ([v for v in luma if (v >= mean) == k] for k in (True, False))
    upper, lower = sum(up) / len(up), sum(low) / len(low)
    for dither in (False, True):
        bits, error = 0, 0.0
        for i, v in enumerate(luma):
            error = 0.0 if i % 8 == 0 else error
            if v >= mean - error:
                bits |= 1 << i
                error += v - upper if dither else 0
            else:
                error += v - lower if dither else 0
        r = shapes.tight_cells(px, dither).first()
        assert r.bits % 2**64 == bits and r["diff"] == int(upper - lower) and r.low == (int(lower) & 252) << 8 | (127 & 252) << 2 | (139 & 240) >> 4
        back = grid(shapes.expand_tight_cells(shapes.tight_cells(px, dither)), "g")
        assert len(back) == 64 and len(set(back.values())) == 2


def test_texture_of_a_flat_triangle_is_the_picture(spark):
    corners = {"x1": 0.0, "y1": 0.0, "x2": 11.0, "y2": 0.0, "x3": 0.0, "y3": 8.0}
    fields = corners | {f"z{k}": 2.0 for k in (1, 2, 3)} | {f"{n}{k}": corners[f"{c}{k}"] for k in (1, 2, 3) for n, c in (("u", "x"), ("v", "y"))}
    triangle = spark.createDataFrame([(7, 0, *fields.values())], "shape_id int, image_id long, " + ", ".join(f"{n} double" for n in fields))
    got = grid(shapes.map_texture(triangle, image(spark, NOISE), 20, 20))
    assert got == {(y, x): NOISE[y][x] for y in range(9) for x in range(12) if x / 11 + y / 8 <= 1 + 1e-9}


def test_rotation_sort_by_loop(spark):
    rng = random.Random(5)
    docs = [list(b"banana"), list(b"mississippi"), [3], [1, 1, 1, 1], *([rng.choice(b"abc") for _ in range(rng.randint(2, 40))] for _ in range(12))]

    def words(s):
        # the longest beginning that is less than all its ends, again and again
        out = []
        while s:
            n = max(k for k in range(1, len(s) + 1) if all(s[:k] < s[i:k] for i in range(1, k)))
            out.append(s[:n])
            s = s[n:]
        return out

    sy = symbols_of(spark, *docs)
    got = {}
    for r in signals.rotation_sort(sy).orderBy("doc_id", "out").collect():
        got.setdefault(r.doc_id, []).append(r.s)
    for d, doc in enumerate(docs):
        turns = [((w[i:] + w[:i]) * (2 * len(doc)), w[i - 1]) for w in words(doc) for i in range(len(w))]
        assert got[d] == [last for _, last in sorted(turns, key=lambda t: t[0][: 2 * len(doc)])]
    assert sorted(map(tuple, signals.rotation_unsort(signals.rotation_sort(sy)).collect())) == sorted(map(tuple, sy.collect()))


def test_cubic_reduction(spark):
    got = grid(resample.reduce_field(image(spark, [[3 * x + y for x in range(8)] for y in range(8)]), 1, "cubic"))
    assert got[0, 0] == pytest.approx(0) and got[1, 2] == pytest.approx(14) and len(got) == 16


def test_reachable_by_rounds(spark):
    side, dist = 24, lambda y, x: 2.5 if 10 <= x <= 11 and y < 16 else 4.7
    field = spark.createDataFrame([(1, y, x, dist(y, x)) for y in range(side) for x in range(side)], "image_id long, y int, x int, dist double")
    hits, seen, front = set(), set(), {(5, 4)}
    while front := {(y, x) for y, x in front if dist(y, x) >= 3}:
        hits |= front
        for y, x in front:
            seen |= {(y + b, x + a) for b in range(-3, 4) for a in range(-3, 4) if a * a + b * b <= 9 and 0 <= y + b < side and 0 <= x + a < side}
        ends = {(y, x + a) for y, x in front for a in (-4, 4) if 0 < x + a < side} | {(y + b, x) for y, x in front for b in (-4, 4) if 0 < y + b < side}
        front = ends - seen
    got = shapes.reachable(field, spark.createDataFrame([(1, 5, 4), (1, 5, 4)], "image_id long, y int, x int")).collect()
    assert {(r.y, r.x) for r in got} == seen and {(r.y, r.x) for r in got if r.hit} == hits and len(hits) > 10
    assert shapes.reachable(field, spark.createDataFrame([(1, 0, 10)], "image_id long, y int, x int")).count() == 0


def test_longest_match_by_loop(spark):
    rng = random.Random(2)
    docs = [[rng.choice(b"ab") for _ in range(80)], list(b"abcabcabcx"), [1, 2]]
    want = {}
    for d, doc in enumerate(docs):
        for i in range(len(doc)):
            best = (0, 0)
            for j in range(max(0, i - 16), i):
                n = 0
                while i + n < len(doc) and doc[i + n] == doc[j + n]:
                    n += 1
                best = max(best, (n, j - i))
            if best[0] >= 3:
                want[d, i] = (best[0], -best[1])
    got = {(r.doc_id, r.pos): (r.len, r.distance) for r in signals.longest_match(symbols_of(spark, *docs), 16).collect()}
    assert got == want


NEW = """c1_ycbcr24 c9_hsp_inverse c10_hcl_inverse c19_colour_pickers c20_invert_hsp src4_pack_argb e3_more_code_lengths e4_texts e10_vectors a2_ngrams_8 a3_huffman_size a5_golomb
    w5_decompose w5_3d w5b_morton w6_soft o3_storage_order r1_resize_fast r2_resize_bicubic a8_range_restore j2_rotate j3_rotate_shear j4_best_rotation j10_fill_spans_winding j11_distance_transform
    a12_composite a6_expand_cells j7_dft st1_butterworth snk1_deinterleave w11_run_blocks w12_adaptive_preset""".split()


@pytest.mark.parametrize("name", NEW)
def test_queries_match_sql(spark, name):
    db = duckdb.connect()
    for t in ("lineitem", "documents", "embeddings", "customer", "events"):
        db.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = db.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({queries.ORACLE[name]})")
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)
