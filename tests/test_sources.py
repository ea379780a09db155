"""Image files, frames, headers and streams, on files made here."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from samplegrid.operators import signals
from samplegrid.sources import images
from samplegrid.streaming.intake import stream_images


def png(w, h, pixel):
    """An 8-bit RGB file of pixel(x, y)."""
    rows = b"".join(b"\0" + bytes(c for x in range(w) for c in pixel(x, y)) for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


HEADERS = {
    "a.png": (png(512, 512, lambda x, y: (0, 0, 0))[:60], ("png", 512, 512)),
    "b.jpg": (b"\xff\xd8\xff\xe0\x00\x10" + bytes(14) + b"\xff\xdb\x00\x43" + bytes(65) + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", 333, 460) + bytes(9), ("jpeg", 460, 333)),
    "c.bmp": (b"BM" + bytes(16) + struct.pack("<ii", 100, 101) + bytes(30), ("bmp", 100, 101)),
    "d.gif": (b"GIF89a" + struct.pack("<hh", 100, 99) + bytes(20), ("gif", 100, 99)),
    "e.webp": (b"RIFF" + bytes(4) + b"WEBPVP8 " + bytes(4) + bytes(3) + b"\x9d\x01\x2a" + struct.pack("<HH", 760, 997 | 0x4000) + bytes(8), ("webp", 760, 997)),
    "f.txt": (b"no image", (None, None, None)),
    "g.jpg": (b"\xff\xd8\xff\xe0\x00\x10", ("jpeg", None, None)),
    "desktop.ini": (b"GIF89a", None),
}


@pytest.fixture
def folder(tmp_path):
    for name, (data, _) in HEADERS.items():
        (tmp_path / name).write_bytes(data)
    return f"file://{tmp_path}"


def test_headers(spark, folder):
    got = {r.path.rpartition("/")[2]: (r.format, r.width, r.height) for r in images.read_image_headers(spark, folder).collect()}
    assert got == {n: want for n, (_, want) in HEADERS.items() if want}


def test_stream_of_headers_equals_batch(spark, folder, tmp_path):
    query = stream_images(spark, folder).writeStream.format("memory").queryName("seen").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda r: r.path
    assert sorted(spark.table("seen").collect(), key=key) == sorted(images.read_image_headers(spark, folder).collect(), key=key)


def test_images_and_frames(spark, tmp_path):
    for k in (2, 10, 1):
        (tmp_path / f"frame{k}.png").write_bytes(png(3, 2, lambda x, y, k=k: (k, x, y)))
    (tmp_path / "notes.txt").write_text("no image")
    got = images.read_frames(spark, f"file://{tmp_path}/*.png").collect()
    assert {(r.z, r.y, r.x): (r.r, r.g, r.b) for r in got} == {(z, y, x): (k, x, y) for z, k in enumerate((1, 2, 10)) for y in range(2) for x in range(3)}
    assert {(r.w, r.h) for r in images.read_images(spark, f"file://{tmp_path}").collect()} == {(3, 2)}


def test_downscale_all(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(16, 8, lambda x, y: (100, x, y)))
    (tmp_path / "b.png").write_bytes(png(4, 4, lambda x, y: (7, 8, 9)))
    out = images.downscale_all(spark, f"file://{tmp_path}", 8, 8)
    sizes = {r.path.rpartition("/")[2]: (r.w, r.h) for r in out.groupBy("path").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).collect()}
    assert sizes == {"a.png": (8, 4), "b.png": (4, 4)}
    assert {r.r for r in out.where("path like '%a.png'").collect()} == {100}


def test_butterworth_stream_equals_batch(spark, tmp_path):
    terms = signals.butterworth_terms(4, 44, "high", 1.0)
    rows = [(u, t, float((t * 37 + u * 11) % 50)) for t in range(40) for u in range(3)]
    schema = "u int, t int, v double"
    for k in range(4):
        spark.createDataFrame(rows[k * 30 : k * 30 + 30], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    out = signals.butterworth_stream(stream, "u", ["t"], terms, prime=5.0)
    query = out.writeStream.format("memory").queryName("filtered").option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = {(r.u, r.t): r.filtered for r in signals.butterworth(spark.createDataFrame(rows, schema), "u", ["t"], terms, prime=5.0).collect()}
    got = {(r.u, r.t): r.filtered for r in spark.table("filtered").collect()}
    assert got.keys() == batch.keys() and all(got[k] == pytest.approx(batch[k]) for k in batch)
    low = signals.butterworth(spark.createDataFrame([(0, t, 9.0) for t in range(80)], schema), "u", ["t"], signals.butterworth_terms(4, 44)).orderBy("t").collect()
    assert low[-1].filtered == pytest.approx(9, abs=1e-3)  # a low pass lets a constant through
