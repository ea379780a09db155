"""Images and frames as tables of samples, and header sniffing."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes of the formats, in hexadecimal; WebP means its lossy form.
MAGIC = {"bmp": ("424D",), "gif": ("474946383761", "474946383961"), "png": ("89504E470D0A1A0A",), "jpeg": ("FFD8",), "webp": ("52494646",)}


def is_image_path(path) -> Column:
    """Not one of the files that a folder of images may hold besides."""
    return ~F.lower(F.col(path) if isinstance(path, str) else path).endswith("desktop.ini")


def _pixels(images: DataFrame) -> DataFrame:
    """(path, w, h, y, x, r, g, b) of Spark's image rows: bytes in blue, green, red order, or one grey byte."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                a = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels)
                a = a[:, :, :3] if row.nChannels >= 3 else np.repeat(a[:, :, :1], 3, 2)
                step = max(1, (1 << 18) // row.width)
                for y in range(0, row.height, step):  # some rows at a time
                    part = a[y : y + step].reshape(-1, 3).astype(np.int32)
                    n = len(part)
                    yield pd.DataFrame({
                        "path": row.path, "w": row.width, "h": row.height, "y": (y + np.arange(n) // row.width).astype(np.int32), "x": (np.arange(n) % row.width).astype(np.int32),
                        "r": part[:, 2], "g": part[:, 1], "b": part[:, 0],
                    })

    flat = images.selectExpr("image.origin path", "image.width width", "image.height height", "image.nChannels nChannels", "image.data data")
    return flat.mapInPandas(run, "path string, w int, h int, y int, x int, r int, g int, b int")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, w, h, y, x, r, g, b): the samples of all images under path, by Spark's decoder; files that are no images are left out."""
    return _pixels(spark.read.format("image").option("dropInvalid", "true").load(path).where(is_image_path("image.origin")))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """read_images() with z: the rank of the last number in the file's name. The ranks come from the paths alone."""
    from pyspark.sql.window import Window

    px = read_images(spark, path)
    number = F.regexp_extract("path", r"(\d+)\D*$", 1).try_cast("long")
    names = spark.read.format("binaryFile").load(path).select("path").where(is_image_path("path"))
    # one row a file; the frames of one block
    z = names.select("path", (F.dense_rank().over(Window.orderBy(number, "path")) - 1).alias("z"))
    base = F.regexp_replace("path", r"^file:/+", "/")
    return px.withColumn("path", base).join(z.withColumn("path", base), "path")


def _jpeg_size(content: bytes) -> tuple[int | None, int | None]:
    """Width and height from the first marker of kind C0; each marker is FF, its kind and the length of what follows, itself included."""
    at = 2
    while content[at : at + 1] == b"\xff" and at + 4 <= len(content):
        if content[at + 1] == 0xC0:
            size = content[at + 5 : at + 9]
            return (int.from_bytes(size[2:], "big"), int.from_bytes(size[:2], "big")) if len(size) == 4 else (None, None)
        at += 2 + max(2, int.from_bytes(content[at + 2 : at + 4], "big"))
    return None, None


#: How the sides are stored: first byte, bytes, byte order, signed, and the bits that count.
SIDES = {
    "bmp": ((18, 4, "little", True, -1), (22, 4, "little", True, -1)), "gif": ((6, 2, "little", False, -1), (8, 2, "little", False, -1)),
    "png": ((16, 4, "big", True, -1), (20, 4, "big", True, -1)), "webp": ((26, 2, "little", False, 0x3FFF), (28, 2, "little", False, 0x3FFF)),
}


def headers(files: DataFrame) -> DataFrame:
    """(path, format, width, height) of files(path, content), from fixed places of the first bytes, or a walk over all markers of a JPEG file. A BMP that is
    stored from the top down has a height below zero. Unknown or cut files have null format or size. Batch or stream."""
    kind = F.lit(None).cast("string")
    head = F.substring("content", 1, 32)
    for name, marks in MAGIC.items():
        kind = F.when(F.substring(F.hex(head), 1, len(marks[0])).isin(*marks), name).otherwise(kind)
    # only JPEG files are read beyond their beginning
    df = files.select("path", kind.alias("format"), F.when(kind == "jpeg", F.col("content")).otherwise(head).alias("bytes"))

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            sizes = []
            for name, data in zip(pdf["format"], pdf["bytes"], strict=True):
                if name == "jpeg":
                    sizes.append(_jpeg_size(bytes(data)))
                    continue
                sides = [(bytes(data[at : at + n]), n, order, signed, mask) for at, n, order, signed, mask in SIDES.get(name, ())]
                sizes.append(tuple(int.from_bytes(x, order, signed=signed) & mask if len(x) == n else None for x, n, order, signed, mask in sides) or (None, None))
            out = pdf[["path", "format"]].copy()
            for k, c in enumerate(("width", "height")):
                out[c] = [s[k] for s in sizes]
                out[c] = out[c].astype("Int32")
            yield out

    return df.mapInPandas(run, "path string, format string, width int, height int")


def read_image_headers(spark: SparkSession, path: str) -> DataFrame:
    return headers(spark.read.format("binaryFile").load(path).where(is_image_path("path")))


def downscale_all(spark: SparkSession, path: str, max_w: int, max_h: int) -> DataFrame:
    """(path, y, x, r, g, b): every image under path at the size that fits it into the box (resample.fit_into); none is enlarged."""
    from samplegrid.operators.resample import fit_into

    px = read_images(spark, path)
    planes = px.select(F.posexplode(F.array("r", "g", "b")).alias("plane", "v"), "path", "y", "x").select(F.struct("path", "plane").alias("image_id"), "y", "x", "v")
    out = fit_into(planes, max_w, max_h).select("image_id.path", "image_id.plane", "y", "x", "v").groupBy("path", "y", "x").pivot("plane", [0, 1, 2]).agg(F.first("v"))
    return out.toDF("path", "y", "x", "r", "g", "b")


def color_grid(spark: SparkSession, n: int) -> DataFrame:
    """(r, g, b): n steps from 0 to 255 on each channel."""
    step = lambda c: F.round(F.col(c) * 255 / (n - 1)).cast("int").alias(c)
    one = lambda c: spark.range(n).select(F.col("id").alias(c))
    return one("r").crossJoin(one("g")).crossJoin(one("b")).select(*map(step, "rgb"))
