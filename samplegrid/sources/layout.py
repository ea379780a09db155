"""Stored tables whose layout serves their readers: wavelet coefficients in folders by level, and rows in the order of a space-filling key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samplegrid.operators.wavelet import decompose, reconstruct, storage_order


def write_coefficients(px: DataFrame, path: str, levels: int, kind: str = "cdf97", scheme: str = "half", shift: float = 0.0) -> None:
    """Decomposes px(image_id, y, x, v), padded as decompose() asks for, and writes a folder of coefficients for each level (0: the finest details, `levels`: what is
    left), each image's in storage order, and a table of one row with the parameters. One sort by level, image and place."""
    c = storage_order(decompose(px, levels, kind, scheme, shift), levels)
    c = c.repartitionByRange("level", "image_id", "order_pos").sortWithinPartitions("level", "image_id", "order_pos")
    c.write.partitionBy("level").parquet(f"{path}/coefficients")
    parameters = px.sparkSession.range(1).select(F.lit(levels).alias("levels"), F.lit(kind).alias("kind"), F.lit(scheme).alias("scheme"), F.lit(float(shift)).alias("shift"))
    parameters.coalesce(1).write.parquet(f"{path}/parameters")


def read_coefficients(spark: SparkSession, path: str, scale: int = 0) -> DataFrame:
    """The coefficients that an image at 1 / 2^scale of its sides needs: the folders of finer levels are not read."""
    return spark.read.parquet(f"{path}/coefficients").where(F.col("level") >= scale)


def read_scale(spark: SparkSession, path: str, scale: int = 0) -> DataFrame:
    """(image_id, y, x, v) of all stored images at 1 / 2^scale of their sides, from the coarse levels alone."""
    p = spark.read.parquet(f"{path}/parameters").first()
    if not 0 <= scale <= p["levels"]:
        raise ValueError(f"stored images have scales 0 to {p['levels']}")
    c = read_coefficients(spark, path, scale).drop("level", "order_pos")
    return reconstruct(c, p["levels"], p["kind"], p["scheme"], p["shift"], scale)


def write_by_key(df: DataFrame, key: Column, path: str) -> None:
    """df with its key, in files of ranges of the key and in its order within a file, so that a reader of a range skips files and row groups by
    their least and largest keys."""
    df.withColumn("key", key).repartitionByRange("key").sortWithinPartitions("key").write.parquet(path)


def read_range(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """The rows of write_by_key() with low <= key <= high; the bounds reach the scan."""
    return spark.read.parquet(path).where(F.col("key").between(low, high))


def morton_ranges(x0: int, y0: int, x1: int, y1: int, least: int = 4) -> list[tuple[int, int]]:
    """Ranges of 2-D Morton keys that cover the rectangle x0 .. x1 by y0 .. y1 (both included): squares of the quadtree that lie inside it, or are of
    `least` to a side and touch it, neighbouring ones joined. Rows outside the rectangle remain to be filtered."""
    side = 1
    while side <= max(x1, y1):
        side *= 2
    out: list[tuple[int, int]] = []

    def visit(x: int, y: int, side: int, key: int) -> None:
        if x > x1 or y > y1 or x + side <= x0 or y + side <= y0:
            return
        if side <= least or (x0 <= x and x + side - 1 <= x1 and y0 <= y and y + side - 1 <= y1):
            if out and out[-1][1] + 1 == key:
                out[-1] = (out[-1][0], key + side * side - 1)
            else:
                out.append((key, key + side * side - 1))
            return
        half = side // 2
        for k, (dx, dy) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1))):
            visit(x + dx * half, y + dy * half, half, key + k * half * half)

    visit(0, 0, side, 0)
    return out


def read_window(spark: SparkSession, path: str, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """The rows of a table of x and y in Morton order, whose places lie in a rectangle."""
    inside = F.lit(False)
    for low, high in morton_ranges(x0, y0, x1, y1):
        inside = inside | F.col("key").between(low, high)
    return spark.read.parquet(path).where(inside & F.col("x").between(x0, x1) & F.col("y").between(y0, y1)).drop("key")
