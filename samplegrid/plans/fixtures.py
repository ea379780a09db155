"""Rasters, symbols and points derived from the driver's tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image for each label in a block of 640 vectors, one row per vector, 64 samples of 0..255 a row. Images keep their size
    and grow in number with the table."""
    e = table(spark, sf_dir, "embeddings").selectExpr("cast(label + 10 * (vec_id div 640) as bigint) image_id", "vec_id", "embedding")
    e = e.withColumn("y", F.dense_rank().over(Window.partitionBy("image_id").orderBy("vec_id")) - 1)
    e = e.select("image_id", "y", F.posexplode("embedding").alias("x", "e"))
    v = F.least(F.greatest(F.floor(127.5 + 127.5 * F.col("e").cast("double")), F.lit(0)), F.lit(255)).cast("int")
    return e.select("image_id", "y", "x", v.alias("v"))


EMB_RASTER = """e as (select (label + 10 * (vec_id // 640))::bigint image_id, dense_rank() over (partition by label, vec_id // 640 order by vec_id) - 1 y, embedding, unnest(range(64)) x from embeddings),
    px as (select image_id, y, x, least(greatest(floor(127.5 + 127.5 * cast(embedding[x + 1] as double)), 0), 255)::int v from e)"""


def rgb_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    return t.selectExpr("l_orderkey k1", "l_linenumber k2", "cast(l_partkey % 256 as int) r", "cast(l_suppkey % 256 as int) g", "cast(l_orderkey % 256 as int) b")


RGB_LINES = "c as (select l_orderkey k1, l_linenumber k2, (l_partkey % 256)::int r, (l_suppkey % 256)::int g, (l_orderkey % 256)::int b from lineitem)"


def doc_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte of every text: its UTF-8 read as Latin-1 has a character of the same number for each byte."""
    bytes_ = F.split(F.decode(F.encode("text", "utf-8"), "iso-8859-1"), "")
    t = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.posexplode(bytes_).alias("pos", "c"))
    return t.select("doc_id", "pos", F.ascii("c").alias("s"))


def doc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, b, n): the UTF-8 of every text that has any, and its bytes."""
    return table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.encode("text", "utf-8").alias("b"), F.octet_length("text").alias("n"))


DOC_BYTES = """h as (select doc_id, regexp_extract_all(hex(encode(text)), '..') b from documents),
    i as (select doc_id, unnest(b) b, unnest(range(len(b))) pos from h),
    sy as (select doc_id, pos::int pos, ('0x' || b)::int s from i)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer")
    return t.selectExpr("c_custkey id", "cast(c_custkey % 64 as double) x", "(cast(c_acctbal as double) + 1000) * 63 / 11000 y")


POINTS = "p as (select c_custkey id, (c_custkey % 64)::double x, (c_acctbal::double + 1000) * 63 / 11000 y from customer)"

#: Fixed shapes: a triangle, a concave arrow and a self-crossing star.
POLYGONS = {
    1: [(5.0, 5.0), (60.0, 8.0), (30.0, 55.0)],
    2: [(10.0, 10.0), (55.0, 30.0), (10.0, 50.0), (25.0, 30.0)],
    3: [(32.0, 2.0), (50.0, 60.0), (3.0, 22.0), (61.0, 22.0), (14.0, 60.0)],
}
SEGMENTS = [(s, *ring[i], *ring[(i + 1) % len(ring)]) for s, ring in POLYGONS.items() for i in range(len(ring))]


def segments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEGMENTS, "shape_id int, ax double, ay double, bx double, by double")


SEGMENTS_SQL = "s(shape_id, ax, ay, bx, \"by\") as (values " + ", ".join(f"({a}, {b}::double, {c}::double, {d}::double, {e}::double)" for a, b, c, d, e in SEGMENTS) + ")"
