"""Shared pieces: scratch tables in the cluster's shared folder, size-checked broadcasts, joins on hot keys, connected
components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of (key, long) up to which a side is broadcast: about 10 MB.
BROADCAST_ROWS = 200_000
#: A key with more than one in HOT_KEYS of all rows, and over HOT_ROWS of them, is hot: there are fewer than HOT_KEYS such keys.
HOT_KEYS, HOT_ROWS = 100_000, 1000


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local folder only where it is unset and the master is local (tests)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="samplegrid-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to a Parquet scratch table and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by materialize() that nothing reads any more."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, df._scratch
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow in batches of 1000 rows, where the session sets no size of its own: at whole texts, the usual 10,000
    rows make batches of tens of MB, held outside the heap and once more in the Python worker."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, "1000")
    return df.mapInArrow(run, schema)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (narrow, already materialized) with a broadcast hint if it has at most `rows` rows; else a shuffle join stays."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def by_key(left: DataFrame, right: DataFrame, key: str | list[str], total: int, how: str = "inner") -> DataFrame:
    """left join right on key (how: inner or left), where right is narrow, has one row a key, and n, the rows of left with
    that key; total is the sum of n or more. Rows of hot keys meet right in a broadcast, which is bounded as there are
    fewer than HOT_KEYS hot keys; all others are shuffled. So no key gathers more than max(HOT_ROWS, total / HOT_KEYS)
    rows in a task. left and right should be scratch tables: they are read more than once if there are hot keys."""
    most = max(HOT_ROWS, total // HOT_KEYS)
    hot = right.where(F.col("n") > most).drop("n")
    if total <= most or not hot.limit(1).count():
        return left.join(right.drop("n"), key, how)
    hot = F.broadcast(hot)
    rest = left.join(hot, key, "left_anti").join(right.where(F.col("n") <= most).drop("n"), key, how)
    return left.join(hot, key).unionByName(rest)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge to another node; component is the smallest node reachable.

    Alternates large-star and small-star steps until the edge set stops changing (O(log^2) rounds). Each
    step is a grouped minimum plus an equi-join in which the neighbours of a hub are not gathered; edges never leave the
    executors, each round is a written table.
    Null ends and loops are ignored; an empty input gives an empty result.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = materialize(e, "cc")
    mark = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or now[0] == 0:
            break
        mark = now
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = by_key(both, low, "u", 2 * now[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        step = by_key(large, low, "u", 2 * now[0]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        done, e = e, materialize(step.union(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        discard(done)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
