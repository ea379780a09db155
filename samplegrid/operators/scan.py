"""Scratch tables, prefix scans over blocks and ranks of a whole table: what recurrences and sorts of very long series are made of."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Elements that one task folds at a time.
BLOCK = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir); a local one only where that is unset and the master local."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="samplegrid-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as a Parquet scratch table, read back: the lineage ends, statistics are kept, and lost executors cost a read."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by cut() that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@dataclass(frozen=True)
class Maps:
    """Functions of a state that are closed under composition. apply(state, f) is the next state, merge(f, g) the function that is f, then
    g; both make SQL of SQL. unit and start are SQL of the identity and of the first state."""

    apply: Callable[[str, str], str]
    merge: Callable[[str, str], str]
    unit: str
    start: str


#: x -> least(greatest(x + c, lo), hi)
def clamped(start: int) -> Maps:
    bound = lambda x, f: f"least(greatest({x} + {f}.c, {f}.lo), {f}.hi)"
    merge = lambda f, g: f"named_struct('c', {f}.c + {g}.c, 'lo', {bound(f'{f}.lo', g)}, 'hi', {bound(f'{f}.hi', g)})"
    # with more room than any sum of steps needs
    far = 1 << 60
    return Maps(bound, merge, f"named_struct('c', 0L, 'lo', {-far}L, 'hi', {far}L)", f"{start}L")


#: (y1, y2) -> (a * y1 + b * y2 + p, c * y1 + d * y2 + q)
def affine(start: float) -> Maps:
    def at(y1: str, y2: str, f: str, p: str = "1D") -> tuple[str, str]:
        return f"{f}.a * {y1} + {f}.b * {y2} + {p} * {f}.p", f"{f}.c * {y1} + {f}.d * {y2} + {p} * {f}.q"

    def merge(f: str, g: str) -> str:
        columns = [at(f"{f}.{u}", f"{f}.{v}", g, one) for u, v, one in (("a", "c", "0D"), ("b", "d", "0D"), ("p", "q", "1D"))]
        names = (("a", "c"), ("b", "d"), ("p", "q"))
        pairs = {n: e for ns, es in zip(names, columns, strict=True) for n, e in zip(ns, es, strict=True)}
        return "named_struct(" + ", ".join(f"'{n}', {pairs[n]}" for n in "abcdpq") + ")"

    def apply(y: str, f: str) -> str:
        y1, y2 = at(f"{y}.y1", f"{y}.y2", f)
        return f"named_struct('y1', {y1}, 'y2', {y2})"

    return Maps(apply, merge, "named_struct(" + ", ".join(f"'{n}', {int(n in 'ad')}D" for n in "abcdpq") + ")", f"named_struct('y1', {start!r}D, 'y2', {start!r}D)")


def states_before(df: DataFrame, keys: list[str], maps: Maps, size: int = BLOCK) -> DataFrame:
    """(keys, i, f, before) of df(keys, i, f), where i counts from 0 in each series: the state that element i meets. f may hold more
    fields than its function needs.

    A series is cut into blocks of `size` elements. The compositions of blocks are elements of a shorter series, whose states are found
    in the same way, so a series of any length is dealt over all tasks, and a task holds one block. Each level is a scratch
    table of 1 / size of the rows of the one below.
    """
    last = df.agg(F.max("i")).first()[0]
    blocks = df.groupBy(*keys, F.expr(f"i div {size}").alias("b")).agg(F.expr("array_sort(collect_list(struct(i, f)))").alias("e"))
    if last is None or last < size:
        blocks = blocks.withColumn("x", F.expr(maps.start))
    else:
        whole = cut(blocks.select(*keys, F.col("b").alias("i"), F.expr(f"aggregate(e, {maps.unit}, (a, t) -> {maps.merge('a', 't.f')})").alias("f")))
        above = states_before(whole, keys, maps, size).select(*keys, F.col("i").alias("b"), F.col("before").alias("x"))
        blocks = blocks.join(above, [*keys, "b"])
    walk = f"aggregate(e, named_struct('x', x, 'out', slice(array(x), 1, 0)), (a, t) -> named_struct('x', {maps.apply('a.x', 't.f')}, 'out', concat(a.out, array(a.x))), a -> a.out)"
    found = blocks.select(*keys, "e", F.expr(walk).alias("s"))
    return found.select(*keys, F.expr("inline(zip_with(e, s, (t, x) -> named_struct('i', t.i, 'f', t.f, 'before', x)))"))


def ranked(keys: DataFrame, order: list[str]) -> DataFrame:
    """keys, which have no repeats, with rank: longs in their order, by a sort of the whole table over ranges."""
    return cut(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id()))


def split_by_size(df: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the series of at most `most` rows, and those of longer ones (None if there are none)."""
    long_ = cut(df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most).select(key))
    if not long_.limit(1).count():
        return df, None
    return df.join(long_, key, "left_anti"), df.join(long_, key, "left_semi")


def earlier_smaller(df: DataFrame, keys: list[str], size: int = 64, fan: int = 16) -> DataFrame:
    """df(keys, i, x, ...) with smaller: how many rows of the same keys have a smaller i and a smaller x (longs; i from 0, without repeats).

    Rows of one block of `size` places are compared in an array. Then blocks are merged, `fan` at a time: in the order of x, a row meets the running
    counts of the blocks to the left of its own. Each merge is one window over the merged blocks; the last one has all rows of its
    keys in one sorted stream."""
    names = [c for c in df.columns if c not in (*keys, "i", "x")]
    rest, fields = ", ".join(("i", "x", *names)), ", ".join(f"'{c}', t.{c}" for c in ("i", "x", *names))
    least = "filter(e, u -> u.i < t.i and u.x < t.x)"
    blocks = df.groupBy(*keys, F.expr(f"i div {size}").alias("b")).agg(F.expr(f"collect_list(struct({rest}))").alias("e"))
    out = blocks.select(*keys, F.expr(f"inline(transform(e, t -> named_struct({fields}, 'smaller', cast(size({least}) as long))))"))
    last = df.agg(F.max("i")).first()[0] or 0
    while last >= size:
        out = out.withColumns({"whole": F.expr(f"i div {size * fan}"), "child": F.expr(f"i div {size} % {fan}")})
        below = Window.partitionBy(*keys, "whole").orderBy("x").rangeBetween(Window.unboundedPreceding, -1)
        left = F.array(*(F.count_if(F.col("child") <= c).over(below) for c in range(fan - 1)))
        more = F.when(F.col("child") > 0, F.coalesce(F.element_at(left, F.greatest(F.col("child"), F.lit(1)).cast("int")), F.lit(0))).otherwise(0)
        out = out.withColumn("smaller", F.col("smaller") + more).drop("whole", "child")
        size *= fan
    return out
