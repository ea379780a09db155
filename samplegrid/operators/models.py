"""Adaptive models whose counts do not only grow: decaying counts, and chances that are nudged between two bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from samplegrid.operators.scan import clamped, cut, states_before
from samplegrid.operators.symbols import line


def _late(sy: DataFrame) -> DataFrame:
    """(doc_id, s, j, real): each symbol at the step at which a model that learns one symbol late takes it in; at step 0 it takes in a 0."""
    first = sy.select("doc_id").distinct().select("doc_id", F.lit(0).alias("s"), F.lit(0).alias("j"), F.lit(False).alias("real"))
    return sy.select("doc_id", "s", (F.col("pos") + 1).alias("j"), F.lit(True).alias("real")).union(first)


def late_bits(sy: DataFrame, gain: int = 2, alphabet: int = 257) -> DataFrame:
    """(doc_id, bits) of an adaptive model without context that learns each symbol one symbol late, beginning with a 0: counts start at one and
    grow by `gain`."""
    own = Window.partitionBy("doc_id", "s").orderBy("j")
    p = _late(sy).withColumns({"seen": F.row_number().over(own) - 1, "again": F.lag("j").over(own)}).where("real")
    share = (1 + gain * (F.col("seen") - F.when(F.col("again") == F.col("j") - 1, 1).otherwise(0))) / (alphabet + gain * (F.col("j") - 1))
    return p.groupBy("doc_id").agg(F.sum(-F.log2(share)).alias("bits"))


def rolling_bits(sy: DataFrame, gain: int = 16, alphabet: int = 257) -> DataFrame:
    """(doc_id, bits) of the rolling model: a symbol that is taken in (one symbol late, first a 0) has `gain` more, all others one less, down to one.

    A symbol's count falls in a straight line between its places, so what it has where it comes again is a walk with a floor:
    the running sum of gains less gaps, less the running minimum of that. The sum of all counts is `gain` for each step less the symbols that
    fall at it; each place of a symbol makes it fall from the next step on until its floor or its next place, so ends of falls are counted by
    step. Windows alone; a document's symbols are one window group for the sum."""
    own = Window.partitionBy("doc_id", "s").orderBy("j")
    drift = (gain + 1) * F.row_number().over(own) - F.col("j")
    p = _late(sy).withColumn("drift", drift)
    p = p.withColumn("low", 1 + F.col("drift") - F.min("drift").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumns({"last": F.lag("j").over(own), "low_then": F.lag("low").over(own), "next": F.lead("j").over(own)})
    count = F.when(F.col("last").isNull(), 1).when(F.col("last") == F.col("j") - 1, F.col("low_then")).otherwise(F.greatest(F.lit(1), F.col("low_then") + gain - (F.col("j") - 2 - F.col("last"))))
    ends = p.select("doc_id", F.least("next", F.col("j") + F.col("low") + gain).alias("i")).groupBy("doc_id", "i").agg(F.count("*").alias("ends"))
    p = p.where("real").select("doc_id", (F.col("j") - 1).alias("i"), count.alias("count")).join(ends, ["doc_id", "i"], "left")
    by_step = Window.partitionBy("doc_id").orderBy("i")
    p = p.withColumn("ended", F.sum(F.coalesce("ends", F.lit(0))).over(by_step.rowsBetween(Window.unboundedPreceding, 0)))
    ended = F.coalesce(F.sum("ended").over(by_step.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    i = F.col("i").cast("long")
    p = p.withColumn("all", alphabet + gain * i - (i * (i - 1) / 2).cast("long") + ended)
    return p.groupBy("doc_id").agg(F.sum(-F.log2(F.col("count") / F.col("all"))).alias("bits"))


#: Steps between the least and the largest chance of the bit chain; weight of a bit, and what a step from the middle adds to it.
CHAIN_STEPS, CHAIN_WEIGHT, CHAIN_GAIN = 10_000, 10_000, 25


def bit_chain_bits(sy: DataFrame, size: int = 256) -> DataFrame:
    """(doc_id, bits) of coding each byte's bits, high first, by a chance kept for each history of 16 bits, the last bit left out: it starts in the
    middle of 10,000 steps, and each bit that follows the history in turn moves it a step, no further than either end. The more likely bit weighs 10,000 and 25
    for each step from the middle, the other 10,000, and all three symbols (two bits and an end) one more.

    The chance is counted in whole steps. A walk between two bounds is a scan of functions (scan.clamped), so neither a long document nor a
    frequent history is one task's work; histories of fewer places than half the steps can't reach a bound, and are running sums."""
    w = line()
    word = F.col("s").cast("long")
    for k in (1, 2, 3):
        word = word + F.shiftleft(F.coalesce(F.lag("s", k).over(w), F.lit(0)).cast("long"), 8 * k)
    p = sy.select("doc_id", "pos", word.alias("word")).select("doc_id", "pos", "word", F.explode(F.expr("sequence(0, 7)")).alias("bit"))
    p = p.selectExpr("doc_id", "pos * 8L + bit place", "cast(shiftright(word, 7 - bit) & 1 as int) s", "if(shiftright(word, 8 - bit) & 1 = 1, 1L, -1L) step", "shiftright(word, 9 - bit) & 65535 history")
    keys = ["doc_id", "history"]
    by_place, half = Window.partitionBy(*keys).orderBy("place"), CHAIN_STEPS // 2
    frequent = cut(p.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > half).select(*keys))
    tight = None
    if frequent.limit(1).count():
        p, tight = p.join(frequent, keys, "left_anti"), p.join(frequent, keys, "left_semi")
    moved = F.coalesce(F.sum("step").over(by_place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = p.select("doc_id", "s", (moved + half).alias("at"))
    if tight is not None:
        f = f"named_struct('c', step, 'lo', 0L, 'hi', {CHAIN_STEPS}L, 's', s) f"
        tight = tight.withColumn("i", (F.row_number().over(by_place) - 1).cast("long")).selectExpr(*keys, "i", f)
        out = out.unionByName(states_before(tight, keys, clamped(half), size).selectExpr("doc_id", "f.s s", "before at"))
    one = f"{CHAIN_WEIGHT + 1} + if(at >= {half} and s = 1 or at < {half} and s = 0, abs(at - {half}) * {CHAIN_GAIN}, 0)"
    all_ = f"{2 * CHAIN_WEIGHT + 3} + abs(at - {half}) * {CHAIN_GAIN}"
    return out.groupBy("doc_id").agg(F.sum(F.expr(f"log2(({all_}) / ({one}))")).alias("bits"))
