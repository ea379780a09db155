"""Symbol analytics on (doc_id, pos, s): histograms, predictors, runs, adaptive code lengths, context sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from samplegrid.functions.scalar import CODES, code_len, pin, zigzag
from samplegrid.functions.scalar import bits as bit_width


def line() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("pos")


def histogram(sy: DataFrame, unit: str = "byte") -> DataFrame:
    """(doc_id, s, cnt, share) of bytes, or of their two nybbles."""
    if unit == "nybble":
        sy = sy.select("doc_id", F.explode(F.array(F.shiftright("s", 4), F.col("s").bitwiseAND(F.lit(15)))).alias("s"))
    counts = sy.groupBy("doc_id", "s").agg(F.count("*").alias("cnt"))
    return counts.select("doc_id", "s", "cnt", (F.col("cnt") / F.sum("cnt").over(Window.partitionBy("doc_id"))).alias("share"))


def entropy(sy: DataFrame) -> DataFrame:
    """(doc_id, n, bits): the bits that a model of the whole stream's frequencies takes."""
    h = sy.groupBy("doc_id", "s").agg(F.count("*").alias("c"))
    return h.groupBy("doc_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("own")).select(
        "doc_id", "n", (F.col("n") * F.log2("n") - F.col("own")).alias("bits")
    )


def huffman_size(sy: DataFrame) -> DataFrame:
    """(doc_id, bits): total length of an optimal prefix code, by a fold that merges the two least weights of at most 256."""
    h = sy.groupBy("doc_id", "s").agg(F.count("*").alias("c")).groupBy("doc_id").agg(F.array_sort(F.collect_list("c")).alias("w"))
    merge = """aggregate(sequence(1, greatest(size(w) - 1, 1)), named_struct('w', w, 'bits', 0L),
        (a, i) -> if(size(a.w) < 2, a, named_struct('w', array_sort(concat(slice(a.w, 3, size(a.w)), array(a.w[0] + a.w[1]))), 'bits', a.bits + a.w[0] + a.w[1])),
        a -> a.bits)"""
    return h.select("doc_id", F.expr(merge).alias("bits"))


def huffman_lengths(sy: DataFrame) -> DataFrame:
    """(doc_id, s, cnt, len): code lengths of an optimal prefix code; 0 if there is one symbol only. Each merge lengthens the codes
    of all symbols below it."""
    counts = sy.groupBy("doc_id", "s").agg(F.count("*").alias("cnt"))
    h = counts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("cnt").alias("c"), F.array("s").alias("below")))).alias("w"))
    merge = """aggregate(sequence(1, greatest(size(w) - 1, 1)), named_struct('w', w, 'out', cast(array() as array<int>)), (a, i) -> if(size(a.w) < 2, a, named_struct(
        'w', array_sort(concat(slice(a.w, 3, size(a.w)), array(named_struct('c', a.w[0].c + a.w[1].c, 'below', concat(a.w[0].below, a.w[1].below))))),
        'out', concat(a.out, a.w[0].below, a.w[1].below))), a -> a.out)"""
    lengths = h.select("doc_id", F.explode(F.expr(merge)).alias("s")).groupBy("doc_id", "s").agg(F.count("*").alias("len"))
    return counts.join(lengths, ["doc_id", "s"], "left").select("doc_id", "s", "cnt", F.coalesce("len", F.lit(0)).alias("len"))


def ngrams(sy: DataFrame, n: int = 2, canonical: bool = True) -> DataFrame:
    """(g, cnt): counts of the n-grams of all documents, as hexadecimal; canonical: of their least rotation. A gram ends at each
    symbol; before the start there are zeros."""
    parts = [F.coalesce(F.lpad(F.lower(F.hex(F.lag("s", k).over(line()) if k else F.col("s"))), 2, "0"), F.lit("00")) for k in reversed(range(n))]
    g = sy.select(F.concat(*parts).alias("g"))
    if canonical:
        g = g.select(F.array_min(F.array(*(F.concat(F.substring("g", 2 * k + 1, 2 * n), F.substring("g", 1, 2 * k)) if k else F.col("g") for k in range(n)))).alias("g"))
    return g.groupBy("g").agg(F.count("*").alias("cnt"))


def top_ngrams(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent of ngrams(); equal ones by name."""
    return counts.orderBy(F.desc("cnt"), "g").limit(k)


def ngram_report(counts: DataFrame, n: int, k: int) -> DataFrame:
    """One row: distinct grams and their largest count, bytes of the k most frequent and of all as a table, symbols in those k and
    beside them, and an estimate of the bytes if each of those were an index and a rotation."""
    top = top_ngrams(counts, k).agg(F.sum("cnt").alias("covered"))
    index, rotation = (max(0, v - 1).bit_length() for v in (k, n))
    whole = counts.agg(F.count("*").alias("grams"), F.max("cnt").alias("most"), F.sum("cnt").alias("total"))
    out = whole.join(F.broadcast(top))  # one row each
    return out.selectExpr(
        "grams", "most", f"{k * n}L top_bytes", f"grams * {n} all_bytes", "covered", "total - covered remaining",
        f"covered * {index * rotation} / 8D + (total - covered) + {k} compact",
    )


def delta(sy: DataFrame) -> DataFrame:
    """(doc_id, pos, delta, xor): byte-wrapped difference to, and exclusive-or with, the symbol before (0 at the start)."""
    before = F.coalesce(F.lag("s").over(line()), F.lit(0))
    return sy.select("doc_id", "pos", F.pmod(F.col("s") - before, F.lit(256)).alias("delta"), F.col("s").bitwiseXOR(before).alias("xor"))


def undelta(df: DataFrame) -> DataFrame:
    total = F.sum("delta").over(line().rowsBetween(Window.unboundedPreceding, 0))
    return df.select("doc_id", "pos", F.pmod(total, F.lit(256)).cast("int").alias("s"))


def unxor(df: DataFrame) -> DataFrame:
    """Inverse of delta()'s xor: the running exclusive-or."""
    return df.select("doc_id", "pos", F.bit_xor("xor").over(line().rowsBetween(Window.unboundedPreceding, 0)).alias("s"))


def linear_residual(sy: DataFrame) -> DataFrame:
    """(doc_id, pos, residual): difference to the mean of the two symbols before, cut, zig-zagged and pinned to a byte; the first two
    symbols are kept."""
    p = sy.select("doc_id", "pos", "s", F.lag("s", 1).over(line()).alias("a"), F.lag("s", 2).over(line()).alias("b"))
    guess = F.least(F.greatest((F.col("a") + F.col("b")) / 2.0, F.lit(0.0)), F.lit(255.0))
    folded = pin(zigzag((F.col("s") - guess).cast("int")), 0, 255)
    return p.select("doc_id", "pos", F.when(F.col("b").isNull(), F.col("s")).otherwise(folded).cast("int").alias("residual"))


def zero_runs(sy: DataFrame, longest: int = 252) -> DataFrame:
    """(doc_id, literals, runs, bytes): symbols kept, runs of zeros (two bytes each) and encoded bytes. A run restarts after
    `longest` zeros, and the next zero is kept as it is."""
    islands = runs(sy, 1).where("s = 0").groupBy("doc_id").agg(
        F.sum(F.expr(f"n div {longest + 1} + if(n % {longest + 1} > 0, 1, 0)")).alias("r"), F.sum(F.expr(f"n div {longest + 1}")).alias("z")
    )
    kept = sy.groupBy("doc_id").agg(F.sum(F.when(F.col("s") != 0, 1).otherwise(0)).alias("kept"))
    out = kept.join(islands, "doc_id", "left").selectExpr("doc_id", "kept + coalesce(z, 0) literals", "coalesce(r, 0) runs")
    return out.selectExpr("doc_id", "literals", "runs", "literals + 2 * runs bytes")


def run_blocks(sy: DataFrame, min_len: int = 4) -> DataFrame:
    """(doc_id, start, is_run, n): runs of min_len equal symbols at least, and the literal blocks between them."""
    islands = runs(sy, 1).withColumn("is_run", F.col("n") >= min_len)
    w = Window.partitionBy("doc_id").orderBy("start")
    joined = F.when(F.lag("is_run").over(w).eqNullSafe(False) & ~F.col("is_run"), 0).otherwise(1)
    islands = islands.withColumn("new", joined).withColumn("block", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc_id", "block").agg(F.min("start").alias("start"), F.first("is_run").alias("is_run"), F.sum("n").alias("n")).drop("block")


def runs(sy: DataFrame, min_len: int = 4) -> DataFrame:
    """(doc_id, start, s, n): maximal runs of equal symbols, of min_len at least."""
    change = F.when(F.lag("s").over(line()) == F.col("s"), 0).otherwise(1)
    island = sy.select("doc_id", "pos", "s", change.alias("c")).withColumn("island", F.sum("c").over(line().rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("doc_id", "island").agg(F.min("pos").alias("start"), F.first("s").alias("s"), F.count("*").alias("n")).where(F.col("n") >= min_len).drop("island")


def with_end(sy: DataFrame, end: int = 256) -> DataFrame:
    """sy with the end symbol that closes each stream."""
    last = sy.groupBy("doc_id").agg((F.max("pos") + 1).alias("pos"))
    return sy.select("doc_id", "pos", "s").union(last.select("doc_id", "pos", F.lit(end)))


def flat_bits(sy: DataFrame, alphabet: int = 257) -> DataFrame:
    """(doc_id, bits) of a model without learning: every symbol is as likely as the other."""
    return sy.groupBy("doc_id").agg((F.count("*") * F.log2(F.lit(float(alphabet)))).alias("bits"))


def adaptive_bits(sy: DataFrame, context: list[Column], gain: int = 2, alphabet: int = 257, listed: tuple[int, ...] = (), weight: int = 0) -> DataFrame:
    """(doc_id, bits): an adaptive model starts each context with ones and adds `gain` for each symbol it has seen. Symbols in
    `listed` start with `weight` more."""
    names = [f"k{i}" for i in range(len(context))]
    p = sy.select("doc_id", "pos", "s", *(c.alias(n) for c, n in zip(context, names, strict=True)))
    past = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1
    p = p.withColumn("seen", past(["doc_id", *names, "s"])).withColumn("all", past(["doc_id", *names]))
    start = F.when(F.col("s").isin(*listed), 1 + weight).otherwise(1) if listed else F.lit(1)
    share = (start + gain * F.col("seen")) / (alphabet + weight * len(listed) + gain * F.col("all"))
    return p.groupBy("doc_id").agg(F.sum(-F.log2(share)).alias("bits"))


def order(k: int) -> list[Column]:
    """Context of the k symbols before; 0 before the start."""
    return [F.coalesce(F.lag("s", i + 1).over(line()), F.lit(0)) for i in range(k)]


def context_hits(sy: DataFrame, k: int = 2) -> DataFrame:
    """(doc_id, n, hits): how often the symbol last seen after the same k symbols comes again; the first guess is 0."""
    names = [f"k{i}" for i in range(k)]
    p = sy.select("doc_id", "pos", "s", *(c.alias(n) for c, n in zip(order(k), names, strict=True)))
    guess = F.coalesce(F.lag("s").over(Window.partitionBy("doc_id", *names).orderBy("pos")), F.lit(0))
    return p.select("doc_id", (guess == F.col("s")).cast("long").alias("hit")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))


def xor_of(k: int) -> list[Column]:
    """Context of the exclusive-or of the k symbols before."""
    past = order(k)
    out = past[0]
    for c in past[1:]:
        out = out.bitwiseXOR(c)
    return [out]


def nybbles(sy: DataFrame) -> DataFrame:
    """(doc_id, pos, s): the two halves of each byte as symbols, the high one first."""
    return sy.select("doc_id", F.posexplode(F.array(F.shiftright("s", 4), F.col("s").bitwiseAND(F.lit(15)))).alias("i", "s"), F.col("pos").alias("p")).selectExpr("doc_id", "p * 2 + i pos", "s")


def bits(sy: DataFrame) -> DataFrame:
    """(doc_id, pos, s): the eight bits of each byte as symbols, the high bit first."""
    return sy.select("doc_id", "pos", "s", F.explode(F.expr("sequence(0, 7)")).alias("i")).selectExpr("doc_id", "pos * 8 + i pos", "shiftright(s, 7 - i) & 1 s")


def cumulative(hist: DataFrame) -> DataFrame:
    """(doc_id, s, cnt, low, high): the half-open range of running counts of each symbol."""
    high = F.sum("cnt").over(Window.partitionBy("doc_id").orderBy("s"))
    return hist.select("doc_id", "s", "cnt", (high - F.col("cnt")).alias("low"), high.alias("high"))


def range_sum(cumulated: DataFrame, first: int, last: int) -> DataFrame:
    """(doc_id, total): counts of the symbols first .. last - 1, from cumulative()."""
    inside = F.col("s").between(first, last - 1)
    return cumulated.groupBy("doc_id").agg(F.coalesce(F.max(F.when(inside, F.col("high"))) - F.min(F.when(inside, F.col("low"))), F.lit(0)).alias("total"))


def find_symbol(cumulated: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, value, s): the symbol whose range low <= value < high holds a value of values(doc_id, value). At most 256 ranges a document."""
    c = cumulated.select("doc_id", "s", "low", "high")
    return values.join(c, "doc_id").where("low <= value and value < high").select("doc_id", "value", "s")


def sum_pyramid(sy: DataFrame, lengths: tuple[int, ...] = (2, 4, 8)) -> DataFrame:
    """Byte-wrapped sums of the next 2, 4, 8 symbols (fewer at the end)."""
    return sy.select("doc_id", "pos", *((F.sum("s").over(line().rowsBetween(0, n - 1)) % 256).cast("int").alias(f"sum{n}") for n in lengths))


def block_checksum(sy: DataFrame, size: int = 257) -> DataFrame:
    """(doc_id, block, checksum): the sum of the zig-zagged values of each block; the last, short one too."""
    return sy.groupBy("doc_id", F.expr(f"pos div {size}").alias("block")).agg(F.sum(zigzag("s")).alias("checksum"))


def erase_bad_blocks(sy: DataFrame, sums: DataFrame, size: int = 257) -> DataFrame:
    """(doc_id, pos, s): zeros where the block's checksum is not that of sums(doc_id, block, checksum), or missing."""
    good = block_checksum(sy, size).join(sums, ["doc_id", "block", "checksum"]).select("doc_id", "block", F.lit(True).alias("ok"))
    p = sy.withColumn("block", F.expr(f"pos div {size}")).join(good, ["doc_id", "block"], "left")
    return p.select("doc_id", "pos", F.when(F.col("ok"), F.col("s")).otherwise(0).alias("s"))


def code_size_report(sy: DataFrame, codes: tuple[str, ...] = CODES) -> DataFrame:
    """(doc_id, code, bits): total bits of each universal code; Elias and Stout codes take s + 1. Lengths are worked out once for each
    symbol of a document, on its histogram."""
    h = sy.groupBy("doc_id", "s").agg(F.count("*").alias("n"))
    totals = h.groupBy("doc_id").agg(
        *(F.sum(F.col("n") * code_len(c, F.col("s") + 1 if c.startswith(("elias", "stout")) else F.col("s"), 256 if c == "truncated" else 8)).cast("long").alias(c) for c in codes)
    )
    pairs = ", ".join(f"'{c}', {c}" for c in codes)
    return totals.selectExpr("doc_id", f"stack({len(codes)}, {pairs}) as (code, bits)")


def best_code(sy: DataFrame) -> DataFrame:
    """(doc_id, code, bits): the shortest; of equal ones the first by name."""
    return code_size_report(sy).groupBy("doc_id").agg(F.min(F.struct("bits", "code")).alias("b")).select("doc_id", "b.code", "b.bits")


def best_golomb(sy: DataFrame) -> DataFrame:
    """(doc_id, m, bits): the Golomb parameter of the least total, of equal ones the smallest, by trying all up to the largest
    symbol + 1 on the document's histogram; documents with symbols of 2048 or more are left out."""
    h = sy.groupBy("doc_id", "s").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.collect_list(F.struct("s", "n")).alias("h"), F.max("s").alias("most")).where("most < 2048")
    k = "length(bin(m))"
    cost = f"cast(x.n as bigint) * (x.s div m + 1 + {k} - if(x.s % m < shiftleft(1, {k}) - m, 1, 0))"
    tried = f"transform(sequence(1, most + 1), m -> named_struct('bits', aggregate(h, 0L, (a, x) -> a + {cost}), 'm', m))"
    return h.select("doc_id", F.expr(f"array_min({tried})").alias("b")).select("doc_id", "b.m", "b.bits")


def sequential_bits(sy: DataFrame) -> DataFrame:
    """(doc_id, bits) of the binary adaptive sequential code: each symbol's width is told by that of the symbol before; the count and the
    first width are Elias delta codes."""
    n = bit_width(F.col("s"))
    p = sy.select("doc_id", "pos", n.alias("n")).withColumn("w", F.lag("n").over(line()))
    first = code_len("elias_delta", F.col("n")) + F.col("n")
    cost = F.when(F.col("w").isNull(), first).when(F.col("n") <= F.col("w"), F.col("w") + 1).otherwise(F.col("n") * 2 - F.col("w"))
    total = p.groupBy("doc_id").agg(F.sum(cost).alias("t"), F.count("*").alias("c"))
    return total.select("doc_id", (F.col("t") + code_len("elias_delta", F.col("c") + 1)).alias("bits"))


def fixed_bits(sy: DataFrame) -> DataFrame:
    """(doc_id, bits): every symbol at the width of the largest."""
    return sy.groupBy("doc_id").agg((bit_width(F.max("s")) * F.count("*")).alias("bits"))


def keystream(seed: int, n: int) -> list[int]:
    """n whitening bytes of a linear feedback register of seven bits, from its seed on."""
    out, state = [], seed
    for _ in range(n):
        byte = 0
        for k in range(8):
            if state & 128:
                state ^= 0x11
                byte |= 1 << k
            state = state << 1 & 255
        out.append(byte)
    return out


def whiten(sy: DataFrame, seed: int) -> DataFrame:
    """(doc_id, pos, s): symbols xor a keystream by position; its own inverse. After the first byte the register's states repeat
    every 127 bytes, so one short literal array serves every position."""
    stream = ", ".join(map(str, keystream(seed, 128)))
    return sy.selectExpr("doc_id", "pos", f"s ^ array({stream})[cast(if(pos = 0, 0, (pos - 1) % 127 + 1) as int)] s")


def context_sort(sy: DataFrame) -> DataFrame:
    """(doc_id, out, s): the symbols in the stable order of the symbol before and the one before that, circularly."""
    whole = line().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.last("s").over(whole)
    p1 = F.coalesce(F.lag("s", 1).over(line()), last)
    p = sy.select("doc_id", "pos", "s", p1.alias("p1"))
    p2 = F.coalesce(F.lag("p1", 1).over(line()), F.last("p1").over(whole))
    p = p.select("doc_id", "pos", "s", "p1", p2.alias("p2"))
    return p.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("p1", "p2", "pos")) - 1).alias("out"), "s")


def remap(sy: DataFrame) -> DataFrame:
    """Symbols by their rank among the document's distinct symbols. The ranks come from the grouped symbols."""
    ranks = sy.select("doc_id", "s").distinct().select("doc_id", "s", (F.dense_rank().over(Window.partitionBy("doc_id").orderBy("s")) - 1).alias("code"))
    return sy.join(ranks, ["doc_id", "s"]).select("doc_id", "pos", "code")


def context_lead(sy: DataFrame) -> DataFrame:
    """(doc_id, a, b): the last two symbols, which context_unsort() starts from; of one symbol, it twice."""
    last = F.max_by("s", "pos")
    before = sy.join(sy.groupBy("doc_id").agg((F.max("pos") - 1).alias("pos")), ["doc_id", "pos"], "left_semi").select("doc_id", F.col("s").alias("a"))
    return sy.groupBy("doc_id").agg(last.alias("b")).join(before, "doc_id", "left").select("doc_id", F.coalesce("a", "b").alias("a"), "b")


def context_unsort(df: DataFrame, lead: DataFrame) -> DataFrame:
    """(doc_id, pos, s): inverse of context_sort() with context_lead(). Each step takes the next symbol of the bucket of the last two,
    so a document is walked in order, in one group."""

    def walk(pdf):
        import numpy as np

        s = pdf.sort_values("out")["s"].to_numpy()
        # the bucket of (previous, the one before): symbols sorted, then those of each symbol's rows sorted again
        previous = np.sort(s)
        pairs = np.sort(s.astype(np.int64) << 8 | previous)
        begin = np.searchsorted(pairs, np.arange(65537)).tolist()
        q, p, symbols, out = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0]), s.tolist(), []
        for _ in range(len(symbols)):
            k = p << 8 | q
            out.append(symbols[begin[k]])
            begin[k] += 1
            q, p = p, out[-1]
        return type(pdf)({"doc_id": pdf["doc_id"].iloc[0], "pos": np.arange(len(out), dtype=np.int32), "s": np.array(out, np.int32)})

    return df.join(lead, "doc_id").groupBy("doc_id").applyInPandas(walk, "doc_id long, pos int, s int")


def fold_pairs(sy: DataFrame) -> DataFrame:
    """(doc_id, pos, mean, diff) of symbol pairs: the floored mean, and the second symbol less the mean, byte-wrapped; a last single
    symbol is left out."""
    p = sy.select("doc_id", "pos", "s", F.lead("s").over(line()).alias("t")).where("pos % 2 = 0 and t is not null")
    return p.selectExpr("doc_id", "cast(pos div 2 as int) pos", "cast((s + t) div 2 as int) mean", "cast(pmod(t - (s + t) div 2, 256) as int) diff")


def interleave(planes: DataFrame) -> DataFrame:
    """(image_id, plane, pos, s) with seq: symbol i of every plane before symbol i + 1 of any, exhausted planes skipped.
    Closed form over the planes' lengths (a few an image), so no image is sorted in one task."""
    lengths = planes.groupBy("image_id", "plane").agg((F.max("pos") + 1).alias("n"))
    lengths = lengths.groupBy("image_id").agg(F.collect_list(F.struct("plane", "n")).alias("planes"))
    seq = F.expr("aggregate(planes, 0L, (a, p) -> a + least(p.n, pos + if(p.plane < plane, 1, 0)))")
    return planes.join(lengths, "image_id").select("image_id", "plane", "pos", "s", seq.alias("seq"))


def read_prefix(df: DataFrame, n: int) -> DataFrame:
    """(image_id, plane, pos, s): interleave()'s planes if only the first n symbols of each image are left; the others are 0."""
    return df.select("image_id", "plane", "pos", F.when(F.col("seq") < n, F.col("s")).otherwise(0).alias("s"))


def deinterleave(stream: DataFrame, lengths: DataFrame) -> DataFrame:
    """(image_id, plane, pos, s) of stream(image_id, seq, s) and lengths(image_id, plane, n): the inverse of interleave(). A plane's
    symbol stands where its own and the other planes' shorter parts have gone before."""
    sizes = lengths.groupBy("image_id").agg(F.collect_list(F.struct("plane", "n")).alias("planes"))
    seq = F.expr("aggregate(planes, 0L, (a, p) -> a + least(p.n, pos + if(p.plane < plane, 1, 0)))")
    places = lengths.where("n > 0").select("image_id", "plane", F.explode(F.expr("sequence(0, cast(n - 1 as int))")).alias("pos")).join(sizes, "image_id")
    return places.withColumn("seq", seq).join(stream, ["image_id", "seq"]).select("image_id", "plane", "pos", "s")
