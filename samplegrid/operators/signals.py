"""Signals: Fourier transforms and filters along lines, the second-order Butterworth filter (batch and stream), recency ranks, repeats."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.window import Window

from samplegrid.operators.scan import BLOCK, affine, cut, discard, earlier_smaller, ranked, split_by_size, states_before
from samplegrid.operators.symbols import line
from samplegrid.operators.window import normalise


def dft(px: DataFrame, inverse: bool = False) -> DataFrame:
    """(image_id, y, k, re, im) of each row of px(image_id, y, x, v), or of re, im at k with inverse (then x, re, im): sums over the row, which is one
    array; lines of up to some hundred samples, longer ones by fft_filter()'s way."""
    sign, scale = (1, "s") if inverse else (-1, "1")
    if inverse:
        rows = px.groupBy("image_id", "y").agg(F.expr("transform(array_sort(collect_list(struct(k, re, im))), t -> named_struct('re', t.re, 'im', t.im)) a"))
    else:
        rows = px.groupBy("image_id", "y").agg(F.expr("transform(array_sort(collect_list(struct(x, v))), t -> named_struct('re', cast(t.v as double), 'im', 0D)) a"))
    rows = rows.withColumn("s", F.size("a"))
    turn = f"({sign * 2 * math.pi!r}D * ((k * i) % s) / s)"
    total = lambda e: f"aggregate(transform(a, (t, i) -> {e}), 0D, (z, t) -> z + t) / {scale}"
    each = f"transform(sequence(0, s - 1), k -> named_struct('{'x' if inverse else 'k'}', k, 're', {total(f't.re * cos({turn}) - t.im * sin({turn})')}, 'im', {total(f't.re * sin({turn}) + t.im * cos({turn})')}))"
    return rows.select("image_id", "y", F.inline(F.expr(each)))


def fft_filter(px: DataFrame, scale: float, kind: str = "low") -> DataFrame:
    """Low or high pass along rows, then columns: each line is extended to a power of two by reflection, the bins from n / scale on (low; before
    it: high) become 0, and the real part goes on; the image is spread over 0..255 at the end. A group is one line."""

    def along_axis(df: DataFrame, axis: str) -> DataFrame:
        other = "y" if axis == "x" else "x"

        def run(pdf):
            import numpy as np

            a = pdf.sort_values(axis)["v"].to_numpy(float)
            n = 1 << max(0, len(a) - 1).bit_length()
            f = np.fft.fft(np.concatenate([a, a[::-1][: n - len(a)]]))
            edge = int(n / scale)
            f[slice(edge, None) if kind == "low" else slice(0, edge)] = 0
            return type(pdf)({"image_id": pdf["image_id"].iloc[0], other: pdf[other].iloc[0], axis: np.arange(len(a), dtype=np.int32), "v": np.fft.ifft(f).real[: len(a)]})

        kind_ = df.schema["image_id"].dataType.simpleString()
        return df.groupBy("image_id", other).applyInPandas(run, f"image_id {kind_}, {other} int, {axis} int, v double")

    p = px.selectExpr("image_id", "cast(y as int) y", "cast(x as int) x", "cast(v as double) v")
    return normalise(along_axis(along_axis(p, "x"), "y"))


def butterworth_terms(frequency: float, rate: float, kind: str = "low", resonance: float = math.sqrt(2)) -> tuple[float, float, float, float, float]:
    """(a1, a2, a3, b1, b2) of output = a1 * in + a2 * in before + a3 * in before that - b1 * out before - b2 * out before that."""
    c = math.tan(math.pi * frequency / rate)
    c = 1 / c if kind == "low" else c
    a1 = 1 / (1 + resonance * c + c * c)
    back = 2 * (1 - c * c) * a1 if kind == "low" else 2 * (c * c - 1) * a1
    return a1, (2 if kind == "low" else -2) * a1, a1, back, (1 - resonance * c + c * c) * a1


def _filtered(values, terms, state):
    a1, a2, a3, b1, b2 = terms
    x1, x2, y1, y2 = state
    out = []
    for x in values:
        y = a1 * x + a2 * x1 + a3 * x2 - b1 * y1 - b2 * y2
        x1, x2, y1, y2 = x, x1, y, y1
        out.append(y)
    return out, (x1, x2, y1, y2)


def butterworth(sm: DataFrame, key: str, order: list[str], terms: tuple[float, ...], prime: float = 0.0, size: int = BLOCK) -> DataFrame:
    """(key, *order, v, filtered) of sm(key, *order, v), filtered along each series; `prime` is the value before it began.

    What the inputs add is a window; what the last two outputs add is an affine function of these, and such functions are scanned over
    blocks, so that one long series is not one task's work beyond its sort. A null v makes the rest of its series null."""
    a1, a2, a3, b1, b2 = terms
    w = Window.partitionBy(key).orderBy(*order)
    v = F.col("v").cast("double")
    p = sm.select(key, *order, v.alias("v")).withColumns({"i": F.row_number().over(w) - 1, "x1": F.lag("v", 1, prime).over(w), "x2": F.lag("v", 2, prime).over(w)})
    p = p.withColumn("fed", a1 * F.col("v") + a2 * F.col("x1") + a3 * F.col("x2"))
    kept = ", ".join(f"'{c}', {c}" for c in (*order, "v"))
    p = p.selectExpr(key, "cast(i as long) i", f"named_struct('a', {-b1!r}D, 'b', {-b2!r}D, 'c', 1D, 'd', 0D, 'p', fed, 'q', 0D, {kept}) f")
    out = states_before(p, [key], affine(prime), size)
    return out.select(key, *(F.col(f"f.{c}").alias(c) for c in (*order, "v")), F.expr(f"f.p - {b1!r}D * before.y1 - {b2!r}D * before.y2").alias("filtered"))


def butterworth_stream(sdf: DataFrame, key: str, order: list[str], terms: tuple[float, ...], prime: float = 0.0, delay: str | None = None) -> DataFrame:
    """butterworth() on a stream.

    With a delay (as "10 minutes"), order[0] is the event time: rows wait in the series' state until the watermark, the latest event time of all
    series less the delay, has passed them, and are then filtered in order, so a stream that is out of order by less than the delay gives the
    batch's results. Rows behind the watermark come too late and are dropped. The state of a series is its last two inputs and outputs and
    the rows of one delay; it needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).

    Without one, rows are filtered as they come: those of a batch in order, and late ones where they come."""
    kinds = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    out = ", ".join(f"{c} {kinds[c]}" for c in (key, *order)) + ", v double, filtered double"
    p = sdf.select(key, *order, F.col("v").cast("double").alias("v"))
    if delay:
        waiting = ", ".join(f"{c} {'timestamp' if c == order[0] else kinds[c]}" for c in order) + ", v double"
        return p.withWatermark(order[0], delay).groupBy(key).transformWithStateInPandas(_OrderedFilter(key, order, terms, prime, waiting), out, "Append", "EventTime")
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(keys: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        pdf = pd.concat(list(batches)).sort_values(order)
        values, after = _filtered(pdf["v"].tolist(), terms, state.get if state.exists else (prime,) * 4)
        state.update(after)
        yield pdf.assign(filtered=values)

    return p.groupBy(key).applyInPandasWithState(run, out, "x1 double, x2 double, y1 double, y2 double", "append", GroupStateTimeout.NoTimeout)


class _OrderedFilter(StatefulProcessor):
    """Holds rows back until the watermark has passed them. One timer a series, at its earliest row that waits."""

    def __init__(self, key: str, order: list[str], terms: tuple[float, ...], prime: float, waiting: str):
        self.key, self.order, self.terms, self.prime, self.schema = key, order, terms, prime, waiting

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "x1 double, x2 double, y1 double, y2 double")
        self.waiting = handle.getListState("waiting", self.schema)

    @staticmethod
    def _ms(t) -> int:
        import pandas as pd

        return int(pd.Timestamp(t).timestamp() * 1000)

    def _renew_timer(self, first) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if first is not None:
            self.handle.registerTimer(self._ms(first))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        new = pd.concat(list(rows))[[*self.order, "v"]]
        held = [*self.waiting.get(), *new.itertuples(index=False, name=None)] if self.waiting.exists() else [*new.itertuples(index=False, name=None)]
        self.waiting.put([tuple(r) for r in held])
        self._renew_timer(min(r[0] for r in held))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(r) for r in self.waiting.get())
        ready = [r for r in held if self._ms(r[0]) <= mark]
        rest = held[len(ready) :]
        values, after = _filtered([r[-1] for r in ready], self.terms, tuple(self.last.get()) if self.last.exists() else (self.prime,) * 4)
        self.last.update(after)
        self.waiting.put(rest) if rest else self.waiting.clear()
        self._renew_timer(rest[0][0] if rest else None)
        if ready:
            yield pd.DataFrame([(key[0], *r, y) for r, y in zip(ready, values, strict=True)], columns=[self.key, *self.order, "v", "filtered"])

    def close(self) -> None:
        pass


def recency_rank(sy: DataFrame, width: int = 1, listed: bool = False) -> DataFrame:
    """(doc_id, pos, rank) of symbols of `width` bytes: how many different symbols came since this one did last; a new symbol has its value plus the
    number of known ones (listed: of known greater ones, as if all symbols stood in a list from the start). A last part of a symbol is
    left out.

    Without a list a document: of all places before, those whose own last use lies before this one's stand for the different symbols up to there,
    so the rank is a count of earlier and smaller last uses (scan.earlier_smaller) less the places up to the last use."""
    w = line()
    parts = [F.col("s").cast("long") * 256 ** (width - 1)] + [F.lead("s", k).over(w).cast("long") * 256 ** (width - 1 - k) for k in range(1, width)]
    value = sum(parts[1:], parts[0])
    p = sy.select("doc_id", "pos", value.alias("v")).where(f"pos % {width} = 0 and v is not null").selectExpr("doc_id", f"cast(pos div {width} as long) i", "v")
    p = p.withColumn("x", F.coalesce(F.lag("i").over(Window.partitionBy("doc_id", "v").orderBy("i")), F.lit(-1)))
    if listed:
        fresh = p.where("x = -1").selectExpr("doc_id", "v", "i", "row_number() over (partition by doc_id order by i) - 1 n")
        fresh = earlier_smaller(fresh.selectExpr("doc_id", "cast(n as long) i", "v x", "i at"), ["doc_id"]).selectExpr("doc_id", "at i", "x + i - smaller new")
    else:
        fresh = p.where("x = -1").selectExpr("doc_id", "i", "v + row_number() over (partition by doc_id order by i) - 1 new")
    out = earlier_smaller(p.drop("v"), ["doc_id"]).join(fresh, ["doc_id", "i"], "left")
    return out.select("doc_id", F.col("i").cast("int").alias("pos"), F.when(F.col("x") < 0, F.col("new")).otherwise(F.col("smaller") - F.col("x") - 1).alias("rank"))


def list_weights(fall_off: int = 3) -> list[int]:
    """Weights of a list's 257 places: 0x7000, then each shifted right by fall_off with the low bit set."""
    weights = [0x7000]
    while len(weights) < 257:
        weights.append(weights[-1] >> fall_off | 1)
    return weights


def recency_bits(sy: DataFrame, fall_off: int = 3) -> DataFrame:
    """(doc_id, bits) of a model in which the weight of a symbol is that of its place in a list of 257, the last used one in front
    (list_weights)."""
    weights = list_weights(fall_off)
    steps = next(i for i in range(257) if weights[i] == 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights[: steps + 1])), (F.least("rank", F.lit(steps)) + 1).cast("int"))
    ranks = recency_rank(sy, listed=True)
    return ranks.groupBy("doc_id").agg(F.sum(F.lit(math.log2(sum(weights))) - F.log2(weight)).alias("bits"))


def bump_rank(sy: DataFrame) -> DataFrame:
    """(doc_id, pos, rank): each byte's place in a list of all bytes, in which it then changes places with the one before it."""

    def run(pdf):
        import numpy as np

        place, at, out = list(range(256)), list(range(256)), []
        for v in pdf.sort_values("pos")["s"].tolist():
            i = place[v]
            out.append(i)
            if i:
                other = at[i - 1]
                at[i], at[i - 1], place[other], place[v] = other, v, i, i - 1
        return type(pdf)({"doc_id": pdf["doc_id"].iloc[0], "pos": np.arange(len(out), dtype=np.int32), "rank": np.array(out, np.int64)})

    return sy.select("doc_id", "pos", "s").groupBy("doc_id").applyInPandas(run, "doc_id long, pos int, rank long")


def repeats(sy: DataFrame, lengths: tuple[int, ...], window: int = 8172) -> DataFrame:
    """(doc_id, pos, len, match): the first place within `window` symbols before at which the same `len` symbols begin, for lengths that are powers
    of two. Content hashes of 2n symbols are made of two of n; equal 64-bit hashes count as equal content. No self-join."""
    w = line()
    p = sy.select("doc_id", F.col("pos").cast("long").alias("pos"), F.xxhash64("s").alias("h1"))
    n = 1
    while n < max(lengths):
        ahead = F.lead(f"h{n}", n).over(w)
        p = p.withColumn(f"h{2 * n}", F.when(ahead.isNotNull(), F.xxhash64(f"h{n}", ahead)))
        n *= 2
    rows = p.select("doc_id", "pos", F.inline(F.array(*(F.struct(F.lit(k).alias("len"), F.col(f"h{k}").alias("h")) for k in lengths)))).where("h is not null")
    same = Window.partitionBy("doc_id", "len", "h").orderBy("pos")
    return rows.withColumn("match", F.min("pos").over(same.rangeBetween(-window, -1))).where("match is not null").select("doc_id", "pos", "len", "match")


def longest_match(sy: DataFrame, window: int = 256, min_len: int = 3) -> DataFrame:
    """(doc_id, pos, len, distance): the longest run of symbols from pos on, of min_len (3 or more) at least, that also begins up to `window`
    symbols before; of equally long ones the nearest. Runs may overlap. Places with the same three symbols meet by document, symbols and a cell of
    `window` places, so a frequent triple makes at most 2 * window pairs a place; on each distance, runs of such pairs are the matches."""
    w = line()
    p = sy.select("doc_id", F.col("pos").cast("long").alias("pos"), (F.col("s") * 65536 + F.lead("s", 1).over(w) * 256 + F.lead("s", 2).over(w)).alias("g")).where("g is not null")
    p = p.withColumn("cell", F.expr(f"pos div {window}"))
    earlier = p.selectExpr("doc_id", "g", "pos before", "explode(array(cell, cell + 1)) cell")
    pairs = p.join(earlier, ["doc_id", "g", "cell"]).where(f"before < pos and pos - before <= {window}").selectExpr("doc_id", "pos", "pos - before distance")
    diagonal = Window.partitionBy("doc_id", "distance").orderBy("pos")
    runs = pairs.withColumn("island", F.col("pos") - F.row_number().over(diagonal))
    end = F.max("pos").over(Window.partitionBy("doc_id", "distance", "island"))
    found = runs.select("doc_id", "pos", "distance", (end - F.col("pos") + 3).alias("len")).where(f"len >= {min_len}")
    best = found.groupBy("doc_id", "pos").agg(F.max(F.struct("len", (-F.col("distance")).alias("d"))).alias("b"))
    return best.select("doc_id", "pos", "b.len", (-F.col("b.d")).alias("distance"))


def lyndon_starts(s: list[int]) -> list[int]:
    """Where the words of the factorization of s into falling words begin, each of which is less than its own rotations."""
    out, i, n = [], 0, len(s)
    while i < n:
        j, k = i + 1, i
        while j < n and s[k] <= s[j]:
            k = i if s[k] < s[j] else k + 1
            j += 1
        while i <= k:
            out.append(i)
            i += j - k
    return out


#: Symbols of a document that one task sorts or walks by itself.
WHOLE = 1 << 20


def rotation_sort(sy: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(doc_id, out, s): for all rotations of all words of a document's factorization, in order, the symbol before each in its word. Ranks of
    2n symbols are made of ranks of n, so the rounds are the logarithm of the longest word. A document of up to `whole` symbols is one group; longer ones are ranked
    by joins and sorts of the whole table, in the same way and with the same result."""
    short, long_ = split_by_size(sy.select("doc_id", "pos", "s"), "doc_id", whole)
    out = _rotation_sort_each(short)
    return out if long_ is None else out.unionByName(_rotation_sort_joined(long_))


def _doubled(ranks: DataFrame, ahead) -> DataFrame:
    """(doc_id, pos, ..., rank) by ever longer beginnings: ahead(df, step) is the place `step` symbols on, or null beyond the end. Rounds go on until a round tells no more
    places apart."""
    step, classes = 1, None
    while True:
        there = ranks.select("doc_id", F.col("pos").alias("at"), F.col("rank").alias("then"))
        both = ahead(ranks, step).join(there, ["doc_id", "at"], "left").drop("at").withColumn("then", F.coalesce("then", F.lit(-1)))
        both = cut(both)
        names = ranked(both.select("doc_id", "rank", "then").distinct().withColumnsRenamed({"rank": "first"}), ["doc_id", "first", "then"])
        new = cut(both.withColumnRenamed("rank", "first").join(names, ["doc_id", "first", "then"]).drop("first", "then"))
        now = names.count()
        discard(both, names)
        if step > 1 and now == classes:
            return new
        ranks, classes, step = new, now, 2 * step


def _rotation_sort_joined(sy: DataFrame) -> DataFrame:
    start = cut(sy.selectExpr("doc_id", "cast(pos as long) pos", "s", "cast(s as long) rank"))
    suffixes = _doubled(start.drop("s"), lambda df, step: df.withColumn("at", F.col("pos") + step))
    # a word begins where the rest of the document is less than at all places before
    w = line()
    least = F.min("rank").over(w.rowsBetween(Window.unboundedPreceding, -1))
    p = suffixes.withColumn("new", least.isNull() | (F.col("rank") < least)).withColumn("word", F.sum(F.col("new").cast("long")).over(w))
    word = Window.partitionBy("doc_id", "word")
    p = p.withColumns({"first": F.min("pos").over(word), "size": F.count("*").over(word)}).select("doc_id", "pos", F.col("first").alias("begin"), "size")
    turns = cut(p.join(start.select("doc_id", "pos", "s", "rank"), ["doc_id", "pos"]))
    on = lambda df, step: df.withColumn("at", F.expr(f"begin + (pos - begin + {step}) % size"))
    order = _doubled(turns.drop("s"), on)
    before = turns.select("doc_id", F.expr("begin + (pos - begin + 1) % size").alias("pos"), "s")
    out = F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "pos")) - 1
    return order.join(before, ["doc_id", "pos"]).select("doc_id", out.alias("out"), "s")


def _rotation_sort_each(sy: DataFrame) -> DataFrame:

    def run(pdf):
        import numpy as np

        s = pdf.sort_values("pos")["s"].to_numpy()
        n = len(s)
        starts = np.array([*lyndon_starts(s.tolist()), n])
        ahead, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ahead[starts[1:] - 1], before[starts[:-1]] = starts[:-1], starts[1:] - 1
        rank, step, reach = s.astype(np.int64), ahead, 1
        while True:
            both = rank * (int(rank.max(initial=0)) + 1) + rank[step]
            values, new = np.unique(both, return_inverse=True)
            done = reach >= n or (len(values) == len(np.unique(rank)) and reach > 1)
            rank, step, reach = new, step[step], 2 * reach
            if done:
                break
        order = np.argsort(rank, kind="stable")
        return type(pdf)({"doc_id": pdf["doc_id"].iloc[0], "out": np.arange(n, dtype=np.int32), "s": s[before[order]].astype(np.int32)})

    return sy.select("doc_id", "pos", "s").groupBy("doc_id").applyInPandas(run, "doc_id long, out int, s int")


def rotation_unsort(df: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(doc_id, pos, s): inverse of rotation_sort(). Each cycle of the stable sort's permutation is one word, from its end; the words come from the
    last one. Documents of over `whole` symbols are ranked by joins: pointers of doubled reach carry the least place on their way and how far it is, until all
    know their cycle's least place, which orders the cycles and the places in each."""
    short, long_ = split_by_size(df.select("doc_id", "out", "s"), "doc_id", whole)
    out = _rotation_unsort_each(short)
    return out if long_ is None else out.unionByName(_rotation_unsort_joined(long_))


def _rotation_unsort_joined(df: DataFrame) -> DataFrame:
    to = F.row_number().over(Window.partitionBy("doc_id").orderBy("s", "out")) - 1
    base = cut(df.select("doc_id", F.col("out").cast("long").alias("i"), "s", to.cast("long").alias("to")))
    cur, step = cut(base.selectExpr("doc_id", "i", "to", "i least", "0L off")), 1
    while True:
        there = cur.select("doc_id", F.col("i").alias("to"), F.col("to").alias("on"), F.col("least").alias("least2"), F.col("off").alias("off2"))
        new = cut(cur.join(there, ["doc_id", "to"]).selectExpr("doc_id", "i", "on to", "least(least, least2) least", f"if(least2 < least, off2 + {step}, off) off", "least2 < least moved"))
        discard(cur)
        if not new.where("moved").limit(1).count():
            break
        cur, step = new.drop("moved"), 2 * step
        cur._scratch = new._scratch
    cycles = new.groupBy("doc_id", "least").agg(F.count("*").alias("size"))
    by_doc = Window.partitionBy("doc_id")
    cycles = cycles.withColumns({"n": F.sum("size").over(by_doc), "before": F.sum("size").over(by_doc.orderBy("least")) - F.col("size")})
    placed = new.join(cycles, ["doc_id", "least"]).selectExpr("doc_id", "i", "cast(n - 1 - before - (size - off) % size as int) pos")
    return placed.join(base.select("doc_id", "i", "s"), ["doc_id", "i"]).select("doc_id", "pos", "s")


def _rotation_unsort_each(df: DataFrame) -> DataFrame:

    def run(pdf):
        import numpy as np

        s = pdf.sort_values("out")["s"].to_numpy()
        n = len(s)
        to = np.empty(n, np.int64)
        to[np.argsort(s, kind="stable")] = np.arange(n)
        to, symbols, seen, out = to.tolist(), s.tolist(), bytearray(n), []
        for i in range(n):
            while not seen[i]:
                seen[i] = 1
                out.append(symbols[i])
                i = to[i]
        return type(pdf)({"doc_id": pdf["doc_id"].iloc[0], "pos": np.arange(n, dtype=np.int32), "s": np.array(out[::-1], np.int32)})

    return df.select("doc_id", "out", "s").groupBy("doc_id").applyInPandas(run, "doc_id long, pos int, s int")
