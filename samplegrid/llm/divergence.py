"""Source divergence audit: how the term frequencies of each source of a language differ from its other sources and from the
language as a whole.

1. Workers cut texts into terms on the bytes of whole Arrow batches. Terms of up to 8 bytes become one big-endian uint64 word,
   those of 9 to 16 bytes two; both kinds are sorted by a radix sort over 16-bit digits and counted by runs. Longer terms lie
   in byte-sorted buckets by length, each twice as wide as the one before. A run is a row (lang, source, term, n, docs).
2. Spark adds the runs up, keeps the terms in enough documents of their language, and derives the exact shares from decimals.
3. Pairs of sources: rows of a language meet in blocks of terms and of TILE by TILE sources, each of which adds up its
   differences from the pair's share of absent terms. A source's rows are copied once for each tile of sources of its language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samplegrid.llm.bpe import slices
from samplegrid.llm.common import by_key, map_arrow, materialize

#: Bytes of text that are counted together in a worker; longer texts are cut into pieces of this size.
CHUNK = 8 << 20
#: Sources of one side of a tile; terms of a dense block in it.
TILE, DENSE = 64, 2048
#: Pairs of sources whose sums a task holds, and one tile's more.
PAIRS = 100_000
#: Parts per billion of the shares, and what is added to each count.
BILLION, SMOOTH = 1_000_000_000, 5

#: The byte that stands in a term for each byte of a text; 0: no part of a term.
LETTER = np.arange(256, dtype=np.uint8)
LETTER[:128] = 0
LETTER[97:123] = LETTER[65:91] = np.arange(97, 123)
#: The first k bytes of a big-endian word.
HEAD = np.array([(1 << 64) - (1 << (64 - 8 * k)) for k in range(9)], np.uint64)


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The stable order by words (the first is the most significant): least significant 16 bits first; numpy sorts 16-bit
    numbers by counting."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of all terms; data holds LETTER of each byte, a text lies at offsets[i] .. offsets[i + 1]."""
    inside = data != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    first[cuts], last[cuts - 1] = inside[cuts], inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def _strings(rows: np.ndarray) -> pa.Array:
    """Rows of bytes, padded with zeros, as strings."""
    full = rows != 0
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum(full.sum(1), out=ends[1:])
    return pa.StringArray.from_buffers(len(rows), pa.py_buffer(ends.tobytes()), pa.py_buffer(rows[full].tobytes()))


def count_terms(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, group, occurrences, texts) of the runs of equal terms and groups, one item for each kind of term; the texts
    at offsets belong to group[i]. data holds LETTER of each byte."""
    starts, ends, text = term_spans(data, offsets)
    # texts in the order of their groups, so that a term's rows come by group and then by text
    rank = np.empty(len(group), np.int64)
    rank[np.argsort(group, kind="stable")] = np.arange(len(group))
    by_rank = np.argsort(rank[text], kind="stable")
    starts, ends, text = starts[by_rank], ends[by_rank], text[by_rank]
    length = ends - starts
    for low, high in [(1, 8), (9, 16), *_long_buckets(length)]:
        at = np.flatnonzero((length >= low) & (length <= high))
        if not len(at):
            continue
        begin, size, doc = starts[at], length[at], text[at]
        if high <= 16:
            padded = np.concatenate([data, np.zeros(16, np.uint8)])
            eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
            words = [eight[begin + 8 * k].view(">u8")[:, 0].astype(np.uint64) & HEAD[np.clip(size - 8 * k, 0, 8)] for k in range(high // 8)]
            order = radix_order(words)
            words, doc = [w[order] for w in words], doc[order]
            same = np.logical_and.reduce([w[1:] == w[:-1] for w in words])
            rows = lambda i, words=words: np.stack([w[i] for w in words], 1).astype(">u8").view(np.uint8).reshape(len(i), -1)
        else:
            table = np.zeros((len(at), high), np.uint8)
            spot = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            table[np.repeat(np.arange(len(at)), size), spot] = data[np.repeat(begin, size) + spot]
            keys = table.view(f"S{high}")[:, 0]
            order = np.argsort(keys, kind="stable")
            keys, doc = keys[order], doc[order]
            same = keys[1:] == keys[:-1]
            rows = lambda i, table=table, order=order: table[order[i]]
        owner = group[doc]
        same &= owner[1:] == owner[:-1]
        begin = np.flatnonzero(np.concatenate([[True], ~same]))
        # a text counts where its run of a term begins
        fresh = np.concatenate([[True], ~(same & (doc[1:] == doc[:-1]))])
        counts = np.diff(np.append(begin, len(doc)))
        yield _strings(rows(begin)), owner[begin], counts, np.add.reduceat(fresh.astype(np.int64), begin)


def _long_buckets(length: np.ndarray) -> list[tuple[int, int]]:
    """The lengths of terms over 16 bytes in buckets (17, 32), (33, 64) and so on."""
    out, high = [], 32
    while high // 2 < length.max(initial=0):
        out.append((high // 2 + 1, high))
        high *= 2
    return out


def _table(parts: list, groups: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    for terms, owner, n, docs in parts:
        lang, source = (pa.array([g[k] for g in groups], pa.string()).take(pa.array(owner)) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([lang, source, terms, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])


def _one_long(text: bytes, group: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """The counts of one text of more than CHUNK bytes, in pieces that are cut between terms."""
    data, at, total = LETTER[np.frombuffer(text, np.uint8)], 0, {}
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and data[end] and data[end - 1]:
            end += 1
        for terms, _, n, _ in count_terms(data[at:end], np.array([0, end - at]), np.zeros(1, np.int64)):
            for term, k in zip(terms.to_pylist(), n.tolist(), strict=True):
                total[term] = total.get(term, 0) + k
        at = end
    if total:
        n = np.fromiter(total.values(), np.int64)
        yield from _table([(pa.array(total, pa.string()), np.zeros(len(n), np.int64), n, np.ones(len(n), np.int64))], [group])


def partial_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n occurrences, docs texts with the term) of chunks of docs; no shuffle. Nulls are ''."""

    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        texts = batch.column("text").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = LETTER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
        known: dict[tuple[str, str], int] = {}
        pairs = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        group = np.array([known.setdefault(p, len(known)) for p in pairs], np.int64)
        yield from _table(count_terms(data, offsets - offsets[0], group), list(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                n = part.column("text").nbytes
                if len(part) == 1 and n > CHUNK:
                    row = part.to_pylist()[0]
                    yield from _one_long(row["text"].encode(), (row["lang"], row["source"]))
                    continue
                if held and size + n > CHUNK:
                    yield from counted(held)
                    held, size = [], 0
                held.append(part)
                size += n
        if held:
            yield from counted(held)

    named = docs.selectExpr("coalesce(text, '') text", "coalesce(lang, '') lang", "coalesce(source, '') source")
    return map_arrow(named, run, "lang string, source string, term string, n long, docs long")


def share(count: str, total: str, kept: str):
    """1 + floor(10^9 * (count + 5) / (total + 5 * kept)), exactly, as SQL."""
    return f"1L + (cast({BILLION} as decimal(38,0)) * ({count} + {SMOOTH})) div cast({total} + {SMOOTH} * {kept} as decimal(38,0))"


def tile_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value), source < item: for the sources of tile a and of tile b, the sums over all terms of this task of
    |p - p'| - |p0 - p0'|, where p0 is the share of an absent term. Rows come by (lang, a, b, block) and term; those
    without a term name the sources. Sums of the task's blocks are added up, PAIRS at most at a time."""
    key, names, base, sums, dense, filled, term = None, {}, None, None, None, 0, None
    total: dict[tuple[str, str, str], int] = {}

    def flush() -> None:
        nonlocal filled
        if filled:
            block = dense[:filled]
            for i in range(len(base)):
                sums[i] += np.abs(block - block[:, i : i + 1]).sum(0) - filled * np.abs(base - base[i])
            dense[:filled] = base
            filled = 0

    def done() -> None:
        if sums is not None:
            flush()
            sources, tile = list(names), list(names.values())
            for i, j in zip(*np.nonzero(sums), strict=True):
                if sources[i] < sources[j] and (key[1] == key[2] or tile[i] != tile[j]):
                    pair = (key[0], sources[i], sources[j])
                    total[pair] = total.get(pair, 0) + int(sums[i, j])

    def rows() -> pa.RecordBatch:
        lang, source, item = zip(*total, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(list(total.values()), pa.int64())], ["lang", "source", "item", "value"])

    for batch in batches:
        for lang, a, b, block, t, source, tile, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (lang, a, b, block) != key:
                done()
                if len(total) >= PAIRS:
                    yield rows()
                    total.clear()
                key, names, first, sums, term = (lang, a, b, block), {}, [], None, None
            if t is None:
                names[source] = tile
                first.append(p)
                continue
            if sums is None:
                base, place = np.array(first, np.int64), {s: i for i, s in enumerate(names)}
                sums, dense, filled = np.zeros((len(base), len(base)), np.int64), np.tile(base, (DENSE, 1)), 0
            if t != term:
                if filled == DENSE:
                    flush()
                term = t
                filled += 1
            dense[filled - 1, place[source]] = p
    done()
    if total:
        yield rows()


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value long, rank int) of docs(text, lang, source, ...); other columns are not read.

    Each row is a document; nulls are ''; rows that repeat count each time. Part `pair` has a row for every other source of
    the language, part `term` the `top` terms that are more frequent in the source than in its language, by value and then
    by the bytes of the item. A language in which no term is in least_docs documents has pairs of value 0 and no terms; one
    with a single source has no pairs. An empty table gives an empty result.
    """
    key = ["lang", "source"]
    counts = materialize(partial_counts(docs).groupBy(*key, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    # a row a source: as many as a term's language has sources
    of_term = Window.partitionBy("lang", "term")
    own = counts.withColumns({"docs": F.sum("docs").over(of_term), "all": F.sum("n").over(of_term), "lead": F.row_number().over(of_term.orderBy("source")) == 1})
    own = materialize(own.where(F.col("docs") >= least_docs).drop("docs"), "own")
    groups = docs.selectExpr("coalesce(lang, '') lang", "coalesce(source, '') source").distinct()
    sums = own.groupBy(*key).agg(F.sum("n").alias("total"), F.count("*").alias("n"), F.count_if("lead").alias("leads"))
    groups = groups.join(sums, key, "left").fillna(0)
    of_lang = Window.partitionBy("lang")
    groups = groups.withColumns({"of_lang": F.sum("total").over(of_lang), "kept": F.sum("leads").over(of_lang), "tile": F.floor((F.row_number().over(of_lang.orderBy("source")) - 1) / TILE)})
    groups = materialize(groups.withColumn("tiles", F.max("tile").over(of_lang) + 1).drop("leads"), "groups")
    rows = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = groups.where("kept > 0")
    joined = by_key(own, known, key, rows).withColumn("p", F.expr(share("n", "total", "kept")))

    terms = joined.withColumn("q", F.expr(share("all", "of_lang", "kept"))).where("p > q").selectExpr(*key, "'term' part", "term item", "p - q value")
    best = Window.partitionBy(*key).orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    meet = "explode(transform(sequence(0L, tiles - 1), j -> struct(least(j, tile) as a, greatest(j, tile) as b)))"
    split = joined.where("tiles > 0").selectExpr(*key, "term", f"pmod(xxhash64(term), {parts}) block", "tile", "p", f"{meet} at")
    heads = known.withColumn("p", F.expr(share("0L", "total", "kept"))).selectExpr(*key, "cast(null as string) term", f"explode(sequence(0L, {parts - 1}L)) block", "tile", "p", "tiles")
    heads = heads.selectExpr(*key, "term", "block", "tile", "p", f"{meet} at")
    tiled = split.unionByName(heads).selectExpr("lang", "at.a a", "at.b b", "block", "term", "source", "tile", "p")
    tiled = tiled.repartition("lang", "a", "b", "block").sortWithinPartitions("lang", "a", "b", "block", "term", "source")
    sums = map_arrow(tiled, tile_sums, "lang string, source string, item string, value long").groupBy(*key, "item").agg(F.sum("value").alias("value"))
    absent = groups.withColumn("p", F.expr(f"if(kept = 0, 0L, {share('0L', 'total', 'greatest(kept, 1L)')})"))
    pairs = absent.join(absent.selectExpr("lang", "source item", "p q"), "lang").where("source <> item")
    sums = sums.unionByName(sums.selectExpr("lang", "item source", "source item", "value"))
    pairs = pairs.join(sums, [*key, "item"], "left").selectExpr(*key, "'pair' part", "item", "coalesce(value, 0L) + kept * abs(p - q) value")
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(terms)
