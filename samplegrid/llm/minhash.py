"""Near-duplicate documents by b-bit MinHash.

1. One pass makes, per document, the set of distinct word shingles (as 64-bit hashes), a fingerprint of the set,
   32 bands of 4 minima, and a packed signature of the low 4 bits of 128 minima.
2. Documents with equal sets become one representative (grouped minimum), so copies are never paired.
3. Bands become buckets. In every bucket the other members are paired with up to three leaders. Bit counts of the
   signatures' exclusive-or give a collision-corrected estimate; pairs six standard errors under the threshold go.
   The others are confirmed on full sets.
4. Components of confirmed links show which buckets are settled. In the others, members outside the bucket's largest
   component meet all members of other components, in blocks of bounded size: by signature, then on full sets at once. A
   block returns the links that join its components, fewer than it has members. So no link between different texts that
   share a band is lost, and no group is expanded into its pairs. With s strangers among n members, (s / BLOCK) * n rows and
   s * n comparisons of signatures are made: linear for few strangers, quadratic where most members of a bucket stay unlinked.

At the threshold 0.85, a pair shares none of 32 bands of 4 with probability (1 - 0.85^4)^32 = 6e-11.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplegrid.llm.bpe import slices
from samplegrid.llm.common import by_key, connected_components, discard, map_arrow, materialize, small

HASHES, BANDS, BITS = 128, 32, 4
#: Members of a block in an unsettled bucket, and shingles of all its members.
BLOCK, BLOCK_SHINGLES = 256, 1 << 18
#: Pairs that meet one copy of a leader's set.
FAN = 1000
#: Bytes of the texts whose sets a worker makes at once; the arrays of one step are some 40 times as large.
TEXTS = 1 << 19

_rng = np.random.default_rng(20240607)
_LETTER = _rng.integers(1, 2**63, 256, np.uint64)
_BASE = np.uint64(int(_rng.integers(2**62, 2**63)) | 1)
_SLOT = _rng.integers(2**62, 2**63, 8, np.uint64) | np.uint64(1)
_MUL = _rng.integers(2**62, 2**63, HASHES, np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, HASHES, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    np.multiply.accumulate(np.full(n - 1, _BASE), out=out[1:]) if n > 1 else None
    return out


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts after each other, and the n + 1 offsets of the texts.

    Words are runs of bytes other than space and \\x09-\\x0D, with A-Z lowered. With fewer than k words, the whole
    sequence is the one shingle; a null or wordless text has none.
    """
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if n else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    upper = (data >= 65) & (data <= 90)
    data = data + (upper * np.uint8(32)).astype(np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    first = ~space
    first[1:] &= space[:-1]
    inner = offsets[1:-1][offsets[1:-1] < len(data)]
    first[inner] = ~space[inner]
    starts = np.flatnonzero(first)
    last = ~space
    last[:-1] &= space[1:]
    last[inner[inner > 0] - 1] = ~space[inner[inner > 0] - 1]
    ends = np.flatnonzero(last)
    # word hash: letters times powers of a base counted from the word's start, by cumulative sums
    length = int((ends - starts).max(initial=0)) + 1
    powers = _powers(length)
    at = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if len(starts) and starts[0] == 0 else None
    if at is None:
        lead = int(starts[0]) if len(starts) else len(data)
        at = np.concatenate([np.zeros(lead, np.int64), np.arange(lead, len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))])
    value = _LETTER[data]
    value *= powers[np.minimum(at, length - 1)]
    value[space] = 0
    total = np.cumsum(value, dtype=np.uint64)
    del value, at
    word = _mix(total[ends] - np.where(starts > 0, total[starts - 1], np.uint64(0)) + (ends - starts).astype(np.uint64))
    del total
    doc = np.searchsorted(offsets, starts, side="right") - 1
    count = np.bincount(doc, minlength=n)
    m = len(word)
    parts, owners = [], []
    if m >= k:
        h = np.zeros(m - k + 1, np.uint64)
        for j in range(k):
            h += word[j : m - k + 1 + j] * _SLOT[j]
        whole = doc[: m - k + 1] == doc[k - 1 :]
        parts.append(_mix(h[whole]))
        owners.append(doc[: m - k + 1][whole])
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        begin = np.searchsorted(doc, short)
        h = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            h[has] += word[begin[has] + j] * _SLOT[j]
        parts.append(_mix(h + count[short].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        owners.append(short)
    h, owner = np.concatenate(parts) if parts else np.empty(0, np.uint64), np.concatenate(owners) if owners else np.empty(0, np.int64)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    return h, np.searchsorted(owner, np.arange(n + 1))


def minima(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(sets, HASHES) smallest values under each of the hash functions; empty sets get the largest value."""
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes)
    out = np.full((len(sizes), HASHES), np.iinfo(np.uint64).max, np.uint64)
    begin = offsets[:-1][full]
    if len(full):
        # groups of sets with about 32k shingles, which stay in the cache
        group = begin // 32768
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(full)]
        for a, b in zip(edges, edges[1:], strict=False):
            lo, hi = begin[a], offsets[full[b - 1] + 1]
            x, at = h[lo:hi], begin[a:b] - lo
            buffer = np.empty_like(x)
            for i in range(HASHES):
                np.multiply(x, _MUL[i], out=buffer)
                np.add(buffer, _ADD[i], out=buffer)
                out[full[a:b], i] = np.minimum.reduceat(buffer, at)
    return out


def _lists(values: np.ndarray) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1).view(np.int64)))


def signatures(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, fp1, fp2, bands array<long>, sig array<long>) of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXTS):
                h, offsets = shingle_sets(part.column("text"), k)
                low = minima(h, offsets)
                sizes = np.diff(offsets)
                sums = np.zeros((2, len(h) + 1), np.uint64)
                np.cumsum(h, out=sums[0, 1:])
                np.cumsum(_mix(h + np.uint64(0x51ED270B)), out=sums[1, 1:])
                fp = sums[:, offsets[1:]] - sums[:, offsets[:-1]]
                rows = HASHES // BANDS
                # the high bits of the products are the well-mixed ones
                grouped = _mix(low >> np.uint64(8)).reshape(len(low), BANDS, rows)
                key = np.zeros((len(low), BANDS), np.uint64)
                for j in range(rows):
                    key = _mix(key * _SLOT[j] + grouped[:, :, j])
                key ^= _mix(np.arange(1, BANDS + 1, dtype=np.uint64))
                nibble = _mix(low).reshape(len(low), HASHES // 16, 16) & np.uint64(15)
                sig = np.bitwise_or.reduce(nibble << (np.arange(16, dtype=np.uint64) * np.uint64(BITS)), axis=2)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), *(pa.array(x.view(np.int64)) for x in fp), _lists(key), _lists(sig)],
                    ["doc_id", "n_shingles", "fp1", "fp2", "bands", "sig"],
                )

    schema = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, sig array<long>"
    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, schema)


def full_sets(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, shingles array<long>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXTS):
                h, offsets = shingle_sets(part.column("text"), k)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "shingles"])

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, shingles array<long>")


def least_agreement(threshold: float) -> int:
    """Equal nibbles that a pair at the threshold has at least, but for six standard errors."""
    p = threshold + (1 - threshold) / 2**BITS
    return int(np.floor(HASHES * (p - 6 * np.sqrt(p * (1 - p) / HASHES))))


def agreement(a: str, b: str):
    """Equal nibbles of two signatures, as a Column: bit counts of the folded exclusive-or."""
    folded = "(x ^ y) | shiftrightunsigned(x ^ y, 1)"
    folded = f"({folded}) | shiftrightunsigned({folded}, 2)"
    return F.expr(f"{HASHES} - aggregate(zip_with({a}, {b}, (x, y) -> bit_count(({folded}) & 1229782938247303441)), 0, (s, c) -> s + c)")


def whole_sets(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, shingles) of ids(doc_id); a doc_id that repeats with different texts has a row for each set."""
    wanted = docs.selectExpr("cast(doc_id as long) doc_id", "text").join(small(ids), "doc_id", "left_semi")
    return materialize(full_sets(wanted, k).withColumn("f", F.xxhash64("shingles")).dropDuplicates(["doc_id", "f"]).drop("f"), "sets")


def confirm(pairs: DataFrame, docs: DataFrame, percent: int, k: int) -> DataFrame:
    """Of the (a, b), those with 100 * intersection >= percent * union of their full sets. b may stand in many pairs: its set
    is copied, once for FAN pairs, so that they don't meet in one task."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    sets = whole_sets(ids, docs, k)
    fan = materialize(pairs.groupBy("b").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / FAN)), "fan")
    total = fan.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    both = by_key(pairs, fan, "b", total).selectExpr("a", "b", "pmod(xxhash64(a), salts) salt")
    both = both.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    copies = sets.join(fan.selectExpr("b doc_id", "salts"), "doc_id").selectExpr("doc_id b", "shingles sb", "explode(sequence(0L, salts - 1)) salt")
    both = both.join(copies, ["b", "salt"]).withColumn("i", F.expr("size(array_intersect(sa, sb))"))
    out = materialize(both.where(f"100 * i >= {percent} * (size(sa) + size(sb) - i)").select("a", "b").distinct(), "links")
    discard(ids, sets, fan)
    return out


def _block_links(pdf, least: int, percent: int):
    """Links that join different components of a block (or of two blocks): a spanning forest, not all pairs."""
    import pandas as pd

    values, flat = np.unique(np.concatenate(pdf["shingles"].to_numpy()), return_inverse=True)
    sizes = np.array([len(x) for x in pdf["shingles"]])
    sets = np.split(flat, np.cumsum(sizes)[:-1])
    sig = np.stack(pdf["sig"].to_numpy()).astype(np.uint64)
    rep, label, side = pdf["rep"].to_numpy(), pdf["comp"].to_numpy().copy(), pdf["side"].to_numpy()
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    mark, out = np.zeros(len(values), bool), []
    for i in left:
        others = right[right > i] if side[i] == 2 else right
        others = others[label[others] != label[i]]
        if not len(others):
            continue
        x = sig[others] ^ sig[i]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        equal = HASHES - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(1)
        others, equal = others[equal >= least], equal[equal >= least]
        mark[sets[i]] = True
        for j in others[np.argsort(-equal, kind="stable")]:
            if label[j] != label[i]:
                common = np.count_nonzero(mark[sets[j]])
                if 100 * common >= percent * (sizes[i] + sizes[j] - common):
                    out.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
                    label[label == label[j]] = label[i]
        mark[sets[i]] = False
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text, ...); other columns are not read.

    Rows link if 100 * intersection >= percent * union of their sets of k-word shingles. component_id is the
    smallest doc_id reachable. A text without words has an empty set and stands alone, as does a null text. Rows
    that repeat a doc_id are one document (their sets link its component together) and come out once each. A null
    doc_id gives a null component and kept = false. An empty table gives an empty result.
    """
    least = least_agreement(percent / 100)
    sig = materialize(signatures(docs, k), "sig")
    known = sig.where("doc_id is not null and n_shingles > 0")
    same = ["fp1", "fp2", "n_shingles"]
    reps = materialize(known.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "reps")
    total = reps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    member = materialize(by_key(known.select("doc_id", *same), reps, same, total).select("doc_id", "rep"), "member")
    own = known.join(member.where("doc_id = rep").select("doc_id").distinct(), "doc_id", "left_semi")
    bands = own.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("size"), F.explode("bands").alias("key")).groupBy("rep", "key").agg(F.max("size").alias("size"))
    bands = materialize(bands, "bands")
    # by an order of all documents, so that few different leaders serve the many buckets of one family
    order = F.xxhash64("rep")
    leaders = bands.groupBy("key").agg(
        F.count("*").alias("n"), F.min("rep").alias("l1"), F.max("rep").alias("l2"), F.min(F.struct(order.alias("o"), F.col("rep").alias("l"))).alias("l3")
    )
    leaders = materialize(leaders.where("n > 1").select("key", "n", F.array_distinct(F.array("l1", "l2", "l3.l")).alias("leaders")), "leaders")
    total = leaders.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = materialize(by_key(bands, leaders, "key", total), "buckets")
    discard(reps, bands, leaders)
    # (a, b): b leads a; a document has at most three leaders in each of its buckets, a leader may have many followers
    stars = buckets.select(F.col("rep").alias("a"), F.explode("leaders").alias("b")).where("a != b").distinct()
    stars = materialize(stars, "pairs")
    signs = materialize(own.join(buckets.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "sig").distinct(), "signs")
    fan = stars.groupBy("b").agg(F.count("*").alias("n"))
    fan = materialize(signs.select(F.col("doc_id").alias("b"), F.col("sig").alias("s2")).join(fan, "b"), "fan")
    total = fan.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    followed = by_key(stars, fan, "b", total).join(signs.select(F.col("doc_id").alias("a"), F.col("sig").alias("s1")), "a")
    near = materialize(followed.where(agreement("s1", "s2") >= least).select("a", "b").distinct(), "near")
    links = confirm(near, docs, percent, k)
    comp = materialize(connected_components(links), "comp")
    discard(stars, fan, near, links)

    now = buckets.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
    now = now.select("key", "rep", "size", F.coalesce("component", "rep").alias("comp"))
    # of each open bucket: members and shingles inside and outside its largest component
    parts = now.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size")).groupBy("key")
    parts = parts.agg(F.max(F.struct("n", "size", "comp")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("comps")).where("comps > 1 and n > 2")
    count = f"cast(greatest(ceil(({{0}}) / {BLOCK}), ceil(({{1}}) / {BLOCK_SHINGLES})) as int)"
    parts = parts.selectExpr("key", "n", "main.comp main", count.format("n - main.n", "size - main.size") + " others", count.format("main.n", "main.size") + " mains")
    parts = materialize(parts, "parts")
    if parts.limit(1).count():
        now = materialize(now.join(small(parts.select("key")), "key", "left_semi"), "open")
        total = parts.agg(F.sum("n")).first()[0]
        # parts 0 .. others - 1 hold the members outside the largest component, the following ones those inside. A part p of the
        # former meets all parts q >= p: as the left side of (p, q), or as both sides if p = q
        rest = by_key(now, parts, "key", total).selectExpr("*", "if(comp = main, others + pmod(xxhash64(rep), mains), pmod(xxhash64(rep), others)) part")
        rest = rest.selectExpr("key", "rep", "comp", "part", "explode(sequence(0, if(comp = main, others, others + mains) - 1)) q")
        rest = materialize(rest.selectExpr("key", "least(part, q) p", "greatest(part, q) q", "case when part = q then 2 when part < q then 0 else 1 end side", "rep", "comp"), "rest")
        ids = materialize(rest.select(F.col("rep").alias("doc_id")).distinct(), "ids")
        sets = whole_sets(ids, docs, k)
        rest = rest.join(sets.join(signs, "doc_id").withColumnRenamed("doc_id", "rep"), "rep")
        more = materialize(rest.groupBy("key", "p", "q").applyInPandas(lambda pdf: _block_links(pdf, least, percent), "a long, b long").distinct(), "more")
        ends = comp.select(F.col("node").alias("a"), F.col("component").alias("b"))
        done, comp = comp, materialize(connected_components(more.unionByName(ends)), "comp")
        discard(now, ids, sets, more, done)
    discard(buckets, signs, parts)
    # copies of a set follow their representative; a repeated doc_id may stand in more than one set
    split = member.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("rep2"))
    bridges = split.where("rep != rep2").select(F.col("rep").alias("a"), F.col("rep2").alias("b"))
    bridges = materialize(member.join(bridges.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "rep", "left_semi").selectExpr("doc_id a", "rep b"), "bridges")
    if bridges.limit(1).count():
        ends = comp.select(F.col("node").alias("a"), F.col("component").alias("b"))
        comp = materialize(connected_components(bridges.unionByName(ends)), "comp")
    split = materialize(split.select("doc_id", "rep"), "split")
    copies = split.groupBy("rep").agg(F.count("*").alias("n")).join(comp.select(F.col("node").alias("rep"), "component"), "rep")
    label = by_key(split, materialize(copies, "copies"), "rep", split.count(), "left")
    label = label.select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    discard(member, bridges)
    out = sig.select("doc_id", "n_shingles").join(label, "doc_id", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicate(docs: DataFrame, percent: int = 85, k: int = 5) -> DataFrame:
    """docs with one row of each near-duplicate component: the one of the smallest doc_id. Rows without an id stay; of rows
    that repeat a kept id, one stays."""
    judged = near_duplicates(docs, percent, k).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept"))
    judged = materialize(judged.where("not kept or n > 1"), "judged")
    out = docs.join(small(judged.where("not kept").select("doc_id")), "doc_id", "left_anti")
    twice = judged.where("kept and n > 1").select("doc_id")
    if twice.limit(1).count():
        out = out.join(small(twice), "doc_id", "left_anti").unionByName(out.join(small(twice), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return out.select(*docs.columns)
