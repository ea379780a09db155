"""SimHash near-duplicates by the generalised pigeonhole principle.

1. One pass makes the fingerprints: bit b is set if it is in over half of the hashes of a text's shingles, repeats included.
   Documents of one fingerprint are one member from there on (grouped minimum), so copies are never paired.
2. Counts of joint bits over all members put correlated bits together into GROUPS groups of WIDTH bits.
3. For every group, the members at each value (at most 65536) give the members within e bits of a value exactly; for two groups
   taken as one part they give an estimate, as if both were independent.
4. If two fingerprints differ in at most t bits and T_1 + .. + T_m = t - m + 1, then in some part i of m they differ in at
   most T_i bits (T_i = -1: never). For each member, dynamic programming over the parts of each partition in PLANS finds the
   thresholds of the fewest estimated candidates, where a probe costs as much as PROBE candidates. The member then probes every
   part's values within its thresholds; members under these values are verified by counting differing bits.
5. Keys with over BLOCK rows are dealt into blocks that meet pairwise, so no key gathers in one task: n rows of a key make n / BLOCK
   copies of 17 bytes each and n^2 / 2 comparisons, which the thresholds avoid wherever other parts are cheaper. A block
   returns links that join its members' components, fewer than it has rows, never all its pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplegrid.llm.bpe import slices
from samplegrid.llm.common import by_key, connected_components, discard, map_arrow, materialize

GROUPS, WIDTH = 4, 16
#: The parts of the partitions to choose from, as groups each; parts of two groups have values of 32 bits.
PLANS = (((0,), (1,), (2,), (3,)), ((0, 1), (2,), (3,)), ((0,), (1,), (2, 3)), ((0, 1), (2, 3)))
PARTS = ((0,), (1,), (2,), (3,), (0, 1), (2, 3))
#: Candidates that may be compared for the price of one probe; rows of a key that meet in one block.
PROBE, BLOCK = 256, 2048
#: Bytes of text whose words are held at once.
PIECE = 1 << 22
WHITE = b" \t\n\x0b\x0c\r"


def words_of(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in pieces of about `size` bytes; a piece ends where a word does."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and text[end] not in WHITE:
            end += 1
        yield text[at:end].lower().split()
        at = end


def shingle_hashes(text: bytes, k: int = 3) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of all shingles of k words, repeats included, in pieces; with fewer words, of the whole sequence."""
    h, kept, any_yet = xxhash.xxh64_intdigest, [], False
    for words in words_of(text):
        kept += words
        if len(kept) >= k:
            joined, at, spots = b" ".join(kept), 0, []
            for w in kept:
                spots.append(at)
                at += len(w) + 1
            ends = [*(s - 1 for s in spots[k:]), len(joined)]
            yield np.array([h(joined[a:b], 42) for a, b in zip(spots, ends, strict=False)], np.uint64)
            any_yet, kept = True, kept[len(kept) - k + 1 :]
    if kept and not any_yet:
        yield np.array([h(b" ".join(kept), 42)], np.uint64)


def bits_of(values: np.ndarray) -> np.ndarray:
    """(n, 64) zeros and ones; column b is the bit of weight 2^b."""
    return np.unpackbits(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprint(text: bytes, k: int = 3) -> int:
    total, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, k):
        for i in range(0, len(hashes), 1 << 16):
            total += bits_of(hashes[i : i + (1 << 16)]).sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp long: the 64 bits) of every row of docs(doc_id, text); a null text is empty. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PIECE):
                texts = part.column("text").cast(pa.large_binary())
                found = np.fromiter((fingerprint(t.as_py() or b"", k) for t in texts), np.uint64, len(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, fp long")


def joint_bits(members: DataFrame) -> np.ndarray:
    """(64, 64): in how many members both bits are set. Each task sends 2080 sums or fewer, as does Spark to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64), np.int64)
        for batch in batches:
            bits = bits_of(batch.column("fp").to_numpy().view(np.uint64)).astype(np.float32)
            for i in range(0, len(bits), 1 << 16):
                total += np.rint(bits[i : i + (1 << 16)].T @ bits[i : i + (1 << 16)]).astype(np.int64)
        a, b = np.nonzero(np.triu(total))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(total[a, b])], ["a", "b", "n"])

    out = np.zeros((64, 64), np.int64)
    for a, b, n in members.select("fp").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n")).collect():
        out[a, b] = out[b, a] = n
    return out


def grouped_bits(joint: np.ndarray, members: int) -> np.ndarray:
    """(GROUPS, WIDTH) bit numbers: each group starts with the most correlated pair left and takes the bit that is most
    correlated with it until it is full."""
    n, set_ = max(members, 1), np.diag(joint).astype(float)
    cov = joint / n - np.outer(set_, set_) / n**2
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(scale, scale))
    np.fill_diagonal(corr, 0)
    left, out = list(range(64)), []
    for _ in range(GROUPS):
        sub = corr[np.ix_(left, left)]
        own = [left[int(sub.sum(1).argmax())] if len(left) == WIDTH else left[int(np.unravel_index(sub.argmax(), sub.shape)[0])]]
        while len(own) < WIDTH:
            rest = [b for b in left if b not in own]
            own.append(rest[int(corr[np.ix_(rest, own)].sum(1).argmax())])
        out.append(sorted(own))
        left = [b for b in left if b not in own]
    return np.array(out)


def gathered(fp: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """(GROUPS, n) values of the groups' bits."""
    out = np.zeros((len(groups), len(fp)), np.uint64)
    for g, bits in enumerate(groups):
        for i, b in enumerate(bits.tolist()):
            out[g] |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def around(counts: np.ndarray, most: int) -> np.ndarray:
    """(most + 1, 2^WIDTH): members at exactly e differing bits from each value."""
    out = np.zeros((most + 1, len(counts)), np.int64)
    out[0] = counts
    at = np.arange(len(counts))
    for b in range(WIDTH):
        out[1:] += out[:-1, at ^ (1 << b)]
    return out


@functools.cache
def masks(width: int, most: int) -> list[np.ndarray]:
    """By e up to most: the values of e set bits among `width`."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(width), e)], np.uint64) for e in range(most + 1)]


def thresholds(near: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The plan of each member, and (PARTS, n) the threshold of each part (-1: not probed). near: around() of each group."""
    n = values.shape[1]
    exact = [near[g][:, values[g].astype(np.int64)].astype(float) for g in range(GROUPS)]
    cost = {}
    for part in PARTS:
        if len(part) == 1:
            candidates = exact[part[0]]
        else:
            a, b = (exact[g] for g in part)
            total = max(near[part[0]][0].sum(), 1)
            candidates = np.stack([sum(a[i] * b[e - i] for i in range(e + 1)) / total for e in range(most + 1)])
        probes = np.array([len(m) for m in masks(WIDTH * len(part), most)], float)
        cost[part] = np.vstack([np.zeros(n), np.cumsum(candidates + PROBE * probes[:, None], axis=0)])  # row T + 1
    best, plan, chosen = np.full(n, np.inf), np.zeros(n, np.int64), np.full((len(PARTS), n), -1, np.int64)
    for k, parts in enumerate(PLANS):
        budget = most + 1  # the sum of T_i + 1 over all parts
        table, back = np.full((budget + 1, n), np.inf), []
        table[0] = 0
        for part in parts:
            options = np.stack([np.stack([table[s - x] + cost[part][x] if x <= s else np.full(n, np.inf) for x in range(budget + 1)]) for s in range(budget + 1)])
            back.append(options.argmin(1))
            table = options.min(1)
        better = table[budget] < best
        best[better], plan[better] = table[budget][better], k
        chosen[:, better] = -1
        left = np.full(n, budget)
        for part, pick in zip(reversed(parts), reversed(back), strict=True):
            x = pick[left, np.arange(n)]
            chosen[PARTS.index(part), better] = x[better] - 1
            left = left - x
    return plan, chosen


def probes(members: DataFrame, groups: np.ndarray, near: np.ndarray, most: int) -> DataFrame:
    """(key, fp, side): side 1: a member under its own value of a part, 2: one that probes this value, 3: both. Values of
    parts that the member itself does not probe are written too, as others may probe them."""
    tables = members.sparkSession.sparkContext.broadcast(near)  # GROUPS * (most + 1) * 2^WIDTH numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = {len(p): masks(WIDTH * len(p), most) for p in PARTS}
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                fp = batch.column("fp").to_numpy()[lo : lo + 4096]
                values = gathered(fp.view(np.uint64), groups)
                _, chosen = thresholds(tables.value, values, most)
                for i, part in enumerate(PARTS):
                    value = values[part[0]] | (values[part[-1]] << np.uint64(WIDTH) if len(part) > 1 else np.uint64(0))
                    base = (np.uint64(i) << np.uint64(2 * WIDTH)) | value
                    keys, owners, sides = [base], [fp], [np.where(chosen[i] >= 0, 3, 1)]
                    for e in range(1, most + 1):
                        own = np.flatnonzero(chosen[i] >= e)
                        flip = flips[len(part)][e]
                        keys.append((base[own][:, None] ^ flip).reshape(-1))
                        owners.append(np.repeat(fp[own], len(flip)))
                        sides.append(np.full(len(own) * len(flip), 2))
                    arrays = [np.concatenate(x) for x in (keys, owners, sides)]
                    yield pa.RecordBatch.from_arrays([pa.array(arrays[0].view(np.int64)), pa.array(arrays[1]), pa.array(arrays[2], pa.int8())], ["key", "fp", "side"])

    return members.select("fp").mapInArrow(run, "key long, fp long, side byte")


def block_links(fp: np.ndarray, side: np.ndarray, left: np.ndarray, whole: bool, most: int) -> list[tuple[int, int]]:
    """Links between members of a block (whole), or of a block (left) and another one, one of which probes the other: a spanning
    forest of the components."""
    label, out, bits = np.arange(len(fp)), [], fp.view(np.uint64)
    right = np.arange(len(fp)) if whole else np.flatnonzero(~left)
    for i in range(len(fp)) if whole else np.flatnonzero(left):
        others = right[right > i] if whole else right
        others = others[(label[others] != label[i]) & ((side[others] | side[i]) == 3)]
        others = others[np.bitwise_count(bits[others] ^ bits[i]) <= most]
        if len(others):
            found, first = np.unique(label[others], return_index=True)
            out += [(int(fp[i]), int(fp[j])) for j in others[first]]
            label[np.isin(label, found)] = label[i]
    return out


def verified(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows (key, p, q, fp, side, part) that come by (key, p, q)."""
    few = 16
    rest = None

    def links(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        new = np.zeros(len(x["key"]), bool)
        for c in ("key", "p", "q"):
            new[1:] |= x[c][1:] != x[c][:-1]
        starts = np.flatnonzero(np.concatenate([[True], new[1:]]))
        sizes = np.diff(np.append(starts, len(new)))
        run, small = np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes <= few, sizes)
        bits, a, b = x["fp"].view(np.uint64), [], []
        for d in range(1, min(few, int(sizes.max(initial=1)))):
            i = np.flatnonzero((run[d:] == run[:-d]) & small[d:])
            i = i[((x["side"][i] | x["side"][i + d]) == 3) & (np.bitwise_count(bits[i] ^ bits[i + d]) <= most)]
            i = i[x["fp"][i] != x["fp"][i + d]]
            a.append(x["fp"][i])
            b.append(x["fp"][i + d])
        for s, n in zip(starts[sizes > few].tolist(), sizes[sizes > few].tolist(), strict=True):
            cut = slice(s, s + n)
            left = x["part"][cut] == x["p"][cut]
            found = block_links(x["fp"][cut], x["side"][cut], left, x["p"][s] == x["q"][s], most)
            a.append(np.array([f[0] for f in found], np.int64))
            b.append(np.array([f[1] for f in found], np.int64))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    for batch in batches:
        if not len(batch):
            continue
        x = {c: batch.column(c).to_numpy() for c in batch.schema.names}
        if rest is not None:
            x = {c: np.concatenate([rest[c], v]) for c, v in x.items()}
        # the last run may go on in the next batch
        last = np.flatnonzero(np.logical_or.reduce([x[c][1:] != x[c][:-1] for c in ("key", "p", "q")]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield from links({c: v[:cut] for c, v in x.items()})
        rest = {c: v[cut:] for c, v in x.items()}
    if rest is not None:
        yield from links(rest)


def near_duplicates(docs: DataFrame, most: int = 3, k: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs(doc_id, text, ...); other columns are not read.

    Fingerprints (16 hexadecimal digits) link if they differ in at most `most` bits (0 to 3). component_id is the
    smallest doc_id reachable. Null, empty and blank texts have fingerprint zero, linked like any other. Rows that repeat a
    doc_id are each a document of their own; rows without a doc_id link others, and have a null component only if all that
    they reach have none. An empty table gives an empty result.
    """
    if not 0 <= most < GROUPS:
        raise ValueError(f"most must be from 0 to {GROUPS - 1}")
    sig = materialize(fingerprints(docs, k), "sig")
    members = materialize(sig.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "members")
    rows = members.count()
    groups = grouped_bits(joint_bits(members), rows)
    comp = None
    if rows > 1:
        counts = np.zeros((GROUPS, 1 << WIDTH), np.int64)
        packed = [" | ".join(f"shiftleft(shiftrightunsigned(fp, {b}) & 1, {i})" for i, b in enumerate(bits.tolist())) for bits in groups]
        values = members.select(F.posexplode(F.array(*map(F.expr, packed))).alias("part", "value"))
        # at most GROUPS * 2^WIDTH rows
        for part, value, n in values.groupBy("part", "value").agg(F.count("*")).toPandas().itertuples(index=False):
            counts[part, value] = n
        near = np.stack([around(c, most) for c in counts])
        probing = materialize(probes(members, groups, near, most), "probes")
        big = materialize(probing.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "big")
        if big.limit(1).count():
            parts = big.withColumn("parts", F.expr(f"cast(ceil(n / {BLOCK}) as int)"))
            dealt = by_key(probing, parts, "key", probing.count(), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        else:
            dealt = probing.withColumn("parts", F.lit(1))
        dealt = dealt.withColumn("part", F.expr("cast(pmod(xxhash64(fp), parts) as int)")).withColumn("other", F.expr("explode(sequence(0, parts - 1))"))
        dealt = dealt.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "fp", "side", "part")
        dealt = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
        found = materialize(dealt.mapInArrow(lambda it: verified(it, most), "a long, b long").distinct(), "links")
        comp = materialize(connected_components(found), "comp")
        discard(probing, big, found)
    else:
        comp = members.select(F.col("fp").alias("node"), F.col("fp").alias("component")).limit(0)
    named = members.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = materialize(named, "named")
    least = materialize(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "least")
    label = materialize(by_key(named.drop("least").withColumnRenamed("n", "copies"), least, "component", rows).selectExpr("fp", "component_id", "copies n"), "label")
    total = label.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return by_key(sig, label, "fp", total).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
