"""Symbol operators on whole documents (doc_id, b): a document's bytes are one value, so nothing is dealt out or sorted by document.

Documents come in Arrow batches and are worked on some at a time, as one array of bytes. Those of over WHOLE bytes go to the operators on
(doc_id, pos, s), whose windows can spill (by_length)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a document that one task works on by itself; bytes of documents that are worked on together.
WHOLE, PIECE = 1 << 20, 1 << 18


def rows(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, s) of docs(doc_id, b)."""
    return docs.select("doc_id", F.posexplode(F.split(F.decode("b", "iso-8859-1"), "")).alias("pos", "c")).select("doc_id", "pos", F.ascii("c").alias("s"))


def by_length(docs: DataFrame, short: Callable[[DataFrame], DataFrame], long_: Callable[[DataFrame], DataFrame], whole: int = WHOLE) -> DataFrame:
    """short() of the documents of up to `whole` bytes, and long_() of the rows of longer ones, if there are any. docs(doc_id, b, n), n being the bytes."""
    over = docs.where(F.col("n") > whole).select("doc_id", "b")
    out = short(docs.where(F.col("n") <= whole).select("doc_id", "b"))
    return out.unionByName(long_(rows(over))) if over.limit(1).count() else out


class Piece:
    """Some documents as one array s; document k is s[starts[k]:starts[k + 1]]. more: the batch's other columns, sliced."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, s: np.ndarray, more: list = ()):
        self.ids, self.starts, self.s, self.more = ids, starts, s, more
        self.lens = np.diff(starts)
        self.doc = np.repeat(np.arange(len(ids)), self.lens)

    @property
    def pos(self) -> np.ndarray:
        return np.arange(len(self.s)) - self.starts[self.doc]

    def before(self, k: int = 1, a: np.ndarray | None = None) -> np.ndarray:
        """The symbol (or value of a) k places before, 0 before a document's start."""
        a = self.s if a is None else a
        out = np.zeros_like(a)
        out[k:] = a[:-k]
        firsts = self.starts[:-1]
        for j in range(k):
            at = firsts + j
            out[at[at < len(out)]] = 0
        return out

    def halves(self) -> Piece:
        """The two halves of each byte as symbols, the high one first."""
        return Piece(self.ids, self.starts * 2, np.column_stack([self.s >> 4, self.s & 15]).ravel())

    def bits(self) -> Piece:
        """The eight bits of each byte as symbols, the high one first."""
        return Piece(self.ids, self.starts * 8, np.unpackbits(self.s))

    def words(self) -> np.ndarray:
        """Of each byte, it and the three before."""
        s = self.s.astype(np.uint32)
        return s | self.before(1, s) << 8 | self.before(2, s) << 16 | self.before(3, s) << 24

    def past_bits(self, skip: int, n: int) -> np.ndarray:
        """For each bit of each byte, the n bits before it less the last `skip`; n + skip up to 24."""
        return (self.words()[:, None] >> np.arange(8 + skip, skip, -1, dtype=np.uint32) & np.uint32((1 << n) - 1)).ravel()

    def sums(self, a: np.ndarray, doc: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.doc if doc is None else doc, weights=a, minlength=len(self.ids))


def pieces(batches: Iterator, size: int) -> Iterator[Piece]:
    for batch in batches:
        b = batch.column(1)
        _, ends, data = b.buffers()
        ends = np.frombuffer(ends, np.int32)[b.offset : b.offset + len(b) + 1].astype(np.int64) if len(b) else np.zeros(1, np.int64)
        ids, data = batch.column(0).to_numpy(zero_copy_only=False), np.frombuffer(data or b"", np.uint8)
        low = 0
        while low < len(ids):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + size, "right")) - 1)
            yield Piece(ids[low:high], ends[low : high + 1] - ends[low], data[ends[low] : ends[high]], [c.slice(low, high - low) for c in batch.columns[2:]])
            low = high


def mapped(docs: DataFrame, run: Callable[[Piece], dict], schema: str, size: int = PIECE) -> DataFrame:
    """The columns that run() makes of each piece: arrays, or (starts, bytes) for binaries."""

    def each(batches):
        import pyarrow as pa

        def column(a):
            if isinstance(a, tuple):
                return pa.BinaryArray.from_buffers(pa.binary(), len(a[0]) - 1, [None, pa.py_buffer(a[0].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(a[1]))])
            return pa.array(a)

        for p in pieces(batches, size):
            out = run(p)
            yield pa.RecordBatch.from_arrays([column(a) for a in out.values()], list(out))

    return docs.mapInArrow(each, schema)


def in_groups(p: Piece, key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of p in the order of key (of `width` bits), documents and places, and whether each has the key and the document of the one before it."""
    n = len(key)
    low = max(1, (n - 1).bit_length())
    kind = np.uint32 if width + low <= 32 else np.uint64
    places = np.arange(n, dtype=kind)
    if width + low <= 64:
        order = np.sort(key.astype(kind) << kind(low) | places)
        same = order[1:] >> kind(low) == order[:-1] >> kind(low)
        order = (order & kind((1 << low) - 1)).astype(np.int64)
    else:
        # by the high bits of a product; keys that share them by chance are sorted by all bits
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed = mixed * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(low) << np.uint64(low)
        order = np.sort(mixed | places)
        alike = order[1:] >> np.uint64(low) == order[:-1] >> np.uint64(low)
        order = (order & np.uint64((1 << low) - 1)).astype(np.int64)
        same = key[order[1:]] == key[order[:-1]]
        if np.any(alike & ~same):
            order = np.lexsort((places, key))
            same = key[order[1:]] == key[order[:-1]]
    doc = p.doc[order]
    return order, np.concatenate([np.zeros(min(n, 1), bool), same & (doc[1:] == doc[:-1])])


def _bits_in_groups(p: Piece, key: np.ndarray, width: int, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bits of p's bytes in the order of documents, key and places: numbers that end in the step's bit and the bit itself, whether each has the key and the
    document of the one before it, and where the documents begin."""
    s = np.unpackbits(p.s)
    low = max(1, (len(s) - 1).bit_length())
    assert width + low + len(p.ids).bit_length() + 2 <= 64
    out = np.repeat(p.doc.astype(np.uint64) << np.uint64(width), 8) | key
    out = (out << np.uint64(low) | np.arange(len(s), dtype=np.uint64)) << np.uint64(2) | (step << np.uint32(1) | s)
    out.sort()
    group = out >> np.uint64(low + 2)
    return out, np.concatenate([[False], group[1:] == group[:-1]]), p.starts[:-1] * 8


def heads(same: np.ndarray) -> np.ndarray:
    """For each place of in_groups() where its group begins."""
    return np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))


# models


def order_of(k: int, width: int = 8) -> Callable[[Piece], tuple[np.ndarray, int]]:
    """The k symbols before as one number, and its bits."""

    def context(p: Piece):
        out = np.zeros(len(p.s), np.uint64)
        for i in range(k):
            out |= p.before(i + 1).astype(np.uint64) << np.uint64(i * width)
        return out, k * width

    return context


def folded(k: int) -> Callable[[Piece], tuple[np.ndarray, int]]:
    """The low halves of the k symbols before."""

    def context(p: Piece):
        out = np.zeros(len(p.s), np.uint64)
        for i in range(k):
            out |= (p.before(i + 1) & 15).astype(np.uint64) << np.uint64(i * 4)
        return out, k * 4

    return context


def with_place(context: Callable, div: int = 1, mod: int = 0) -> Callable[[Piece], tuple[np.ndarray, int]]:
    """The context and pos div `div`, or that modulo `mod`."""

    def both(p: Piece):
        key, width = context(p)
        place = p.pos // div
        place = place % mod if mod else place
        return key | place.astype(np.uint64) << np.uint64(width), width + int(place.max(initial=0)).bit_length()

    return both


def adaptive_bits(docs: DataFrame, context: Callable[[Piece], tuple[np.ndarray, int]], gain: int = 2, alphabet: int = 257, unit: str = "byte") -> DataFrame:
    """symbols.adaptive_bits(). The bits of a context depend on the counts of its symbols alone, not on their order: the counts take the steps
    1, 1 + gain ... each and their sum the steps alphabet, alphabet + gain ..."""
    tables: dict[int, np.ndarray] = {}

    def steps(first: int, n: np.ndarray) -> np.ndarray:
        most = int(n.max(initial=0))
        if len(tables.get(first, ())) <= most:
            logs = np.log2(first + gain * np.arange(2 * most + 16, dtype=np.longdouble))
            tables[first] = np.concatenate([[0], np.cumsum(logs)]).astype(float)
        return tables[first][n]

    def run(p: Piece):
        if unit == "bit":
            key, width = p.past_bits(1, 16), 16
            p = p.bits()
        else:
            p = p.halves() if unit == "half" else p
            key, width = context(p)
        least = {"byte": 8, "half": 4, "bit": 1}[unit]
        kind = np.uint32 if width + least + len(p.ids).bit_length() <= 32 else np.uint64
        key = np.sort((p.doc.astype(kind) << kind(width) | key.astype(kind)) << kind(least) | p.s.astype(kind))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n, key = np.diff(np.append(first, len(key))), key[first] >> kind(least)
        outer = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        doc = (key >> kind(width)).astype(np.int64)
        bits = p.sums(steps(alphabet, np.add.reduceat(n, outer)), doc[outer]) - p.sums(steps(1, n), doc)
        return {"doc_id": p.ids, "bits": bits}

    return mapped(docs, run, "doc_id long, bits double", PIECE // 4 if unit == "bit" else PIECE)


def context_hits(docs: DataFrame, k: int, unit: str = "byte") -> DataFrame:
    """symbols.context_hits(), of bits with k of 24 at most."""

    def run(p: Piece):
        if unit == "bit":
            key, same, starts = _bits_in_groups(p, p.past_bits(0, k), k, np.uint32(0))
            s = (key & np.uint64(1)).astype(np.uint8)
            guess = np.concatenate([s[:1] * 0, s[:-1]]) * same
            return {"doc_id": p.ids, "n": p.lens * 8, "hits": np.add.reduceat(guess == s, starts, dtype=np.int64)}
        order, same = in_groups(p, *order_of(k)(p))
        s = p.s[order]
        guess = np.concatenate([s[:1] * 0, s[:-1]]) * same
        hits = np.bincount(p.doc[order[guess == s]], minlength=len(p.ids))
        return {"doc_id": p.ids, "n": p.lens, "hits": hits}

    return mapped(docs, run, "doc_id long, n long, hits long", PIECE // 4 if unit == "bit" else PIECE)


def rolling_bits(docs: DataFrame, gain: int = 16, alphabet: int = 257) -> DataFrame:
    """models.rolling_bits(), by the same steps."""

    def run(p: Piece):
        # each document with a 0 before it
        at = np.arange(len(p.s)) + p.doc + 1
        s = np.zeros(len(p.s) + len(p.ids), np.uint8)
        s[at] = p.s
        late = Piece(p.ids, p.starts + np.arange(len(p.ids) + 1), s)
        order, same = in_groups(late, s, 8)
        j = late.pos[order]
        head = heads(same)
        drift = (gain + 1) * (np.arange(len(s)) - head + 1) - j
        # groups one below the other, so that the least value so far is that of the group
        far = np.int64((gain + 2) * (int(p.lens.max()) + 2)) * 2
        level = np.cumsum(~same) * far
        low = 1 + drift - (np.minimum.accumulate(drift - level) + level)
        last, was = np.roll(j, 1), np.roll(low, 1)
        count = np.where(~same, 1, np.where(last == j - 1, was, np.maximum(1, was + gain - (j - 2 - last))))
        again = np.append(same[1:], False)
        end = np.where(again, np.minimum(np.roll(j, -1), j + low + gain), j + low + gain)
        doc = late.doc[order]
        end, doc = end[kept := end < p.lens[doc]], doc[kept]
        ends = np.bincount(p.starts[doc] + end, minlength=len(p.s))

        def running(a):
            total = np.concatenate([[0], np.cumsum(a)])
            return total[1:] - total[p.starts[:-1]][p.doc]

        ended = running(ends)
        fallen = running(ended) - ended
        i = p.pos
        all_ = alphabet + gain * i - i * (i - 1) // 2 + fallen
        by_place = np.empty(len(s), np.int64)
        by_place[order] = count
        return {"doc_id": p.ids, "bits": p.sums(-np.log2(by_place[at] / all_))}

    return mapped(docs, run, "doc_id long, bits double")


def bit_chain_bits(docs: DataFrame) -> DataFrame:
    """models.bit_chain_bits(): the chance of a history is the middle and a running sum, but where that leaves the bounds, which is walked step by step."""
    from samplegrid.operators.models import CHAIN_GAIN, CHAIN_STEPS, CHAIN_WEIGHT

    half = CHAIN_STEPS // 2
    off = np.abs(np.arange(CHAIN_STEPS + 1) - half) * CHAIN_GAIN
    likely = np.arange(CHAIN_STEPS + 1) >= half
    cost = np.column_stack([np.log2((2 * CHAIN_WEIGHT + 3 + off) / (CHAIN_WEIGHT + 1 + np.where(likely == bool(s), off, 0))) for s in (0, 1)]).ravel()

    def run(p: Piece):
        key, same, starts = _bits_in_groups(p, p.past_bits(1, 16), 16, p.past_bits(0, 1))
        step = (key & np.uint64(2)).astype(np.int32) - 1
        moved = np.cumsum(step, dtype=np.int32) - step
        first = np.flatnonzero(~same)
        at = half + moved - np.repeat(moved[first], np.diff(np.append(first, len(key))))
        out = (at < 0) | (at > CHAIN_STEPS)
        if out.any():
            for i in np.unique(first[np.searchsorted(first, np.flatnonzero(out), "right") - 1]).tolist():
                x = half
                at[i], i = x, i + 1
                while i < len(at) and same[i]:
                    x = min(max(x + int(step[i - 1]), 0), CHAIN_STEPS)
                    at[i], i = x, i + 1
        return {"doc_id": p.ids, "bits": np.add.reduceat(cost[at << 1 | (key & np.uint64(1)).astype(np.int32)], starts)}

    return mapped(docs, run, "doc_id long, bits double", PIECE // 4)


# runs and sums


def _islands(p: Piece, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the maximal runs of equal values of s begin, and their lengths."""
    new = np.concatenate([[True], s[1:] != s[:-1]])
    new[p.starts[:-1]] = True
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(s)))


def runs(docs: DataFrame, min_len: int = 4) -> DataFrame:
    """symbols.runs()."""

    def run(p: Piece):
        first, n = _islands(p, p.s)
        first, n = first[n >= min_len], n[n >= min_len]
        doc = p.doc[first]
        return {"doc_id": p.ids[doc], "start": (first - p.starts[doc]).astype(np.int32), "s": p.s[first].astype(np.int32), "n": n}

    return mapped(docs, run, "doc_id long, start int, s int, n long")


def delta_zero_runs(docs: DataFrame, longest: int = 252) -> DataFrame:
    """symbols.zero_runs() of symbols.delta()."""

    def run(p: Piece):
        d = p.s - p.before()
        first, n = _islands(p, d)
        zero = d[first] == 0
        doc, whole = p.doc[first], np.where(zero, n // (longest + 1), n)
        literals = np.bincount(doc, weights=whole, minlength=len(p.ids)).astype(np.int64)
        pairs = np.bincount(doc, weights=np.where(zero, -(-n // (longest + 1)), 0), minlength=len(p.ids)).astype(np.int64)
        return {"doc_id": p.ids, "literals": literals, "runs": pairs, "bytes": literals + 2 * pairs}

    return mapped(docs, run, "doc_id long, literals long, runs long, bytes long")


def sum_pyramid(docs: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """symbols.sum_pyramid() of lengths that are powers of two: the sum of 2n symbols is one of n and the next one."""

    def run(p: Piece):
        out = {"doc_id": p.ids[p.doc], "pos": p.pos.astype(np.int32)}
        left = (p.starts[1:][p.doc] - np.arange(len(p.s))).astype(np.int32)
        total, n = p.s, 1
        while n < max(lengths):
            there = np.zeros_like(total)
            there[:-n] = total[n:]
            total, n = total + there * (left > n), 2 * n
            if n in lengths:
                out[f"sum{n}"] = total.astype(np.int32)
        return out

    return mapped(docs, run, "doc_id long, pos int, " + ", ".join(f"sum{n} int" for n in sorted(lengths)))


def _signed_delta(p: Piece) -> np.ndarray:
    return (p.s - p.before()).view(np.int8).astype(np.int32)


def _block_sums(p: Piece, d: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, block and sum of zig-zagged values of each block."""
    n = -(-p.lens // size)
    doc = np.repeat(np.arange(len(p.ids)), n)
    block = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return doc, block, np.add.reduceat(np.where(d >= 0, 2 * d, -2 * d - 1).astype(np.int64), p.starts[doc] + block * size)


def delta_checksums(docs: DataFrame, size: int = 257) -> DataFrame:
    """symbols.block_checksum() of signed differences to the symbol before."""

    def run(p: Piece):
        doc, block, total = _block_sums(p, _signed_delta(p), size)
        return {"doc_id": p.ids[doc], "block": block, "checksum": total}

    return mapped(docs, run, "doc_id long, block long, checksum long")


def delta_erase_bad_blocks(docs: DataFrame, sums: DataFrame, size: int = 257) -> DataFrame:
    """symbols.erase_bad_blocks() of signed differences to the symbol before. A document meets its sums as one list."""
    lists = sums.groupBy("doc_id").agg(F.collect_list("block").alias("block"), F.collect_list("checksum").alias("checksum"))

    def run(p: Piece):
        d = _signed_delta(p)
        doc, block, total = _block_sums(p, d, size)
        blocks, given = p.more
        given_doc = np.repeat(np.arange(len(p.ids)), np.nan_to_num(blocks.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
        far = int(block.max(initial=0)) + 1
        given_block, given = blocks.flatten().to_numpy(zero_copy_only=False), given.flatten().to_numpy(zero_copy_only=False)
        inside = (given_block >= 0) & (given_block < far)
        first = np.cumsum(np.bincount(doc, minlength=len(p.ids))) - np.bincount(doc, minlength=len(p.ids))
        given_doc, given_block, given = given_doc[inside], given_block[inside].astype(np.int64), given[inside]
        real = given_block < -(-p.lens // size)[given_doc]
        at = (first[given_doc] + given_block)[real]
        good = np.zeros(len(doc), bool)
        good[at[given[real] == total[at]]] = True
        pos = p.pos
        return {"doc_id": p.ids[p.doc], "pos": pos.astype(np.int32), "s": d * good[first[p.doc] + pos // size]}

    return mapped(docs.join(lists, "doc_id", "left").select("doc_id", "b", "block", "checksum"), run, "doc_id long, pos int, s int")


# context sort


def context_sort(docs: DataFrame) -> DataFrame:
    """(doc_id, b, q, p): the bytes as in symbols.context_sort() and the last two of symbols.context_lead()."""

    def run(p: Piece):
        prev = np.arange(len(p.s)) - 1
        prev[p.starts[:-1]] = p.starts[1:] - 1
        p1 = p.s[prev]
        p2 = p1[prev]
        key = (p.doc.astype(np.uint64) << np.uint64(8) | p1) << np.uint64(8) | p2
        order, _ = in_groups(p, key, 16 + len(p.ids).bit_length())
        last = p.starts[1:] - 1
        return {"doc_id": p.ids, "b": (p.starts, p.s[order]), "q": p1[last].astype(np.int32), "p": p.s[last].astype(np.int32)}

    return mapped(docs, run, "doc_id long, b binary, q int, p int")


def context_unsort(df: DataFrame) -> DataFrame:
    """(doc_id, pos, s): inverse of context_sort(), by symbols.context_unsort()'s walk over codes of the symbols that occur."""

    def run(p: Piece):
        out = []
        for k, (q, last) in enumerate(zip(*(c.to_numpy() for c in p.more), strict=True)):
            s = p.s[p.starts[k] : p.starts[k + 1]]
            found = np.bincount(s, minlength=256)
            symbols = np.flatnonzero(found)
            m = len(symbols)
            code = np.zeros(256, np.int64)
            code[symbols] = np.arange(m)
            c = code[s]
            pairs = np.bincount(c * m + np.repeat(np.arange(m), found[symbols]), minlength=m * m)
            begin, c = (np.cumsum(pairs) - pairs).tolist(), c.tolist()
            old, now, walk = int(code[q]), int(code[last]), []
            add = walk.append
            for _ in c:
                at = now * m + old
                i = begin[at]
                begin[at] = i + 1
                old, now = now, c[i]
                add(now)
            out.append(symbols[walk])
        return {"doc_id": p.ids[p.doc], "pos": p.pos.astype(np.int32), "s": np.concatenate(out).astype(np.int32)}

    return mapped(df, run, "doc_id long, pos int, s int")


# rotation sort


def _words(s: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where the falling words of s begin, as signals.lyndon_starts(); key has the first eight symbols of each suffix, zeros beyond the end. A word begins where
    the suffix is less than all before it: where its key is less than all before it, or, of equal ones, where the rest is."""
    from samplegrid.operators.signals import lyndon_starts

    least = np.minimum.accumulate(key)
    maybe = np.flatnonzero(np.concatenate([[True], key[1:] <= least[:-1]]))
    falls = np.concatenate([[True], key[maybe[1:]] < least[maybe[1:] - 1]])
    if falls.all():
        return maybe
    text, best, out, left = s.tobytes(), 0, [], 64 * len(s)
    for i, less in zip(maybe.tolist(), falls.tolist(), strict=True):
        if not less:
            n = 64
            while text[i : i + n] == text[best : best + n]:  # the later suffix ends first
                n *= 2
            left -= n
            if left < 0:
                return np.array(lyndon_starts(s.tolist()))
            less = text[i : i + n] < text[best : best + n]
        if less:
            best = i
            out.append(i)
    return np.array(out)


def rotation_sorted(s: np.ndarray) -> np.ndarray:
    """signals.rotation_sort() of one document: ranks of 2n symbols are made of ranks of n, for the places that share theirs."""
    n = len(s)
    key = np.concatenate([s, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        key[: n + 8 - k] = key[: n + 8 - k] << np.uint64(8 * k) | key[k:]
    key = key[:n]
    starts = np.append(_words(s, key), n)
    step, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    step[starts[1:] - 1], before[starts[:-1]] = starts[:-1], starts[1:] - 1
    # five symbols, or two ranks, and the place make one number
    assert n <= 1 << 20
    low, mask = np.uint64(20), np.uint64((1 << 20) - 1)
    key, one = s.astype(np.uint64), step
    for k in (8, 16):
        key = key << np.uint64(k) | key[step]
        step = step[step]
    order = np.sort((key << np.uint64(8) | s[step]) << low | np.arange(n, dtype=np.uint64))
    step, reach = one[step], 5
    new = np.concatenate([[True], order[1:] >> low != order[:-1] >> low])
    order = (order & mask).astype(np.int64)
    rank = np.empty(n, np.uint64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    # slots whose rank is shared
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(slots):
        places = order[slots]
        both = np.sort((rank[places] << low | rank[step[places]]) << low | places.astype(np.uint64))
        order[slots] = places = (both & mask).astype(np.int64)
        both >>= low
        changed = np.concatenate([[True], both[1:] != both[:-1]])
        both >>= low
        outer = np.concatenate([[True], both[1:] != both[:-1]])
        rank[places] = np.maximum.accumulate(np.where(changed, slots, 0))
        if reach >= n or (changed == outer).all():
            break
        slots = slots[~(changed & np.append(changed[1:], True))]
        step, reach = step[step], 2 * reach
    return s[before[order]]


def rotation_sort(docs: DataFrame) -> DataFrame:
    """(doc_id, b): the bytes in the order of signals.rotation_sort()."""

    def run(p: Piece):
        out = [rotation_sorted(p.s[a:b]) for a, b in zip(p.starts[:-1].tolist(), p.starts[1:].tolist(), strict=True)]
        return {"doc_id": p.ids, "b": (p.starts, np.concatenate(out))}

    return mapped(docs, run, "doc_id long, b binary")


def rotation_unsort(df: DataFrame) -> DataFrame:
    """(doc_id, pos, s): inverse of rotation_sort(), by signals.rotation_unsort()'s walk."""

    def run(p: Piece):
        out = []
        for a, b in zip(p.starts[:-1].tolist(), p.starts[1:].tolist(), strict=True):
            s, n = p.s[a:b], b - a
            to = np.empty(n, np.int64)
            to[np.argsort(s, kind="stable")] = np.arange(n)
            to, seen, first, cycles, left = to.tolist(), bytearray(n), 0, [], n
            mark = np.frombuffer(seen, np.uint8)
            while left:
                first = seen.find(0, first)
                walk = [first]
                add, i = walk.append, to[first]
                while i != first:
                    add(i)
                    i = to[i]
                walk = np.array(walk)
                mark[walk] = 1
                cycles.append(s[walk])
                left -= len(walk)
            out.append(np.concatenate(cycles)[::-1])
        return {"doc_id": p.ids[p.doc], "pos": p.pos.astype(np.int32), "s": np.concatenate(out).astype(np.int32)}

    return mapped(df, run, "doc_id long, pos int, s int")


# recency

#: Groups of 2 ** SMALL numbers are compared pair by pair.
SMALL = 5


def earlier_smaller(order: np.ndarray) -> np.ndarray:
    """Of a permutation of 0 .. n - 1 how many smaller numbers stand before each: numbers are dealt by their bits from the high one on, and one with a set bit has those
    without it in its group before it."""
    n = len(order)
    levels = max(SMALL, (n - 1).bit_length())
    # the rest of the last group
    v = np.concatenate([order, np.arange(n, 1 << levels)]).astype(np.int32)
    found = np.zeros(len(v), np.int32)
    for level in reversed(range(SMALL, levels)):
        half = 1 << level
        g = v.reshape(-1, 2 * half)
        one = (g >> level & 1).astype(bool)
        zeros = np.cumsum(~one, axis=1, dtype=np.int32)
        found[g[one]] += zeros[one]
        # half of a group's numbers have the bit
        v = np.concatenate([g[~one].reshape(-1, half), g[one].reshape(-1, half)], axis=1).ravel()
    g = v.reshape(-1, 1 << SMALL)
    low = (g & (1 << SMALL) - 1).astype(np.uint8)
    less = np.zeros_like(low)
    for d in range(1, 1 << SMALL):
        less[:, d:] += low[:, :-d] < low[:, d:]
    found[g] += less
    return found[order]


def recency_ranks(p: Piece, v: np.ndarray, width: int, listed: bool = False) -> np.ndarray:
    """signals.recency_rank() of the symbols v of p's documents."""
    n = len(v)
    order, same = in_groups(p, v, width)
    last = np.full(n, -1)
    last[order[1:][same[1:]]] = order[:-1][same[1:]]
    fresh = last < 0
    # places of all documents in a row: those before a document's start are earlier and smaller for all of it, and are taken off with the places up to the last use
    again = np.flatnonzero(~fresh)
    used = np.zeros(n, bool)
    used[last[again]] = True
    out = np.cumsum(fresh)
    out[again] += earlier_smaller(np.cumsum(used)[last[again]] - 1) - last[again] - 1
    new = np.flatnonzero(fresh)
    doc = p.doc[new]
    known = np.arange(len(new)) - np.searchsorted(doc, np.arange(len(p.ids)))[doc]
    value = v[new].astype(np.int64)
    if listed:
        by = np.argsort(doc << 32 | value)
        place = np.empty(len(new), np.int64)
        place[by] = np.arange(len(new))
        out[new] = value + np.arange(len(new)) - earlier_smaller(place)
    else:
        out[new] = value + known
    return out


def recency_rank(docs: DataFrame, width: int = 1) -> DataFrame:
    """signals.recency_rank()."""

    def run(p: Piece):
        v = p.s
        if width > 1:
            starts = np.append(0, np.cumsum(p.lens // width))
            wide = Piece(p.ids, starts, np.empty(starts[-1], np.uint8))
            at = p.starts[:-1][wide.doc] + wide.pos * width
            v = np.zeros(len(at), np.uint64)
            for k in range(width):
                v = v << np.uint64(8) | p.s[at + k]
            p = wide
        return {"doc_id": p.ids[p.doc], "pos": p.pos.astype(np.int32), "rank": recency_ranks(p, v, 8 * width).astype(np.int64)}

    return mapped(docs, run, "doc_id long, pos int, rank long")


def recency_bits(docs: DataFrame, weights: list[int]) -> DataFrame:
    """signals.recency_bits() with the weights of a list's places."""
    cost = np.log2(sum(weights)) - np.log2(np.array(weights, float))

    def run(p: Piece):
        return {"doc_id": p.ids, "bits": p.sums(cost[recency_ranks(p, p.s, 8, True)])}

    return mapped(docs, run, "doc_id long, bits double")


# matches


def longest_match(docs: DataFrame, window: int = 256, min_len: int = 3) -> DataFrame:
    """signals.longest_match(): on each distance, runs of places that begin with the same three symbols are the matches."""

    def run(p: Piece):
        n = len(p.s)
        g = -1 - np.arange(n, dtype=np.int32)
        if n > 2:
            three = p.s.astype(np.int32)
            three = three[:-2] << 16 | three[1:-1] << 8 | three[2:]
            inside = p.doc[:-2] == p.doc[2:]
            g[:-2][inside] = three[inside]
        best, at, pos = np.zeros(n, np.int64), np.zeros(n, np.int64), p.pos
        for d in range(1, min(window, n - 1) + 1):
            hit = np.flatnonzero(g[d:] == g[:-d]) + d
            hit = hit[pos[hit] >= d]
            if len(hit):
                last = np.append(hit[1:] != hit[:-1] + 1, True)
                ends = hit[last]
                length = np.repeat(ends, np.diff(np.append(-1, np.flatnonzero(last)))) - hit + 3
                more = length > best[hit]
                best[hit[more]], at[hit[more]] = length[more], d
        found = np.flatnonzero(best >= min_len)
        return {"doc_id": p.ids[p.doc[found]], "pos": pos[found], "len": best[found], "distance": at[found]}

    return mapped(docs, run, "doc_id long, pos long, len long, distance long")


def repeats(docs: DataFrame, lengths: tuple[int, ...], window: int = 8172) -> DataFrame:
    """signals.repeats(), for lengths from 8 on. Places are gathered by the content itself: runs of eight symbols are one number, longer ones are numbered."""

    def run(p: Piece):
        n, doc, pos, more = len(p.s), p.doc, p.pos, np.ones(len(p.s), bool)
        left = p.starts[1:][doc] - np.arange(n)
        key = np.concatenate([p.s, np.zeros(8, np.uint8)]).astype(np.uint64)
        for k in (1, 2, 4):
            key[: n + 8 - k] = key[: n + 8 - k] << np.uint64(8 * k) | key[k:]
        key, size, out = key[:n], 8, []
        width = 64
        while True:
            # places that share their content with another one of the same document
            whole = np.flatnonzero((left >= size) & more)
            some = Piece(p.ids, np.searchsorted(whole, p.starts), p.s[whole])
            order, same = in_groups(some, key[whole], width)
            head = heads(same)
            # a number of its own where the content occurs once, or was not looked at for that
            number = np.arange(n, 2 * n, dtype=np.uint64)
            number[whole[order]] = head
            more = np.zeros(n, bool)
            more[whole[order]] = shared = same | np.append(same[1:], False)
            width = (2 * n).bit_length()
            if size in lengths:
                places = whole[order[shared]]
                place, group = pos[places], head[shared]
                keys = group << 32 | place
                first = np.searchsorted(keys, group << 32 | np.maximum(place - window, 0))
                match = place[first] if len(first) else place
                kept = match < place
                out.append((places[kept], np.full(int(kept.sum()), size), match[kept]))
            if size >= max(lengths):
                break
            there = np.zeros(n, np.uint64)
            there[:-size] = number[size:]
            key, width, size = number << np.uint64(width) | there, 2 * width, 2 * size
        at, size, match = (np.concatenate(c) for c in zip(*out, strict=True))
        return {"doc_id": p.ids[doc[at]], "pos": pos[at], "len": size.astype(np.int32), "match": match}

    return mapped(docs, run, "doc_id long, pos long, len int, match long")


# interleaved planes


def _planes(docs: DataFrame) -> DataFrame:
    """docs with image_id, plane and the lists (planes, n) of its image's planes."""
    sizes = docs.groupBy("image_id").agg(F.collect_list("plane").alias("planes"), F.collect_list(F.octet_length("b")).alias("n"))
    return docs.join(sizes.hint("shuffle_hash"), "image_id").select("image_id", "b", "plane", "planes", "n")


def _seq(pos: np.ndarray, plane: int, planes: list[int], n: list[int]) -> np.ndarray:
    """Places in the interleaved stream of the symbols of a plane."""
    return sum(np.minimum(size, pos + int(other < plane)) for other, size in zip(planes, n, strict=True))


def _each_seq(p: Piece) -> np.ndarray:
    plane, planes, n = (c.to_pylist() for c in p.more)
    return np.concatenate([_seq(np.arange(size), *x) for size, x in zip(p.lens, zip(plane, planes, n, strict=True), strict=True)])


def interleaved_prefix(docs: DataFrame, n: int) -> DataFrame:
    """symbols.read_prefix() of symbols.interleave() of docs(image_id, plane, b)."""

    def run(p: Piece):
        plane = p.more[0].to_numpy(zero_copy_only=False)
        return {"image_id": p.ids[p.doc], "plane": plane[p.doc], "pos": p.pos.astype(np.int32), "s": p.s * (_each_seq(p) < n).astype(np.int32)}

    return mapped(_planes(docs), run, "image_id long, plane long, pos int, s int")


def interleave(docs: DataFrame) -> DataFrame:
    """(image_id, b): the stream of symbols.interleave() of docs(image_id, plane, b), one value an image."""
    whole = docs.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("plane", "b"))).alias("p"))

    def run(p: Piece):
        sizes = p.more[0].to_pylist()
        out = np.empty_like(p.s)
        for k, n in enumerate(sizes):
            at = int(p.starts[k])
            part = at
            for plane, size in enumerate(n):
                out[at + _seq(np.arange(size), plane, list(range(len(n))), n)] = p.s[part : part + size]
                part += size
        return {"image_id": p.ids, "b": (p.starts, out)}

    joined = F.expr("aggregate(p, X'', (a, t) -> concat(a, t.b))")
    return mapped(whole.select("image_id", joined.alias("b"), F.expr("transform(p, t -> octet_length(t.b))").alias("n")), run, "image_id long, b binary")


def deinterleave(stream: DataFrame, lengths: DataFrame) -> DataFrame:
    """(image_id, plane, pos, s) of interleave()'s stream and lengths(image_id, plane, n)."""
    sizes = lengths.where("n > 0").groupBy("image_id").agg(F.collect_list("plane").alias("planes"), F.collect_list(F.col("n").cast("long")).alias("n"))

    def run(p: Piece):
        out = {"image_id": [], "plane": [], "pos": [], "s": []}
        for k, (planes, n) in enumerate(zip(*(c.to_pylist() for c in p.more), strict=True)):
            s = p.s[p.starts[k] : p.starts[k + 1]]
            for plane, size in zip(planes, n, strict=True):
                pos = np.arange(size, dtype=np.int32)
                at = _seq(pos.astype(np.int64), plane, planes, n)
                pos, at = pos[kept := at < len(s)], at[kept]
                for name, a in (("image_id", np.full(len(pos), p.ids[k])), ("plane", np.full(len(pos), plane)), ("pos", pos), ("s", s[at].astype(np.int32))):
                    out[name].append(a)
        return {name: np.concatenate(a) for name, a in out.items()}

    return mapped(stream.join(sizes.hint("shuffle_hash"), "image_id").select("image_id", "b", "planes", "n"), run, "image_id long, plane long, pos int, s int")
