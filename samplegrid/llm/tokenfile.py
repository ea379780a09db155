"""Token ids in binary files: patched frame-of-reference blocks.

File: magic "TPF1", number of blocks and ids; the blocks; the index of block starts; its offset. Each block has up to
BLOCK ids: its minimum is subtracted, values are packed at the width that a percentile of them needs, and the high bits
of the others stand in an exception list (positions and values). A sidecar table has each document's place.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplegrid.llm.bpe import Splitter, byte_alphabet, slices
from samplegrid.llm.common import materialize, scratch_path

BLOCK = 4096
PERCENTILE = 0.98
MAGIC = b"TPF1"
#: Of the merge ranks: no key in a slot, no rank of a pair.
EMPTY, NONE = np.uint64(2**64 - 1), 2**31 - 1
#: Bytes of the texts that are encoded at once.
TEXTS = 4 << 20


def pack_block(ids: np.ndarray) -> bytes:
    """minimum u32, count u16, width u8, exceptions u16; packed low bits; u16 positions; u32 high bits."""
    low = int(ids.min())
    v = (ids - np.uint32(low)).astype(np.uint32)
    ranked = np.partition(v, k := int(PERCENTILE * (len(v) - 1)))[k]
    width = int(ranked).bit_length()
    odd = np.flatnonzero(v >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    head = np.uint32(low).tobytes() + np.uint16(len(v)).tobytes() + bytes([width]) + np.uint16(len(odd)).tobytes()
    if width in (8, 16):  # whole bytes need no shifting
        packed = v.astype(f"<u{width // 8}").tobytes()
    else:
        bits = np.unpackbits(v.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
        packed = np.packbits(bits.reshape(-1), bitorder="little").tobytes()
    return head + packed + odd.astype("<u2").tobytes() + (v[odd] >> np.uint32(width)).astype("<u4").tobytes()


def unpack_block(data: memoryview) -> np.ndarray:
    low, n, width, odd = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:6], "little"), data[6], int.from_bytes(data[7:9], "little")
    size = (n * width + 7) // 8
    if width in (8, 16):
        v = np.frombuffer(data, f"<u{width // 8}", n, 9).astype("<u4")
    else:
        bits = np.zeros((n, 32), np.uint8)
        bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8, size, 9), count=n * width, bitorder="little").reshape(n, width)
        v = np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4").copy()
    at = np.frombuffer(data, "<u2", odd, 9 + size)
    if odd:
        v[at] |= np.frombuffer(data, "<u4", odd, 9 + size + 2 * odd) << np.uint32(width)
    return v + np.uint32(low)


class Writer:
    """Writes one file under a temporary name and moves it to its own when it is whole, so a repeated task does no harm."""

    def __init__(self, folder: str, name: str, attempt: int):
        self.fs, path = pa.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(path, recursive=True)
        self.path, self.temp = f"{path}/{name}", f"{path}/.{name}.{attempt}"
        self.out = self.fs.open_output_stream(self.temp)
        self.starts, self.left, self.count, self.at = [], np.empty(0, np.uint32), 0, self.out.write(MAGIC)

    def add(self, ids: np.ndarray) -> None:
        ids = np.concatenate([self.left, ids])
        whole = len(ids) // BLOCK * BLOCK
        for k in range(0, whole, BLOCK):
            self.block(ids[k : k + BLOCK])
        self.left = ids[whole:]

    def block(self, ids: np.ndarray) -> None:
        self.starts.append(self.at)
        self.at += self.out.write(pack_block(ids))
        self.count += len(ids)

    def close(self) -> None:
        if len(self.left):
            self.block(self.left)
        self.out.write(np.array(self.starts, "<u8").tobytes())
        self.out.write(np.array([len(self.starts), self.count, self.at], "<u8").tobytes())
        self.out.close()
        self.fs.move(self.temp, self.path)


class Reader:
    """Reads ids [start, start + n) of a file by its index of block starts; keeps the last block."""

    def __init__(self, folder: str, name: str):
        self.fs, path = pa.fs.FileSystem.from_uri(folder)
        self.file = self.fs.open_input_file(f"{path}/{name}")
        size = self.file.size()
        blocks, self.count, at = np.frombuffer(self.file.read_at(24, size - 24), "<u8").tolist()
        self.starts = np.append(np.frombuffer(self.file.read_at(8 * blocks, at), "<u8"), at).astype(np.int64)
        self.block = functools.lru_cache(maxsize=64)(self._block)

    def _block(self, k: int) -> np.ndarray:
        return unpack_block(memoryview(self.file.read_at(int(self.starts[k + 1] - self.starts[k]), int(self.starts[k]))))

    def ids(self, start: int, n: int) -> np.ndarray:
        if not n:
            return np.empty(0, np.uint32)
        first, last = start // BLOCK, (start + n - 1) // BLOCK
        joined = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return joined[start - first * BLOCK : start - first * BLOCK + n]


class Merges:
    """Rank of a pair of ids, for arrays of pairs: a hash table with linear probing, at most a fifth full."""

    def __init__(self, pairs: list[tuple[int, int]]):
        keys = np.array([left << 32 | right for left, right in pairs], np.uint64)
        self.shift = np.uint64(64 - max(4, (5 * len(keys)).bit_length()))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.keys, self.ranks = np.full(self.mask + 1, EMPTY, np.uint64), np.full(self.mask + 1, NONE, np.int32)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self.slot(keys).tolist(), strict=True)):
            while self.ranks[at] != NONE:
                at = at + 1 & self.mask
            self.keys[at], self.ranks[at] = key, rank

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = self.slot(keys)
        found = self.keys[at]
        out = self.ranks[at]
        todo = np.flatnonzero((found != keys) & (found != EMPTY))
        while len(todo):
            at[todo] = at[todo] + 1 & self.mask
            found = self.keys[at[todo]]
            out[todo] = self.ranks[at[todo]]
            todo = todo[(found != keys[todo]) & (found != EMPTY)]
        out[self.keys[at] != keys] = NONE
        return out


def strings(words: list[str]) -> pa.StringArray:
    """An Arrow array of words without line breaks, by one encoding of all."""
    data = np.frombuffer("\n".join([*words, ""]).encode(), np.uint8)
    breaks = np.flatnonzero(data == 10)
    offsets = np.concatenate([[0], breaks - np.arange(len(breaks))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(offsets), pa.py_buffer(data[data != 10]))


class Library:
    """Ids as the tokenizers library gives them. The words of many texts are numbered by Arrow, the distinct ones of up to
    LONGEST bytes are merged together, a merge of each word at a time, and longer ones are encoded by the library's model."""

    LONGEST = 64

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.splitter = Splitter(spec, path)
        self.model = Tokenizer.from_file(path).model
        self.letters = byte_alphabet()
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.rank = Merges([(vocab[a], vocab[b]) for a, b in pairs])
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.inner, self.last = (np.array([vocab[c + end] for c in self.letters], np.int32) for end in ("", suffix))

    def long_word(self, word: str) -> list[int]:
        """The library's model takes a word that is split and normalized, in the byte alphabet."""
        return [t.id for t in self.model.tokenize("".join([self.letters[b] for b in word.encode()]))]

    def word_ids(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words after each other, and the offsets of the words; an added token has its id, an empty word none.

        Words with L symbols are rows of one matrix, and so are their pairs' ranks: each row loses one symbol by its first
        pair of least rank and joins the rows of L - 1, or has no pair to merge and is done.
        """
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        sizes = np.diff(offsets)
        own = {i: self.long_word(words[i].as_py()) for i in np.flatnonzero(sizes > self.LONGEST).tolist()}
        own |= {i: [self.splitter.added[t]] for t in self.splitter.added if (i := pc.index(words, t).as_py()) >= 0}
        sizes[list(own)] = 0
        done = [(np.array([i]), np.array([x], np.int32)) for i, x in own.items()]
        at, ids, ranks = np.empty(0, np.int64), np.empty((0, self.LONGEST), np.int32), np.empty((0, self.LONGEST - 1), np.int32)
        for n in range(self.LONGEST, 0, -1):
            fresh = np.flatnonzero(sizes == n)
            if len(fresh):
                new = data[offsets[fresh][:, None] + np.arange(n)]
                new = np.concatenate([self.inner[new[:, :-1]], self.last[new[:, -1:]]], axis=1)
                at, ids = np.concatenate([at, fresh]), np.concatenate([ids, new])
                ranks = np.concatenate([ranks, self.rank(new[:, :-1].ravel(), new[:, 1:].ravel()).reshape(len(fresh), n - 1)])
            if n == 1:
                done.append((at, ids))
                break
            row, k = np.arange(len(at)), ranks.argmin(axis=1)
            least = ranks[row, k]
            done.append((at[least == NONE], ids[least == NONE]))
            more = np.flatnonzero(least != NONE)
            at, ids, ranks, k, row, new = at[more], ids[more], ranks[more], k[more], row[: len(more)], self.merged[least[more]]
            stays = np.ones(ids.shape, bool)
            stays[row, k + 1] = False
            ids = ids[stays].reshape(len(at), n - 1)
            ids[row, k] = new
            stays = np.ones(ranks.shape, bool)
            stays[row, k] = False
            ranks = ranks[stays].reshape(len(at), n - 2)
            left, right = np.flatnonzero(k > 0), np.flatnonzero(k < n - 2)
            ranks[left, k[left] - 1] = self.rank(ids[left, k[left] - 1], new[left])
            ranks[right, k[right]] = self.rank(new[right], ids[right, k[right] + 1])
        counts = np.zeros(len(words), np.int64)
        for which, ids in done:
            counts[which] = ids.shape[1]
        starts = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(starts[-1], np.uint32)
        for which, ids in done:
            out[starts[which][:, None] + np.arange(ids.shape[1])] = ids
        return out, starts

    def encode_texts(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts after each other, each text's closed by `end`, and how many each text has."""
        parts = [self.splitter.parts(t) if t else [] for t in texts]
        words = strings([w for p in parts for w in (*p, "")]).dictionary_encode()
        number = words.indices.to_numpy()
        ids, starts = self.word_ids(words.dictionary)
        if end is not None:  # an empty word stands behind each text
            ids, starts = np.append(ids, np.uint32(end)), starts.copy()
            closing = number == pc.index(words.dictionary, "").as_py()
        sizes = np.diff(starts)[number]
        first = starts[number]
        if end is not None:
            sizes[closing], first[closing] = 1, len(ids) - 1
        ends = np.cumsum(sizes)
        flat = ids[np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        behind = np.cumsum([len(p) + 1 for p in parts])
        return flat, np.diff(ends[behind - 1], prepend=0) if len(parts) else np.empty(0, np.int64)

    def encode(self, text: str | None) -> bytes:
        return self.encode_texts([text])[0].tobytes()


@functools.lru_cache(maxsize=2)
def library(path: str) -> Library:
    return Library(path)


def write_ids(docs: DataFrame, vocab: str, end_id: int = 1, partitions: int | None = None) -> tuple[DataFrame, str]:
    """Writes the ids of docs(doc_id, text, ...), each document closed by end_id, in ascending doc_id order; returns the
    sidecar (doc_id, file, part, first, n_tokens, start) and the folder. start counts the ids of all documents before.

    One range shuffle of the texts; only one number a file reaches the driver's plan (a running sum over files). Null
    texts are empty. Rows with equal ids are ordered by text; null ids come first. Other columns are not read.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    rows = docs.select("doc_id", "text")
    rows = rows.repartitionByRange(partitions, "doc_id", F.xxhash64("text")) if partitions else rows.repartitionByRange("doc_id", F.xxhash64("text"))
    rows = rows.sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        name, encoder, writer, first = f"part-{part:05d}.tpf", library(vocab), None, 0
        for batch in batches:
            for piece in slices(batch, "text", TEXTS):
                writer = writer or Writer(folder, name, attempt)
                ids, sizes = encoder.encode_texts(piece.column("text").to_pylist(), end_id)
                writer.add(ids)
                starts = first + np.cumsum(sizes) - sizes
                first += int(sizes.sum())
                n = len(sizes)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([name] * n), pa.array([part] * n, pa.int32()), pa.array(starts), pa.array(sizes)], ["doc_id", "file", "part", "first", "n_tokens"])
        if writer:
            writer.close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = materialize(rows.mapInArrow(run, f"doc_id {kind}, file string, part int, first long, n_tokens long"), "places")
    sizes = placed.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row a file: a running sum over at most as many rows as there are partitions
    offsets = sizes.selectExpr("part", "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) base")
    index = placed.join(F.broadcast(offsets), "part").select("doc_id", "file", "part", "first", "n_tokens", (F.col("base") + F.col("first")).alias("start"))
    return index, folder


def read_ids(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary): the ids of each row of the sidecar, read from the files, as little-endian
    unsigned 32-bit integers. Rows stay in their partitions; each opens the files it names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[str, Reader] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for name, first, n in zip(*(part.column(c).to_pylist() for c in ("file", "first", "n_tokens")), strict=True):
                    if name not in readers:
                        readers.clear()
                        readers[name] = Reader(folder, name)
                    out.append(readers[name].ids(first, n).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("start"), part.column("n_tokens"), pa.array(out, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    kind = index.schema["doc_id"].dataType.simpleString()
    return index.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids binary")


