"""BPE encoding by a priority queue of merge ranks over a linked symbol list, and decoding by vocabulary strings.

Reads the JSON file of a public tokenizer (model BPE, byte-level alphabet, word-end suffix). Texts are split into
words; ids of words are memoized in two bounded generations, so each Python worker holds a fixed amount of memory
however long its input is.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from samplegrid.llm.common import map_arrow

#: Entries of one generation of a worker's word memo; longer keys are not kept, which bounds its bytes.
WORDS, LONGEST_KEY = 150_000, 64
#: Bytes of the texts that are encoded at once, and rows that are decoded at once.
TEXTS, ROWS = 1 << 20, 128

#: The white space of the tokenizer's regular expressions.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Memo(dict):
    """key -> make(key), with at most two generations of `size` entries; keys over LONGEST_KEY characters are made anew."""

    def __init__(self, make, size: int):
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > LONGEST_KEY:
            return value
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in keep else next(rest)) for b in range(256)]


@functools.cache
def char_class(kind: str, last: int = sys.maxunicode) -> str:
    """The characters up to `last` whose Unicode category begins with `kind`, as ranges of a regular expression's class. Cn:
    characters that this Python's tables do not know."""
    out, first = [], None
    for c in range(last + 2):
        inside = c <= last and unicodedata.category(chr(c)).startswith(kind)
        if inside and first is None:
            first = c
        elif not inside and first is not None:
            out.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return "".join(out)


class Splitter:
    """Normalized words of a tokenizer file: added tokens first, then NFC and lower case, then its split pattern. Texts with
    characters that Python's Unicode tables do not know are split by the library, whose tables may be newer."""

    def __init__(self, spec: dict, path: str):
        self.path, self.unknown = path, re.compile(f"[{char_class('Cn')}]").search
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        ascii_only = pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")
        # classes of two bytes are bitmaps, others are tried range by range
        basic, wide = (pattern.replace(r"\p{L}", char_class("L", c)).replace(r"\p{N}", char_class("N", c)).replace(r"\s", SPACE) for c in (0xFFFF, sys.maxunicode))
        self.split_ascii, self.split_basic, self.split_wide = re.compile(ascii_only, re.ASCII).findall, re.compile(basic).findall, re.compile(wide).findall
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def words(self, text: str) -> list[str]:
        """Lower case goes letter by letter (no final-sigma rule)."""
        if text.isascii():
            return self.split_ascii(text.lower())
        if self.unknown("".join(set(text))):
            return self.library_words(text)
        text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
        return self.split_wide(text) if self.beyond(text) else self.split_basic(text)

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path), {c: b for b, c in enumerate(byte_alphabet())}

    def library_words(self, text: str) -> list[str]:
        tokenizer, byte = self.library
        return [bytes(byte[c] for c in w).decode() for w, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(text))]

    def parts(self, text: str) -> list[str]:
        """Words of a whole text, and its added tokens, which are taken first from the text as it is: as their content, which
        no word is, as it mixes letters and signs."""
        if not self.special or not self.special.search(text):
            return self.words(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.words(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.words(text[at:])


class BPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.splitter = Splitter(spec, path)
        vocab, suffix, added = model["vocab"], model["end_of_word_suffix"] or "", self.splitter.added
        self.strings = [""] * (1 + max([*vocab.values(), *added.values()]))
        for s, i in [*vocab.items(), *added.items()]:
            self.strings[i] = s
        #: left id << 20 | right id -> rank << 32; and the merged id of each rank
        self.merges, self.merged = {}, []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left] << 20 | vocab[right]] = rank << 32
            self.merged.append(vocab[left + right])
        letters = byte_alphabet()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + suffix] for c in letters]
        self.word_ids = Memo(lambda w: array("I", [added[w]]).tobytes() if w in added else self.merge_word(w), WORDS)

    def merge_word(self, word: str) -> bytes:
        """Ids of one word as little-endian uint32. The heap holds rank << 32 | position; an entry is stale if
        the pair now at that position has another rank. A -1 stands after the last symbol (and so at index -1)."""
        data = word.encode()
        n, inner, get, pop, push = len(data), self.inner, self.merges.get, heapq.heappop, heapq.heappush
        ids = [inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        if n == 1:
            return array("I", ids).tobytes()
        ids.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [r | i for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            top = pop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            j = after[i] if ids[i] >= 0 else n
            if j == n or get(ids[i] << 20 | ids[j]) != rank << 32:
                continue
            ids[i] = new = self.merged[rank]
            ids[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(new << 20 | ids[k])) is not None:
                    push(heap, r | i)
            if i and (r := get(ids[h := before[i]] << 20 | new)) is not None:
                push(heap, r | h)
        return array("I", [x for x in ids if x >= 0]).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian uint32; None counts as empty."""
        return b"".join(map(self.word_ids.__getitem__, self.splitter.parts(text))) if text else b""

    def decode(self, ids) -> str:
        """Vocabulary strings, joined by one space as the tokenizer's default decoder does."""
        return " ".join(map(self.strings.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def load(path: str) -> BPE:
    return BPE(path)


def _id_lists(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32()))


def slices(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about `size` bytes together; at least one row each."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // size
    starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(starts, starts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def encode(docs: DataFrame, vocab: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) for every row. Null text: no ids. Repeated rows and keys stay as they are; null keys
    are kept; other columns are not read. One pass over the partitions, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab)
        for batch in batches:
            for part in slices(batch, "t", TEXTS):
                yield pa.RecordBatch.from_arrays([part.column("k"), _id_lists([bpe.encode(t) for t in part.column("t").to_pylist()])], ["k", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.selectExpr(f"`{key}` k", f"`{text}` t"), run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decode(encoded: DataFrame, vocab: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, decoded string) for every row of (key, ids). Null ids count as none and decode to ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [bpe.decode(x or ()) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("ids"), pa.array(texts, pa.string())], ["k", "ids", "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    out = map_arrow(encoded.selectExpr(f"`{key}` k", f"`{ids}` ids"), run, f"k {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("k", key)
