"""What a Python worker holds, and what it does for each new word."""

import itertools
import random
import tracemalloc

import pytest

pytest.importorskip("samplegrid.llm")

import numpy as np
import pyarrow as pa
from pyspark.sql.types import StructType

from samplegrid.llm import bpe, minhash, queries, tokenfile


def new_words(n):
    return ["".join(w) for w in itertools.islice(itertools.product("etaoinshrdlu", repeat=6), n)]


def test_worker_of_bpe_holds_each_new_word_once():
    """Neither by piece and by word, nor for ever."""
    own, words = bpe.BPE(queries.VOCAB), new_words(20_000)
    tracemalloc.start()
    own.encode(" ".join(words))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 240 * len(words)
    assert 2 * bpe.WORDS * 240 < 75e6


class Frame:
    """Stands for a table of (doc_id long, ...), up to mapInArrow."""

    schema = StructType().add("doc_id", "long")

    def selectExpr(self, *columns):
        return self

    def withColumnRenamed(self, old, new):
        return self


def test_worker_of_decode_holds_few_rows(monkeypatch):
    own, ids, caught = bpe.load(queries.VOCAB), [list(range(1000, 2000))] * 1000, []
    batch = pa.record_batch({"k": range(1000), "ids": pa.array(ids, pa.list_(pa.int32()))})
    monkeypatch.setattr(bpe, "map_arrow", lambda df, run, schema: caught.append(run) or df)
    bpe.decode(Frame(), queries.VOCAB)
    parts = list(caught[0](iter([batch])))
    assert max(p.num_rows for p in parts) <= 128 and sum(p.num_rows for p in parts) == 1000
    assert parts[-1].column("decoded")[-1].as_py() == own.decode(ids[0])


def test_sets_of_one_step_are_small(monkeypatch):
    """The texts whose shingles a worker makes at once, as signatures() cuts them."""
    text = " ".join(new_words(500))
    batch, sizes, caught = pa.record_batch({"doc_id": range(1000), "text": [text] * 1000}), [], []
    made = minhash.shingle_sets
    monkeypatch.setattr(minhash, "map_arrow", lambda df, run, schema: caught.append(run))
    monkeypatch.setattr(minhash, "shingle_sets", lambda texts, k: sizes.append(texts.nbytes) or made(texts, k))
    minhash.signatures(Frame())
    assert sum(p.num_rows for p in caught[0](iter([batch]))) == 1000
    assert max(sizes) < 600_000


def test_token_file_merges_new_words_together(monkeypatch):
    """The library's model is asked for long words only, one call each; ids are the library's on both sides of that length."""
    from tokenizers import Tokenizer

    whole, rng = Tokenizer.from_file(queries.VOCAB), random.Random(6)
    own, asked = tokenfile.Library(queries.VOCAB), []

    class Model:
        tokenize = staticmethod(lambda word, model=own.model: asked.append(word) or model.tokenize(word))

    own.model = Model
    texts = ["".join(rng.choices("etaoinshrdluabc\u00e9\u00df ", k=rng.randint(0, 300))) for _ in range(300)]
    texts += [" ".join(new_words(5000)), "b" * 64 + " " + "b" * 65, "\u00e9" * 32 + "." + "\u00e9" * 33, "a<|endoftext|>b", None, "", "\U00010400\ufacf x"]
    expected = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    ids, sizes = own.encode_texts(texts, 1)
    assert sizes.tolist() == [len(e) + 1 for e in expected] and ids.tolist() == [i for e in expected for i in (*e, 1)]
    assert min(map(len, asked)) > 64
    assert np.concatenate([np.frombuffer(own.encode(t), "<u4") for t in texts]).tolist() == [i for e in expected for i in e]
