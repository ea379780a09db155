"""Operators on whole documents against those on rows of bytes, and that their queries deal out no bytes."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from samplegrid.operators import models, packed, signals, symbols

SF = "/root/testdata/sf0.001"


def documents():
    rng = random.Random(7)
    text = b"the cat sat on the mat, the rat sat on the cat; " * 9
    some = [b"a", b"ab", b"\0", b"\0\0\0\0", b"z" * 300, bytes(1500), text, text + text[5:90], b"\0a\0a\0", bytes(range(256)) * 2, b"\xff\x80\x7f" * 100]
    some += [bytes(rng.choice(alphabet) for _ in range(rng.randint(1, 700))) for alphabet in (b"01", b"abcde", bytes(range(256)), b"\0 x") for _ in range(4)]
    return [(7 * k + 2, bytearray(b)) for k, b in enumerate(some)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), "doc_id long, b binary").repartition(3).cache()


@pytest.fixture(scope="module")
def sy(docs):
    return packed.rows(docs).cache()


def table(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_rows_are_the_bytes(sy):
    assert table(sy) == sorted((k, i, v) for k, b in documents() for i, v in enumerate(b))


def test_pieces_hold_whole_documents():
    import pyarrow as pa

    some = documents()
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in some]), pa.array([bytes(b) for _, b in some], pa.binary())], ["doc_id", "b"]).slice(1)
    got = [(int(k), p.s[a:b].tobytes()) for p in packed.pieces(iter([batch]), 64) for k, a, b in zip(p.ids, p.starts, p.starts[1:])]  # noqa: B905
    assert got == [(k, bytes(b)) for k, b in some[1:]]


def test_long_documents_go_by_rows(docs, sy):
    docs = docs.withColumn("n", F.octet_length("b"))
    assert table(packed.by_length(docs, packed.runs, symbols.runs, 200)) == table(symbols.runs(sy))


def test_keys_that_mix_alike_are_told_apart():
    """Keys of 64 bits, which are sorted by the high bits of a product."""
    import numpy as np

    keys = np.random.default_rng(3).integers(0, 1 << 63, 5000).astype(np.uint64)
    keys = np.concatenate([keys, keys[::-1]])
    p = packed.Piece(np.arange(1), np.array([0, len(keys)]), np.zeros(len(keys), np.uint8))
    order, same = packed.in_groups(p, keys, 64)
    assert same.sum() == 5000 and (keys[order[1:]] == keys[order[:-1]]).tolist() == same[1:].tolist() and (order[1:] > order[:-1])[same[1:]].all()


#: By query: the operator on documents, and that on rows.
CASES = {
    "j15_longest_match": (lambda t: packed.longest_match(t, 64), lambda y: signals.longest_match(y, 64)),
    "o5_context_unsort": (lambda t: packed.context_unsort(packed.context_sort(t)), lambda y: symbols.context_unsort(symbols.context_sort(y), symbols.context_lead(y))),
    "o6_rotation_unsort": (lambda t: packed.rotation_unsort(packed.rotation_sort(t)), lambda y: signals.rotation_unsort(signals.rotation_sort(y))),
    "o9_recency_rank_wide": (lambda t: packed.recency_rank(t, 2), lambda y: signals.recency_rank(y, 2)),
    "w12_adaptive_nybbles": (lambda t: packed.adaptive_bits(t, packed.order_of(3, 4), 2, 17, "half"), lambda y: symbols.adaptive_bits(symbols.nybbles(y), symbols.order(3), 2, 17)),
    "w12_geometric_recency": (lambda t: packed.recency_bits(t, signals.list_weights()), signals.recency_bits),
    "w15_sum_pyramid_256": (lambda t: packed.sum_pyramid(t, (2, 8, 256)), lambda y: symbols.sum_pyramid(y, (2, 8, 256))),
    "o9_recency_rank": (packed.recency_rank, signals.recency_rank),
    "snk1_deinterleave": (lambda t: packed.deinterleave(packed.interleave(t.selectExpr("doc_id div 3 image_id", "doc_id % 3 plane", "b")), t.selectExpr("doc_id div 3 image_id", "doc_id % 3 plane", "octet_length(b) n")), lambda y: y.selectExpr("doc_id div 3 image_id", "doc_id % 3 plane", "pos", "s")),
    "w12_adaptive_bit_chain": (lambda t: packed.adaptive_bits(t, None, 2, 3, "bit"), lambda y: symbols.adaptive_bits(symbols.bits(y), symbols.order(17)[1:], 2, 3)),
    "a13_erase_bad_blocks": (lambda t: packed.delta_erase_bad_blocks(t, packed.delta_checksums(t).where("block <> 2").selectExpr("doc_id", "block", "checksum + if(doc_id % 5 = block, 1, 0) checksum")), lambda y: symbols.erase_bad_blocks(symbols.delta(y).selectExpr("doc_id", "pos", "if(delta > 127, delta - 256, delta) s"), symbols.block_checksum(symbols.delta(y).selectExpr("doc_id", "pos", "if(delta > 127, delta - 256, delta) s")).where("block <> 2").selectExpr("doc_id", "block", "checksum + if(doc_id % 5 = block, 1, 0) checksum"))),
    "w13_context_hits_bits": (lambda t: packed.context_hits(t, 8, "bit"), lambda y: symbols.context_hits(symbols.bits(y), 8)),
    "w12_bit_chain32": (packed.bit_chain_bits, models.bit_chain_bits),
    "w11_runs": (packed.runs, symbols.runs),
    "w11_zero_runs": (packed.delta_zero_runs, lambda y: symbols.zero_runs(symbols.delta(y).selectExpr("doc_id", "pos", "delta s"))),
    "w13_context_hits_5": (lambda t: packed.context_hits(t, 5), lambda y: symbols.context_hits(y, 5)),
    "w13_context_hits_6": (lambda t: packed.context_hits(t, 6), lambda y: symbols.context_hits(y, 6)),
    "w12_rolling_order0": (packed.rolling_bits, models.rolling_bits),
    "j12_repeats": (lambda t: packed.repeats(t, (16, 64), 500), lambda y: signals.repeats(y, (16, 64), 500)),
    "w12_adaptive_position": (lambda t: packed.adaptive_bits(t, packed.with_place(packed.order_of(1), mod=16)), lambda y: symbols.adaptive_bits(y, [*symbols.order(1), F.col("pos") % 16])),
    "w12_adaptive_position_folded": (lambda t: packed.adaptive_bits(t, packed.with_place(packed.folded(1), mod=16)), lambda y: symbols.adaptive_bits(y, [symbols.order(1)[0] % 16, F.col("pos") % 16])),
    "src8_read_prefix": (lambda t: packed.interleaved_prefix(t.selectExpr("doc_id div 3 image_id", "doc_id % 3 plane", "b"), 200), lambda y: symbols.read_prefix(symbols.interleave(y.selectExpr("doc_id div 3 image_id", "doc_id % 3 plane", "pos", "s")), 200)),
    "w13_context_hits_7": (lambda t: packed.context_hits(t, 7), lambda y: symbols.context_hits(y, 7)),
    "w12_adaptive_order3_folded": (lambda t: packed.adaptive_bits(t, packed.folded(3), 20), lambda y: symbols.adaptive_bits(y, [c % 16 for c in symbols.order(3)], 20)),
    "w13_context_hits_4": (lambda t: packed.context_hits(t, 4), lambda y: symbols.context_hits(y, 4)),
    "w12_adaptive_order3": (lambda t: packed.adaptive_bits(t, packed.order_of(3), 20), lambda y: symbols.adaptive_bits(y, symbols.order(3), 20)),
    "w12_adaptive_order2": (lambda t: packed.adaptive_bits(t, packed.order_of(2), 20), lambda y: symbols.adaptive_bits(y, symbols.order(2), 20)),
    "w12_adaptive_order2_blocks": (lambda t: packed.adaptive_bits(t, packed.with_place(packed.order_of(2), 300), 20), lambda y: symbols.adaptive_bits(y, [*symbols.order(2), F.expr("pos div 300")], 20)),
}


@pytest.mark.parametrize("name", CASES)
def test_documents_equal_rows(docs, sy, name):
    short, long_ = CASES[name]
    assert table(short(docs)) == table(long_(sy))


@pytest.mark.parametrize("name", CASES)
def test_no_bytes_are_dealt_out(spark, name):
    """The query's plan has no row of each byte that is sorted or dealt out."""
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "Window" not in plan and "MapInArrow" in plan
