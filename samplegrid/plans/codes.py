"""Scalars, code lengths and symbol streams beyond the first queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from samplegrid.functions import scalar
from samplegrid.operators import models, packed, symbols
from samplegrid.plans import fixtures as fx
from samplegrid.plans.registry import add

_RGB = f"with {fx.RGB_LINES}"
_SYM = f"with {fx.DOC_BYTES}"
_WP = "partition by doc_id order by pos"


def _lines(name: str, columns, sql: str) -> None:
    add(name, lambda s, d: fx.rgb_lines(s, d).select("k1", "k2", *(c.alias(n) for n, c in columns().items())), f"{_RGB} {sql}")


def _sy(name: str, query, sql: str | None = None) -> None:
    add(name, lambda s, d: query(fx.doc_bytes(s, d)), sql and f"{_SYM}{sql}")


def _docs(name: str, short, long_, sql: str | None = None) -> None:
    """short() of whole documents, long_() of the rows of those that are too long for one."""
    add(name, lambda s, d: packed.by_length(fx.doc_texts(s, d), short, long_), sql and f"{_SYM}{sql}")


def _images(name: str, short, long_, sql: str) -> None:
    """short() of whole documents, or, where three documents in a row are too long for one image, long_() of all rows."""

    def query(s, d):
        docs = fx.doc_texts(s, d)
        over = docs.groupBy(F.expr("doc_id div 3")).agg(F.sum("n").alias("n")).where(F.col("n") > packed.WHOLE)
        return long_(packed.rows(docs)) if over.limit(1).count() else short(docs)

    add(name, query, f"{_SYM}{sql}")


def _bits(x: str) -> str:
    return f"length(bin({x}))"


def _omega(v: str) -> str:
    """1 and the digits of v, of their number less 1, and so on down to 1."""
    out, rest = "1", v
    for _ in range(4):
        out += f" + case when {rest} > 1 then {_bits(rest)} else 0 end"
        rest = f"({_bits(rest)} - 1)"
    return f"({out})"


_FIB = "len(list_filter([" + ", ".join(map(str, scalar.FIBONACCI[:40])) + "]::bigint[], lambda f: f <= {v} + 1)) + 1"
_V = "(r*256 + g)::bigint"
_lines(
    "e3_more_code_lengths",
    lambda: {c: scalar.code_len(c, F.col("r") * 256 + F.col("g") - (40000 if c == "leb128_signed" else 0) + int(c == "elias_omega"), 70000 if c == "truncated" else 6).cast("long") for c in scalar.MORE_CODES},
    f""", n as (select *, {_V} v, {_bits(_V)}::bigint n, case when {_V} < 40000 then 39999 - {_V} else {_V} - 40000 end u from c)
        select k1, k2, {_FIB.format(v="v")} fibonacci, {_omega("(v + 1)")}::bigint elias_omega, 7*greatest(ceil(n/6.0e0), 1)::bigint chunked,
        case when v < 131072 - 70000 then 16 else 17 end::bigint truncated, (case when n < 8 then 3 else {_bits("n")} + 3 end + 1 + n)::bigint stout,
        case when v < 4 then 3 when v < 8 then 4 else n + 4 + case when n >= 8 then {_bits("n")} else 0 end end::bigint even_rodeh,
        case when u = 0 then 8 else 8*ceil(({_bits("u")} + 1)/7.0e0) end::bigint leb128_signed from n""",
)
_lines(
    "e4_texts",
    lambda: {
        "human": scalar.human(F.col("r").cast("long") * F.col("g") * F.col("b") * F.col("r") * F.col("b")), "hexed": F.hex(scalar.big_endian(F.col("r") * 65536 - F.col("b"))), "bits": scalar.bin_text("g"),
        "pow2": scalar.next_pow2(F.col("r") * 7),
    },
    """, h as (select *, r::bigint*g*b*r*b h from c), u as (select *, case when h < 1024 then 0 when h < 1048576 then 1 when h < 1073741824 then 2 else 3 end u from h)
        select k1, k2, regexp_replace(regexp_replace(printf('%.2f', round(h / pow(1024, u), 2)), '0+$', ''), '[.]$', '') || ['b', 'kb', 'mb', 'gb'][u + 1] human,
            right(printf('%016x', r*65536::bigint - b), 16).upper() hexed, lpad(bin(g), 8, '0') bits, case when r*7 < 2 then 1 else pow(2, ceil(log2(r*7)))::bigint end pow2 from u""",
)
_lines("e5_dc_shift", lambda: {"ac": scalar.dc_shift("r"), "dc": scalar.dc_shift("g", 127.5, True)}, " select k1, k2, r - 128.0e0 ac, g + 127.5e0 dc from c")
_cat = lambda x, a, b, c, d: f"({b} + 0.5e0*{x}*({c} - {a} + {x}*(2*{a} - 5*{b} + 4*{c} - {d} + {x}*(3*({b} - {c}) + {d} - {a}))))"
_lines(
    "e6_catmull_rom_2d",
    lambda: {"v": F.round(scalar.catmull_rom2(F.col("k2") / 8, F.col("r") / 256, [["r", "g", "b", "r"], ["g", "b", "r", "g"], ["b", "b", "g", "r"], ["g", "g", "r", "b"]]), 6)},
    ", t as (select *, k2/8.0e0 x, r/256.0e0 y from c) select k1, k2, round("
    + _cat("x", *(_cat("y", *row) for row in ("rgbr", "gbrg", "bbgr", "ggrb"))) + ", 6) v from t",
)
_lines(
    "e10_vectors",
    lambda: {
        "length": F.round(scalar.vector_length("r", "g"), 6), "dot": scalar.dot("r", "g", "g", "b"), "cross": scalar.cross("r", "g", "g", "b"),
        "nx": F.round(scalar.normalized("r", "g")[0], 6), "ny": F.round(scalar.normalized("r", "g")[1], 6),
        "rx": F.round(scalar.rotate2("r", "g", F.col("b") / 40)[0], 6) + 0.0, "ry": F.round(scalar.rotate2("r", "g", F.col("b") / 40)[1], 6) + 0.0,
        # a little more, so that exact halves are rounded alike
        **{f"i{k}": F.round(c + 1e-9, 6) + 0.0 for k, c in enumerate(scalar.invert2("r", "g", "b", F.col("r") + 1))},
    },
    """, t as (select *, b/40.0e0 a, nullif((r*(r + 1) - g*b)::double, 0) det, sqrt((r*r + g*g)::double) l from c)
        select k1, k2, round(l, 6) length, r*g + g*b dot, r*b - g*g "cross", round(case when l = 0 then 0 else r/l end, 6) nx, round(case when l = 0 then 0 else g/l end, 6) ny,
            round(r*cos(a) + g*sin(a), 6) + 0.0 rx, round(g*cos(a) - r*sin(a), 6) + 0.0 ry, round((r + 1)/det + 1e-9, 6) + 0.0 i0, round(-g/det + 1e-9, 6) + 0.0 i1, round(-b/det + 1e-9, 6) + 0.0 i2, round(r/det + 1e-9, 6) + 0.0 i3 from t""",
)
_lines(
    "o1_morton3_decode",
    lambda: dict(zip("xyz", scalar.unmorton3(scalar.morton3("r", "g", "b")), strict=True)),
    " select k1, k2, r::bigint x, g::bigint y, b::bigint z from c",
)
add(
    "o2_hilbert_decode",
    lambda s, d: fx.rgb_lines(s, d).withColumn("d", scalar.hilbert(256, "r", "g")).select("k1", "k2", *(c.alias(n) for n, c in zip("xy", scalar.unhilbert(256, "d"), strict=True))),
    f"{_RGB} select k1, k2, r::bigint x, g::bigint y from c",
)
# of the reader's own columns, so that the map is shown in both directions by values that are not made by the forward one
_sy(
    "a2_top_ngrams",
    lambda y: symbols.top_ngrams(symbols.ngrams(y, 4), 100),
    """, g as (select coalesce(lpad(lower(hex(lag(s, 3) over w)), 2, '0'), '00') || coalesce(lpad(lower(hex(lag(s, 2) over w)), 2, '0'), '00')
            || coalesce(lpad(lower(hex(lag(s, 1) over w)), 2, '0'), '00') || lpad(lower(hex(s)), 2, '0') g from sy window w as (partition by doc_id order by pos)),
        c as (select least(g, substr(g, 3) || substr(g, 1, 2), substr(g, 5) || substr(g, 1, 4), substr(g, 7) || substr(g, 1, 6)) g, count(*) cnt from g group by 1)
        select g, cnt from c order by cnt desc, g limit 100""",
)
_sy(
    "a2_ngram_report",
    lambda y: symbols.ngram_report(symbols.ngrams(y, 2), 2, 100),
    """, g as (select coalesce(lag(s) over (partition by doc_id order by pos), 0) a, s b from sy), c as (select least(a*256 + b, b*256 + a) g, count(*) n from g group by 1),
        t as (select sum(n)::bigint covered from (select n from c order by n desc limit 100)), w as (select count(*) grams, max(n) most, sum(n)::bigint total from c)
        select grams, most, 200::bigint top_bytes, grams*2 all_bytes, covered, total - covered remaining, covered*7/8.0e0 + (total - covered) + 100 compact from t, w""",
)
_sy(
    "a3_huffman_lengths",
    lambda y: symbols.huffman_lengths(y).groupBy("doc_id").agg(F.sum(F.col("cnt") * F.col("len")).alias("bits"), F.round(F.sum(F.pow(F.lit(2.0), -F.col("len"))), 9).alias("kraft")),
)
_CODES = {
    "fibonacci": _FIB.format(v="s"), "elias_omega": _omega("(s + 1)"), "chunked": "9", "truncated": "8", "stout": f"4 + {_bits('s + 1')} + case when s + 1 >= 128 then 4 else 0 end",
    "even_rodeh": f"case when s < 4 then 3 when s < 8 then 4 else {_bits('s')} + 4 + case when s >= 128 then 4 else 0 end end", "leb128_signed": "case when s < 64 then 8 else 16 end",
}
_sy(
    "a5_more_code_sizes",
    lambda y: symbols.code_size_report(y, scalar.MORE_CODES),
    " " + " union all ".join(f"select doc_id, '{n}' code, sum({e})::bigint bits from sy group by doc_id" for n, e in _CODES.items()),
)
_sy(
    "a5_golomb",
    symbols.best_golomb,
    """, f as (select doc_id, s, count(*) n from sy group by all), m as (select doc_id, max(s) most from f group by doc_id), t as (select doc_id, unnest(range(1, most + 2)) m from m),
        b as (select doc_id, m, sum(n*(s // m + 1 + length(bin(m)) - case when s % m < (1 << length(bin(m))) - m then 1 else 0 end))::bigint bits from f join t using (doc_id) group by all)
        select doc_id, m::int m, bits from b qualify row_number() over (partition by doc_id order by bits, m) = 1""",
)
_delta = lambda v: f"({_bits(v)} - 1 + 2*{_bits(_bits(v))} - 1)"
_sy(
    "a5_sequential",
    symbols.sequential_bits,
    f""", w as (select doc_id, {_bits("s")} n, lag({_bits("s")}) over ({_WP}) w from sy)
        select doc_id, (sum(case when w is null then {_delta("n")} + n when n <= w then w + 1 else 2*n - w end) + {_delta("(count(*) + 1)")})::bigint bits from w group by doc_id""",
)
_sy("a5_fixed", symbols.fixed_bits, f" select doc_id, ({_bits('max(s)')}*count(*))::bigint bits from sy group by doc_id")
_sy("a4_flat", lambda y: symbols.flat_bits(y).withColumn("bits", F.round("bits", 4)), " select doc_id, round(count(*)*log2(257), 4) bits from sy group by doc_id")
_docs(
    "a13_erase_bad_blocks",
    # sums that are wrong for every third block
    lambda t: packed.delta_erase_bad_blocks(t, packed.delta_checksums(t).withColumn("checksum", F.expr("checksum + if(block % 3 = 1, 1, 0)"))),
    lambda y: symbols.erase_bad_blocks(
        symbols.delta(y).selectExpr("doc_id", "pos", "if(delta > 127, delta - 256, delta) s"),
        symbols.block_checksum(symbols.delta(y).selectExpr("doc_id", "pos", "if(delta > 127, delta - 256, delta) s")).withColumn("checksum", F.expr("checksum + if(block % 3 = 1, 1, 0)")),
    ),
    f""", p as (select doc_id, pos, s, coalesce(lag(s) over ({_WP}), 0) b from sy), d as (select doc_id, pos, ((s - b + 384) % 256 - 128)::int s from p)
        select doc_id, pos, case when (pos // 257) % 3 = 1 then 0 else s end s from d""",
)
_sy(
    "a13_signed_checksum",
    lambda y: symbols.block_checksum(symbols.delta(y).selectExpr("doc_id", "pos", "if(delta > 127, delta - 256, delta) s")),
    f""", p as (select doc_id, pos, s, coalesce(lag(s) over ({_WP}), 0) b from sy), d as (select doc_id, pos, (s - b + 384) % 256 - 128 s from p)
        select doc_id, (pos // 257)::bigint block, sum(case when s >= 0 then 2*s else -2*s - 1 end)::bigint checksum from d group by all""",
)
_sy("w10_xor_inverse", lambda y: symbols.unxor(symbols.delta(y)), " select doc_id, pos, s from sy")
_sy(
    "w10_linear",
    symbols.linear_residual,
    f""", p as (select doc_id, pos, s, lag(s) over ({_WP}) a, lag(s, 2) over ({_WP}) b from sy), d as (select *, trunc(s - (a + b)/2.0e0) d from p)
        select doc_id, pos, (case when b is null then s else least(case when d >= 0 then 2*d else -2*d - 1 end, 255) end)::int residual from d""",
)
_RUNS = f"g as (select *, pos - row_number() over (partition by doc_id, s order by pos) g from x), r as (select doc_id, s, min(pos) start, count(*) n from g group by doc_id, s, g)"
_docs(
    "w11_zero_runs",
    packed.delta_zero_runs,
    lambda y: symbols.zero_runs(symbols.delta(y).selectExpr("doc_id", "pos", "delta s")),
    f""", p as (select doc_id, pos, s, coalesce(lag(s) over ({_WP}), 0) b from sy), x as (select doc_id, pos, (s - b + 256) % 256 s from p), {_RUNS},
        t as (select doc_id, sum(case when s <> 0 then n else n // 253 end)::bigint literals, sum(case when s <> 0 then 0 else n // 253 + (n % 253 > 0)::int end)::bigint runs from r group by doc_id)
        select doc_id, literals, runs, literals + 2*runs bytes from t""",
)
_sy(
    "w11_run_blocks",
    symbols.run_blocks,
    f""", x as (select doc_id, pos, s from sy), {_RUNS}, f as (select *, n > 3 is_run from r),
        b as (select *, sum((is_run or coalesce(prev, true))::int) over (partition by doc_id order by start) k from (select *, lag(is_run) over (partition by doc_id order by start) prev from f))
        select doc_id, min(start) start, bool_or(is_run) is_run, sum(n)::bigint n from b group by doc_id, k""",
)


def _adaptive(context: str, gain: int, source: str = "sy", alphabet: int = 257, start: str = "1") -> str:
    return f""", k as (select doc_id, pos, s, {context} k from {source}),
        p as (select doc_id, s, count(*) over (partition by doc_id, k, s order by pos) - 1 a, count(*) over (partition by doc_id, k order by pos) - 1 b from k)
        select doc_id, round(sum(-log2(({start} + {gain}.0e0*a) / ({alphabet} + {gain}*b))), 4) bits from p group by doc_id"""


def _lag(k: int) -> str:
    return f"coalesce(lag(s, {k}) over ({_WP}), 0)"


_ENDED = ", e as (select doc_id, pos, s from sy union all select doc_id, max(pos) + 1, 256 from sy group by doc_id)"
_LETTERS = tuple(range(97, 123))
_round = lambda df: df.withColumn("bits", F.round("bits", 4))
for _name, _source, _context, _gain, _sql, *_packed in (
    ("order0_end", symbols.with_end, lambda: [], 2, _ENDED + _adaptive("0", 2, "e")),
    ("order1_end", symbols.with_end, lambda: symbols.order(1), 2, _ENDED + _adaptive(_lag(1), 2, "e")),
    ("order2_blocks", None, lambda: [*symbols.order(2), F.expr("pos div 4096")], 20, _adaptive(f"{_lag(1)}*16777216::bigint + {_lag(2)}*65536 + pos // 4096", 20), packed.with_place(packed.order_of(2), 4096)),
    ("order3", None, lambda: symbols.order(3), 20, _adaptive(f"{_lag(1)}*65536 + {_lag(2)}*256 + {_lag(3)}", 20), packed.order_of(3)),
    ("order3_folded", None, lambda: [c % 16 for c in symbols.order(3)], 20, _adaptive(f"({_lag(1)} & 15)*256 + ({_lag(2)} & 15)*16 + ({_lag(3)} & 15)", 20), packed.folded(3)),
    ("position_folded", None, lambda: [symbols.order(1)[0] % 16, F.col("pos") % 16], 2, _adaptive(f"({_lag(1)} & 15)*16 + (pos & 15)", 2), packed.with_place(packed.folded(1), mod=16)),
    ("xor2", None, lambda: symbols.xor_of(2), 2, _adaptive(f"xor({_lag(1)}, {_lag(2)})", 2)),
    ("xor3", None, lambda: symbols.xor_of(3), 2, _adaptive(f"xor(xor({_lag(1)}, {_lag(2)}), {_lag(3)})", 2)),
):
    _by_rows = lambda y, f=_source, c=_context, g=_gain: _round(symbols.adaptive_bits(f(y) if f else y, c(), g))
    if _packed:
        _docs(f"w12_adaptive_{_name}", lambda t, c=_packed[0], g=_gain: _round(packed.adaptive_bits(t, c, g)), _by_rows, _sql)
    else:
        _sy(f"w12_adaptive_{_name}", _by_rows, _sql)
_sy(
    "w12_adaptive_preset",
    lambda y: _round(symbols.adaptive_bits(y, [], 2, listed=_LETTERS, weight=16)),
    _adaptive("0", 2, alphabet=257 + 16 * len(_LETTERS), start="case when s between 97 and 122 then 17 else 1 end"),
)
_HALVES = ", e as (select doc_id, pos*2 + i pos, case when i = 0 then s >> 4 else s & 15 end s from (select *, unnest([0, 1]) i from sy))"
_docs(
    "w12_adaptive_nybbles",
    lambda t: _round(packed.adaptive_bits(t, packed.order_of(3, 4), 2, 17, "half")),
    lambda y: _round(symbols.adaptive_bits(symbols.nybbles(y), symbols.order(3), 2, 17)),
    _HALVES + _adaptive(f"{_lag(1)}*256 + {_lag(2)}*16 + {_lag(3)}", 2, "e", 17),
)
_BITS = ", e as (select doc_id, pos*8 + i pos, (s >> (7 - i)::int) & 1 s from (select *, unnest(range(8)) i from sy))"
_CHAIN = " || ".join(f"{_lag(k)}" for k in range(2, 18))
_docs(
    "w12_adaptive_bit_chain",
    lambda t: _round(packed.adaptive_bits(t, None, 2, 3, "bit")),
    lambda y: _round(symbols.adaptive_bits(symbols.bits(y), symbols.order(17)[1:], 2, 3)),
    _BITS + _adaptive(_CHAIN, 2, "e", 3),
)

# models that learn one symbol late, the first symbol being 0
_LATE = ", u as (select doc_id, s, pos + 1 j, true as real from sy union all select distinct doc_id, 0, 0, false from sy)"
_OWN = "partition by doc_id, s order by j"
_sy(
    "w12_order0_late",
    lambda y: _round(models.late_bits(y)),
    f"""{_LATE}, k as (select *, row_number() over ({_OWN}) - 1 seen, lag(j) over ({_OWN}) as last from u)
        select doc_id, round(sum(-log2((1 + 2.0e0*(seen - case when last = j - 1 then 1 else 0 end)) / (257 + 2*(j - 1)))), 4) bits from k where real group by doc_id""",
)
_docs(
    "w12_rolling_order0",
    lambda t: _round(packed.rolling_bits(t)),
    lambda y: _round(models.rolling_bits(y)),
    # a symbol's count at step i is what its places before have left; the sum of all counts is counted symbol by symbol where they fall
    f"""{_LATE}, v as (select *, 17*row_number() over ({_OWN}) - j d from u), z as (select *, 1 + d - min(d) over ({_OWN} rows unbounded preceding) low from v),
        k as (select *, lag(j) over ({_OWN}) as last, lag(low) over ({_OWN}) was, coalesce(lead(j) over ({_OWN}), 1000000000) as next from z),
        f as (select doc_id, j + 1 i, 1 n from k union all select doc_id, least(next, j + low + 16), -1 from k),
        g as (select doc_id, i, sum(n) n from f group by all),
        r as (select doc_id, j - 1 i, case when last is null then 1 when last = j - 1 then was else greatest(1, was + 16 - (j - 2 - last)) end c from k where real),
        hh as (select doc_id, i, sum(coalesce(n, 0)) over (partition by doc_id order by i) falling, c from r left join g using (doc_id, i)),
        t as (select doc_id, c, 257 + 16*i - coalesce(sum(falling) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) total from hh)
        select doc_id, round(sum(-log2(c::double / total)), 4) bits from t group by doc_id""",
)
_docs(
    "w12_bit_chain32",
    lambda t: _round(packed.bit_chain_bits(t)),
    lambda y: _round(models.bit_chain_bits(y)),
    # a fold over the places of each history; d is the chance in steps, b the bits so far
    f""", w as (select doc_id, pos, s + 256::bigint*{_lag(1)} + 65536::bigint*{_lag(2)} + 16777216::bigint*{_lag(3)} w, unnest(range(8)) i from sy),
        e as (select doc_id, pos*8 + i p, (w >> (9 - i)) & 65535 h, ((w >> (8 - i)) & 1)::double u, ((w >> (7 - i)) & 1)::double s from w),
        l as (select doc_id, h, list({{'d': u*2 - 1, 'b': s}} order by p) l from e group by doc_id, h),
        f as (select doc_id, list_reduce(l, lambda a, x: {{'d': least(greatest(a.d + x.d, 0), 10000),
            'b': a.b + log2((20003 + abs(a.d - 5000)*25) / (10001 + case when (a.d >= 5000) = (x.b = 1) then abs(a.d - 5000)*25 else 0 end))}}, {{'d': 5000.0e0, 'b': 0.0e0}}).b b from l)
        select doc_id, round(sum(b), 4) bits from f group by doc_id""",
)

_SUMS = ", c as (select doc_id, s, count(*) n from sy group by all), u as (select doc_id, s, sum(n) over (partition by doc_id order by s) - n low, sum(n) over (partition by doc_id order by s) high from c)"
_cum = lambda y: symbols.cumulative(symbols.histogram(y).drop("share"))
_sy("w14_range_sum", lambda y: symbols.range_sum(_cum(y), 97, 123), _SUMS + " select doc_id, coalesce(sum(n) filter (s between 97 and 122), 0)::bigint total from c group by doc_id")
_sy(
    "w14_find_symbol",
    lambda y: symbols.find_symbol(_cum(y), y.groupBy("doc_id").agg(F.count("*").alias("n")).selectExpr("doc_id", "explode(sequence(0L, n - 1, greatest(n div 16, 1))) value")),
    _SUMS + """, n as (select doc_id, count(*) n from sy group by doc_id), v as (select doc_id, unnest(range(0, n, greatest(n // 16, 1))) value from n)
        select v.doc_id, value, s from v join u on u.doc_id = v.doc_id and low <= value and value < high""",
)
_STREAM = symbols.keystream(0x65, 128)
_sy("e8_whiten", lambda y: symbols.whiten(y, 0x65), f" select doc_id, pos, xor(s, ([{', '.join(map(str, _STREAM))}])[case when pos = 0 then 1 else (pos - 1) % 127 + 2 end]) s from sy")
_sy("e8_whiten_inverse", lambda y: symbols.whiten(symbols.whiten(y, 0x65), 0x65), " select doc_id, pos, s from sy")
_docs("o5_context_unsort", lambda t: packed.context_unsort(packed.context_sort(t)), lambda y: symbols.context_unsort(symbols.context_sort(y), symbols.context_lead(y)), " select doc_id, pos, s from sy")
_planes = lambda y: y.selectExpr("doc_id div 3 image_id", "doc_id % 3 plane", "pos", "s")
_planes_of = lambda t: t.selectExpr("doc_id div 3 image_id", "doc_id % 3 plane", "b")
_images(
    "snk1_deinterleave",
    lambda t: packed.deinterleave(packed.interleave(_planes_of(t)), _planes_of(t).selectExpr("image_id", "plane", "octet_length(b) n")),
    lambda y: symbols.deinterleave(symbols.interleave(_planes(y)).select("image_id", "seq", "s"), _planes(y).groupBy("image_id", "plane").agg((F.max("pos") + 1).alias("n"))),
    " select doc_id // 3 image_id, doc_id % 3 plane, pos, s from sy",
)
_images(
    "src8_read_prefix",
    lambda t: packed.interleaved_prefix(_planes_of(t), 1000),
    lambda y: symbols.read_prefix(symbols.interleave(_planes(y)), 1000),
    """, q as (select doc_id // 3 image_id, doc_id % 3 plane, pos, s, row_number() over (partition by doc_id // 3 order by pos, doc_id % 3) - 1 seq from sy)
        select image_id, plane, pos, case when seq < 1000 then s else 0 end s from q""",
)
