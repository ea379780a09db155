"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans (assign, access, hex) are reported as they are. Weak parts (an endpoint, an access-like identifier, a long
mixed token) mean nothing alone: they are joined by position, and a weak part is reported only if an access identifier,
a secret and an endpoint, at least two of these three and of different roles with one of them a secret, lie within one
scope of SCOPE characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplegrid.llm.common import materialize, small

#: Characters from the start of one part to the start of another of the same credential.
SCOPE = 400

#: Patterns of the base kinds, in the order in which kinds are listed.
BASE = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "length(regexp_extract(m, p, 1)) >= 6"),
    "access": (r"AKIA[A-Z0-9]{16,}", "true"),
    "hex": (r"[0-9a-f]{24,}", "true"),
}
#: Weak parts and their roles; kinds of the base have roles too.
WEAK = {
    "endpoint": r"(?i:https?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[A-Za-z0-9._~:@/-]{4,}",
    "ident": r"(?i:user(?:name)?|login|client_?id|account|access_?key_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]{3,})",
    # a maximal run with a digit, an upper and a lower letter, its padding included
    "mixed": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}",
}
#: What a match of a weak kind must fulfil besides.
WEAK_KEEP = {"mixed": "x.m rlike '[0-9]' and x.m rlike '[A-Z]' and x.m rlike '[a-z]'"}
#: What redaction takes of a match, from here to its end: of an assignment the value, else the whole.
VALUE = {k: "x.start + length(x.m) - length(regexp_extract(x.m, p, 1))" for k in ("assign", "ident")}
ROLE = {"assign": "secret", "hex": "secret", "mixed": "secret", "access": "ident", "ident": "ident", "endpoint": "endpoint"}
KINDS = [*BASE, *WEAK]
#: Matches of a text whose offsets are summed up at a time.
CHUNK = 256


def _sql(s: str) -> str:
    return "r'" + s.replace("'", r"\x27") + "'"


def _spans(kind: str, pattern: str, keep: str = "true") -> str:
    """SQL: array<struct<start, end, rank, cut>> of the pattern's matches in `text`, in code points, end exclusive; redaction
    takes cut to end. The texts between the matches and the matches themselves give the offsets, summed up in chunks, as a
    fold copies its array with each match."""
    p = _sql(pattern)
    cut = VALUE.get(kind, "x.start").replace("x.start", "s.at + x.gap").replace("(x.m, p,", f"(x.m, {p},")
    span = f"""named_struct('start', s.at + x.gap, 'end', s.at + x.gap + length(x.m), 'rank', {KINDS.index(kind)}, 'cut', {cut}, 'ok', {keep.replace('(m, p,', f'(x.m, {p},')})"""
    spans = "array<struct<start:int,end:int,rank:int,cut:int,ok:boolean>>"
    fold = f"""aggregate(c, named_struct('at', a.at, 'out', cast(array() as {spans})),
        (s, x) -> named_struct('at', s.at + x.gap + coalesce(length(x.m), 0), 'out', if(x.m is null, s.out, concat(s.out, array({span})))))"""
    pairs = f"zip_with(split(text, {p}, -1), regexp_extract_all(text, {p}, 0), (g, m) -> named_struct('gap', length(g), 'm', m))"
    chunks = f"transform(array({pairs}), z -> transform(sequence(0, (size(z) - 1) div {CHUNK}), i -> slice(z, i * {CHUNK} + 1, {CHUNK})))[0]"
    return f"""case when text rlike {p} then filter(flatten(aggregate({chunks}, named_struct('at', 0, 'out', cast(array() as array<{spans}>)),
        (a, c) -> transform(array({fold}), r -> named_struct('at', r.at, 'out', concat(a.out, array(r.out))))[0], a -> a.out)), x -> x.ok) else array() end"""


def _text(spans: str) -> str:
    """SQL: kind:start:end of each span by start, then kind, comma-joined."""
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform(array_sort({spans}), x -> concat({kinds}[x.rank], ':', x.start, ':', x.end)), ',')"


def _scan(docs: DataFrame, scope: int) -> DataFrame:
    """scan() with h, the hash of the text that the spans belong to."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    plain = "transform({}, x -> named_struct('start', x.start, 'rank', x.rank, 'end', x.end, 'cut', x.cut))"
    found = rows.select(
        "doc_id",
        F.xxhash64("text").alias("h"),
        F.expr("concat(" + ", ".join(plain.format(_spans(k, p, keep)) for k, (p, keep) in BASE.items()) + ")").alias("base"),
        F.expr("concat(" + ", ".join(plain.format(_spans(k, p, WEAK_KEEP.get(k, "true"))) for k, p in WEAK.items()) + ")").alias("weak"),
    ).withColumn("base", F.array_sort("base"))
    # narrow, and read twice: the texts are searched once
    found = materialize(found, "spans")
    # the interval join: parts of one text, by the scope they start in and the next one
    roles = "array(" + ", ".join(f"'{ROLE[k]}'" for k in KINDS) + ")"
    parts = found.where("size(weak) > 0 and size(weak) + size(base) > 1").select("doc_id", "h", F.explode(F.concat("base", "weak")).alias("x")).distinct()
    parts = parts.selectExpr("doc_id", "h", "x", f"{roles}[x.rank] role", f"x.rank >= {len(BASE)} weak", f"cast(x.start div {scope} as int) cell")
    # one row for each role, cell and text is enough to find partners: its first and last start
    cells = parts.groupBy("doc_id", "h", "role", "cell").agg(F.sort_array(F.collect_set(F.col("x.start"))).alias("starts"))
    cells = cells.select(F.col("doc_id").alias("doc2"), F.col("h").alias("h2"), F.col("role").alias("other"), "starts", F.explode(F.expr("array(cell - 1, cell, cell + 1)")).alias("cell2"))
    weak = parts.where("weak").join(cells, F.expr("doc_id <=> doc2 and h = h2 and cell = cell2 and role <> other"))
    near = weak.where(F.expr(f"exists(starts, s -> abs(s - x.start) <= {scope})")).select("doc_id", "h", "x", "role", "other")
    near = near.groupBy("doc_id", "h", "x", "role").agg(F.bool_or(F.col("other") == "secret").alias("secret"))
    linked = near.where("secret or role = 'secret'").groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("x")).alias("linked"))
    left, right = found.select("doc_id", "h", "base").alias("l"), linked.alias("r")
    out = left.join(right, F.expr("l.doc_id <=> r.doc_id and l.h = r.h"), "left")
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,cut:int>>)")
    return out.select("l.doc_id", "l.h", "l.base", F.coalesce("r.linked", none).alias("linked"))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, base, linked) for every row of docs(doc_id, text, ...): arrays of struct(start, rank, end, cut), by start and
    rank; rank counts KINDS, cut is where redaction starts. base: spans of the base kinds. linked: weak spans confirmed by
    complementary parts.

    Null and empty texts have no spans. Rows that repeat both id and text are scanned alike; a null doc_id is kept.
    Other columns are not read.
    """
    return _scan(docs, scope).drop("h")


def report(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans) of scan()'s rows, spans as text."""
    counts = [F.expr(f"cast(size(filter(base, x -> x.rank = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.expr(_text("base")).alias("base"), F.expr(_text("concat(base, linked)")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]", scope: int = SCOPE) -> DataFrame:
    """docs with every span that scan() reports, base or linked, replaced by a mark (of name = value the value, not the name)
    and n_chars, if there is such a column, counted anew. Spans that overlap get one mark. Null texts stay null; null ids
    and repeated rows are kept."""
    spans = _scan(docs, scope).where("size(base) + size(linked) > 0").dropDuplicates(["doc_id", "h"])
    order = "array_sort(transform(concat(base, linked), x -> named_struct('start', x.cut, 'end', x.end)))"
    merge = f"""aggregate({order}, cast(array() as array<struct<start:int,end:int>>), (out, x) -> if(
        size(out) > 0 and x.start < element_at(out, -1).end,
        concat(slice(out, 1, size(out) - 1), array(named_struct('start', element_at(out, -1).start, 'end', greatest(element_at(out, -1).end, x.end)))),
        concat(out, array(x))))"""
    spans = small(materialize(spans.select("doc_id", "h", F.expr(merge).alias("cuts")), "cuts")).alias("s")
    kept = "transform(s.cuts, (x, i) -> substring(d.text, if(i = 0, 0, s.cuts[i - 1].end) + 1, x.start - if(i = 0, 0, s.cuts[i - 1].end)))"
    tail = "substring(d.text, element_at(s.cuts, -1).end + 1)"
    out = docs.alias("d").join(spans, F.expr("d.doc_id <=> s.doc_id and xxhash64(coalesce(d.text, '')) = s.h"), "left")
    text = F.when(F.col("s.cuts").isNull(), F.col("d.text")).otherwise(F.array_join(F.expr(f"concat({kept}, array({tail}))"), mark))
    out = out.select(*(text.alias("text") if c == "text" else F.col(f"d.{c}") for c in docs.columns))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
