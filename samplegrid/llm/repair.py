"""Conversation structure repair: the cheapest edits that give a conversation the roles s?(ua)+ or no rows at all.

A row is one of nine symbols: its role's initial (s, u, a or another), cut off or not, or a row that must go. The least cost to
finish from each of four states of the role automaton is a vector; its differences are bounded, so only a few normalised
vectors exist. After the method of the four Russians, their transitions are tabulated for every block of BLOCK symbols:
vectors run backward through a conversation by one lookup a block. Edits are then traced forward: each block is
expanded backward from the vector behind it, and at each row the first letter of the alphabet is taken that keeps the
cost least, so ties end in the least audit string.

Rows are sorted by range over all conversations, equal rows as one with a count, so a large conversation lies in several tasks;
each task cuts its rows into chunks. A chunk is a function of vectors (backward) and, once these are known, of
states (forward); functions are composed over the chunks of a task and then over tasks. A task that joins a conversation reads
its repaired rows in order and holds one batch of chunks.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplegrid.llm.common import by_key, discard, map_arrow, materialize

#: Symbols of a block; rows and bytes of text after which a chunk ends.
BLOCK, CHUNK_ROWS, CHUNK_BYTES = 4, 1024, 1 << 16
#: Costs.
RENAME, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
WHITE = " \t\n\x0b\x0c\r"

START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: What a row of each role may follow, and where it leads.
FOLLOWS = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
#: The role that an inserted or renamed row takes in each state.
NEEDED = {START: "user", AFTER_S: "user", AFTER_U: "assistant", AFTER_A: "user"}
INITIALS, GONE, SYMBOLS = "sua", 8, 9


def symbol(initial: str, cut_off: bool) -> int:
    """The symbol of a row that may stay; rows that must go are GONE."""
    return 2 * (INITIALS.find(initial) % 4 if initial else 3) + cut_off


def _needed(q: int) -> int:
    return FOLLOWS[q, NEEDED[q][0]]


class Tables:
    """vectors: the normalised vectors, vectors[0] that of the end. step[v][symbol], block[v, code]: the vector before one
    symbol, or before BLOCK symbols (code: their number of base 9). trace[v][symbol][q]: what happens from state q with v
    behind the symbol: (audit letters, rows inserted before, role the row takes or None if deleted or kept, kept, cost, next state).
    finish[q]: the roles inserted at the end."""

    def __init__(self) -> None:
        end = self._closed([0, np.inf, np.inf, 0])
        self.vectors, number, self.step, self.trace = [end], {end: 0}, [], []
        for v in self.vectors:  # grows
            self.step.append([])
            self.trace.append([])
            for s in range(SYMBOLS):
                before = self._closed([min(c for _, c, _ in self._edits(v, s, q)) for q in range(4)])
                least = min(before)
                normal = tuple(x - least for x in before)
                if normal not in number:
                    number[normal] = len(self.vectors)
                    self.vectors.append(normal)
                self.step[-1].append(number[normal])
                self.trace[-1].append([self._traced(v, before, s, q) for q in range(4)])
        one = np.array(self.step)
        self.block = np.arange(len(one))[:, None]
        for _ in range(BLOCK):  # one more symbol behind: the old block before the vector that it gives
            self.block = np.stack([self.block[one[:, s]] for s in range(SYMBOLS)], axis=2).reshape(len(one), -1)
        self.finish = []
        for q in range(4):
            roles = []
            while q not in (START, AFTER_A):
                roles.append(NEEDED[q])
                q = _needed(q)
            self.finish.append(roles)

    @staticmethod
    def _closed(v: list) -> tuple:
        v = list(v)
        for _ in range(4):
            v = [min(v[q], INSERT + v[_needed(q)]) for q in range(4)]
        return tuple(v)

    @staticmethod
    def _edits(v: tuple, s: int, q: int) -> list[tuple[str, float, int]]:
        """(letter, cost with what follows, next state) of what can be done with a row."""
        out = [("D", DELETE + v[q], q)]
        if s != GONE:
            extra = CUT_OFF * (s % 2)
            to = FOLLOWS.get((q, (INITIALS + "-")[s // 2]))
            if to is not None:
                out.append(("K", extra + v[to], to))
            out.append(("R", RENAME + extra + v[_needed(q)], _needed(q)))
        return out

    def _traced(self, v: tuple, before: tuple, s: int, q: int) -> tuple:
        letters, inserted, cost = "", [], 0
        while True:
            options = {x: (c, to) for x, c, to in self._edits(v, s, q) if c == before[q]}
            if "D" in options or before[q] != INSERT + before[_needed(q)]:
                break
            letters, cost = letters + "I", cost + INSERT
            inserted.append(NEEDED[q])
            q = _needed(q)
        x = min(options)
        to = options[x][1]
        cost += {"D": DELETE, "K": 0, "R": RENAME}[x] + (CUT_OFF * (s % 2) if s != GONE and x != "D" else 0)
        return letters + x, tuple(inserted), NEEDED[q] if x == "R" else None, x != "D", cost, to


@functools.cache
def tables() -> Tables:
    return Tables()


def blocks(symbols: bytes) -> Iterator[tuple[bytes, int]]:
    """(the block, its code) from the last to the first; the first may be short, then its code is -1."""
    for end in range(len(symbols), 0, -BLOCK):
        cut = symbols[max(0, end - BLOCK) : end]
        yield cut, functools.reduce(lambda n, s: n * SYMBOLS + s, cut, 0) if len(cut) == BLOCK else -1


def before(symbols: bytes, v):
    """The vector (or an array of vectors) before the symbols, from that behind them."""
    t = tables()
    for cut, code in blocks(symbols):
        if code >= 0:
            v = t.block[v, code]
        else:
            for s in reversed(cut):
                v = np.array(t.step)[v, s]
    return v


def edits(symbols: bytes, v: int, q: int) -> Iterator[tuple]:
    """The trace of each symbol, from state q and with vector v behind the last one."""
    t, behind = tables(), []
    for cut, code in blocks(symbols):
        behind.append((cut, v))
        v = int(t.block[v, code]) if code >= 0 else v
    for cut, v in reversed(behind):
        inside = [v]
        for s in reversed(cut[1:]):
            inside.append(t.step[inside[-1]][s])
        for s, w in zip(cut, reversed(inside), strict=True):
            found = t.trace[w][s][q]
            q = found[-1]
            yield found


def repaired(symbols: bytes, rows: list[tuple[str, str]], v: int = 0, q: int = START) -> tuple[str, list[str], int, int]:
    """(audit, `role:text` lines, cost, next state) of a chunk; rows: those whose symbol is not GONE."""
    audit, lines, cost, own = [], [], 0, iter(rows)
    for s, (letters, inserted, role, kept, price, q) in zip(symbols, edits(symbols, v, q), strict=True):
        row = next(own) if s != GONE else None
        audit.append(letters)
        lines += [f"{r}:" for r in inserted]
        if kept:
            lines.append(f"{role or row[0]}:{row[1]}")
        cost += price
    return "".join(audit), lines, cost, q


def damage(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) with faults by a checksum of id and turn; nulls become one space. Rows that
    are dropped stay as gone = true, so that no conversation is lost; repeated rows have two copies."""
    kind = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind")
    )
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def flagged(rows: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, role, text, gone, copies, blank, cut_off, seen): equal rows as one; conv is conv_id as text, a
    space if null; seen: the role and text stand earlier in the conversation."""
    rows = rows.selectExpr("coalesce(cast(conv_id as string), ' ') conv", "conv_id", *(f"if(gone, {none}, {c}) {c}" for c, none in (("turn", "null"), ("role", "''"), ("text", "''"))), "gone", "copies")
    rows = rows.groupBy("conv", "conv_id", "turn", "role", "text", "gone").agg(F.sum("copies").alias("copies"))
    tail = F.rtrim(F.col("text"), F.lit(WHITE))
    rows = rows.withColumns({"blank": tail == "", "cut_off": ~F.substring(tail, -1, 1).isin(*".!?"), "same": F.sha2(F.concat_ws(":", "conv", F.length("role"), F.concat("role", "text")), 256)})
    rows = materialize(rows, "rows")
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    again = rows.where("not gone and not blank").groupBy("same").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    again = materialize(again, "again")
    out = by_key(rows, again, "same", rows.count(), "left").withColumn("seen", F.col("first").isNotNull() & ~F.col("blank") & ~F.col("gone") & (F.col("first") != place))
    return materialize(out.drop("same", "first"), "flagged")


CHUNK = (
    "conv string, conv_id long, part int, seq long, symbols binary, rows array<struct<role:string,text:string>>, n long, first string, last string, "
    "illegal long, blank long, duplicate long, truncated long, low long, high long, turns long"
)
STATS = ["n", "first", "last", "illegal", "blank", "duplicate", "truncated", "low", "high", "turns"]
ILLEGAL_BUT = {"su", "ua", "au"}


def _joined(a: dict | None, b: dict) -> dict:
    """The statistics of two neighbours, a before b."""
    if a is None or not a["n"]:
        return dict(b)
    if not b["n"]:
        return dict(a)
    out = {c: a[c] + b[c] for c in ("n", "illegal", "blank", "duplicate", "truncated", "turns")}
    out |= {"first": a["first"], "last": b["last"]}
    out["illegal"] += a["last"] + b["first"] not in ILLEGAL_BUT
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    out["low"], out["high"] = (b["low"] if a["low"] is None else a["low"]), (a["high"] if b["high"] is None else b["high"])
    return out


def _row_stats(row: dict) -> dict:
    n, initial, turn = row["copies"], row["role"][:1], row["turn"]
    first = "blank" if row["blank"] else "duplicate" if row["seen"] else "truncated" if row["cut_off"] else None
    out = dict.fromkeys(("blank", "duplicate", "truncated"), 0) | {"n": n, "first": initial, "last": initial, "illegal": n - 1, "low": turn, "high": turn, "turns": int(turn is not None)}
    if first in ("blank", "duplicate"):
        out[first] = n
    else:
        out |= {"duplicate": n - 1, "truncated": int(first == "truncated")}
    return out


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of sorted rows: one or more for each conversation of the task."""
    part, open_, seq, size, out = TaskContext.get().partitionId(), None, 0, 0, []
    schema = pa.schema([("conv", pa.string()), ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("symbols", pa.binary()), ("rows", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), *((c, pa.string() if c in ("first", "last") else pa.int64()) for c in STATS)])
    nothing = dict.fromkeys(STATS, 0) | dict.fromkeys(("first", "last", "low", "high"))
    held = 0
    for batch in batches:
        for row in batch.to_pylist():
            if open_ is None or open_["conv"] != row["conv"] or len(open_["symbols"]) >= CHUNK_ROWS or size >= CHUNK_BYTES:
                seq = seq + 1 if open_ and open_["conv"] == row["conv"] else 0
                if held >= 1 << 22 or len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out[:-1], schema)
                    out, held = out[-1:], size
                open_, size = {"conv": row["conv"], "conv_id": row["conv_id"], "part": part, "seq": seq, "symbols": bytearray(), "rows": []} | nothing, 0
                out.append(open_)
            if row["gone"]:
                continue
            open_ |= _joined(open_, _row_stats(row))
            goes = row["blank"] or row["seen"]
            open_["symbols"] += bytes([GONE if goes else symbol(row["role"][:1], row["cut_off"])]) + bytes([GONE]) * (row["copies"] - 1)
            if not goes:
                open_["rows"].append({"role": row["role"], "text": row["text"]})
                size += len(row["text"])
                held += len(row["text"])
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def entering(steps: DataFrame, start: int, back: bool) -> DataFrame:
    """(conv, part, seq, state): the state that enters each chunk of a conversation, which begins with `start`; a chunk maps
    state i to step[i]. Chunks come by part and seq, or the other way round (back). A task holds the chunks that one
    task of the sort made for a conversation, or one row for each of those tasks."""

    def folded(pdf):
        pdf = pdf.sort_values("seq", ascending=not back)
        step = functools.reduce(lambda done, nxt: np.asarray(nxt)[done], pdf["step"], np.arange(len(pdf["step"].iloc[0])))
        return pdf.iloc[:1][["conv", "part"]].assign(step=[step.tolist()])

    def walked(pdf, by: str, first: int):
        pdf = pdf.sort_values(by, ascending=not back)
        states = [*itertools.accumulate(pdf["step"], lambda q, step: int(step[q]), initial=first)][:-1]
        return pdf.drop(columns="step").assign(state=states)

    parts = steps.groupBy("conv", "part").applyInPandas(folded, "conv string, part int, step array<int>")
    heads = parts.groupBy("conv").applyInPandas(lambda pdf: walked(pdf, "part", start), "conv string, part int, state int")
    both = steps.join(heads.withColumnRenamed("state", "head"), ["conv", "part"])
    inner = lambda pdf: walked(pdf.drop(columns="head"), "seq", int(pdf["head"].iloc[0]))
    return both.groupBy("conv", "part").applyInPandas(inner, "conv string, part int, seq long, state int")


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Chunks with the vector behind them and the state before them, as their edits."""
    for batch in batches:
        for row in batch.to_pylist():
            audit, lines, cost, q = repaired(row["symbols"], [(r["role"], r["text"]) for r in row["rows"]], row["vector"], row["state"])
            yield row | {"audit": audit, "lines": lines, "cost": cost, "state": q}


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its chunks in order."""
    schema = pa.schema([(c.split()[0], pa.int64() if c.split()[1] == "long" else pa.string()) for c in RESULT.split(", ")])
    out = []
    for _, own in itertools.groupby(solved(batches), lambda row: row["conv"]):
        stats, audit, cost, digest, lead = None, [], 0, hashlib.sha256(), ""
        for row in own:
            stats = _joined(stats, {c: row[c] for c in STATS})
            audit.append(row["audit"])
            cost += row["cost"]
            for line in row["lines"]:
                digest.update((lead + line).encode())
                lead = "\n"
        for role in tables().finish[row["state"]]:
            digest.update(f"{lead}{role}:".encode())
            lead, cost = "\n", cost + INSERT
            audit.append("I")
        gaps = 0 if stats["low"] is None else stats["high"] - stats["low"] + 1 - stats["turns"]
        out.append({"conv_id": row["conv_id"], "gaps": gaps, "cost": cost, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()} | {c: stats[c] for c in ("blank", "duplicate", "truncated", "illegal")})
        if len(out) == 1000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each conversation.

    rows(conv_id, turn, role, text, gone, copies): role and text not null; gone rows count for nothing but name their
    conversation. Other columns are not read. Rows come by turn, null turns first; those of one turn by role and text, so
    repeated rows are neighbours. A null conv_id is a conversation of its own. A role without an initial can't be kept, only
    renamed. A conversation without rows has zeros, an empty audit and the hash of the empty string; an empty table
    gives an empty result.
    """
    ready = flagged(rows)
    # long texts don't go to the driver as samples: the order by their beginnings holds for whole texts, too
    ranged = ready.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    cut = materialize(map_arrow(ranged, chunks, CHUNK), "chunks")
    discard(ready)
    many = materialize(cut.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1"), "many")
    alone = cut.withColumns({"vector": F.lit(0), "state": F.lit(START)})
    if not many.limit(1).count():
        return map_arrow(alone, joined, RESULT)
    dealt = materialize(by_key(cut, many.withColumn("pieces", F.lit(True)), "conv", cut.count(), "left"), "dealt")
    pieces, key = dealt.where("pieces").drop("pieces"), ["conv", "part", "seq"]

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = [before(s, np.arange(len(tables().vectors))).tolist() for s in batch.column("symbols").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key), pa.array(steps, pa.list_(pa.int32()))], [*key, "step"])

    def forth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = [[[q, *(e[-1] for e in edits(s, v, q))][-1] for q in range(4)] for s, v in zip(batch.column("symbols").to_pylist(), batch.column("vector").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key), pa.array(steps, pa.list_(pa.int32()))], [*key, "step"])

    step = "conv string, part int, seq long, step array<int>"
    vectors = materialize(entering(materialize(pieces.select(*key, "symbols").mapInArrow(back, step), "back"), 0, True).withColumnRenamed("state", "vector"), "vectors")
    known = pieces.select(*key, "symbols").join(vectors, key)
    states = materialize(entering(materialize(known.mapInArrow(forth, step), "forth"), START, False), "states")
    pieces = pieces.join(vectors, key).join(states, key).repartition("conv").sortWithinPartitions(*key)
    single = dealt.where("pieces is null").drop("pieces").withColumns({"vector": F.lit(0), "state": F.lit(START)})
    return map_arrow(single, joined, RESULT).unionByName(map_arrow(pieces, joined, RESULT))
