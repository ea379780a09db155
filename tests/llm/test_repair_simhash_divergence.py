"""Conversation repair, SimHash and source divergence against brute force and SQL, with nulls, ties, repeats, hot keys and empty tables."""

import collections
import functools
import hashlib
import itertools
import random
import re

import duckdb
import pytest

pytest.importorskip("samplegrid.llm")

import numpy as np
import xxhash
from pyspark.sql import functions as F

from samplegrid.llm import divergence, queries, repair, simhash

SF = "/root/testdata/sf0.001"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def matches_sql(df, name, folder=SF, tables=None):
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        if tables and t in tables:
            db.register(t, tables[t])
        else:
            db.sql(f"create view {t} as from '{folder}/{t}.parquet'")
    want = db.sql(queries.ORACLE[name])
    key = lambda r: tuple(map(repr, r))
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want.fetchall(), key=key)


# repair

GO = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
ROLE = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def brute_repair(rows):
    """rows: (turn, role, text), in order. The best (cost, audit, lines) by a memo over all edits, letters tried as strings."""
    white, seen, faults = " \t\n\x0b\x0c\r", set(), []
    for _, role, text in rows:
        t = text.rstrip(white)
        faults.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else None)
        seen.add((role, text))

    @functools.cache
    def best(i, q, inserts):
        out = []
        if i == len(rows) and q in ("", "a"):
            out.append((0, "", ()))
        if inserts < 4:
            c, a, r = best(i, GO[q, ROLE[q][0]], inserts + 1)
            out.append((c + 3, "I" + a, (ROLE[q] + ":", *r)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, r = best(i + 1, q, 0)
            out.append((c + 4, "D" + a, r))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] else 0
                if (q, role[:1]) in GO:
                    c, a, r = best(i + 1, GO[q, role[:1]], 0)
                    out.append((c + more, "K" + a, (f"{role}:{text}", *r)))
                c, a, r = best(i + 1, GO[q, ROLE[q][0]], 0)
                out.append((c + 3 + more, "R" + a, (f"{ROLE[q]}:{text}", *r)))
        return min(out, default=(10**9, "", ()))

    turns = [t for t, _, _ in rows if t is not None]
    count = collections.Counter(faults)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    c, a, r = best(0, "", 0)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, c, a, sha("\n".join(r)))


def by_turn(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


ROWS = "conv_id long, turn long, role string, text string, gone boolean, copies int, k int, part string, n long"


def repaired(spark, convs):
    rows = [(c, t, r, x, False, 1, 1, "p", 7) for c, own in convs.items() for t, r, x in own]
    return {r.conv_id: tuple(r)[1:] for r in repair.repair(spark.createDataFrame(rows, ROWS)).collect()}


def test_repair_equals_brute_force(spark):
    rng = random.Random(5)
    texts = ["Yes.", "No", "Ok!", "", " \n", "Fine?  ", "Long text without end", "é…"]
    convs = {
        c: [(rng.choice([None, *range(8)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), rng.choice(texts)) for _ in range(rng.randint(1, 9))] for c in [None, *range(250)]
    }
    got = repaired(spark, convs)
    for c, rows in convs.items():
        assert got[c] == brute_repair(by_turn(rows)), (c, by_turn(rows))


def test_repair_of_a_long_conversation(spark):
    """One conversation of many chunks and tasks, with a repeated row and a very long text, beside short ones."""
    rng = random.Random(8)
    long_ = [(t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", "no", "", f"text {t}.", f"open {t}"])) for t in range(6000)]
    long_ += [(7, "user", "again.")] * 3000 + [(9, "user", "word. " * 100_000)]
    got = repaired(spark, {1: long_, 2: [(0, "user", "a."), (1, "assistant", "b.")]})
    rows = by_turn(long_)
    # the same by a plain table of least costs from the end
    white, seen, faults = " \t\n\x0b\x0c\r", set(), []
    for _, role, text in rows:
        t = text.rstrip(white)
        faults.append(2 if not t or (role, text) in seen else 1 if t[-1] not in ".!?" else 0)
        seen.add((role, text))
    states, ahead = ["", "s", "u", "a"], {"": 0, "s": 6, "u": 3, "a": 0}
    tables = [ahead]
    for (_, role, _), fault in zip(reversed(rows), reversed(faults), strict=True):
        now = {}
        for q in states:
            now[q] = 4 + ahead[q]
            if fault < 2:
                now[q] = min(now[q], 3 + 3 * fault + ahead[GO[q, ROLE[q][0]]], 3 * fault + ahead[GO[q, role[:1]]] if (q, role[:1]) in GO else 10**9)
        for _ in range(3):
            now = {q: min(now[q], 3 + now[GO[q, ROLE[q][0]]]) for q in states}
        ahead = now
        tables.append(now)
    tables.reverse()
    audit, lines, q, i = [], [], "", 0
    while i < len(rows) or q not in ("", "a"):
        now, to = tables[i][q], GO[q, ROLE[q][0]]
        if i < len(rows) and now == 4 + tables[i + 1][q]:
            audit.append("D")
            i += 1
        elif now == 3 + tables[i][to]:
            audit.append("I")
            lines.append(ROLE[q] + ":")
            q = to
        else:
            role, text = rows[i][1:]
            kept = (q, role[:1]) in GO and now == 3 * faults[i] + tables[i + 1][GO[q, role[:1]]]
            audit.append("K" if kept else "R")
            lines.append(f"{role if kept else ROLE[q]}:{text}")
            q, i = GO[q, role[:1]] if kept else to, i + 1
    assert got[1][5:] == (tables[0][""], "".join(audit), sha("\n".join(lines)))
    assert got[2] == (0, 0, 0, 0, 0, 0, "KK", sha("user:a.\nassistant:b."))


def test_repair_query(spark):
    matches_sql(queries.op11_repair(spark, SF), "op11_repair")
    matches_sql(queries.op11_repair(spark, SF.replace("0.001", "0.01")), "op11_repair", SF.replace("0.001", "0.01"))


def test_repair_nulls_and_conversations_without_rows(spark):
    rows = [(c, t, r, x) for c in (None, *range(40)) for t, r, x in ((0, "user", None), (None, None, "a."), (3, "user", "a."), (3, "user", "a."))] + [(77, t, "user", "x.") for t in range(3)]
    gone = [t for t in range(3000) if __import__("zlib").crc32(f"78:{t}".encode()) % 20 == 0][:2]
    rows += [(78, t, "user", "x") for t in gone]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = repair.repair(repair.damage(df))
    matches_sql(out, "op11_repair", tables={"conversations": df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"})})
    assert tuple(out.where("conv_id = 78").first())[1:] == (0, 0, 0, 0, 0, 0, "", sha(""))
    assert repair.repair(repair.damage(df.limit(0))).count() == 0


def test_repair_tables():
    t = repair.tables()
    assert 10 < len(t.vectors) < 200 and t.block.shape == (len(t.vectors), 9**repair.BLOCK)
    symbols = bytes(random.Random(1).choices(range(9), k=50))
    for v in range(len(t.vectors)):
        w = v
        for s in reversed(symbols):
            w = t.step[w][s]
        assert repair.before(symbols, v) == w


# SimHash


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, most=3):
    """doc_id -> (fingerprint, least doc_id reachable), over all pairs of fingerprints."""
    fp = {}
    for d, t in rows:
        fp.setdefault(brute_fingerprint(t), []).append(d)
    values = np.array(list(fp), np.uint64)
    label = np.arange(len(values))
    for i in range(len(values)):
        near = np.flatnonzero(np.bitwise_count(values ^ values[i]) <= most)
        label[np.isin(label, label[near])] = label[i]
    least = {}
    for k, v in zip(label, fp.values(), strict=True):
        least[k] = min([x for x in (*v, least.get(k)) if x is not None], default=None)
    return sorted(((d, f"{x:016x}", least[k]) for k, (x, v) in zip(label, fp.items(), strict=True) for d in v), key=repr)


DOCS = "doc_id long, text string, lang string, source string, fp long, n int, key string, part int"


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, None, "s", 5, 1, "k", 2) for d, t in rows], DOCS)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def near_texts(rng, n, words=400, changes=4):
    base = [f"w{rng.randrange(3000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randint(0, changes)):
            t[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_simhash_fingerprints(spark):
    odd = [None, "", " \n\t", "a", "One two", "ONE  two\tthree four\x0bFIVE", "ß Σ ü \x1c x\xa0y", "word " * 3000, "é" * 5000, "Ab " * 2_000_000]
    rows = list(enumerate(odd))
    got = dict(simhash.fingerprints(docs_of(spark, rows)).collect())
    assert {d: x % 2**64 for d, x in got.items()} == {d: brute_fingerprint(t) for d, t in rows}
    text = " ".join(f"w{i}" for i in range(50))
    spark_hash = {r[0] % 2**64 for r in spark.createDataFrame([(" ".join(f"w{j}" for j in range(i, i + 3)),) for i in range(48)], "s string").select(F.xxhash64("s")).collect()}
    assert spark_hash == {int(x) for part in simhash.shingle_hashes(text.encode()) for x in part}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(simhash.words_of, "__defaults__", (37,))
        assert {int(x) for part in simhash.shingle_hashes(text.encode()) for x in part} == spark_hash


@pytest.mark.parametrize("hot", [False, True])
def test_simhash_equals_brute_force(spark, monkeypatch, hot):
    rng = random.Random(3)
    texts = [t for n in (60, 30, 1, 1, 5) for t in near_texts(rng, n)] + near_texts(rng, 300, 3000, 2) + ["copy of a text"] * 40 + [None, "", "  "]
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[100]), (None, "alone here without an id")]
    if hot:
        monkeypatch.setattr(simhash, "BLOCK", 20)
    got = found(simhash.near_duplicates(docs_of(spark, rows)))
    assert got == brute_components(rows)
    assert len({c for _, _, c in got}) < len(got) - 100


def test_simhash_query(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert found(queries.op12_simhash(spark, SF)) == brute_components(rows)


def test_simhash_small_tables(spark):
    assert found(simhash.near_duplicates(docs_of(spark, []))) == []
    assert found(simhash.near_duplicates(docs_of(spark, [(4, "a b c d")]))) == brute_components([(4, "a b c d")])
    assert found(simhash.near_duplicates(docs_of(spark, [(4, ""), (2, None), (9, "")]))) == [(2, "0" * 16, 2), (4, "0" * 16, 2), (9, "0" * 16, 2)]


def test_simhash_thresholds_find_every_pair():
    """Unequal thresholds keep the sum of the general principle, avoid crowded values, and catch each pair at 3 bits."""
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 2**63, 4000, np.uint64) * np.uint64(2) | rng.integers(0, 2, 4000).astype(np.uint64)
    fp[:2000] = fp[:2000] & ~np.uint64(0xFFFF) | np.uint64(7)  # half of all share their lowest 16 bits
    groups = np.arange(64).reshape(4, 16)
    values = simhash.gathered(fp, groups)
    for scale in (10, 10**7):
        near = np.stack([simhash.around(np.bincount(v.astype(np.int64), minlength=1 << 16) * scale, 3) for v in values])
        plan, chosen = simhash.thresholds(near, values, 3)
        for k, parts in enumerate(simhash.PLANS):
            used = [simhash.PARTS.index(p) for p in parts]
            assert (chosen[used][:, plan == k].sum(0) == 3 - len(parts) + 1).all()
            assert (chosen[[i for i in range(6) if i not in used]][:, plan == k] == -1).all()
        if scale == 10:
            assert (plan[2000:] == 0).all() and (chosen[0, :2000] == -1).mean() > 0.5
        else:
            assert (plan > 0).all()  # many members: wider parts, a bit off in each
        for i in range(0, 4000, 7):
            other = int(fp[i])
            for b in rng.choice(64, rng.integers(0, 4), replace=False):
                other ^= 1 << int(b)
            off = [bin((int(fp[i]) ^ other) >> 16 * g & 0xFFFF).count("1") for g in range(4)]
            assert any(sum(off[g] for g in part) <= chosen[p, i] for p, part in enumerate(simhash.PARTS))


# divergence


def brute_audit(rows, least=30, top=50):
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, docs, groups = collections.Counter(), collections.Counter(), {(g, s) for _, g, s in rows}
    for text, lang, source in rows:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        counts.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(t for (g, t), n in docs.items() if g == lang and n >= least)
        sources = [s for g, s in groups if g == lang]
        share = lambda own: [1 + 10**9 * (n + 5) // (sum(own) + 5 * len(kept)) for n in own] if kept else []
        own = {s: [counts[lang, s, t] for t in kept] for s in sources}
        p, q = {s: share(own[s]) for s in sources}, share([sum(own[s][i] for s in sources) for i in range(len(kept))])
        for s in sources:
            pairs = [(sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o) for o in sources if o != s]
            terms = [(p[s][i] - q[i], t) for i, t in enumerate(kept) if own[s][i] and p[s][i] > q[i]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for r, (v, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, v, r))
    return sorted(out)


TEXTS = "text string, lang string, source string, doc_id long, term string, n long, p long, tile int"


def test_divergence_equals_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    words = ["The", "the", "a", "straße", "ÉCOLE", "中文没有空格", "exactly8", "ninechars", "sixteen_is_split", "sixteencharacter", "seventeencharacte", "averyveryverylongwordindeedofmanyletters", "b" * 300, "x", "Y2K", "z-z"]
    rows = []
    for i in range(400):
        lang = rng.choice(["en", "en", "de", None])
        rows.append((" ".join(rng.choices(words, k=rng.randint(0, 30))), lang, rng.choice(["s1", "s2", "s3", None, "ü", f"rare{i % 7}"])))
    rows += [(None, "fr", "s1"), ("", "fr", "s2"), ("only one source", "it", "s1"), *[("same row", "en", "s1")] * 40]
    df = spark.createDataFrame([(*r, 1, "t", 2, 3, 4) for r in rows], TEXTS)
    want = brute_audit(rows)
    assert sorted(map(tuple, divergence.audit(df).collect())) == want
    monkeypatch.setattr(divergence, "TILE", 3)
    assert sorted(map(tuple, divergence.audit(df).collect())) == want
    assert divergence.audit(df.limit(0)).count() == 0


def test_divergence_of_a_very_long_text(spark):
    """Texts over CHUNK bytes are cut into pieces, one of them is a single term; each counts once as a document."""
    rows = [("Word other " * 900_000, "en", "a"), ("w" * (9 << 20), "en", "a"), ("word " * 3, "en", "b"), ("other", "en", "b")]
    got = {(r.lang, r.source, r.term): (r.n, r.docs) for r in divergence.partial_counts(spark.createDataFrame(rows, "text string, lang string, source string")).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).collect()}
    assert got == {("en", "a", "word"): (900_000, 1), ("en", "a", "other"): (900_000, 1), ("en", "a", "w" * (9 << 20)): (1, 1), ("en", "b", "word"): (3, 1), ("en", "b", "other"): (1, 1)}


def test_divergence_query(spark):
    matches_sql(queries.op13_divergence(spark, SF), "op13_divergence")


def test_divergence_radix_order():
    rng = np.random.default_rng(2)
    words = [rng.integers(0, 5, 3000, np.uint64) << np.uint64(40), rng.integers(0, 2**63, 3000, np.uint64)]
    assert (divergence.radix_order(words) == np.lexsort(words[::-1])).all()
