"""Cases that once were lost: wasted bits and unset checksums of FLAC, ids that stood for null, links of all forms, altered numbers in copies."""

import hashlib
import random
import re

import duckdb
import pytest

pytest.importorskip("samplegrid.llm")

import numpy as np

from samplegrid.llm import chat, decontam, flac, queries, urls

SF = "/root/testdata/sf0.001"


def test_flac_wasted_bits():
    """Verbatim and fixed subframes whose samples leave two low bits out, by hand."""
    samples = [4 * v for v in (3, -5, 7, 0, 31, -32, 1, 1, 2, -3, 9, 9, 8, -8, 12, 5)]
    verbatim = "0" + "000001" + "1" + "01" + "".join(f"{s // 4 & 63:06b}" for s in samples)
    residual = [b // 4 - a // 4 for a, b in zip(samples, samples[1:], strict=False)]
    codes = "".join("0" * (f >> 3) + "1" + f"{f & 7:03b}" for f in (2 * r if r >= 0 else -2 * r - 1 for r in residual))
    fixed = "0" + "001001" + "1" + "01" + f"{samples[0] // 4 & 63:06b}" + "00" + "0000" + "0011" + codes
    for bits in (verbatim, fixed):
        bits += "0" * (-len(bits) % 8)
        frame = flac.with_crc16([flac.frame_header(0, 16) + int(bits, 2).to_bytes(len(bits) // 8, "big")])[0]
        out, size = flac.decode_frames(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))
        assert out[0].tolist() == samples and size[0] == 16
    none_left = "0" + "000001" + "1" + "00000001" + "0" * 16
    frame = flac.with_crc16([flac.frame_header(0, 16) + int(none_left, 2).to_bytes(len(none_left) // 8, "big")])[0]
    with pytest.raises(ValueError, match="no bits"):
        flac.decode_frames(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))


def test_flac_unset_md5():
    stream = flac.encode([b"some payload" * 100])[0]
    md5 = flac.read_stream(stream)[1]
    at = stream.index(md5)
    assert flac.decode([stream[:at] + bytes(16) + stream[at + 16 :]]) == [b"some payload" * 100]
    with pytest.raises(ValueError, match="MD5"):
        flac.decode([stream[:at] + b"\1" * 16 + stream[at + 16 :]])


def test_chat_keeps_every_id_apart_from_null(spark):
    ids = [None, -(2**62), 0, -(2**63), 2**63 - 1]
    rows = spark.createDataFrame([(c, t, r, f"{c} {t}") for c in ids for t, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    out = chat.parse(chat.format_conversations(chat.linear_tree(rows))).collect()
    assert sorted((r.conv_id for r in out), key=repr) == sorted(ids, key=repr)
    assert {r.conv_id: [t.text for t in r.turns] for r in out} == {c: [f"{c} 0", f"{c} 1"] for c in ids}


def test_urls_links_of_all_forms(spark):
    rows = [
        ("http://a.org/x", "<link rel=\"alternate canonical\" href=\"http://b.org/it's\">"),
        ("http://c.org/x", "<link rel=canonicals href='http://b.org/no'><!-- <link rel=canonical href=http://b.org/no2> --><link href='/y' rel='Canonical'>"),
        ("http://d.org/x/y", '<base href="/en/"><link rel="canonical" href="z">'),
        ("http://e.org/x", '<link rel="canonical" title="a > b" href="http://b.org/q?a=1&amp;b=\'2\'"><!-- open <link rel=canonical href=/no>'),
        ("http://f.org/x", "<meta http-equiv='refresh' content=\"3; url='http://b.org/f'\"><meta name=refresh content='0; url=/no'><link rel=canonical href=''>"),
        ("http://g.org/x", '<base href="http://h.org/deep/"><meta http-equiv=refresh content="0;URL=one"><link data-href="/no" rel="canonical" href=" two ">'),
    ]
    got = {(r.a, r.b) for r in urls.alias_edges(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got == {
        ("a.org/x", "b.org/it's"), ("c.org/x", "c.org/y"), ("d.org/x/y", "d.org/en/z"), ("e.org/x", "b.org/q?a=1&b='2'"), ("f.org/x", "b.org/f"), ("g.org/x", "h.org/deep/one"), ("g.org/x", "h.org/deep/two"),
    }


def test_decontamination_with_one_altered_number(spark):
    """A number that stands twice in the item and once differs in the copy takes its windows away, not the copy."""
    rng = random.Random(1)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n))
    item = f"{words(3)} 120 {words(30)} 120 {words(4)}"
    docs = [item, item[::-1].replace("021", "99", 1)[::-1], item.replace("120", "99")]
    cols = "doc_id long, text string, at int, torn int, m int"
    out = decontam.contamination(spark.createDataFrame([(i, t, 0, 0, 0) for i, t in enumerate(docs)], cols), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r.doc_id: (r.matched, r.windows, r.exact) for r in out} == {0: (32, 32, True), 1: (32 - 4 - 5, 32, False), 2: (32, 32, False)}


def brute_leaks(docs, items, coverage=0.5):
    """Typed tokens, windows, diagonals and slots in plain Python."""
    units = set(decontam.UNITS)

    def typed(text):
        raw = re.findall(r"[^\W\d_]+|[0-9]+(?:[.,][0-9]+)*|[.!?:\n]+", text)
        out = []
        for i, t in enumerate(raw):
            before = raw[i - 1] if i else ""
            if t[0] in "0123456789":
                out.append(("#number", t))
            elif re.match(r"[.!?:\n]", t):
                continue
            elif before[:1].isdigit() and t.lower() in units:
                out.append(("#unit", t.lower()))
            elif i and t != t.lower() and len(t) > 2 and t[0] != t[0].lower() and t[1] != t[1].upper() and not re.match(r"[.!?:\n]", before):
                out.append(("#name", t.lower()))
            else:
                out.append((t.lower(), t.lower()))
        return out

    found = set()
    for i, item in items:
        b = typed(item)
        n = min(len(b), decontam.WINDOW)
        if n < decontam.LEAST:
            continue
        total = len(b) - n + 1
        places = {}
        for p in range(total):
            places.setdefault(tuple(c for c, _ in b[p : p + n]), []).append(p)
        for d, doc in docs:
            s = typed(doc)
            by = {}
            for q in range(len(s) - n + 1):
                for p in places.get(tuple(c for c, _ in s[q : q + n]), ()):
                    by.setdefault(q - p, set()).add(p)
            held = set()
            for off, at in by.items():
                slots = {q: (b[q][0], b[q][1], s[q + off][1]) for p in at for q in range(p, p + n) if b[q][0][0] == "#"}
                alike = {q: sum(v == w for w in slots.values()) for q, v in slots.items()}
                torn = {q for q, v in slots.items() if any(w[0] == v[0] and (w[1] == v[1]) != (w[2] == v[2]) and alike[r] >= alike[q] for r, w in slots.items())}
                at = {p for p in at if not any(p <= q < p + n for q in torn)}
                if n == decontam.WINDOW or (at and all(v[1] == v[2] for v in slots.values()) and not torn):
                    held |= at
            if held and len(held) >= coverage * total:
                found.add((d, i))
    return found


def test_decontamination_equals_brute_force(spark):
    """All of the small tables, and 200 copies with other numbers, names and units, torn, shortened or mixed."""
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    got = {(r.doc_id, r.item_id) for r in queries.op4_decontamination(spark, SF).collect()}
    assert got == brute_leaks(docs, items)
    rng = random.Random(3)
    own = [
        (1, "A train leaves London at 9 with 120 passengers and reaches Paris after 3 hours, how many miles did 120 passengers travel"),
        (2, "Anna buys 4 kg of apples for 12 euros. Ben buys 7 kg of pears for 21 euros. How much did Anna pay for 1 kg?"),
        (3, "water boils at 100 degrees"), (4, "Name the capital of France."), (5, "the mass of 5 g of gold, of 5 g of lead and of 9 g of salt is weighed by Clara and by Clara again in 20 minutes"),
    ]
    made = []
    for k in range(200):
        text = own[k % len(own)][1]
        for _ in range(rng.randint(0, 4)):
            tokens = re.findall(r"\w+|\W+", text)
            spots = [i for i, t in enumerate(tokens) if t.isdigit() or t.istitle()]
            i = rng.choice(spots)
            new = str(rng.randint(1, 150)) if tokens[i].isdigit() else rng.choice(["Rome", "Oslo", "Dora", "Emil"])
            text = "".join(new if (t == tokens[i] if rng.random() < 0.7 else j == i) else t for j, t in enumerate(tokens))
        if rng.random() < 0.3:
            text = text[: rng.randint(10, len(text))]
        made.append((k, f"so {text} and so on" if rng.random() < 0.5 else text))
    cols = "doc_id long, text string"
    got = {(r.doc_id, r.item_id) for r in decontam.contamination(spark.createDataFrame(made, cols), spark.createDataFrame(own, "item_id long, text string")).collect()}
    want = brute_leaks(made, own)
    assert got == want and len(want) > 60


def test_hashes_of_feature_rows_are_stable(spark):
    """Equal texts have equal values in op8's columns."""
    rows = {}
    for r in queries.op8_flac(spark, SF).collect():
        rows.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.feature, r.tail_crc32, r.media_bytes))
    assert all(len(v) == 1 for v in rows.values()) and hashlib.sha256(bytes(64)).hexdigest() not in rows
