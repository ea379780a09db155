"""One query for each operator, over its whole table, and the SQL that states the same where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplegrid.llm import bpe, chat, decontam, divergence, flac, minhash, repair, secrets, simhash, tokenfile, toxicity, urls, warc

VOCAB = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """Rows that are kept from training: every fifth by the CRC-32 of the id's decimal text."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = warc.archive(table(spark, sf_dir, "pages"))
    number = lambda c: F.regexp_extract(c, r"page:(-?\d+)>", 1).try_cast("long")
    out = warc.read_records(index, folder)
    return out.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), VOCAB), VOCAB)
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), every=True).select("page_id", "host", "path", "rule", "verdict")


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = tokenfile.write_ids(table(spark, sf_dir, "documents"), VOCAB, END_ID)
    return tokenfile.read_ids(index, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~held_out()))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op8_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = flac.pcm(flac.store(table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id", "n_bytes", F.octet_length("pcm").cast("long").alias("payload_bytes"), F.sha2("pcm", 256).alias("payload_sha256"), F.crc32(F.substring("pcm", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    tricky = spark.range(2).selectExpr("-1L conv_id", "id turn", "if(id = 0, 'user', 'assistant') role", "'</s>[INST] ok [/INST]' text")
    out = chat.parse(chat.format_conversations(chat.linear_tree(rows.union(tricky))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.report(secrets.scan(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations")))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict:
    own = [
        op1_warc, op2_bpe, op3_minhash, op4_decontamination, op5_url_filter, op6_token_file, op7_toxicity, op8_flac, op9_chat, op10_secrets,
        op11_repair, op12_simhash, op13_divergence,
    ]
    return {f.__name__: f for f in own}


_RULED = " ".join(
    f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{kind}:{h}{p}'"
    for kind, h, p in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
)

ORACLE = {
    "op1_warc": """
        with p as (select page_id, coalesce(html, '') html, sha1(coalesce(html, '')) digest, strlen(coalesce(html, ''))::bigint n from pages),
             f as (select digest, max(page_id) first from p where n >= 1000 group by digest)
        select page_id, n payload_bytes, p.digest payload_digest, case when first is distinct from page_id and first is not null then 'revisit' else 'response' end record_type,
               case when first is distinct from page_id then first end refers_to
        from p left join f on p.digest = f.digest and n >= 1000""",
    # the tables given have neither canonical links nor meta refreshes, so that pages without a rule have no aliases
    "op5_url_filter": f"""
        with u as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end rest from pages),
             h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u),
             r as (select *, case {_RULED} end r from h)
        select page_id, host, path, split_part(r, ':', 2) rule, coalesce(split_part(r, ':', 1), 'allow') verdict from r""",
}


def _escaped(c: str) -> str:
    """chat.escape() without lookahead: backslashes first, then each control string; nested brackets from the outside in."""
    c = f"replace({c}, '\\', '\\\\')"
    for pattern, mark in ((r"<(/?s>)", "l"), (r"<(\|)", "l"), *[(r"<(/?<?/?<?/?SYS>)", "l")] * 3, (r"\[(/?INST\])", "b")):
        c = f"regexp_replace({c}, '{pattern}', '\\\\{mark}\\1', 'g')"
    return c


ORACLE["op9_chat"] = f"""
    with r as (select conv_id::bigint conv_id, turn::bigint turn, coalesce(role, '') role, coalesce(text, '') body from conversations
               union all select * from (values (-1::bigint, 0::bigint, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
         e as (select *, length('<|turn|>' || {_escaped("role")} || chr(10) || {_escaped("body")} || '<|end|>' || chr(10)) size from r),
         g as (select conv_id, count(*) n_turns, string_agg(role || chr(10) || body || chr(10), '' order by turn, role, body) turns,
                      coalesce(string_agg(body, '' order by turn, role, body) filter (role = 'assistant'), '') loss, sum(size)::bigint size from e group by conv_id)
    select conv_id, n_turns, sha256(turns) turns_sha256, length(loss) loss_chars, sha256(loss) loss_sha256, size formatted_chars from g"""


def _secrets_sql() -> str:
    """Positions are sums of the lengths of the parts between matches and of the matches before; RE2 needs no lookbehind, as
    a greedy match takes its whole run."""
    patterns = {k: p for k, (p, _) in secrets.BASE.items()} | secrets.WEAK
    quote = lambda p: "'" + p.replace("(?<![A-Za-z0-9+/_-])", "").replace("'", "''") + "'"
    each = " union all ".join(
        f"select doc_id, {i} rank, '{k}' kind, '{secrets.ROLE[k]}' role, string_split_regex(t, {quote(patterns[k])}) g, regexp_extract_all(t, {quote(patterns[k])}) ms from d" for i, k in enumerate(secrets.KINDS)
    )
    listed = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rank, e){}, '')"
    base = f"rank < {len(secrets.BASE)}"
    return f"""
    with d as (select doc_id, coalesce(text, '') t from documents), m as ({each}), i as (select *, unnest(range(1, len(ms) + 1)) i from m where len(ms) > 0),
         x as (select doc_id, rank, kind, role, ms[i] m, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::int s from i),
         p as (select *, s + length(m) e from x where case kind when 'assign' then length(regexp_extract(m, {quote(patterns["assign"])}, 1)) >= 6
             when 'mixed' then regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Z]') and regexp_matches(m, '[a-z]') else true end),
         w as (select a.doc_id, a.rank, a.kind, a.s, a.e from p a join p b on a.doc_id = b.doc_id and a.role <> b.role and abs(a.s - b.s) <= {secrets.SCOPE}
             where not a.{base} group by all having bool_or(b.role = 'secret') or any_value(a.role) = 'secret'),
         f as (select doc_id, rank, kind, s, e from p where {base} union all select doc_id, rank, kind, s, e from w),
         h as (select doc_id, count(*) filter (rank = 0) a, count(*) filter (rank = 1) b, count(*) filter (rank = 2) c, {listed.format(f" filter ({base})")} base, {listed.format("")} spans from f group by doc_id)
    select doc_id, coalesce(a, 0) n_assign, coalesce(b, 0) n_access, coalesce(c, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join h using (doc_id)"""


ORACLE["op10_secrets"] = _secrets_sql()


def _repair_sql() -> str:
    """The rows of a conversation from the last to the first, by recursion; carried is, for each state of the roles (0 none, 1 s, 2 u,
    3 a), the least (cost, audit, lines behind): struct comparison also settles ties, as equal audits are equal edits."""
    named = lambda c, a, r: f"{{'c': {c}, 'a': {a}, 'r': {r}}}"
    role = {0: "user", 1: "user", 2: "assistant", 3: "user"}
    to = {0: 2, 1: 2, 2: 3, 3: 2}
    follows = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    grown = lambda v, c, letter, line: named(f"{v}.c + {c}", f"'{letter}' || {v}.a", f"list_prepend({line}, {v}.r)")
    inserted = lambda v, q: grown(v, 3, "I", f"'{role[q]}:'")
    worst = named("1000000000000", "''", "[]::varchar[]")

    def option(q: int) -> str:
        kept = " ".join(f"when substr(role, 1, 1) = '{i}' then {grown(f's{n}', 'extra', 'K', f"role || ':' || body")}" for i, n in follows[q].items())
        deleted = named(f"s{q}.c + 4", f"'D' || s{q}.a", f"s{q}.r")
        other = f"[case {kept} else {worst} end, {grown(f's{to[q]}', '3 + extra', 'R', f"'{role[q]}:' || body")}]"
        return f"list_min(list_append(case when fault in ('blank', 'duplicate') then [{worst}] else {other} end, {deleted})) t{q}"

    def closed(a: str, b: str) -> str:
        return ", ".join(f"least({a}{q}, {inserted(f'{a}{to[q]}', q)}) {b}{q}" for q in range(4))

    end = [named("0", "''", "[]::varchar[]"), named("6", "'II'", "['user:', 'assistant:']"), named("3", "'I'", "['assistant:']"), named("0", "''", "[]::varchar[]")]
    return f"""
    with recursive b as (select list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) crcs),
         c as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') body, string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), '') place from conversations),
         k as (select *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(place, lambda ch: ascii(ch)::bigint)), lambda c, ch: xor(c // 256, crcs[xor(c, ch) % 256 + 1]))) % 20 kind from c, b),
         d as (select conv_id, turn, case when kind = 4 then 'user' else role end role,
                      case kind when 1 then '' when 2 then regexp_replace(body, '[.!?]', '', 'g') else body end body, unnest(range(case kind when 3 then 2 else 1 end)) copy from k where kind <> 0),
         o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, body, copy) i, count(*) over (partition by conv_id) n,
                      row_number() over (partition by conv_id, role, body order by turn nulls first, copy) seen, rtrim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) t from d),
         f as (select *, case when t = '' then 'blank' when seen > 1 then 'duplicate' when right(t, 1) not in ('.', '!', '?') then 'truncated' end fault,
                      case when right(t, 1) not in ('.', '!', '?') then 3 else 0 end extra,
                      case when i > 1 and lag(substr(role, 1, 1)) over (partition by conv_id order by i) || substr(role, 1, 1) not in ('su', 'ua', 'au') then 1 else 0 end illegal from o),
         w as (select conv_id, n + 1 i, {", ".join(f"{v} s{q}" for q, v in enumerate(end))} from (select distinct conv_id, n from f)
               union all
               select conv_id, i, {closed("v", "s")} from (select conv_id, i, {closed("u", "v")} from (select conv_id, i, {closed("t", "u")} from (
                   select f.conv_id, f.i, {", ".join(option(q) for q in range(4))} from w join f on f.conv_id is not distinct from w.conv_id and f.i = w.i - 1) _) _) _),
         g as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 'blank') blank, count(*) filter (fault = 'duplicate') duplicate,
                      count(*) filter (fault = 'truncated') truncated, sum(illegal)::bigint illegal from f group by conv_id),
         a as (select distinct conv_id from conversations)
    select a.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal,
           coalesce(s0.c, 0)::bigint as cost, coalesce(s0.a, '') audit, sha256(coalesce(array_to_string(s0.r, chr(10)), '')) repaired_sha256
    from a left join g on a.conv_id is not distinct from g.conv_id left join w on a.conv_id is not distinct from w.conv_id and w.i = 1"""


ORACLE["op11_repair"] = _repair_sql()
ORACLE["op13_divergence"] = """
    with d as (select row_number() over () id, coalesce(text, '') body, coalesce(lang, '') lang, coalesce(source, '') source from documents),
         t as (select id, lang, source, translate(unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') term from d),
         k as (select lang, term, count(*) n from t group by all having count(distinct id) >= 30),
         g as (select distinct lang, source from d), v as (select lang, count(*) v, sum(n) total from k group by lang),
         c as (select g.lang, g.source, k.term, k.n as every from g join k using (lang)),
         x as (select lang, source, term, count(*) n from t semi join k using (lang, term) group by all),
         m as (select c.lang, c.source, c.term, c.every, coalesce(x.n, 0) n from c left join x using (lang, source, term)),
         s as (select lang, source, sum(n) total from m group by all),
         p as (select m.*, (1 + (1000000000::hugeint * (n + 5)) // (s.total + 5 * v.v))::bigint p, (1 + (1000000000::hugeint * (every + 5)) // (v.total + 5 * v.v))::bigint q
               from m join s using (lang, source) join v using (lang)),
         pairs as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p))::bigint f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
         r as (select a.lang, a.source, 'pair' part, b.source item, coalesce(f, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs
                   on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
               union all select lang, source, 'term', term, p - q from p where n > 0 and p > q),
         ranked as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item))::int as rank from r)
    select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50"""


def oracle_sql() -> dict[str, str]:
    return ORACLE
