"""Benchmark decontamination by template windows, in DataFrame functions only.

Numbers, names and units of a text become typed placeholders. Windows of WINDOW such tokens are hashed and joined with
the windows of the benchmark. A document is contaminated by an item if it holds at least half of the item's windows in
copies whose slot values map one to one to the item's: where two slots contradict each other, the less frequent mapping (or both, if
equally frequent) is taken as altered, and the windows that hold it don't count. So a question with other numbers or names is caught, and
one whose numbers contradict each other throughout is not. Items of LEAST to WINDOW - 1 tokens are one window and need equal slot values;
shorter ones match nothing, as they name no question. A name at the start of a sentence is a plain word.

A pair is nominated by the rarest windows of the item, just so many that half of its windows can't be found without one of
them; only nominated pairs meet all windows. So a passage that many documents and items share makes no rows for each
document and item that hold it, unless it is most of the item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from samplegrid.llm.common import materialize, small

WINDOW, LEAST = 8, 4
COVERAGE = 0.5
#: Windows of the benchmark up to which they are broadcast (24 bytes each); beyond it the join shuffles.
BROADCAST_WINDOWS = 1_000_000

#: Words that count as units after a number.
UNITS = (
    "mm cm m km in inch inches ft feet yard yards mile miles mg g kg t lb lbs oz ml l liter liters litre litres s sec second seconds min minute minutes "
    "h hour hours day days week weeks month months year years usd eur dollar dollars euro euros cent cents percent mph kmh"
).split()

#: Words, numbers, and the ends of sentences.
TOKEN = r"[\p{L}\p{M}]+|[0-9]+(?:[.,][0-9]+)*|[.!?:\n]+"


def _typed(tokens: str) -> str:
    """SQL: each token as (canonical string, slot type or '', raw token); ends of sentences become null.

    A number is a token that begins with a digit; a unit is a listed word after a number; a name is a capitalised word of any
    script (not one all in capitals) of three or more letters after a word or number in the same sentence."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    return f"""transform({tokens}, (t, i) -> case
        when t < ':' and t >= '0' then '#number'
        when t rlike '^[.!?:\\n]' then null
        when i > 0 and get({tokens}, i - 1) between '0' and ':' and lower(t) in ({units}) then '#unit'
        when i > 0 and t <> lower(t) and length(t) > 2 and left(t, 1) <> lower(left(t, 1)) and substring(t, 2, 1) <> upper(substring(t, 2, 1))
            and not get({tokens}, i - 1) rlike '^[.!?:\\n]' then '#name'
        else lower(t) end)"""


def windows(df: DataFrame, keys: list[str], text: str, sizes: tuple[int, ...] = (WINDOW,), whole: bool = False) -> DataFrame:
    """(keys, pos, h): the hash of each window of n typed tokens, for each n of `sizes`; a null text has none. whole: with n
    the number of tokens if that is less than WINDOW, LEAST at least; and a column n."""
    # arrays are bound by lambdas, so that each is made once per text and not once per token
    hashed = f"filter(transform({_typed('tokens')}, t -> xxhash64(t)), h -> h <> 42)"  # xxhash64(null) is its seed, 42
    cut = lambda n: f"if(size(h) < greatest({n}, {LEAST}), array(), transform(sequence(0, size(h) - {n}), i -> struct(i as pos, xxhash64(slice(h, i + 1, {n})) as h, {n} as n)))"
    each = cut(f"least(size(h), {WINDOW})") if whole else f"concat({', '.join(map(cut, sizes))})"
    bound = f"transform(transform(array(regexp_extract_all({text}, r'{TOKEN}', 0)), tokens -> {hashed}), h -> {each})[0]"
    return df.where(F.col(text).isNotNull()).selectExpr(*keys, f"inline({bound})").select(*keys, "pos", "h", *(["n"] if whole else []))


def slots(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, slots array<struct<type, raw>>): one entry for each token that windows() counts, '' as type of plain words."""
    typed = f"zip_with({_typed('tokens')}, tokens, (c, r) -> named_struct('c', c, 'raw', r))"
    kept = "transform(filter(z, x -> x.c is not null), x -> named_struct('type', if(x.c like '#%', x.c, ''), 'raw', lower(x.raw)))"
    return df.selectExpr(*keys, f"transform(transform(array(regexp_extract_all({text}, r'{TOKEN}', 0)), tokens -> {typed}), z -> {kept})[0] slots")


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, matched, windows, coverage, slots, exact) of each pair of a document and an item that it leaks.

    exact: all slot values are equal too. Null texts, null ids and items under LEAST tokens match nothing. Rows that repeat
    a doc_id count as one document, rows that repeat an item_id as one item; each of their texts is compared by itself, and
    the pair has the figures of the best one. Other columns are not read; empty tables give no rows.

    If the benchmark has more than BROADCAST_WINDOWS windows, the join with it is a shuffle, whose hot windows Spark splits
    (adaptive skew join).
    """
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text").where("doc_id is not null and text is not null").withColumn("th", F.xxhash64("text"))
    items = benchmark.selectExpr("cast(item_id as long) item_id", "text item_text").where("item_id is not null and item_text is not null").distinct()
    items = items.withColumn("ih", F.xxhash64("item_text"))
    item, doc = ["item_id", "ih"], ["doc_id", "th"]
    theirs = materialize(windows(items, item, "item_text", whole=True).withColumnRenamed("pos", "bpos"), "items")
    total = theirs.groupBy(*item, "n").agg(F.count("*").alias("windows"))
    # the rarest windows of each item, by the number of items that have them
    common = theirs.select("h", *item).distinct().groupBy("h").agg(F.count("*").alias("items"))
    rarest = Window.partitionBy(*item).orderBy("items", "h", "bpos")
    rare = theirs.join(common, "h").withColumn("rank", F.row_number().over(rarest)).join(total.drop("n"), item)
    rare = materialize(rare.where(F.col("rank") <= F.col("windows") - F.ceil(coverage * F.col("windows")) + 1).select("h", *item).distinct(), "rare")
    sizes = tuple(sorted(r.n for r in theirs.select("n").distinct().collect()))  # of 4 to 8
    if not sizes:
        return docs.limit(0).selectExpr("doc_id", "doc_id item_id", "0L matched", "0L windows", "0D coverage", "0 slots", "false exact")
    nominated = windows(docs, doc, "text", sizes).join(small(rare, BROADCAST_WINDOWS), "h").select(*doc, *item).distinct()
    nominated = materialize(nominated, "nominated")
    # all windows of the nominated pairs
    concerned = docs.join(small(nominated.select("doc_id").distinct()), "doc_id", "left_semi")
    wanted = nominated.join(theirs, item)
    hits = windows(concerned, doc, "text", sizes).distinct().join(wanted, [*doc, "h"]).select(*doc, *item, "n", "pos", "bpos")
    hits = materialize(hits, "hits")
    enough = hits.groupBy(*doc, *item).agg(F.countDistinct("bpos").alias("matched")).join(total, item)
    enough = materialize(enough.where(F.col("matched") >= coverage * F.col("windows")).drop("matched", "n"), "enough")
    # slot values of the documents and items concerned
    ours = slots(concerned.join(small(enough.select(*doc).distinct()), doc, "left_semi"), doc, "text").dropDuplicates(doc)
    theirs = slots(items, item, "item_text")
    # a copy of an item lies on one diagonal pos - bpos; each is judged by itself
    copies = hits.join(enough, [*doc, *item])
    copies = copies.groupBy(*doc, *item, "windows", "n", (F.col("pos") - F.col("bpos")).alias("d")).agg(F.collect_set("bpos").alias("at"))
    copies = copies.join(ours.withColumnRenamed("slots", "s"), doc).join(theirs.withColumnRenamed("slots", "b"), item)
    # (place, type, theirs, ours) of every slot under a matched window, and in how many of them it is mapped alike
    place = "array_distinct(flatten(transform(at, p -> sequence(p, p + n - 1))))"
    copies = copies.selectExpr(
        *doc, *item, "windows", "n", "at",
        f"""filter(transform({place}, q -> named_struct('q', q, 'type', get(b, q).type, 'theirs', get(b, q).raw, 'ours', get(s, q + d).raw)), x -> x.type <> '') m""",
    )
    alike = "size(filter(m, y -> y.type = x.type and y.theirs = x.theirs and y.ours = x.ours))"
    copies = copies.withColumn("m", F.expr(f"transform(m, x -> named_struct('q', x.q, 'type', x.type, 'theirs', x.theirs, 'ours', x.ours, 'alike', {alike}))"))
    torn = "filter(m, x -> exists(m, y -> y.type = x.type and (y.theirs = x.theirs) <> (y.ours = x.ours) and y.alike >= x.alike))"
    copies = copies.withColumn("torn", F.expr(f"transform({torn}, x -> x.q)"))
    copies = copies.withColumn("at", F.expr("filter(at, p -> not exists(torn, q -> q >= p and q < p + n))")).where("size(at) > 0")
    held = "filter(m, x -> exists(at, p -> x.q >= p and x.q < p + n))"
    copies = copies.withColumn("m", F.expr(f"array_distinct(transform({held}, x -> struct(x.type, x.theirs, x.ours)))"))
    copies = copies.selectExpr(*doc, *item, "windows", "n", "at", "size(m) slots", "forall(m, x -> x.theirs = x.ours) and size(torn) = 0 same")
    copies = copies.where(f"n = {WINDOW} or same")
    out = copies.groupBy(*doc, *item, "windows").agg(F.array_distinct(F.flatten(F.collect_set("at"))).alias("at"), F.max("slots").alias("slots"), F.bool_or("same").alias("exact"))
    out = out.selectExpr("doc_id", "item_id", "struct(size(at) / windows as coverage, cast(size(at) as long) as matched, windows, slots, exact) best")
    out = out.where(F.col("best.coverage") >= coverage).groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    return out.select("doc_id", "item_id", "best.matched", "best.windows", "best.coverage", "best.slots", "best.exact")
