"""Chat formatting of reply trees.

Root-to-leaf paths come from iterative self-joins that double the distance: after r rounds every node knows its ancestor
2^r steps up and the sum of the scores on the way. So leaves are ranked by the scores of their whole paths with one row a
node and round; only the chosen paths are expanded, by the same jumps from the largest down. Each is written as one text
with marked turns. Control strings inside texts are escaped reversibly, and the spans of the loss mask are returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from samplegrid.llm.common import HOT_KEYS, HOT_ROWS, by_key, discard, materialize

#: The template's marks, and other control strings that are escaped too.
OPEN, MIDDLE, CLOSE = "<|turn|>", "\n", "<|end|>\n"
CONTROL = r"\\|<(?=/?s>|/?<?/?<?/?SYS>|\|)|\[(?=/?INST\])"


def escape(c):
    """Backslash, and the first letter of every control string, as \\\\, \\l (<) and \\b ([)."""
    c = F.regexp_replace(c, CONTROL, r"\\$0")
    return F.regexp_replace(F.regexp_replace(c, r"\\<", r"\\l"), r"\\\[", r"\\b")


def escape_role(c):
    """escape(), and line ends, which close the role, as \\n."""
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape(c):
    """Inverse of escape() and escape_role()."""
    inner = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.transform(F.split(c, r"\\\\", -1), inner), "\\")


def linear_tree(rows: DataFrame) -> DataFrame:
    """(conv_id, node, parent, role, text, score) of rows(conv_id, turn, role, text): each turn replies to the one before.
    Equal turns are ordered by role and text; every row counts. Null roles and texts are empty; null conv_ids are one
    conversation; null turns come first."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    out = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    out = out.withColumn("node", F.row_number().over(order).cast("long"))
    return out.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def best_paths(tree: DataFrame, branches: int) -> DataFrame:
    """(conv_id, branch, back, node): of each conversation the nodes of its `branches` best paths, `back` steps from the leaf.

    tree(conv_id, node, parent, score): nodes whose parent is missing are roots; a cycle and what hangs on it reach no root
    and give no path; null nodes are left out; of rows that repeat a node the smallest parent and score count. Rounds: the logarithm of the deepest path.
    """
    nodes = tree.where("node is not null").groupBy("conv_id", "node").agg(F.min("parent").alias("parent"), F.min("score").alias("score"))
    nodes = materialize(nodes, "nodes")
    deepest = nodes.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    most = max(HOT_ROWS, (deepest[1] or 0) // HOT_KEYS)
    parents = materialize(nodes.where("parent is not null").groupBy("conv_id", "parent").agg(F.count("*").alias("n")), "parents")
    known = parents.join(nodes.select("conv_id", F.col("node").alias("parent")), ["conv_id", "parent"], "left_semi").withColumn("to", F.col("parent"))
    # (node, to, total): `to` is 2^r steps up, null past the root; total sums the scores on the way, that of `to` left out
    way = materialize(by_key(nodes, known, ["conv_id", "parent"], deepest[1] or 0, "left").select("conv_id", "node", "to", F.col("score").alias("total")), "way")
    ways = [way]
    while way.where("to is not null").limit(1).count() and 2 ** (len(ways) - 1) < deepest[0]:
        up = way.selectExpr("conv_id", "node to", "to further", "total more")
        fan = way.where("to is not null").groupBy("conv_id", "to").agg(F.count("*").alias("n"))
        # an ancestor of very many nodes is not gathered
        if deepest[1] > most and fan.where(F.col("n") > most).limit(1).count():
            step = by_key(way.where("to is not null"), up.join(fan, ["conv_id", "to"]), ["conv_id", "to"], deepest[1])
        else:
            step = way.where("to is not null").join(up, ["conv_id", "to"])
        step = step.selectExpr("conv_id", "node", "further to", "total + more total")
        way = materialize(step.union(way.where("to is null").select("conv_id", "node", "to", "total")), "way")
        ways.append(way)
    leaves = way.where("to is null").join(parents.select("conv_id", F.col("parent").alias("node")), ["conv_id", "node"], "left_anti")
    # Spark cuts each partition to its first rows before the shuffle, so that no conversation's leaves are gathered
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("total"), "node"))
    out = leaves.withColumn("branch", rank).where(F.col("branch") <= branches).selectExpr("conv_id", "branch", "0L back", "node")
    out = materialize(out, "path")
    for r in reversed(range(len(ways) - 1)):
        step = out.join(ways[r].where("to is not null").select("conv_id", "node", "to"), ["conv_id", "node"])
        done, out = out, materialize(out.union(step.selectExpr("conv_id", "branch", f"back + {2**r} back", "to node")), "path")
        discard(done)
    discard(nodes, parents, *ways)
    return out


def format_conversations(tree: DataFrame, branches: int = 1, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, branch, formatted, loss) for the best `branches` paths of each conversation of
    tree(conv_id, node, parent, role, text, score); loss: array of struct(start, length) in characters of `formatted`.

    Paths are ranked by total score, equal ones by the smaller leaf. Null texts and roles are empty, null scores 0, null
    conv_ids one conversation; of rows that repeat a node the smallest parent, score, role and text count. Conversations that are
    one cycle give no row. An empty table gives no rows; extra columns are not read. A path is one text, so it is put
    together in one task.
    """
    # as text, so that no id stands for null
    kind = tree.schema["conv_id"].dataType
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    nodes = tree.select(key.alias("conv_id"), "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    way = best_paths(nodes.select("conv_id", "node", "parent", "score"), branches)
    turns = way.join(nodes, ["conv_id", "node"])
    head = F.concat(F.lit(OPEN), escape_role("role"), F.lit(MIDDLE))
    turns = turns.select("conv_id", "branch", (-F.col("back")).alias("at"), head.alias("head"), escape("text").alias("body"), F.col("role") == loss_role)
    turns = turns.toDF("conv_id", "branch", "at", "head", "body", "loss")
    whole = turns.groupBy("conv_id", "branch").agg(F.array_sort(F.collect_list(F.struct("at", "head", "body", "loss"))).alias("t"))
    whole = whole.withColumn("t", F.expr("filter(t, (x, i) -> i = 0 or x.at <> t[greatest(i - 1, 0)].at)"))
    text = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
    spans = F.expr(f"""aggregate(t, named_struct('n', 0, 's', cast(array() as array<struct<start:int,length:int>>)),
        (a, x) -> named_struct('n', a.n + length(x.head) + length(x.body) + {len(CLOSE)}, 's', if(x.loss,
            concat(a.s, array(named_struct('start', a.n + length(x.head), 'length', length(x.body)))), a.s)), a -> a.s)""")
    out = whole.select(F.when(F.col("conv_id") != "", F.substring("conv_id", 2, 1 << 30)).cast(kind).alias("conv_id"), "branch", text.alias("formatted"), spans.alias("loss"))
    out = materialize(out, "formatted")
    discard(way)
    return out


def parse(formatted: DataFrame) -> DataFrame:
    """formatted with turns, array of struct(role, text), and loss_text, the unescaped text under the mask in order, read
    back from the formatted text alone and its spans. Columns of these names are replaced."""
    parts = F.filter(F.split("formatted", r"<\|end\|>\n", -1), lambda x: x != "")
    role = lambda x: F.substring_index(x, MIDDLE, 1)
    turn = lambda x: F.struct(
        unescape(F.substr(role(x), F.lit(len(OPEN) + 1))).alias("role"), unescape(F.substr(x, F.length(role(x)) + len(MIDDLE) + 1)).alias("text")
    )
    masked = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.withColumn("turns", F.transform(parts, turn)).withColumn("loss_text", F.array_join(masked, ""))
