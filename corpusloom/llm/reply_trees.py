"""Chat formatting of reply trees, with DataFrame functions only.

Nodes know their parent. Iterated self-joins double the reach of an ancestor pointer until every
pointer has passed its root; another run of joins, from the leaves, spells out every root-to-leaf path
from these pointers, so a thread of depth d takes log2(d) joins. Paths are ranked within their
conversation by score, and each chosen path is formatted as one conversation with a loss mask.

The template is ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n`` for each turn. ``&``, ``<`` and ``[`` in a role
or text (and a line feed in a role) are written as character references, so no control string, of this
template or of the common bracketed ones, survives inside a text, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm._store import Scratch

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in (("&#10;", "\n"), ("&#91;", "["), ("&lt;", "<"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def from_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Nodes of plain conversations: each row replies to the one before it.

    Rows are ordered by turn (null first), then role and text, so ties and repeated rows have one defined
    order and repeated rows are turns of their own. Null roles and texts are empty.
    """
    t = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # Sorted by ranges, not by conversation, so that a very long one is numbered by many tasks; then each range's
    # number of earlier turns is added. The last key parts repeated rows.
    keys = ["conv_id", "turn", "role", "text", "_tie"]
    t = t.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    t = t.withColumn("c", _name("conv_id")).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    t = Scratch(turns.sparkSession, "turns").save(t.drop("turn", "_tie"), "sorted")
    pieces = t.groupBy("c", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.join(pieces.select("c", "part", (earlier - F.col("first") + 1).alias("shift")), ["c", "part"])
    t = t.withColumn("node_id", F.col("at") + F.col("shift"))
    return t.select("conv_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def _name(conv: str) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("v"), F.col(conv).cast("string")), F.lit("n"))


class ReplyTrees:
    """Formats root-to-leaf paths of reply trees.

    ``nodes`` has conv_id, node_id (unique in its conversation, not null), parent_id, role, text, score.
    A node whose parent is null or missing is a root; nodes that reply to themselves in a ring have no root
    and are left out. ``branches`` is the number of paths kept for each conversation (None: all), best mean
    score first (null scores count as 0), then least leaf. A null conv_id is a conversation like any other.
    Equal (conv_id, node_id) rows are not told apart; use ``from_turns`` or unique ids.
    """

    def __init__(self, branches: int | None = None, loss_role: str = "assistant"):
        self.branches, self.loss_role = branches, loss_role

    def paths(self, nodes: DataFrame, scratch: Scratch) -> DataFrame:
        """(c, leaf, node, up): every node of every path that begins at a root; up is its distance from the leaf."""
        known = nodes.select("c", "node_id")
        edge = nodes.select("c", "node_id", F.col("parent_id").alias("to")).where("`to` is not null")
        edge = edge.join(known.withColumnRenamed("node_id", "to"), ["c", "to"], "left_semi")
        inner = edge.select("c", F.col("to").alias("node_id")).distinct()
        jump, jumps, size = scratch.save(edge, "jump"), [], nodes.count()
        while 2 ** len(jumps) <= size and not jump.isEmpty():
            jumps.append(jump)
            far = jump.alias("a").join(jump.alias("b"), (F.col("a.c") == F.col("b.c")) & (F.col("a.to") == F.col("b.node_id")))
            jump = scratch.save(far.select("a.c", "a.node_id", "b.to"), "jump")
        found = known.join(inner, ["c", "node_id"], "left_anti").select("c", F.col("node_id").alias("leaf"), F.col("node_id").alias("node"), F.lit(0).cast("long").alias("up"))
        for k in range(len(jumps) - 1, -1, -1):
            j = jumps[k].select("c", F.col("node_id").alias("node"), F.col("to"))
            # Written each time: the plan would double with every join.
            was, found = found, scratch.save(found.union(found.join(j, ["c", "node"]).select("c", "leaf", F.col("to").alias("node"), (F.col("up") + 2**k).alias("up"))), "found")
            if hasattr(was, "_scratch_path"):
                scratch.drop(was)
        return found

    def format(self, nodes: DataFrame) -> DataFrame:
        """conv_id, leaf_id, rank, score, formatted, mask array<struct<start, end>> (code points, end exclusive, of the
        loss role's escaped texts, in order)."""
        scratch = Scratch(nodes.sparkSession, "reply-trees")
        nodes = scratch.save(nodes.select("conv_id", "node_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"), _name("conv_id").alias("c")), "nodes")
        steps = self.paths(nodes.select("c", "node_id", "parent_id"), scratch)
        if self.branches is not None:
            rated = steps.join(nodes.select("c", F.col("node_id").alias("node"), "score"), ["c", "node"]).groupBy("c", "leaf").agg(F.avg("score").alias("mean"))
            rated = rated.withColumn("rank", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("mean"), "leaf"))).where(F.col("rank") <= self.branches)
            steps = steps.join(rated.select("c", "leaf"), ["c", "leaf"])
        body = nodes.select("c", F.col("node_id").alias("node"), "conv_id", "score", F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == self.loss_role).alias("loss"))
        t = steps.join(body, ["c", "node"])
        order = Window.partitionBy("c", "leaf").orderBy(F.desc("up"))
        whole = F.concat("head", "body", F.lit(CLOSE))
        before = F.coalesce(F.sum(F.length(whole).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head")
        t = t.select("c", "leaf", "up", "conv_id", "score", whole.alias("turn"), F.when(F.col("loss"), F.struct(before.alias("start"), (before + F.length("body")).alias("end"))).alias("span"))
        g = t.groupBy("c", "leaf").agg(F.first("conv_id").alias("conv_id"), F.avg("score").alias("score"), F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "turn", "span"))).alias("turns"))
        g = g.withColumn("rank", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("score"), "leaf"))) if self.branches != 1 else g.withColumn("rank", F.lit(1))
        turns = F.transform("turns", lambda x: x["turn"])
        mask = F.filter(F.transform("turns", lambda x: x["span"]), lambda s: s.isNotNull())
        return g.select("conv_id", F.col("leaf").alias("leaf_id"), "rank", "score", F.array_join(turns, "").alias("formatted"), mask.alias("mask"))


def turns_of(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(p: Column) -> Column:
        p = F.substr(p, F.lit(len(OPEN) + 1))
        cut = F.locate("\n", p)
        return F.struct(unescape(F.substr(p, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(p, cut + 1)).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
