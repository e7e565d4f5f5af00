"""Conversations from reply trees.

Messages name the message they reply to. Self-joins that double their reach find for every
message its ancestors 1, 2, 4, ... steps up, its depth and the scores above it; leaves, that is
branches, are ranked in their tree by mean score; the chosen branches are expanded from leaf to
root with the same tables, each join doubling what is known, and each path becomes one
formatted conversation. The number of joins is the logarithm of the deepest path, and no step
lists pairs of messages of a tree.

A turn is written as ``<|role|>``, line feed, text, ``<|end|>``, line feed. In texts ``&``, ``<`` and
``[`` are written as ``&amp;``, ``&lt;`` and ``&lb;``, in roles ``|`` as ``&pipe;`` too, so no text can hold a
control string and everything can be read back. The loss mask lists the code points of the
assistant's texts, end exclusive.

Defined results: null texts and roles count as empty. Messages whose parent is missing are roots;
messages that reply to each other in a circle have no root and are left out. Of messages with
the same tree and node all are kept, as turns of one place ordered by role and text; messages
without a node have no place in a tree and are left out. A null tree is a tree
of its own. An empty table gives no rows. Other columns take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwater.llm.tables import col, written

LEARNED_ROLE = "assistant"
END = "<|end|>\n"


def escape(text: Column, role: bool = False) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"), *([("|", "&pipe;")] if role else [])):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in (("|", "&pipe;"), ("[", "&lb;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def _reach(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (tree, node, up, sum, steps) of the messages that have one 1, 2, 4, ... replies up,
    and the same for all messages up to their root.

    ``sum`` and ``steps`` cover the messages passed on the way. Only messages that have not
    reached their root take part in the next round.
    """
    known = nodes.select(F.col("tree").alias("t2"), F.col("node").alias("n2"))
    first = nodes.join(known, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("parent") == F.col("n2")), "left")
    first = written(first.select("tree", "node", F.col("n2").alias("up"), F.col("score").alias("sum"), F.lit(1).cast("bigint").alias("steps")), "reach")
    on_the_way, arrived = [first.where("up is not null")], [first.where("up is null")]
    longest = 2 * first.count()  # no path without a circle is longer
    while 2 ** len(on_the_way) <= longest and not on_the_way[-1].isEmpty():
        last = on_the_way[-1]
        state = reduce(DataFrame.unionByName, [*arrived, last]).select(
            F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("up").alias("up2"), F.col("sum").alias("sum2"), F.col("steps").alias("steps2"))
        joined = last.join(state, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("up") == F.col("n2")))
        further = written(joined.select("tree", "node", F.col("up2").alias("up"), (F.col("sum") + F.col("sum2")).alias("sum"),
                                        (F.col("steps") + F.col("steps2")).alias("steps")), "reach")
        on_the_way.append(further.where("up is not null"))
        arrived.append(further.where("up is null"))
    return on_the_way, reduce(DataFrame.unionByName, arrived)


def best_paths(nodes: DataFrame, paths: int = 1) -> DataFrame:
    """(tree, branch, node, back) of the best branches of each tree, from (tree, node, parent, score).

    Branches are ranked by the mean score of their messages; of equal ones the leaf with the smaller
    number comes first. ``back`` counts replies from the leaf.
    """
    tables, arrived = _reach(nodes)
    parents = nodes.where("parent is not null").select(F.col("tree").alias("t2"), F.col("parent").alias("n2")).distinct()
    leaves = arrived.join(parents, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2")), "left_anti")
    order = Window.partitionBy("tree").orderBy((F.col("sum") / F.col("steps")).desc(), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= paths)
    found = written(chosen.select("tree", F.col("rank").alias("branch"), "node", F.lit(0).cast("bigint").alias("back")), "paths")
    for power in range(len(tables) - 1, -1, -1):
        up = tables[power].select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "up")
        above = found.join(up, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2")))
        above = above.select("tree", "branch", F.col("up").alias("node"), (F.col("back") + 2 ** power).alias("back"))
        found = written(found.unionByName(above), "paths")
    return found


def format_turns(turns: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each conversation: keys, formatted, loss_mask; from rows of (keys, order, role, text)."""
    head = F.concat(F.lit("<|"), escape(F.coalesce("role", F.lit("")), role=True), F.lit("|>\n"))
    parts = turns.select(*keys, *order, head.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"),
                         F.coalesce(F.col("role") == LEARNED_ROLE, F.lit(False)).alias("learned"))
    parts = parts.withColumn("piece", F.concat("head", "body", F.lit(END)))
    in_order = Window.partitionBy(*keys).orderBy(*order, "head", "body").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.withColumn("end", F.sum(F.length("piece")).over(in_order) - len(END)).withColumn("nth", F.count("*").over(in_order))
    span = F.when(F.col("learned"), F.struct((F.col("end") - F.length("body")).alias("start"), F.col("end").alias("end")))
    listed = placed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("nth", "piece", span.alias("span")))).alias("turns"))
    spans = F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
    return listed.select(*keys, F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_mask"))


def conversations(messages: DataFrame, tree_col: str, node_col: str, parent_col: str, role_col: str = "role", text_col: str = "text",
                  score_col: str | None = None, paths: int = 1) -> DataFrame:
    """(tree, branch, formatted, loss_mask) of the best branches of every reply tree."""
    score = F.coalesce(col(score_col).cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)
    rows = messages.select(col(tree_col).alias("tree"), col(node_col).alias("node"), col(parent_col).alias("parent"), score.alias("score"))
    # A place in the tree has one parent and one score, even if several messages share it.
    nodes = written(rows.where("node is not null").groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.avg("score").alias("score")), "nodes")
    found = best_paths(nodes, paths)
    texts = messages.select(col(tree_col).alias("t2"), col(node_col).alias("n2"), col(role_col).alias("role"), col(text_col).alias("text"))
    turns = found.join(texts, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2")))
    return format_turns(turns.select("tree", "branch", (-F.col("back")).alias("place"), "role", "text"), ["tree", "branch"], ["place"])


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda p: p != "")

    def turn(piece):
        at = F.locate("|>\n", piece)
        return F.struct(unescape(F.substring(piece, F.lit(3), at - 3)).alias("role"),
                        unescape(F.substring(piece, at + 3, F.length(piece))).alias("text"))

    return F.transform(pieces, turn)


def learned_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
