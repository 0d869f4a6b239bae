"""Operator 10: chat formatting of reply trees, in DataFrame operations only.

Messages name their parent. Self-joins that double the step (parent, grandparent, ...) give every message its depth and the sum of
scores from the root; the same step tables, largest first, then spell out each chosen branch from its leaf, so that a
thread of thousands of replies takes a dozen joins. Branches are ranked within their tree by mean score, and each chosen one becomes one
conversation text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.llm.common import stage

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"


def escape(c: Column) -> Column:
    """No control string starts inside: a backslash more between ``<`` and ``|``."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def _walk(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Every message with ``depth`` and ``total`` score from its root, and the step tables ``node -> up`` over 1, 2, 4, ... replies."""
    state = stage(messages.select("tree", "node", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("depth"), F.coalesce("score", F.lit(0.0)).alias("total")), "walk")
    steps = []
    while True:
        step = state.where("up is not null").select("tree", "node", "up")
        if step.isEmpty():
            return state, steps
        steps.append(step)
        # Only messages that are not yet at their root move on.
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("total").alias("extra"))
        moved = state.where("up is not null").join(above, ["tree", "up"])
        moved = moved.select("tree", "node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("extra")).alias("total"))
        state = stage(state.where("up is null").union(moved), "walk")


def branches(messages: DataFrame, best: int | None = None) -> DataFrame:
    """Root-to-leaf paths: ``tree, leaf, node, position`` (position 0 is the root), of the ``best`` branches of each tree.

    ``messages`` has tree, node (unique in its tree), parent (null or absent: a root), score (null: 0). Branches rank by
    mean score, ties by the smaller leaf.
    """
    # Parents that are not among the messages are taken off first, so a step table never leads outside.
    have = messages.select("tree", F.col("node").alias("parent"), F.lit(True).alias("have"))
    linked = messages.join(have, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("have"), F.col("parent")).alias("parent"), "score")
    linked = stage(linked, "messages")
    state, steps = _walk(linked)
    parents = linked.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    leaves = state.join(parents, ["tree", "node"], "left_anti")
    if best is not None:
        w = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), "node")
        leaves = leaves.withColumn("r", F.row_number().over(w)).where(F.col("r") <= best)
    path = leaves.select("tree", F.col("node").alias("leaf"), "node", (F.col("depth") - 1).alias("position"))
    for k in range(len(steps) - 1, -1, -1):
        # Whoever is at least 2^k below the root brings in the message 2^k above.
        path = stage(path, "path")
        above = path.where(F.col("position") >= 2**k).join(steps[k], ["tree", "node"])
        path = path.union(above.select("tree", "leaf", F.col("up").alias("node"), F.col("position") - 2**k))
    return path


def format_branches(path: DataFrame, said: DataFrame) -> DataFrame:
    """``tree, leaf, formatted, loss_spans``: the text of each branch, and where in it (code points, half open) replies to be learnt stand.

    ``said`` has tree, node, role, text; nulls there are empty. The text of assistant turns is under the loss mask, without markers.
    """
    rows = path.join(said.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), ["tree", "node"])
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(LINE)), F.lit("\n"))
    turn = F.struct("position", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("learn"))
    lists = rows.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    tail = END + "\n"

    def add(acc, t):
        begin = acc["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        return F.struct((end + len(tail)).alias("at"), F.when(t["learn"], F.concat(acc["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("spans"))
    text = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))))
    return lists.select("tree", "leaf", text.alias("formatted"), F.aggregate("turns", start, add, lambda acc: acc["spans"]).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: array of role and text."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p, i: i > 0)

    def turn(p):
        role = F.substring_index(p, "\n", 1)
        body = F.substring_index(F.substr(p, F.length(role) + 2), END, 1)
        return F.struct(unescape(F.replace(role, F.lit(LINE), F.lit("\n"))).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans`` of conversations whose rows follow each other by turn.

    Each row answers the one before it, by turn, then role, then text (nulls first), so repeated turns and rows all
    stay, one after the other. A null conv_id is one conversation more; null roles and texts are empty; no rows give no rows.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    # Trees are joined by id; the null id goes as a tree of its own.
    tree = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("id"))
    said = stage(rows.select(tree.alias("tree"), F.row_number().over(w).cast("bigint").alias("node"), "role", "text"), "said")
    messages = said.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"))
    out = format_branches(branches(messages, 1), said)
    return out.select(F.when(~F.col("tree.none"), F.col("tree.id")).alias("conv_id"), "formatted", "loss_spans")
