"""Conversations from reply trees: root-to-leaf paths, ranked and formatted.

Paths come from iterated self-joins that double their reach: after round k a message
knows the one 2**k replies above it, so a tree of depth d takes log2(d) rounds and every
round holds one small row a message. Only chosen branches are then expanded, by the same
jumps in reverse order, and only they meet their texts. DataFrame operations only.

In a formatted conversation a turn is ``<|turn|>role<|text|>text<|end|>``. Control
strings inside roles and texts get a backslash behind their first character, and
backslashes are doubled, so that the turns read back exactly.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from particlelake.llm.common import plain_names, stored

ASSISTANT = "assistant"


@dataclass(frozen=True)
class ChatTemplate:
    """Marks of a turn, and control strings of other templates that texts may not hold either."""

    turn: str = "<|turn|>"
    body: str = "<|text|>"
    end: str = "<|end|>"
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

    def __post_init__(self) -> None:
        if any(len(c) < 2 or "\\" in c for c in self.control):
            raise ValueError("a control string has two characters at least and no backslash")

    @property
    def control(self) -> tuple[str, ...]:
        return (self.turn, self.body, self.end, *self.foreign)

    def escaped(self, text: Column) -> Column:
        doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        return F.regexp_replace(doubled, f"(?s)(?={'|'.join(re.escape(c) for c in self.control)})(.)", r"$1\\")

    @staticmethod
    def unescaped(text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")


TEMPLATE = ChatTemplate()


def thread_messages(
    rows: DataFrame, thread_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Messages of plain threads: every row replies to the one before it.

    Order within a thread is ``order_col``, nulls first, then role and text; repeated rows
    are messages of their own. Rows without a thread are one thread. Ids are
    (thread, position), scores 0.
    """
    plain = plain_names(rows, (thread_col, "thread"), (order_col, "place"), (role_col, "role"), (text_col, "text"))
    at = F.row_number().over(Window.partitionBy("thread").orderBy(*[F.col(c).asc_nulls_first() for c in ("place", "role", "text")]))
    placed = plain.withColumn("position", at.cast("long"))
    name = lambda position: F.struct("thread", position.alias("position"))
    return placed.select(
        name(F.col("position")).alias("message_id"),
        F.when(F.col("position") > 1, name(F.col("position") - 1)).alias("parent_id"),
        "role", "text", F.lit(0.0).alias("score"),
    )


def _climbed(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(node, root, n, total) of every message below a root, and the jumps of 1, 2, 4, ... replies upwards.

    A row is the segment from ``node`` up to ``top``, ``n`` messages with ``total`` score;
    ``up`` is the parent of ``top``, null once ``top`` is a root.
    """
    ids = messages.select(F.col("message_id").alias("up"))
    has_parent = messages.where("parent_id <> message_id").select(F.col("message_id").alias("node"), F.col("parent_id").alias("up"))
    known = has_parent.join(ids, "up", "left_semi")
    first = messages.select(F.col("message_id").alias("node"), "score").join(known, "node", "left")
    state = stored(first.select("node", F.col("node").alias("top"), "up", F.lit(1).cast("long").alias("n"), F.col("score").alias("total")), "segments")
    messages_in_all = state.count()
    jumps: list[DataFrame] = []
    while 2 ** len(jumps) <= messages_in_all:
        open_ = state.where("up is not null")
        if open_.isEmpty():
            break
        jumps.append(open_.select("node", "up"))
        above = state.select(F.col("node").alias("up"), F.col("top").alias("top2"), F.col("up").alias("up2"), F.col("n").alias("n2"), F.col("total").alias("total2"))
        longer = open_.join(above, "up").select("node", F.col("top2").alias("top"), F.col("up2").alias("up"), (F.col("n") + F.col("n2")).alias("n"), (F.col("total") + F.col("total2")).alias("total"))
        state = stored(state.where("up is null").unionByName(longer), "segments")
    return state.where("up is null").select("node", F.col("top").alias("root"), "n", "total"), jumps


def branch_turns(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """(root, leaf, rank, branch_score, position, role, text) of the ``top`` branches of every tree.

    ``messages(message_id, parent_id, role, text, score)``: a message without parent, with
    an unknown one or with itself as parent is a root. A branch runs from a root to a message
    without replies; its score is the mean of its messages' scores (null: 0), and ties go to
    the smaller leaf. ``top=None`` takes all branches. Of rows with one id the smallest
    by parent, role, text and score counts; rows without id, to which nothing can reply,
    and replies that lead back to themselves are no part of any tree.
    """
    plain = messages.select("message_id", "parent_id", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    one = plain.where("message_id is not null").groupBy("message_id").agg(F.min(F.struct("parent_id", "role", "text", "score")).alias("m"))
    one = stored(one.select("message_id", "m.*"), "messages")
    reached, jumps = _climbed(one.select("message_id", "parent_id", "score"))
    parents = one.where("parent_id <> message_id").select(F.col("parent_id").alias("node")).distinct()
    leaves = reached.join(parents, "node", "left_anti").select("root", F.col("node").alias("leaf"), "n", (F.col("total") / F.col("n")).alias("branch_score"))
    order = Window.partitionBy("root").orderBy(F.col("branch_score").desc(), "leaf")
    ranked = leaves.withColumn("rank", F.row_number().over(order).cast("long"))
    chosen = stored(ranked if top is None else ranked.where(F.col("rank") <= top), "branches")
    found = chosen.select("leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("above"))
    for k in range(len(jumps) - 1, -1, -1):
        here, there = F.struct("node", "above"), F.struct(F.col("up").alias("node"), (F.col("above") + 2**k).alias("above"))
        both = F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, there))
        found = found.join(jumps[k], "node", "left").select("leaf", F.explode(both).alias("x")).select("leaf", "x.node", "x.above")
    texts = one.select(F.col("message_id").alias("node"), "role", "text")
    placed = found.join(chosen, "leaf").withColumn("position", F.col("n") - 1 - F.col("above"))
    return placed.join(texts, "node").select("root", "leaf", "rank", "branch_score", "position", "role", "text")


def formatted_branches(turns: DataFrame, template: ChatTemplate = TEMPLATE, loss_role: str = ASSISTANT) -> DataFrame:
    """(root, leaf, rank, branch_score, formatted, loss_spans): every branch as one conversation.

    ``loss_spans`` lists the texts of ``loss_role`` in order: ``start`` and ``length`` in code
    points of ``formatted``, and the number and start of their turn. Null roles and texts
    count as empty. A conversation is one value, so its length is bounded by Spark's strings.
    """
    role, text = template.escaped(F.coalesce("role", F.lit(""))), template.escaped(F.coalesce("text", F.lit("")))
    parts = turns.select(
        "root", "leaf", "rank", "branch_score", "position", F.coalesce(F.col("role") == loss_role, F.lit(False)).alias("learn"),
        F.concat(F.lit(template.turn), role, F.lit(template.body)).alias("head"), text.alias("body"),
    )
    piece = F.concat("head", "body", F.lit(template.end))
    sized = parts.select("*", piece.alias("piece"), F.length("head").cast("long").alias("at"), F.length("body").cast("long").alias("length"), F.length(piece).cast("long").alias("size"))
    before = Window.partitionBy("leaf").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("turn_start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    span = F.struct((F.col("turn_start") + F.col("at")).alias("start"), "length", F.col("position").alias("turn"), "turn_start")
    row = F.struct("position", "piece", F.when(F.col("learn"), span).alias("span"))
    grouped = placed.groupBy("root", "leaf", "rank", "branch_score").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return grouped.select(
        "root", "leaf", "rank", "branch_score",
        F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
        F.filter(F.transform("rows", lambda r: r["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(conversations: DataFrame, template: ChatTemplate = TEMPLATE) -> DataFrame:
    """``conversations`` with ``turns(role, text)`` and ``loss_texts``, taken from ``formatted`` and ``loss_spans`` alone."""
    pieces = F.split("formatted", re.escape(template.end))
    cut = conversations.withColumn("__pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))

    def turn(piece: Column) -> Column:
        halves = F.split(F.substring(piece, F.lit(len(template.turn) + 1), F.length(piece)), re.escape(template.body))
        return F.struct(template.unescaped(halves[0]).alias("role"), template.unescaped(halves[1]).alias("text"))

    def under(span: Column) -> Column:
        piece = F.element_at("__pieces", span["turn"].cast("int") + 1)
        return template.unescaped(F.substring(piece, (span["start"] - span["turn_start"] + 1).cast("int"), span["length"].cast("int")))

    return cut.select("*", F.transform("__pieces", turn).alias("turns"), F.transform("loss_spans", under).alias("loss_texts")).drop("__pieces")


def reply_conversations(messages: DataFrame, top: int | None = 1, template: ChatTemplate = TEMPLATE) -> DataFrame:
    """The ``top`` branches of every reply tree as formatted conversations with loss spans.

    See ``branch_turns`` for trees, ties, repeated rows and nulls; extra columns of
    ``messages`` are ignored whatever their names, and an empty table gives an empty one.
    """
    return formatted_branches(branch_turns(messages, top), template)


def turn_digests(conversations: DataFrame) -> DataFrame:
    """Counts and digests of what reads back from formatted conversations."""
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("loss_texts", "")
    return read_back(conversations).select(
        *conversations.columns,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
