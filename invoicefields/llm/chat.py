"""Chat formatting of reply trees.

Replies form trees: a node names the node that it answers.  Self-joins that double their reach
(1, 2, 4, ... ancestors) give each node the score of its whole branch; each conversation's leaves
are ranked by it, and the same jumps, taken from the chosen leaves, enumerate the nodes of their
paths.  Each path becomes one text: per turn ``<|turn|>role<|says|>text<|end|>``, with a backslash
put into control strings (and before backslashes) that stand in roles and texts themselves.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from invoicefields.llm.common import Scratch, map_blocks

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    """No control string is left: neither this template's nor those of other common ones."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(doubled, r"<(?=\||/?s>)", r"<\\"), r"\[(?=/?INST\])", r"[\\")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def linear_tree(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` as a tree in which each turn answers the one before.

    Turns that are equal come in the order of role and text, null turns first."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return (rows.select("conv_id", "turn", "role", "text").withColumn("node_id", F.row_number().over(order).cast("long"))
            .select("conv_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"),
                    F.lit(0.0).alias("score"), "role", "text"))


def best_paths(nodes: DataFrame, top: int, scratch: Scratch) -> DataFrame:
    """``conv_id, leaf_id, rank, node_id, distance`` of the nodes on the ``top`` best paths."""
    plain = scratch.save(nodes.select("conv_id", "node_id", "parent_id", "score"))
    known = plain.select("conv_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("there"))
    level = scratch.save(
        plain.join(known, ["conv_id", "parent_id"], "left")
        .select("conv_id", "node_id", F.coalesce("score", F.lit(0.0)).alias("total"),
                F.when(F.col("there") & (F.col("parent_id") < F.col("node_id")), F.col("parent_id")).alias("up")))
    # Only nodes that have not met their root are joined; what has met it is looked up as it is.
    active, done, jumps = level.filter("up IS NOT NULL"), level.filter("up IS NULL"), []
    while active.limit(1).count():
        jumps.append(active.select("conv_id", "node_id", "up"))
        above = done.unionByName(active).select(
            "conv_id", F.col("node_id").alias("up"), F.col("total").alias("more"), F.col("up").alias("further"))
        level = scratch.save(active.join(above, ["conv_id", "up"]).select(
            "conv_id", "node_id", (F.col("total") + F.col("more")).alias("total"), F.col("further").alias("up")))
        active, done = level.filter("up IS NOT NULL"), done.unionByName(level.filter("up IS NULL"))
    parents = (jumps[0] if jumps else active).select("conv_id", F.col("up").alias("node_id"))
    best = Window.partitionBy("conv_id").orderBy(F.col("total").desc(), "node_id")
    paths = (done.join(parents, ["conv_id", "node_id"], "left_anti").withColumn("rank", F.row_number().over(best))
             .filter(F.col("rank") <= top)
             .select("conv_id", F.col("node_id").alias("leaf_id"), "rank", "node_id", F.lit(0).alias("distance")))
    for k, reach in enumerate(jumps):
        paths = scratch.save(paths.unionByName(
            paths.join(reach, ["conv_id", "node_id"]).select(
                "conv_id", "leaf_id", "rank", F.col("up").alias("node_id"),
                (F.col("distance") + F.lit(1 << k)).alias("distance"))))
    return paths


def format_trees(nodes: DataFrame, top: int = 1) -> DataFrame:
    """``conv_id, leaf_id, rank, n_turns, formatted, loss_spans`` from ``conv_id, node_id, parent_id,
    score, role, text``: each conversation's ``top`` best paths from root to leaf.

    A path's score is the sum over its nodes (null counts as 0); ties go to the smaller leaf.  A node
    whose parent is null, missing, or not smaller than itself is a root, so there are no cycles.
    ``node_id`` is unique within a conversation.  Null roles and texts are empty; a null ``conv_id``
    is one conversation, as any other value.  ``loss_spans`` are the stretches (start, length; code points) of
    assistant texts.  A conversation is one value and must fit one."""
    scratch = Scratch(nodes.sparkSession, "chat")
    # as a struct the id is never null, so rows without one meet in joins like all others
    nodes = nodes.withColumn("conv_id", F.struct(F.col("conv_id").alias("id")))
    said = nodes.select("conv_id", "node_id", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(SAYS))
    body = escaped(F.col("text"))
    turns = best_paths(nodes, top, scratch).join(said, ["conv_id", "node_id"]).select(
        "conv_id", "leaf_id", "rank", (-F.col("distance")).alias("place"), (F.col("role") == ASSISTANT).alias("loss"),
        F.concat(head, body, F.lit(END)).alias("turn"), F.char_length(head).alias("head"),
        F.char_length(body).alias("body"))
    before = (Window.partitionBy("conv_id", "leaf_id", "rank").orderBy("place")
              .rowsBetween(Window.unboundedPreceding, -1))
    length = F.char_length("turn")
    start = F.coalesce(F.sum(length).over(before), F.lit(0)) + F.col("head")
    spans = F.struct("place", F.when(F.col("loss"), F.struct(
        F.col("start").cast("int").alias("start"), F.col("body").alias("length"))).alias("span"), "turn")
    grouped = (turns.withColumn("start", start).groupBy("conv_id", "leaf_id", "rank")
               .agg(F.sort_array(F.collect_list(spans)).alias("turns")))
    out = grouped.select(
        F.col("conv_id.id").alias("conv_id"), "leaf_id", "rank", F.size("turns").cast("long").alias("n_turns"),
        F.array_join("turns.turn", "").alias("formatted"),
        F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_spans"))
    out._scratch = scratch
    return out


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, _, text = part.partition(SAYS)
        turns.append((unescaped(role), unescaped(text.removesuffix(END))))
    return turns


def conversation_report(rows: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted text: turns, their digest, and the size and
    digest of the text under the loss mask."""
    def work(block: pa.RecordBatch) -> dict:
        names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        out: dict[str, list] = {k: [] for k in names}
        for text, spans in zip(block.column("text").to_pylist(), block.column("loss_spans").to_pylist()):
            turns = read_back(text)
            every = "".join(f"{role}\n{said}\n" for role, said in turns)
            loss = "".join(unescaped(text[s["start"]:s["start"] + s["length"]]) for s in spans)
            for k, v in zip(names, (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss),
                                    hashlib.sha256(loss.encode()).hexdigest(), len(text))):
                out[k].append(v)
        return {"conv_id": block.column("conv_id"), **out}

    formatted = format_trees(linear_tree(rows)).select("conv_id", F.col("formatted").alias("text"), "loss_spans")
    return map_blocks(formatted, work, "conv_id LONG, n_turns LONG, turns_sha256 STRING, loss_chars LONG, "
                                       "loss_sha256 STRING, formatted_chars LONG")
