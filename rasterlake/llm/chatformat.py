"""Chat formatting: reply trees to single conversations with a loss mask.

A tree's nodes learn all their ancestors by iterative self-joins (each doubles
the distance), leaves are ranked by the score of their path, and each chosen
path is written as one conversation. Formatted text and mask are read back
without any other column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

START, END = "<|im_start|>", "<|im_end|>"
TURN_END = END + "\n"


def escape(text: Column) -> Column:
    r"""``\`` becomes ``\\`` and ``<|`` becomes ``<\|``: no control string is left, and the map can be undone."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    r"""As ``escape``; a line feed becomes ``<\n>``, since one ends the role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def chain(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) as trees in which each turn answers the one before.

    Ordered by turn, then role, then text, nulls first; every repeated row is a
    turn. Texts may be of any length; other columns are dropped.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    pos = F.row_number().over(order).cast("bigint")
    return turns.select("conv_id", pos.alias("node"), F.when(pos > 1, pos - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def best_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """(conv_id, leaf, node, depth) of the ``top`` best root-to-leaf paths of each conversation.

    ``nodes``: conv_id, node (unique in its conversation), parent (null: a
    root), score (null: 0). A path's score is the sum of its nodes'; ties go to
    the longer path, then the smaller leaf. A node whose parent is missing, or
    whose chain of parents never ends, is on no path.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "paths")
    base = nodes.select(F.col("conv_id").alias("c"), "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    # up: the ancestor 2^k nodes above (null: the chain ends before); hops and total: nodes and score below it
    first = base.select("c", "node", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("hops"), F.col("score").alias("total"), F.col("parent").isNull().alias("rooted"))
    jump = scratch.save(first, "jump0")
    levels, limit = [jump], int(nodes.count()).bit_length() + 1
    while len(levels) <= limit and not jump.filter("up is not null").isEmpty():
        far = jump.select(*(F.col(x).alias(f"f_{x}") for x in jump.columns))
        live = jump.filter("up is not null")
        joined = live.join(far, live["c"].eqNullSafe(far["f_c"]) & (live["up"] == far["f_node"]), "left")
        moved = joined.select(
            "c", "node", F.col("f_up").alias("up"),
            (F.col("hops") + F.coalesce("f_hops", F.lit(0))).alias("hops"),
            (F.col("total") + F.coalesce("f_total", F.lit(0.0))).alias("total"),
            F.coalesce("f_rooted", F.lit(False)).alias("rooted"),
        )
        jump = scratch.save(moved.unionByName(jump.filter("up is null")), f"jump{len(levels)}")
        levels.append(jump)
    parents = base.filter("parent is not null").select(F.col("c").alias("pc"), F.col("parent").alias("pn")).distinct()
    rooted = jump.filter("rooted and up is null")
    leaves = rooted.join(parents, rooted["c"].eqNullSafe(parents["pc"]) & (rooted["node"] == parents["pn"]), "left_anti")
    if top == 1:
        best = leaves.groupBy("c").agg(F.max(F.struct("total", "hops", F.bitwise_not("node").alias("inverse"))).alias("b"))
        chosen = best.select("c", F.bitwise_not("b.inverse").alias("leaf"))
    else:
        rank = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("total"), F.desc("hops"), "node"))
        chosen = leaves.withColumn("r", rank).filter(F.col("r") <= top).select("c", F.col("node").alias("leaf"))
    paths = chosen.select("c", "leaf", F.col("leaf").alias("node"))
    for k, level in reversed(list(enumerate(levels[:-1] or levels))):
        hop = level.filter("up is not null").select(F.col("c").alias("hc"), F.col("node").alias("hn"), "up")
        moved = paths.join(hop, paths["c"].eqNullSafe(hop["hc"]) & (paths["node"] == hop["hn"])).select("c", "leaf", F.col("up").alias("node"))
        paths = scratch.save(paths.unionByName(moved), f"paths{k}")
    depths = jump.select(F.col("c").alias("dc"), F.col("node").alias("dn"), F.col("hops").alias("depth"))
    return paths.join(depths, paths["c"].eqNullSafe(depths["dc"]) & (paths["node"] == depths["dn"])).select(F.col("c").alias("conv_id"), "leaf", "node", "depth")


def format_chats(nodes: DataFrame, top: int = 1, loss_roles: tuple = ("assistant",)) -> DataFrame:
    """conv_id, leaf, formatted, loss_spans: one row per chosen path.

    ``formatted`` is ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn with both
    parts escaped; ``loss_spans`` are (start, length) of the texts under the
    loss mask in UTF-8 bytes of ``formatted``. Null role and text are empty; an
    empty table gives an empty result. A conversation is one value, so its
    turns meet in one task; everything before works on single turns.
    """
    paths = best_paths(nodes, top)
    said = nodes.select(
        F.col("conv_id").alias("nc"), F.col("node").alias("nn"),
        F.concat(F.lit(START), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n")).alias("head"),
        escape(F.coalesce("text", F.lit(""))).alias("body"),
        F.coalesce(F.col("role").isin(*loss_roles), F.lit(False)).alias("loss"),
    )
    turns = paths.join(said, paths["conv_id"].eqNullSafe(said["nc"]) & (paths["node"] == said["nn"]))
    order = Window.partitionBy("conv_id", "leaf").orderBy("depth")
    size = F.octet_length("head") + F.octet_length("body") + len(TURN_END)
    turns = turns.withColumn("begin", F.sum(size.cast("bigint")).over(order) - size + F.octet_length("head"))
    turns = turns.groupBy("conv_id", "leaf").agg(F.array_sort(F.collect_list(F.struct("depth", "head", "body", "loss", "begin"))).alias("t"))
    span = lambda x: F.struct(x["begin"].cast("int").alias("start"), F.octet_length(x["body"]).alias("length"))
    return turns.select(
        "conv_id", "leaf",
        F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(TURN_END))), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["loss"]), span).alias("loss_spans"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, leaf, turns (role, text), loss_texts, formatted: parsed from ``formatted`` and ``loss_spans`` only."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda p: p != "")
    body = lambda p: F.substring(p, len(START) + 1, F.length(p))
    turn = lambda b: F.struct(
        unescape_role(F.substring_index(b, "\n", 1)).alias("role"),
        unescape(F.substring(b, F.locate("\n", b) + 1, F.length(b))).alias("text"),
    )
    raw = F.encode("formatted", "UTF-8")
    loss = F.transform("loss_spans", lambda s: unescape(F.decode(F.substring(raw, s["start"] + 1, s["length"]), "UTF-8")))
    return formatted.select("conv_id", "leaf", F.transform(pieces, lambda p: turn(body(p))).alias("turns"), loss.alias("loss_texts"), "formatted")


def chat_digests(turns: DataFrame) -> DataFrame:
    """Format linear conversations (conv_id, turn, role, text), write them, read them back and digest what was read.

    One row per conv_id, null one included: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars. Null role and text are empty; equal
    turns are in order of role and text, nulls first, and repeated rows are each a
    turn; an empty table gives an empty result. Texts may be of any length, a
    conversation being one value; other columns are not read.
    """
    spark = turns.sparkSession
    scratch = Scratch(spark, "chat")
    nodes = scratch.save(chain(turns), "nodes")
    written = scratch.save(format_chats(nodes), "formatted")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read_chats(written).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
