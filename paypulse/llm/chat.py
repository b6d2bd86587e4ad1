"""Chat formatting of reply trees, with DataFrame functions only.

Iterative self-joins enumerate the paths from the roots to the leaves, doubling the known distance each round; branches
are ranked by the sum of their turns' scores; each chosen path is formatted as one conversation, with the spans of its
loss mask. Formatted text can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paypulse.llm.shared import cut

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LOSS_ROLE = "assistant"
#: The first character of each control string, where the rest follows. A backslash is put between them.
_CONTROL = r"(<(?=\|(?:turn|text|end|im_start|im_end|endoftext)\|>|/?s>)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    """``text`` without control strings: backslashes are doubled, and one splits each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reply_paths(nodes: DataFrame) -> DataFrame:
    """(leaf, node, distance) for every leaf of ``nodes`` (node, parent) and each node above it, itself included.

    Nodes are distinct and not null; a parent that is null or absent ends the path. Round k knows the nodes up to
    distance 2^k - 1 and, for each node, the one 2^k above, so the rounds are logarithmic in the depth. A cycle of
    parents has no leaf; one that a leaf hangs on is an error.
    """
    nodes = cut(nodes.select("node", "parent"))
    jumps = nodes.select("node", F.col("parent").alias("up")).join(
        nodes.select(F.col("node").alias("up")), "up", "left_semi"
    ).select("node", "up")
    leaves = nodes.join(nodes.select(F.col("parent").alias("node")), "node", "left_anti")
    paths = leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("distance"))
    jumps, known, most = cut(jumps), 1, nodes.count()
    while True:
        further = cut(paths.join(jumps, "node").select(
            "leaf", F.col("up").alias("node"), (F.col("distance") + known).alias("distance")
        ))
        if further.isEmpty():
            return paths
        if known > most:
            raise ValueError("parents form a cycle")
        paths = paths.unionByName(further)
        above = jumps.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumps, known = cut(jumps.join(above, "up").select("node", F.col("top").alias("up"))), 2 * known


def format_chats(messages: DataFrame, best: int = 1) -> DataFrame:
    """The ``best`` branches of each tree as (tree, leaf, branch_rank, branch_score, formatted, loss_spans).

    ``messages``: tree, node, parent, role, text, score (extra columns are not read); null roles and texts are empty, a
    null score is 0. Branches are ranked by the sum of their scores, the smaller leaf first among equals. ``loss_spans``
    are the places of the assistant's texts in ``formatted``, in code points from 0, end exclusive. A branch has to fit
    into one row. An empty table gives an empty result.
    """
    paths = reply_paths(messages).withColumnRenamed("node", "member")
    own = messages.select(
        F.col("node").alias("member"), "tree", F.coalesce("score", F.lit(0)).alias("score"),
        escape(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"),
        (F.col("role") == LOSS_ROLE).alias("counts"),
    )
    scores = paths.join(own.select("member", "tree", "score"), "member").groupBy("tree", "leaf").agg(
        F.sum("score").alias("branch_score")
    )
    ranking = Window.partitionBy("tree").orderBy(F.col("branch_score").desc(), "leaf")
    chosen = scores.withColumn("branch_rank", F.row_number().over(ranking)).where(F.col("branch_rank") <= best)
    turns = paths.join(chosen.select("leaf", "branch_rank", "branch_score"), "leaf").join(
        own.drop("score"), "member"
    )
    head = F.concat(F.lit(TURN), "role", F.lit(TEXT))
    turns = turns.withColumn("segment", F.concat(head, "text", F.lit(END)))
    so_far = Window.partitionBy("leaf").orderBy(F.col("distance").desc()).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("segment").cast("long")).over(so_far), F.lit(0)) + F.length(head)
    turns = turns.withColumn("start", start)
    span = F.struct(F.col("start"), (F.col("start") + F.length("text")).alias("end"))
    gathered = turns.groupBy("tree", "leaf", "branch_rank", "branch_score").agg(
        F.sort_array(F.collect_list(F.struct(-F.col("distance"), "segment"))).alias("segments"),
        F.sort_array(F.collect_list(F.when(F.col("counts"), span))).alias("loss_spans"),
    )
    formatted = F.array_join(F.transform("segments", lambda s: s["segment"]), "")
    return gathered.select("tree", "leaf", "branch_rank", "branch_score", formatted.alias("formatted"), "loss_spans")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    segments = F.split(formatted, r"<\|turn\|>", -1)

    def turn(segment: Column) -> Column:
        parts = F.split(segment, r"<\|text\|>", 2)
        text = parts[1].substr(F.lit(1), F.length(parts[1]) - len(END))
        return F.struct(unescape(parts[0]).alias("role"), unescape(text).alias("text"))

    return F.transform(F.slice(segments, 2, F.size(segments)), turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask, one span after another."""
    pieces = F.transform(
        spans, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    )
    return F.array_join(pieces, "")


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as reply trees without branches: each turn replies to the one before it.

    Equal turn numbers are ordered by role and text; null ones come first. A null conversation id is one of its own.
    """
    tree = F.concat(F.when(F.col("conv_id").isNull(), "n").otherwise("v"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "turn", "role", "text", tree.alias("tree")).withColumn(
        "n", F.row_number().over(order)
    )
    name = lambda n: F.concat("tree", F.lit(":"), n.cast("string"))
    return numbered.select(
        "conv_id", "tree", name(F.col("n")).alias("node"),
        F.when(F.col("n") > 1, name(F.col("n") - 1)).alias("parent"), "role", "text", F.lit(0.0).alias("score"),
    )
