"""Shared prefixes of conversations as a trie, built by a van Emde Boas recursion.

A node of the trie is a distinct sequence of first turns ``(role, text)``;
every conversation that starts with it is a member. Naming a prefix by the
whole sequence of its turns costs the square of a conversation's length, so
names come from the van Emde Boas layout of depths instead: the depths of all
conversations are cut at half the greatest depth, the upper trie (depths up to
the cut) and the lower forests (below each named cut prefix) are cut again at
their halves, and so on down to single turns. A block of that recursion is
named from its two halves, bottom up, one level a pass, all forests of a level
at once in one table. A prefix of depth ``d`` is then the name of its cut
prefix grafted with its name inside its lower forest, which is the chain of
the blocks of the binary form of ``d``: at most ``log2 d`` blocks, never its
turns. Names are SHA-256 digests of an unambiguous coding, so two prefixes of
one depth share a name only when their turns are equal.

Totals are grafted upward the same way they arise: every member carries the
sums of its own path below a node (turn bytes, and those of the paths it is
the least member of) up to each node on its path, and a node adds what its
members carry. No node's subtree, member list or sequence of turns is ever
gathered in one place; the only per-node list is that of the ids of the
members that end there, for ``ends_sha256``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askmill.session import materialise

def _root() -> F.Column:
    """The name of the textless root, at depth 0."""
    return F.unhex(F.sha2(F.lit("root"), 256))


def _digest(binary) -> F.Column:
    return F.unhex(F.sha2(binary, 256))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, sym, n_bytes)``: turns of each conversation numbered from 0.

    Turns go by ``turn``, a null turn first; equal turns by role, then text.
    A null role or text is the empty string. ``sym`` names the pair
    ``(role, text)``; ``n_bytes`` is the text's UTF-8 length. Rows with a null
    ``conv_id`` belong to no conversation and are left out. Repeated rows are
    turns of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    sym = _digest(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))
    return rows.select(
        "conv_id",
        (F.row_number().over(order) - 1).cast("bigint").alias("pos"),
        sym.alias("sym"),
        F.octet_length("text").cast("bigint").alias("n_bytes"),
    )


def rebuild(turns: DataFrame, group: int = 5, kept: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversation ``c`` as the first ``h`` turns of ``c - c % group``, then its own after its first ``h``.

    ``h`` is the unsigned CRC-32 of ``c`` in decimal, modulo ``kept``; ``%``
    keeps the sign of ``c``, as SQL's does. Of a base conversation with fewer
    turns all are taken, of an absent one none. Returns ``(convs, rebuilt)``:
    ``convs`` holds ``(conv_id, length)`` for every conversation, turnless ones
    too, and ``rebuilt`` its turns ``(conv_id, pos, sym, n_bytes)``. A base is
    shared by at most ``group`` conversations, so no key is hotter than that.
    """
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    c = F.col("conv_id")
    convs = counts.select(
        "conv_id", "n", (c - c % group).alias("base"), (F.crc32(c.cast("string").cast("binary")) % kept).alias("h")
    )
    bases = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("keep"), "n"
    )
    head = (
        convs.select(F.col("conv_id").alias("c"), "base", "h")
        .join(turns.withColumnRenamed("conv_id", "base"), "base")
        .where(F.col("pos") < F.col("h"))
        .select(F.col("c").alias("conv_id"), "pos", "sym", "n_bytes")
    )
    tail = (
        turns.join(convs.select("conv_id", "h", "keep"), "conv_id")
        .where(F.col("pos") >= F.col("h"))
        .select("conv_id", (F.col("pos") - F.col("h") + F.col("keep")).alias("pos"), "sym", "n_bytes")
    )
    length = F.col("keep") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return convs.select("conv_id", length.alias("length")), head.unionByName(tail)


def blocks(rebuilt: DataFrame, levels: int) -> DataFrame:
    """``(conv_id, k, j, name)``: the name of turns ``[j * 2**k, (j + 1) * 2**k)`` of each conversation.

    Level ``k + 1`` names each pair of level ``k`` from its halves (a lone left
    half when the conversation ends inside it); each level is stored before
    the next is made from it.
    """
    level = materialise(rebuilt.select("conv_id", F.lit(0).alias("k"), F.col("pos").alias("j"), F.col("sym").alias("name")), "trie-blocks")
    every = [level]
    for k in range(1, levels + 1):
        pairs = level.groupBy("conv_id", F.shiftright("j", 1).alias("j")).agg(
            F.min_by("name", "j").alias("left"),
            F.when(F.count(F.lit(1)) == 2, F.max_by("name", "j")).otherwise(F.lit(bytearray())).alias("right"),
        )
        level = materialise(pairs.select("conv_id", F.lit(k).alias("k"), "j", _digest(F.concat("left", "right")).alias("name")), "trie-blocks")
        every.append(level)
    out = every[0]
    for level in every[1:]:
        out = out.unionByName(level)
    return out


def prefix_names(convs: DataFrame, named_blocks: DataFrame, levels: int) -> DataFrame:
    """``(conv_id, depth, name)`` for every depth from 1 to each conversation's length.

    Depth ``d`` is cut at its highest bit (the half depth of the recursion), and
    each lower part again at its own: the blocks of the set bits of ``d``, from
    the highest, are the cut prefix and the names inside the nested lower
    forests. Their names in that order, digested, name the prefix.
    """
    depths = convs.where("length > 0").select("conv_id", F.explode(F.sequence(F.lit(1), "length")).alias("depth"))
    cuts = depths.select(
        "conv_id",
        "depth",
        F.explode(F.expr(f"filter(sequence(0, {levels}), t -> (shiftright(depth, t) & 1) = 1)")).alias("k"),
    ).withColumn("j", F.expr("shiftleft(shiftright(depth, k + 1), 1)"))
    parts = cuts.join(named_blocks, ["conv_id", "k", "j"])
    chained = parts.groupBy("conv_id", "depth").agg(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("o"), "name"))).alias("parts"))
    joined = F.expr("aggregate(parts, cast('' as binary), (acc, p) -> concat(acc, p.name))")
    return chained.select("conv_id", "depth", _digest(joined).alias("name"))


def trie(conversations: DataFrame, group: int = 5, kept: int = 9) -> DataFrame:
    """One row per trie node of the rebuilt conversations (see :func:`rebuild`).

    Columns, all ``long`` but the last: ``conv_id`` (least member), ``depth``,
    ``parent_conv_id`` (null at the root), ``n_convs`` (members), ``n_children``,
    ``n_leaves`` (childless nodes of its subtree, itself included),
    ``saved_tokens`` (over its subtree, each node's ``n_convs - 1`` times the
    UTF-8 bytes of its last text; the root has no text) and ``ends_sha256``
    (SHA-256 of the comma-joined ids, ascending, of members of exactly its
    depth; of the empty string when none). An empty table gives no node; a
    table of turnless conversations only, the root alone. Other columns of
    ``conversations`` are ignored.
    """
    turns = ordered_turns(conversations)
    convs, rebuilt = rebuild(turns, group, kept)
    convs = materialise(convs, "trie-convs")
    rebuilt = materialise(rebuilt, "trie-turns")
    deepest = convs.agg(F.max("length")).first()[0] or 0
    levels = max(int(deepest).bit_length() - 1, 0)
    names = prefix_names(convs, blocks(rebuilt, levels), levels)
    # The path of each conversation: its node at each depth, the root included.
    path = names.unionByName(convs.select("conv_id", F.lit(0).cast("int").alias("depth"), _root().alias("name")))
    path = path.join(convs, "conv_id").join(
        rebuilt.select("conv_id", (F.col("pos") + 1).cast("int").alias("depth"), "n_bytes"), ["conv_id", "depth"], "left"
    )
    parents = names.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent")).unionByName(
        convs.select("conv_id", F.lit(1).alias("depth"), _root().alias("parent"))
    )
    path = materialise(
        path.join(parents, ["conv_id", "depth"], "left").select(
            "conv_id", "depth", "name", "parent", "length", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes")
        ),
        "trie-path",
    )
    ends = F.sort_array(F.collect_list(F.when(F.col("length") == F.col("depth"), F.col("conv_id"))))
    nodes = path.groupBy("depth", "name").agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.first("parent", ignorenulls=True).alias("parent"),
        F.sha2(F.array_join(F.transform(ends, lambda x: x.cast("string")), ","), 256).alias("ends_sha256"),
    )
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("name")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    nodes = materialise(
        nodes.join(children, ["depth", "name"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes"
    )
    # Graft upward: each member carries the sums of its path from a depth down to its end.
    flags = path.join(nodes.select("depth", "name", F.col("conv_id").alias("least"), "n_children"), ["depth", "name"])
    least = F.col("conv_id") == F.col("least")
    carried = flags.select(
        "depth",
        "name",
        "conv_id",
        F.col("n_bytes").alias("all_bytes"),
        F.when(least, F.col("n_bytes")).otherwise(0).alias("own_bytes"),
        F.when(least & (F.col("n_children") == 0), 1).otherwise(0).alias("leaf"),
    )
    below = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = carried.select(
        "depth", "name", *(F.sum(c).over(below).alias(c) for c in ("all_bytes", "own_bytes", "leaf"))
    )
    totals = carried.groupBy("depth", "name").agg(
        (F.sum("all_bytes") - F.sum("own_bytes")).alias("saved_tokens"), F.sum("leaf").alias("n_leaves")
    )
    parent_ids = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id")
    )
    out = nodes.join(totals, ["depth", "name"]).join(parent_ids, ["depth", "parent"], "left")
    return out.select(
        "conv_id",
        F.col("depth").cast("bigint").alias("depth"),
        "parent_conv_id",
        "n_convs",
        F.col("n_children").cast("bigint").alias("n_children"),
        F.col("n_leaves").cast("bigint").alias("n_leaves"),
        F.col("saved_tokens").cast("bigint").alias("saved_tokens"),
        "ends_sha256",
    )
