"""A Merkle manifest of a table: leaf digests, per-group subroots, one root, and a proof per row.

Built by time-forward processing: the nodes of a level are labelled
``(group, index)``, and the digests of each level are delivered to their
parents ``(group, index div 2)`` by a shuffle ordered by that label, the
distributed form of the external priority queue; a parent is made as soon as
its children arrive, one level a pass, all groups at once. What a node needs
for its proof (the other digest of its run and its side) is kept with the
level. A reversed sweep, from the root down, then hands each node the suffix
of its proof (the steps from its parent upward), so that a leaf ends with its
whole path of siblings without any node's subtree being gathered.

Digests are lowercase hex SHA-256; a run of two nodes becomes the digest of
their hex texts joined, a run of one the digest of its text, and a group of
one node is that node itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askmill.session import materialise

STEP = "array<struct<sib:string,right:boolean>>"


def field(value: Column, integer: bool = False) -> Column:
    """``-`` for a null, else the UTF-8 byte count, ``:`` and the value (integers in decimal)."""
    text = value.cast("string") if integer else value
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def numbered(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``idx``: the place from 0 of each row in its group, in ``order``.

    A global sort by ranges, then counts per partition and group, whose running
    sums give each partition's first place: a hot group spreads over as many
    tasks as its rows fill, and only the small table of counts is summed.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group).asc_nulls_first(), *order]
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = materialise(ranged.withColumn("__pid", F.spark_partition_id()).withColumn("__mid", F.monotonically_increasing_id()), "merkle-ids")
    counts = placed.groupBy("__pid", group).agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__first"))
    before = Window.partitionBy(group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    c = counts.select(F.col("__pid").alias("__cp"), F.col(group).alias("__cg"), "__offset", "__first")
    cond = (F.col("__pid") == F.col("__cp")) & F.col(group).eqNullSafe(F.col("__cg"))
    return placed.join(c, cond).select(
        *[F.col(f"`{name}`") for name in rows.columns], (F.col("__offset") + F.col("__mid") - F.col("__first")).alias("idx")
    )


def tree(nodes: DataFrame, group: str) -> tuple[DataFrame, list[DataFrame]]:
    """The top of each group and the levels below it.

    ``nodes`` holds ``(group, idx, hex)``, indexes from 0 in each group.
    Returns ``(tops, levels)``: ``tops`` is ``(group, hex)``; each level is
    ``(group, level, idx, sib, right)``: the other digest of the node's run
    (null in a run of one) and whether the node is its right one. Groups of one
    node have no level.
    """
    size = nodes.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("cnt"))
    now = materialise(nodes.join(size, F.col(group).eqNullSafe(F.col("__g"))).select(group, "idx", "hex", "cnt"), "merkle-level")
    tops, levels, level = [], [], 0
    while True:
        done = now.where("cnt = 1").select(group, "hex")
        tops.append(done)
        rest = now.where("cnt > 1")
        if rest.isEmpty():
            break
        parent = F.shiftright("idx", 1)
        runs = rest.groupBy(group, parent.alias("pidx"), "cnt").agg(
            F.min_by("hex", "idx").alias("left"), F.when(F.count(F.lit(1)) == 2, F.max_by("hex", "idx")).alias("right")
        )
        r = runs.select(F.col(group).alias("__g"), F.col("pidx").alias("__p"), "left", "right")
        joined = rest.join(r, F.col(group).eqNullSafe(F.col("__g")) & (parent == F.col("__p")))
        is_right = (F.col("idx") % 2) == 1
        levels.append(
            materialise(
                joined.select(
                    group, F.lit(level).alias("level"), "idx", F.when(is_right, F.col("left")).otherwise(F.col("right")).alias("sib"), is_right.alias("right")
                ),
                "merkle-steps",
            )
        )
        made = runs.select(
            group,
            F.col("pidx").alias("idx"),
            F.sha2(F.concat("left", F.coalesce("right", F.lit(""))), 256).alias("hex"),
            F.shiftright(F.col("cnt") + 1, 1).alias("cnt"),
        )
        now = materialise(made, "merkle-level")
        level += 1
    out = tops[0]
    for top in tops[1:]:
        out = out.unionByName(top)
    return out, levels


def suffixes(levels: list[DataFrame], group: str, above: DataFrame | None = None) -> DataFrame:
    """``(group, idx, path)`` of the bottom level: its steps upward, its own first, then those of ``above``.

    The sweep runs from the top level down, each level taking the suffix of
    its parent from the level above; a node whose parent is the top of its
    group takes ``above``'s ``(group, path)`` of that group, or nothing.
    """
    carried = None
    tops = above.select(F.col(group).alias("__t"), F.col("path").alias("__top")) if above is not None else None
    for depth in range(len(levels) - 1, -1, -1):
        step = levels[depth]
        own = F.array(F.struct(F.col("sib"), F.col("right")))
        tail = [F.lit(None).cast(STEP)]
        if carried is not None:
            up = carried.select(F.col(group).alias("__g"), F.col("idx").alias("__p"), F.col("path").alias("__up"))
            step = step.join(up, F.col(group).eqNullSafe(F.col("__g")) & (F.shiftright("idx", 1) == F.col("__p")), "left")
            tail = [F.col("__up")]
        if tops is not None:
            step = step.join(tops, F.col(group).eqNullSafe(F.col("__t")), "left")
            tail.append(F.col("__top"))
        path = F.concat(own, F.coalesce(*tail, F.array().cast(STEP)))
        carried = materialise(step.select(group, "idx", path.alias("path")), "merkle-path")
    if carried is None:
        raise ValueError("no level")
    return carried


def fold(start: Column, path: Column) -> Column:
    """The top reached from ``start`` by the steps of ``path``."""
    return F.aggregate(
        path,
        start,
        lambda acc, s: F.sha2(
            F.when(s["sib"].isNull(), acc).when(s["right"], F.concat(s["sib"], acc)).otherwise(F.concat(acc, s["sib"])), 256
        ),
    )


def manifest(docs: DataFrame, tamper_every: int = 7) -> DataFrame:
    """One row per document of ``(doc_id, source, lang, n_chars, text)``; other columns are ignored.

    ``leaf``: the digest of the five fields (see :func:`field`). Leaves of one
    ``lang`` ascend by ``doc_id`` (null first; equal ids, repeated rows too, by
    leaf) and give the lang's ``subroot``; subroots by ``lang`` (null first,
    bytewise) give ``root``. ``proof_sha256`` digests the siblings on the way
    up, leaf side first (none: the empty string's digest). Where
    ``tamper_every`` divides the CRC-32 of the decimal id, ``n_chars`` is
    raised by one (a null stays null) and ``folded_root`` is recomputed from
    that leaf with the original siblings; ``verified`` tells whether it still
    equals ``root``. An empty table gives no row.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.col("n_chars").cast("bigint").alias("n_chars"),
        F.col("text").cast("string").alias("text"),
    )

    def leaf(n_chars: Column) -> Column:
        body = F.concat(
            field(F.col("doc_id"), True), field(F.col("source")), field(F.col("lang")), field(n_chars, True), field(F.col("text"))
        )
        return F.sha2(body, 256)

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % tamper_every == 0
    leaves = rows.select(
        "doc_id",
        "lang",
        leaf(F.col("n_chars")).alias("leaf"),
        F.when(tampered, leaf(F.col("n_chars") + 1)).otherwise(leaf(F.col("n_chars"))).alias("changed"),
    )
    leaves = numbered(leaves, "lang", [F.col("doc_id").asc_nulls_first(), F.col("leaf")])
    subroots, lang_levels = tree(leaves.select("lang", "idx", F.col("leaf").alias("hex")), "lang")
    subroots = materialise(subroots.withColumnRenamed("hex", "subroot"), "merkle-subroots")
    top = numbered(subroots.withColumn("__all", F.lit(0)), "__all", [F.col("lang").asc_nulls_first()])
    roots, root_levels = tree(top.select("__all", "idx", F.col("subroot").alias("hex")), "__all")
    found = roots.first()  # one digest, or none of an empty table
    if found is None:
        return docs.sparkSession.createDataFrame(
            [], "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        )
    root = F.lit(found["hex"])
    # Suffixes of the subroots in the tree of langs, then of the leaves in each lang's tree.
    if root_levels:
        upper = suffixes(root_levels, "__all").join(top.select("idx", "lang"), "idx").select("lang", "path")
    else:
        upper = subroots.select("lang", F.array().cast(STEP).alias("path"))
    if lang_levels:
        paths = suffixes(lang_levels, "lang", upper)
        leaf_paths = leaves.join(
            paths.select(F.col("lang").alias("__l"), F.col("idx").alias("__i"), "path"),
            F.col("lang").eqNullSafe(F.col("__l")) & (F.col("idx") == F.col("__i")),
            "left",
        )
    else:
        leaf_paths = leaves.withColumn("path", F.lit(None).cast(STEP))
    # A lang of one leaf has no level of its own: its path is that of its subroot.
    with_upper = leaf_paths.join(
        upper.select(F.col("lang").alias("__u"), F.col("path").alias("__upper")), F.col("lang").eqNullSafe(F.col("__u")), "left"
    )
    path = F.coalesce(F.col("path"), F.col("__upper"), F.array().cast(STEP))
    sibs = F.transform(F.filter(path, lambda s: s["sib"].isNotNull()), lambda s: s["sib"])
    out = (
        with_upper.join(subroots.select(F.col("lang").alias("__s"), "subroot"), F.col("lang").eqNullSafe(F.col("__s")))
        .select(
            "doc_id",
            "leaf",
            "subroot",
            root.alias("root"),
            F.sha2(F.array_join(sibs, ""), 256).alias("proof_sha256"),
            fold(F.col("changed"), path).alias("folded_root"),
        )
    )
    return out.withColumn("verified", F.col("folded_root") == root)
