"""Merkle manifest of a dataset by nested-struct rollup.

Every row becomes a leaf, ranked within its source. A rank is read in digits of base FAN_OUT. Rows are dealt once by
source and block (DIGITS digits below the block's number); inside a block the digits are grouped away one after the
other, each grouping nesting the structs below, without another shuffle. The roots of blocks are the leaves of the next round, and
so on until each source has one block. On the way back every nested block meets the path above it by a union and a
grouping on the block's key, and transform and explode turn the nested structs into one row with a proof per leaf.
The roots of the sources form a second manifest with one group. A block holds FAN_OUT ** DIGITS leaves at most,
whatever a source holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from urlvane.llm.shared import written

FAN_OUT = 16
DIGITS = 3
_DIGEST = 64  # characters of a digest
STEP = "array<struct<left: string, right: string>>"


def field(value: Column | str) -> Column:
    """A value as it is hashed: `-` for null, else its UTF-8 length, a colon, and itself."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column | str) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(node: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, node, lambda below, step: F.sha2(F.concat(step["left"], below, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def ranked(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add idx (rank in the group from 0) and n (rows of the group) by a distributed sort.

    Rows are sorted into ranges; within a range the rank is the place, and a table with one row per range and group
    gives what lies before it. No window runs over a group's rows.
    """
    ordered = nodes.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    ordered = written(ordered.withColumns(
        {"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ordered")
    sizes = ordered.groupBy("part", group).agg(F.count("*").alias("size"), F.min("at").alias("first"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col("part").alias("_part"), F.col(group).alias("_group"), "first",
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy(group)).alias("n"))
    matched = ordered.join(sizes, (F.col("part") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return matched.select(*nodes.columns, (F.col("at") - F.col("first") + F.col("before")).alias("idx"), "n")


def _grows(n: Column, level: int) -> Column:
    """Whether a group of n nodes has a level of that number (from 1): more than one node lies below it."""
    return n > FAN_OUT ** (level - 1)


def _rolled(nodes: DataFrame, group: str) -> DataFrame:
    """Rows (group, block, n, node, kids): nested structs of each block of rows (group, idx, n, node, extra)."""
    digits = {f"d{i}": F.expr(f"(idx div {FAN_OUT ** i}) % {FAN_OUT}") for i in range(DIGITS)}
    rows = nodes.withColumns({**digits, "block": F.expr(f"idx div {FAN_OUT ** DIGITS}")}).repartition(group, "block")
    child = F.struct("d0", "node", "extra")
    for level in range(1, DIGITS + 1):
        upper = [f"d{i}" for i in range(level, DIGITS)]
        rows = rows.groupBy(group, "block", "n", *upper).agg(F.sort_array(F.collect_list(child)).alias("kids"))
        joined = F.array_join(F.transform("kids", lambda k: k["node"]), "")
        rows = rows.withColumn("node", F.when(_grows(F.col("n"), level), F.sha2(joined, 256)).otherwise(F.col("kids")[0]["node"]))
        if upper:
            child = F.struct(upper[0], "node", "kids")
    return rows


def _unrolled(blocks: DataFrame, above: DataFrame, group: str) -> DataFrame:
    """Rows (group, idx, node, extra, path, top) of rolled blocks and the rows (group, idx, path, top) of their nodes."""
    missing = lambda df, name: F.lit(None).cast(df.schema[name].dataType).alias(name)
    nested = blocks.select(group, "block", "n", "kids", missing(above, "path"), missing(above, "top"))
    paths = above.select(group, F.col("idx").alias("block"), missing(blocks, "n"), missing(blocks, "kids"), "path", "top")
    rows = nested.unionByName(paths).groupBy(group, "block").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "path", "top")])
    place = F.col("block")
    for level in range(DIGITS, 0, -1):
        joined = F.array_join(F.transform("kids", lambda k: k["node"]), "")
        rows = rows.withColumn("joined", joined).select(
            group, "n", "path", "top", "joined", place.alias("place"), F.explode("kids").alias("kid"))
        digit = F.col(f"kid.d{level - 1}")
        step = F.struct(
            F.substring("joined", F.lit(1), (digit * _DIGEST).cast("int")).alias("left"),
            F.substring("joined", ((digit + 1) * _DIGEST + 1).cast("int"), F.lit(FAN_OUT * _DIGEST)).alias("right"))
        path = F.when(_grows(F.col("n"), level), F.concat(F.array(step), "path")).otherwise(F.col("path"))
        below = [F.col("kid.kids").alias("kids")] if level > 1 else [F.col("kid.node").alias("node"), F.col("kid.extra").alias("extra")]
        rows = rows.select(group, "n", path.alias("path"), "top", (F.col("place") * FAN_OUT + digit).alias("idx"), *below)
        place = F.col("idx")
    return rows


def proofs(nodes: DataFrame, group: str, crown: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (group, idx, node, extra, path, top) for rows (group, idx, n, node, extra).

    `crown` turns one row (group, node) per group into rows (group, path, top): what lies above the group's root.
    """
    rounds = [written(_rolled(nodes, group), "blocks")]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > FAN_OUT ** DIGITS:
        size = FAN_OUT ** DIGITS
        most = -(-most // size)
        up = rounds[-1].select(group, F.col("block").alias("idx"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), "node", F.lit(None).cast("int").alias("extra"))
        rounds.append(written(_rolled(up, group), "blocks"))
    found = crown(rounds[-1].select(group, "node")).withColumn("idx", F.lit(0).cast("long"))
    for blocks in reversed(rounds[1:]):
        found = _unrolled(blocks, found, group)
    return _unrolled(rounds[0], found, group)


def manifest(docs: DataFrame, fields: list[str], source: str = "source", doc_id: str = "doc_id",
             altered: Column | None = None) -> DataFrame:
    """Return per row doc_id, leaf, altered_leaf, subroot, root and path.

    The leaf hashes the named fields in order; `altered` is another leaf to check against the same path (null: none).
    path: the digests left and right of the row's node, level by level from its leaf to the root; levels without
    siblings have empty texts. Leaves ascend by id, a null id first, rows of equal ids by leaf; equal rows are leaves of their
    own. A null source is a source, ordered first. Other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(source).alias("source"), F.col(doc_id).alias("doc_id"), leaf(*fields).alias("node"),
        (F.lit(None).cast("string") if altered is None else altered).alias("altered"))
    leaves = ranked(written(rows, "leaves"), "source", ["doc_id", "node"])
    leaves = leaves.select("source", "idx", "n", "node", F.struct("doc_id", "altered").alias("extra"))

    def crown(tops: DataFrame) -> DataFrame:
        sources = ranked(tops.withColumn("all", F.lit(0)), "all", ["source"])
        nodes = sources.select("all", "idx", "n", "node", F.struct("source").alias("extra"))
        found = proofs(nodes, "all", lambda one: one.select(
            "all", F.array().cast(STEP).alias("path"), F.col("node").alias("top")))
        return found.select("extra.source", "path", F.struct(F.col("node").alias("subroot"), F.col("top").alias("root")).alias("top"))

    return proofs(leaves, "source", crown).select(
        "extra.doc_id", F.col("node").alias("leaf"), F.col("extra.altered").alias("altered_leaf"), "top.subroot", "top.root", "path")


def checked(proven: DataFrame) -> DataFrame:
    """The rows of `manifest` with digests of the proofs and the roots that leaves, altered ones first, lead to."""
    folded = fold(F.coalesce("altered_leaf", "leaf"), F.col("path"))
    rows = proven.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_ascii(text: Column | str) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
