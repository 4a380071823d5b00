"""Merkle manifest of a dataset: one hash tree per group of rows and one over the groups' roots.

Slot pivot: the children of a parent are spread by conditional aggregates into as many columns as
the tree fans out. Joining the columns gives the parent's hash; leaving out a child's own column
gives its siblings. Levels are built upward, one aggregation each; paths of siblings then go down
the same tables, so that a leaf's row needs no join of its own: level 0 carries the rows in its slots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizcontacts.llm.common import Scratch
from bizcontacts.llm.ranking import ranked

FANOUT = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
NO_PATH = "cast(array() as array<struct<left: string, right: string>>)"


def leaf_hash(values: Sequence[Column]) -> Column:
    """Hash of a row: each value as its byte count, a colon and the value; ``-`` for null."""
    framed = []
    for v in values:
        text = v.cast("string")
        framed.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*framed), 256)


def _slots(nodes: DataFrame, fanout: int, held: Sequence[str]) -> DataFrame:
    """One row per parent (tree, parent) with the columns ``held`` of its children, by slot."""
    slot = F.col("idx") % fanout
    spread = [F.any_value(F.when(slot == k, F.col(c)), True).alias(f"{c}{k}") for c in held for k in range(fanout)]
    return nodes.groupBy("tree", F.expr(f"idx div {fanout}").alias("parent")).agg(*spread)


def _lone() -> Column:
    """A parent whose only child is the only node of its tree's level: the child is the root."""
    return (F.col("parent") == 0) & F.col("hash1").isNull()


def _joined(slots: Sequence[int]) -> Column:
    return F.concat(F.lit(""), *[F.coalesce(F.col(f"hash{k}"), F.lit("")) for k in slots])


def _climb(nodes: DataFrame, scratch: Scratch, fanout: int) -> list[DataFrame]:
    """Slot tables of all levels, from the leaves up, until every tree has come to its root."""
    levels: list[DataFrame] = []
    while True:
        held = ["hash"] if levels or "item" not in nodes.columns else ["hash", "item"]
        levels.append(scratch.save(_slots(nodes, fanout, held), f"level{len(levels)}"))
        above = levels[-1].filter(~_lone())
        if above.isEmpty():
            return levels
        nodes = above.select("tree", F.col("parent").alias("idx"), F.sha2(_joined(range(fanout)), 256).alias("hash"))


def _roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, root) of all trees, which end at different levels."""
    parts = [t.filter(_lone()).select("tree", F.col("hash0").alias("root")) for t in levels]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def _descend(levels: list[DataFrame], tops: DataFrame, scratch: Scratch, fanout: int) -> DataFrame:
    """Leaves (tree, idx, hash, item) with the siblings on their way up: those of ``tops`` (tree, path,
    further columns) come last. Paths of all but the two lowest levels, a small share, are tables of their own."""
    carried = [c for c in tops.columns if c not in ("tree", "path")]
    below = None
    for level, table in reversed(list(enumerate(levels))):
        ended = table.filter(_lone()).join(tops, "tree")
        run = table.filter(~_lone())
        placed = ended if below is None else ended.unionByName(
            run.join(below.withColumnRenamed("idx", "parent"), ["tree", "parent"]))
        has_item = "item0" in table.columns
        children = []
        for k in range(fanout):
            siblings = F.struct(_joined(range(k)).alias("left"), _joined(range(k + 1, fanout)).alias("right"))
            path = F.when(_lone(), F.col("path")).otherwise(F.concat(F.array(siblings), "path"))
            children.append(F.struct(
                (F.col("parent") * fanout + k).alias("idx"), F.col(f"hash{k}").alias("hash"), path.alias("path"),
                *([F.col(f"item{k}").alias("item")] if has_item else [])))
        keep = ["child.idx", "child.path", *(["child.hash", "child.item"] if has_item else [])]
        below = (placed.select("tree", *carried, F.explode(F.array(*children)).alias("child"))
                 .filter("child.hash is not null").select("tree", *keep, *carried))
        if level > 1:
            below = scratch.save(below, "paths")
    return below


def merkle_manifest(rows: DataFrame, scratch: Scratch, columns: Sequence[str] = COLUMNS, order: str = "doc_id",
                    group: str = "source", carry: dict[str, Column] | None = None,
                    fanout: int = FANOUT) -> DataFrame:
    """One row per row: ``order`` column, leaf, subroot, root, path (left and right siblings by level), carried columns.

    A group's leaves ascend by ``order``, null first; leaves of equal order ascend by their hash, so
    repeated rows all count and equal ones are exchangeable. Groups ascend by name bytewise, the
    null group first. While more than one node is left, each run of ``fanout`` becomes one hash,
    a shorter last run too; a lone leaf is its group's root, and a lone group's root the root. Null
    and empty values hash apart; other columns are not read unless carried; no rows, no manifest.
    Every level is a table on shared storage, with a ``fanout``-th of the rows of the one below.
    """
    if fanout < 2:
        raise ValueError("a tree needs a fanout of two at least")
    item = [F.col(order).alias(order), *(c.alias(n) for n, c in (carry or {}).items())]
    leaves = rows.select(F.col(group).alias("grp"), F.col(order).alias("ord"),
                         leaf_hash([F.col(c) for c in columns]).alias("hash"), F.struct(*item).alias("item"))
    nodes = ranked(leaves, "grp", ["ord", "hash"], scratch).select(
        F.col("group_no").alias("tree"), "idx", "hash", "item")
    levels = _climb(nodes, scratch, fanout)
    subroots = scratch.save(_roots(levels), "subroots")
    top = _climb(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"),
                                 F.col("root").alias("hash"), F.struct("tree", F.col("root").alias("subroot")).alias("item")),
                 scratch, fanout)
    # the one root; an empty table has none
    start = _roots(top).withColumn("path", F.expr(NO_PATH))
    tops = _descend(top, start, scratch, fanout).select("item.tree", "item.subroot", "root", "path")
    sealed = _descend(levels, scratch.save(tops, "tops"), scratch, fanout)
    named = [order, *(carry or {})]
    return sealed.select(*[F.col(f"item.{n}").alias(n) for n in named],
                         F.col("hash").alias("leaf"), "subroot", "root", "path")


def folded_root(leaf: Column | str, path: Column | str = "path") -> Column:
    """Root that a leaf and the siblings of its path lead to."""
    start = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(path: Column | str = "path") -> Column:
    """Hash of all siblings of a path, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def tampered_leaf(columns: Sequence[str] = COLUMNS, key: str = "doc_id", text: str = "text") -> Column:
    """Leaf of a row whose id has an even crc32 after its text lost all line breaks; null for other rows."""
    hit = F.crc32(F.col(key).cast("string").cast("binary")) % 2 == 0
    bare = F.replace(text, F.lit("\n"), F.lit(""))
    return F.when(hit, leaf_hash([bare if c == text else F.col(c) for c in columns]))
