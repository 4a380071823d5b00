"""Connected components of a link table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizcontacts.llm.common import Scratch


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
    return tuple(row)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest id reachable.

    Each round hangs the neighbours of a node on the smallest of them, first the larger ones, then
    the smaller ones; the number of rounds grows with the logarithm of the longest chain. The
    smallest neighbour comes from a pre-aggregated count per node, and joins may split, so a node
    that holds a third of all links is no hot task. Every round is a table on shared storage.
    Null ids and self links are dropped; no links give an empty result.
    """
    pairs = edges.filter(F.col("a") != F.col("b"))
    now = scratch.save(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                       "links")
    mark = _print(now)
    while mark[0]:
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (both.join(low, "u").filter(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                         F.col("m").alias("v"))
                 .filter(F.col("u") != F.col("v")).distinct())
        after = scratch.save(small, "links")
        scratch.drop(now)
        now, before = after, mark
        mark = _print(now)
        if mark == before:
            break
    hung = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return hung.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
