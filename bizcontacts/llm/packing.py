"""Conflict-constrained best-fit packing.

Documents are dealt at random over shards of bounded size, and each shard is packed on its own. Its open bins
lie in a list ordered by residual; every bin carries a bitmap of the sources and one of the
duplicate clusters it holds. A piece looks up the tightest bin that fits and goes on to the next
successor until one has neither its source nor its cluster, or opens a new bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizcontacts.llm.common import ship

CAPACITY = 4096
SHARD_ROWS = 4_000
PACKED = ("bin_id long, slot int, doc_id long, piece int, start long, length long, "
          "source string, cluster long")


class Packer:
    """Best-fit with conflicts; bins are (residual, number), in order."""

    def __init__(self, capacity: int):
        self.capacity, self.open = capacity, []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.counts: list[int] = []
        self.source_bit: dict = {}
        self.cluster_bit: dict = {}

    def bit(self, table: dict, key) -> int:
        """Bit of a key; a null key conflicts with nothing."""
        return 0 if key is None else 1 << table.setdefault(key, len(table))

    def place(self, length: int, source, cluster) -> tuple[int, int]:
        """(bin, slot) of a piece of ``length``, at most the capacity."""
        s, c = self.bit(self.source_bit, source), self.bit(self.cluster_bit, cluster)
        at = bisect_left(self.open, (length, -1))
        while at < len(self.open):
            residual, b = self.open[at]
            if not (self.sources[b] & s or self.clusters[b] & c):
                del self.open[at]
                break
            at += 1
        else:
            residual, b = self.capacity, len(self.counts)
            self.sources.append(0), self.clusters.append(0), self.counts.append(0)
        self.sources[b] |= s
        self.clusters[b] |= c
        self.counts[b] += 1
        if residual > length:
            insort(self.open, (residual - length, b))
        return b, self.counts[b] - 1


def pack_documents(items: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Bins of ``items`` (doc_id, length, source, cluster): one row per piece.

    Within a bin no two pieces share a source or a duplicate cluster. A text longer than the
    capacity gives full pieces with bins of their own and a remainder that is packed like the rest.
    Longest first, ties by id, source and cluster, so the result does not depend on row order.
    Null, zero and negative lengths take an empty slot of length 0 in some bin; null sources and clusters conflict with
    nothing; repeated rows are packed each; no rows give no bins. Shards are equal in size by hash
    of all columns and a number among equals is not needed: equal rows merely share a shard.
    """
    ship(items.sparkSession)
    rows = items.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.col("cluster").cast("long").alias("cluster"),
        F.greatest(F.coalesce(F.col("length").cast("long"), F.lit(0)), F.lit(0)).alias("length"))
    # whole rows are few bytes: the count costs one narrow scan
    shards = max(1, -(-rows.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "source", "length"), F.lit(shards)).cast("int"))

    def pack(key, frame: pd.DataFrame) -> pd.DataFrame:
        packer, out = Packer(capacity), []
        first = (1 << 40) * int(key[0])
        frame = frame.sort_values(["doc_id", "source", "cluster", "length"], kind="stable")
        pieces = []
        for doc, source, cluster, length in zip(
                frame["doc_id"].astype(object), frame["source"], frame["cluster"].astype(object), frame["length"],
                strict=True):
            doc, source, cluster = (None if pd.isna(x) else x for x in (doc, source, cluster))
            whole, rest = divmod(int(length), capacity)
            pieces += [(capacity, doc, k, k * capacity, source, cluster) for k in range(whole)]
            if rest or not whole:
                pieces.append((rest, doc, whole, whole * capacity, source, cluster))
        pieces.sort(key=lambda p: -p[0])
        for size, doc, k, start, source, cluster in pieces:
            b, slot = packer.place(size, source, cluster)
            out.append((first + b, slot, doc, k, start, size, source, cluster))
        made = pd.DataFrame(out, columns=["bin_id", "slot", "doc_id", "piece", "start", "length", "source", "cluster"])
        return made.astype({"doc_id": "Int64", "cluster": "Int64"})

    return rows.groupBy("shard").applyInPandas(pack, PACKED)


def document_items(docs: DataFrame) -> DataFrame:
    """Items of a documents table: length in words, source, and the cluster of equal texts.

    Words are runs between white space. A text without words has no cluster.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.size(F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != ""))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), words.cast("long").alias("length"),
                       F.when(F.length(F.trim(text)) > 0, F.xxhash64(F.lower(F.trim(text)))).alias("cluster"))
