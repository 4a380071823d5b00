"""Exact Jaccard join of word shingles as a metric-space join.

The distance 1 - Jaccard is a metric. Documents that share a shingle of their prefixes form a
region (two documents that link always share one). Each region takes pivots and measures its
documents against them: within the radius a document links to the pivot; regions whose documents
have come together need no more. Before any text is fetched, a bit sketch bounds the distance of a pair
from below: it maps sets to bits linearly, so the bits that differ are never more than the shingles
that differ. The others are cut into the Voronoi cells of their pivots, each
cell extended by the documents that the triangle inequality lets reach into it, and only documents
of different components within a cell and a distance window are compared. Regions that stay large
get further pivots first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizcontacts.llm.common import Scratch, map_batches, ship, word_hashes
from bizcontacts.llm.components import components

SHINGLE = 5
PERCENT = 80
# a shingle in more prefixes than this counts as frequent and is moved back in the order; the bar
# rises where more than FREQUENT shingles would pass it, so what is broadcast stays bounded
COMMON = 2
FREQUENT = 1_000_000
# regions above this size get further pivots, this many rounds at most, before documents are compared
LARGE = 24
ROUNDS = 2
# 64-bit words of the sketch
SKETCH = 16
# ids broadcast at most; more of them are joined by shuffle
BROADCAST_IDS = 1_000_000
_MIX = [np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle, no words none."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return words
    span = min(size, n)
    out = np.full(n - span + 1, span, np.uint64)
    for k in range(span):
        out = (out ^ words[k:n - span + 1 + k]) * _MIX[k % 5]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """Shingles of a set of ``n`` among which every linked set, in one common order, has one too."""
    return n - -(-percent * n // 100) + 1


def prefix(shingles: np.ndarray, frequent: np.ndarray, order: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles in the common order: by hash, the frequent ones last by frequency."""
    size = prefix_size(len(shingles), percent)
    if not len(frequent):
        return shingles[:size]
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    late = frequent[at] == shingles
    first = shingles[~late][:size]
    if len(first) < size:
        back = shingles[late][np.argsort(order[at[late]], kind="stable")]
        first = np.concatenate([first, back[:size - len(first)]])
    return first


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of 64 * SKETCH bins."""
    bins = (shingles * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 10)
    odd = np.bincount(bins.astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _differ(x: str, y: str) -> Column:
    """Bits that differ between two sketch columns."""
    total = F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0]))
    for k in range(1, SKETCH):
        total = total + F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k]))
    return total


def _near_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose doc_id is in ``ids``, broadcast only if counted to be few."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


class MetricJoin:
    """One run of the join over (doc_id, text)."""

    def __init__(self, docs: DataFrame, scratch: Scratch, percent: int, size: int):
        self.docs, self.scratch, self.percent, self.size = docs, scratch, percent, size
        self.radius = 1 - percent / 100
        self.parts: DataFrame | None = None

    def sets(self) -> DataFrame:
        """(doc_id, n, key, sketch, prefix) of every document; the key tells equal sets."""
        size, percent = self.size, self.percent
        none = np.zeros(0, np.uint64)

        def run(batch):
            n, keys, first, bits = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, size)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                first.append(prefix(s, none, none, percent).view(np.int64) if len(s) else [])
                bits.append(sketch(s))
            return {"doc_id": batch.column("doc_id"), "n": n, "key": keys, "sketch": bits, "prefix": first}

        return map_batches(self.docs, "doc_id long, n long, key binary, sketch array<long>, prefix array<long>", run)

    def heads(self, sets: DataFrame) -> DataFrame:
        """(doc_id, prefix) of one document of each set, frequent shingles moved back."""
        first = sets.filter("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
        heads = sets.join(first.select("doc_id"), "doc_id", "left_semi").filter("n > 0").select("doc_id", "prefix")
        counts = self.scratch.save(heads.select(F.explode("prefix").alias("s")).groupBy("s").count()
                                   .filter(F.col("count") > COMMON), "counts")
        levels = counts.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count"))
        above, bar = 0, COMMON
        for r in levels.limit(FREQUENT).collect():  # one row per distinct count
            above += r["n"]
            if above > FREQUENT:
                bar = r["count"]
                break
        counts = counts.filter(F.col("count") > bar).toArrow()
        if not counts.num_rows:
            return heads
        hot, often = counts.column("s").to_numpy().view(np.uint64), counts.column("count").to_numpy()
        by_hash = np.argsort(hot)
        hot, often = hot[by_hash], often[by_hash]
        order = np.empty(len(hot), np.int64)
        order[np.lexsort((hot, often))] = np.arange(len(hot))
        shared = self.docs.sparkSession.sparkContext.broadcast((hot, order))
        size, percent = self.size, self.percent

        def touched(batch):
            hot, _ = shared.value
            lists = batch.column("prefix")
            values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.minimum(np.searchsorted(hot, values), len(hot) - 1)
            seen = np.concatenate([[0], np.cumsum(hot[at] == values)])
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            return {"doc_id": batch.column("doc_id"), "prefix": lists, "hot": seen[ends[1:]] > seen[ends[:-1]]}

        def again(batch):
            hot, order = shared.value
            first = [prefix(shingle_set(t, size), hot, order, percent).view(np.int64)
                     for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "prefix": first}

        marked = self.scratch.save(map_batches(heads, "doc_id long, prefix array<long>, hot boolean", touched), "heads")
        moved = map_batches(_near_ids(self.docs, marked.filter("hot").select("doc_id")),
                            "doc_id long, prefix array<long>", again)
        return marked.filter("not hot").select("doc_id", "prefix").unionAll(moved)

    def regions(self, heads: DataFrame) -> DataFrame:
        """(s, doc, pivot, size) of the regions of two documents or more; the first pivot is the smallest id."""
        one = Window.partitionBy("s")
        entries = heads.select(F.col("doc_id").alias("doc"), F.explode("prefix").alias("s")).distinct() \
            if self.repeated else heads.select(F.col("doc_id").alias("doc"), F.explode("prefix").alias("s"))
        return (entries.select("s", "doc", F.min("doc").over(one).alias("pivot"), F.count("*").over(one).alias("size"))
                .filter("size > 1"))

    def possible(self) -> Column:
        """Whether sets of na and nb shingles, whose sketches differ in ``bits``, may link."""
        p = self.percent
        both = F.col("na") + F.col("nb")
        return ((100 - p) * both >= (100 + p) * F.col("bits")) & (
            100 * F.least("na", "nb") >= p * F.greatest("na", "nb"))

    def bounded(self, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(pairs that may link, the others with bounds low and high of their distance)."""
        of = lambda c: self.meta.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"),
                                        F.col("sketch").alias(f"s{c}"))
        rows = (pairs.distinct().join(of("a"), "a").join(of("b"), "b")
                .select("a", "b", "na", "nb", _differ("sa", "sb").alias("bits")))
        rows = self.scratch.save(rows.select("a", "b", self.possible().alias("possible"),
                                             (2 * F.col("bits") / (F.col("na") + F.col("nb") + F.col("bits"))).alias("low")),
                                 "bounds")
        return rows.filter("possible").select("a", "b"), rows.filter("not possible").select(
            "a", "b", "low", F.lit(1.0).alias("high"))

    def measure(self, pairs: DataFrame) -> DataFrame:
        """(a, b, d, linked) for pairs of ids: exact distances from the whole texts."""
        size, percent = self.size, self.percent
        pairs = self.scratch.save(pairs, "pairs")
        ids = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct()
        texts = _near_ids(self.docs, ids)

        def run(batch):
            kept: dict[int, np.ndarray] = {}
            out = []
            for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")), strict=True):
                sets = []
                for k, t in ((a, ta), (b, tb)):
                    if k not in kept:
                        if len(kept) > 200:
                            kept.clear()
                        kept[k] = shingle_set(t, size)
                    sets.append(kept[k])
                x, y = sets
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                union = len(x) + len(y) - both
                out.append((1 - both / union if union else 1.0, union > 0 and 100 * both >= percent * union))
            return {"a": batch.column("a"), "b": batch.column("b"), "d": [o[0] for o in out],
                    "linked": [o[1] for o in out]}

        rows = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
                .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b"))
        return self.scratch.save(map_batches(rows, "a long, b long, d double, linked boolean", run), "measured")

    def unite(self, measured: DataFrame) -> None:
        links = measured.filter("linked").select("a", "b")
        if self.parts is not None:
            links = links.unionAll(self.parts.select(F.col("node").alias("a"), F.col("component").alias("b")))
        self.parts = self.scratch.save(components(links, self.scratch), "components")

    def open_regions(self, regions: DataFrame, least: int) -> DataFrame:
        """Rows of the regions of more than ``least`` documents that hold several components, with theirs."""
        rows = (regions.filter(F.col("size") > least)
                .join(self.parts.select(F.col("node").alias("doc"), "component"), "doc", "left")
                .withColumn("component", F.coalesce("component", "doc")))
        mixed = rows.groupBy("s").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        return rows.join(mixed.filter("low < high").select("s"), "s")

    def star(self, pairs: DataFrame) -> DataFrame:
        """Unite what links among (document, pivot) pairs; their distances as bounds (a, b, low, high)."""
        near, far = self.bounded(pairs)
        measured = self.measure(near)
        self.unite(measured)
        return measured.select("a", "b", F.col("d").alias("low"), F.col("d").alias("high")).unionAll(far)

    def run(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every row."""
        sets = self.scratch.save(self.sets(), "sets")
        self.repeated = sets.select("doc_id").distinct().count() < sets.count()
        regions = self.scratch.save(self.regions(self.heads(sets)), "regions")
        self.meta = self.scratch.save(
            sets.select("doc_id", "n", "sketch").join(regions.select(F.col("doc").alias("doc_id")).distinct(),
                                                      "doc_id", "left_semi"), "meta")
        known = self.star(regions.filter("doc <> pivot").select(F.col("doc").alias("a"), F.col("pivot").alias("b")))
        pivots = regions.filter("doc = pivot").select("s", "pivot")
        for turn in range(ROUNDS):
            wide = self.scratch.save(self.open_regions(regions, LARGE), "wide")
            if wide.isEmpty():
                break
            # the next pivot of a region is not of the component of its smallest document
            draw = F.struct(F.xxhash64("doc", F.lit(turn)).alias("h"), F.col("doc").alias("pivot"))
            low = wide.groupBy("s").agg(F.min("component").alias("low"))
            chosen = (wide.join(low, "s").filter(F.col("component") != F.col("low"))
                      .groupBy("s").agg(F.min(draw).alias("p")).select("s", F.col("p.pivot").alias("pivot")))
            chosen = self.scratch.save(chosen, "pivots")
            more = self.star(wide.select("s", "doc").join(chosen, "s").filter(F.col("doc") != F.col("pivot"))
                             .select(F.col("doc").alias("a"), F.col("pivot").alias("b")))
            known, pivots = known.unionAll(more), pivots.unionAll(chosen)
        rest = self.scratch.save(self.open_regions(regions, 2).select("s", "doc", "component"), "open")
        if not rest.isEmpty():
            self.unite(self.measure(self.cell_pairs(rest, pivots.distinct(), known)))
        return self.rows(sets)

    def cell_pairs(self, rest: DataFrame, pivots: DataFrame, known: DataFrame) -> DataFrame:
        """Pairs still to be compared: home documents of a cell with those that can reach into it."""
        known = known.groupBy("a", "b").agg(F.max("low").alias("low"), F.min("high").alias("high"))
        own = F.col("doc") == F.col("pivot")
        far = (rest.join(pivots, "s")
               .join(known, (F.col("doc") == F.col("a")) & (F.col("pivot") == F.col("b")), "left")
               .withColumns({"low": F.when(own, 0.0).otherwise(F.col("low")),
                             "high": F.when(own, 0.0).otherwise(F.col("high"))})
               .filter("low is not null").select("s", "doc", "component", "pivot", "low", "high"))
        home = far.groupBy("s", "doc").agg(F.min(F.struct("high", "pivot")).alias("h"))
        slack = 1e-9
        cells = (far.join(home, ["s", "doc"])
                 .filter(F.col("low") <= F.col("h.high") + 2 * self.radius + slack)
                 .join(self.meta, F.col("doc") == F.col("doc_id"))
                 .select("s", "doc", "component", "pivot", "low", "high", "n", "sketch",
                         (F.col("pivot") == F.col("h.pivot")).alias("home")))
        cells = self.scratch.save(cells, "cells")
        of = lambda c: cells.select("s", "pivot", "home", F.col("doc").alias(c), *[
            F.col(x).alias(f"{x}_{c}") for x in ("component", "low", "high", "n", "sketch")])
        x, y = of("x").filter("home").drop("home"), of("y").drop("home")
        p = self.percent
        both = F.col("n_x") + F.col("n_y")
        # a pivot has been compared with its whole region; bounds that cannot link never leave the join
        match = ((x["s"] == y["s"]) & (x["pivot"] == y["pivot"]) & (F.col("x") != F.col("y"))
                 & (F.col("component_x") != F.col("component_y"))
                 & (F.col("low_x") - F.col("high_y") <= self.radius + slack)
                 & (F.col("low_y") - F.col("high_x") <= self.radius + slack)
                 & (F.col("x") != x["pivot"]) & (F.col("y") != x["pivot"])
                 & (100 * F.least("n_x", "n_y") >= p * F.greatest("n_x", "n_y"))
                 & ((100 - p) * both >= (100 + p) * _differ("sketch_x", "sketch_y")))
        return x.join(y, match).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def rows(self, sets: DataFrame) -> DataFrame:
        heads = (sets.filter("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("head"))
                 .join(self.parts, F.col("head") == F.col("node"), "left")
                 .select("key", F.coalesce("component", "head").alias("component")))
        joined = sets.select("doc_id", "n", "key").join(heads, "key", "left")
        return joined.select("doc_id", F.col("n").alias("n_shingles"),
                             F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, scratch: Scratch, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    Two documents link when 100 * intersection >= ``percent`` * union of their shingle sets; the
    component id is the smallest id reachable. Null and empty texts and texts without words have an empty set and
    link with nothing. Equal sets are joined by key first, so any number of copies costs one
    comparison. Rows of one repeated id count as one document; null ids keep their row, without
    component. No rows give no rows; other columns are not read.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return MetricJoin(source, scratch, percent, size).run()
