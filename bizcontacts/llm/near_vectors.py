"""Near-duplicate embeddings by a random-projection tree forest.

Every tree splits the vectors of a label again and again along random directions at the median of a
bounded sample; a vector close to a split goes down both sides. Vectors meet in the leaves, where
cosines are verified in double precision. Small random groups are compared at once; a large leaf is
compared block by block. A pair found in several leaves counts in the first only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizcontacts.llm.common import Scratch, map_batches, ship
from bizcontacts.llm.components import components

TREES = 6
MARGIN = 0.015
LEAF_ROWS = 256
BLOCK_ROWS = 256
# bound of the sample the splits are fitted on; all rows are indexed
SAMPLE_ROWS = 20_000
MIN_SAMPLE = 16


class Forest:
    """Splits of ``trees`` trees: node -> (threshold); directions are drawn from tree and node."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int, margin: float, leaf_rows: int, seed: int = 11):
        self.trees, self.margin, self.seed = trees, margin, seed
        self.dim = sample.shape[1] if sample.ndim == 2 else 0
        self.cuts: dict[tuple[int, int], float] = {}
        share = max(rows, 1) / max(len(sample), 1)
        for t in range(trees):
            stack = [(1, np.arange(len(sample)))]
            while stack:
                node, own = stack.pop()
                if len(own) * share <= leaf_rows or len(own) < MIN_SAMPLE:
                    continue
                x = sample[own] @ self.direction(t, node)
                cut = float(np.median(x))
                left, right = own[x < cut + margin], own[x >= cut - margin]
                if max(len(left), len(right)) > 0.9 * len(own):
                    continue  # too dense for this margin: blocks take over
                self.cuts[t, node] = cut
                stack += [(2 * node, left), (2 * node + 1, right)]

    def direction(self, tree: int, node: int) -> np.ndarray:
        v = np.random.default_rng([self.seed, tree, node]).normal(size=self.dim)
        return v / np.linalg.norm(v)

    def leaves(self, x: np.ndarray) -> list[list[int]]:
        """Leaf numbers of each row of unit vectors, in ascending order; a leaf's number holds its tree."""
        out: list[list[int]] = [[] for _ in range(len(x))]
        for t in range(self.trees):
            stack = [(1, np.arange(len(x)))]
            while stack:
                node, own = stack.pop()
                cut = self.cuts.get((t, node))
                if cut is None:
                    for i in own:
                        out[i].append(t << 40 | node)
                    continue
                p = x[own] @ self.direction(t, node)
                left, right = own[p < cut + self.margin], own[p >= cut - self.margin]
                stack += [(n, o) for n, o in ((2 * node, left), (2 * node + 1, right)) if len(o)]
        return [sorted(x) for x in out]


def unit_rows(embeddings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(positions of usable vectors, their unit vectors in double precision)."""
    rows = embeddings.to_pylist()
    keep, out = [], []
    for k, v in enumerate(rows):
        if v and None not in v:
            a = np.array(v, np.float64)
            top = np.abs(a).max()
            if np.isfinite(top) and top > 0:
                a = a / top  # so that no square runs over or under
                keep.append(k), out.append(a / np.sqrt(a @ a))
    return np.array(keep, np.int64), out


def compare(left: tuple, right: tuple, leaf: int, threshold: float, same: bool) -> tuple:
    """(links of left, links of right, star links) of two blocks (ids, copies, unit vectors, leaf lists).

    A pair counts here only if ``leaf`` is the first that holds both, and as often as the partner
    has copies. Star links join rows to the smallest id they reach within the two blocks.
    """
    (ids_a, copies_a, x, leaves_a), (ids_b, copies_b, y, leaves_b) = left, right
    hit = np.argwhere(x @ y.T >= threshold)
    if same:
        hit = hit[hit[:, 0] < hit[:, 1]]
    links_a, links_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    if not len(hit):
        return links_a, links_b, []
    earlier = sorted({v for row in (*leaves_a, *leaves_b) for v in row if v < leaf})
    place = {v: k for k, v in enumerate(earlier)}
    bits = []
    for rows in (leaves_a, leaves_b):
        held = np.zeros((len(rows), max(1, len(earlier))), np.float32)
        for i, row in enumerate(rows):
            held[i, [place[v] for v in row if v < leaf]] = 1
        bits.append(held)
    first = hit[(bits[0] @ bits[1].T)[hit[:, 0], hit[:, 1]] == 0]
    np.add.at(links_a, first[:, 0], copies_b[first[:, 1]])
    np.add.at(links_b, first[:, 1], copies_a[first[:, 0]])
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    for a, b in zip(ids_a[hit[:, 0]].tolist(), ids_b[hit[:, 1]].tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return links_a, links_b, [(v, root(v)) for v in list(parent) if root(v) != v]


def near_vectors(vectors: DataFrame, scratch: Scratch, threshold: float = 0.98, trees: int = TREES,
                 margin: float = MARGIN, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS,
                 sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label).

    Vectors link when their labels, of any type, are equal and not null and their cosine reaches
    ``threshold``. Null, empty, zero and non-finite vectors link with nothing, and vectors of different
    length do not link. Exact copies are grouped first, so a vector held by a third of all rows costs one
    comparison. Null ids keep their row without links; each row of a repeated id is a vector of its
    own. The splits come from at most ``sample_rows`` vectors of the commonest length; vectors of other
    lengths form one leaf by label and length. A leaf of any size is compared in pairs of blocks of
    ``block_rows``. Other columns are not read; no rows give no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    known = F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                          F.when(known, F.col("embedding").cast("array<double>")).alias("embedding"))

    def clean(batch):
        keep, units = unit_rows(batch.column("embedding"))
        unit, label = [None] * batch.num_rows, batch.column("label").to_pylist()
        for k, u in zip(keep.tolist(), units, strict=True):
            unit[k], label[k] = u, f"{len(u)}:{label[k]}"
        return {"vec_id": batch.column("vec_id"), "label": label, "unit": unit}

    cleaned = map_batches(rows, "vec_id long, label string, unit array<double>", clean)
    copies = cleaned.filter("unit is not null").groupBy("label", "unit").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    heads = scratch.save(copies.withColumn("head", F.monotonically_increasing_id()), "heads")
    dims = heads.groupBy(F.size("unit").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = dims["d"] if dims else 0
    common = heads.filter(F.size("unit") == dim)
    n = common.count()
    sample = common.select("unit").orderBy(F.xxhash64("least", "label"), "label").limit(sample_rows).toArrow()
    points = np.array(sample.column(0).to_pylist(), np.float64).reshape(-1, max(dim, 1))
    labels = max(1, common.select("label").distinct().count())
    forest = spark.sparkContext.broadcast(Forest(points, -(-n // labels), trees, margin, leaf_rows))

    def index(batch):
        x = np.stack(batch.column("unit").to_pylist())
        return {**{c: batch.column(c) for c in ("head", "label", "copies", "unit")}, "leaves": forest.value.leaves(x)}

    kind = "head long, label string, copies long, unit array<double>, leaves array<long>"
    indexed = map_batches(common, kind, index)
    rare = heads.filter(F.size("unit") != dim).select(
        "head", "label", "copies", "unit", F.array(F.lit(-1).cast("long")).alias("leaves"))
    placed = scratch.save(indexed.unionByName(rare), "placed")
    spread = placed.select("*", F.explode("leaves").alias("leaf"))
    sizes = spread.groupBy("label", "leaf").agg(F.count("*").alias("rows")).filter("rows > 1")
    blocks = F.ceil(F.col("rows") / block_rows).cast("int")
    spread = spread.join(sizes, ["label", "leaf"]).withColumn("n_blocks", blocks)
    spread = spread.withColumn("block", F.pmod(F.xxhash64("head"), F.col("n_blocks")).cast("int"))
    # block k meets every other: cell (i, j) holds blocks i <= j
    other = F.sequence(F.lit(0), F.col("n_blocks") - 1)
    cells = spread.withColumn("with", F.explode(other)).select(
        "label", "leaf", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"),
        "block", "head", "copies", "unit", "leaves")

    def cell(key, found):
        leaf, i, j = key[1].as_py(), key[2].as_py(), key[3].as_py()
        block = found.column("block").to_numpy()
        ids, copies = found.column("head").to_numpy(), found.column("copies").to_numpy()
        x = np.stack(found.column("unit").to_pylist())
        leaves = found.column("leaves").to_pylist()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links, star = np.zeros(len(ids), np.int64), []
        if len(left) and len(right):
            sides = [(ids[s], copies[s], x[s], [leaves[k] for k in s]) for s in (left, right)]
            of_left, of_right, star = compare(*sides, leaf, threshold, i == j)
            np.add.at(links, left, of_left)
            np.add.at(links, right, of_right)
        here = np.flatnonzero(links)
        return pa.table({"a": pa.array(np.concatenate([ids[here], np.array([s[0] for s in star], np.int64)])),
                         "b": pa.array([None] * len(here) + [s[1] for s in star], pa.int64()),
                         "n": pa.array(np.concatenate([links[here], np.zeros(len(star), np.int64)]))})

    # dealt by cell: by leaf alone, all cells of a large leaf would meet in one task
    cells = cells.repartition("label", "leaf", "i", "j")
    met = scratch.save(cells.groupBy("label", "leaf", "i", "j").applyInArrow(cell, "a long, b long, n long"), "met")
    parts = components(met.filter("b is not null").select("a", "b"), scratch)
    near = met.filter("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    found = (heads.select("label", "unit", "head", "copies", "least").join(near, F.col("head") == F.col("a"), "left")
             .join(parts, F.col("head") == F.col("node"), "left")
             .select("label", "unit", "least", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"),
                     F.coalesce("component", "head").alias("part")))
    smallest = found.groupBy("part").agg(F.min("least").alias("component"))
    groups = found.join(smallest, "part").select("label", "unit", "links", "component")
    # back to the rows: copies find their group by the vector itself
    own = cleaned.join(groups, ["label", "unit"], "left")
    return own.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component", "vec_id").alias("component_id"),
                      F.coalesce(F.col("component").isNull() | (F.col("component") == F.col("vec_id")), F.lit(False))
                      .alias("kept"))
