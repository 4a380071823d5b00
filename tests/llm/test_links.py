"""Jaccard join and near vectors against brute force."""

import math
import random
import re

from bizcontacts.llm.common import Scratch
from bizcontacts.llm.jaccard_join import jaccard_components
from bizcontacts.llm.near_vectors import Forest, near_vectors


def smallest_reachable(ids, linked):
    """{id: smallest id reachable} over the pairs ``linked`` accepts."""
    part = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and part[a] != part[b] and linked(a, b):
                low, high = sorted((part[a], part[b]))
                part = {k: low if v == high else v for k, v in part.items()}
    return part


def shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard_truth(rows):
    sets = {doc: shingles(text) for doc, text, *_ in rows}
    part = smallest_reachable(sorted(sets), lambda a, b: bool(sets[a]) and bool(sets[b]) and
                              100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    return {d: (len(s), part[d]) for d, s in sets.items()}


def test_jaccard_groups_are_those_of_brute_force(spark, docs, doc_rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, Scratch(spark, "j")).collect()}
    assert got == jaccard_truth(doc_rows)
    assert len({c for _, c in got.values()}) < len(got)


def test_jaccard_of_chained_and_short_sets(spark):
    words = [f"t{k}" for k in range(60)]
    rows = [(k, " ".join(words[k:k + 30])) for k in range(12)]  # each links with its near neighbours only
    rows += [(20, "a b c d e f g"), (21, "a b c d e f g"), (22, "a b c d e f"), (23, "A b"), (24, "a B"), (25, "b a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, Scratch(spark, "j")).collect()}
    assert got == jaccard_truth(rows)


def test_jaccard_of_an_empty_table(spark, no_docs):
    assert jaccard_components(no_docs, Scratch(spark, "j")).count() == 0


def test_vectors_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for k in range(160):
        if k % 4 and rows:
            old = rows[-1][1]
            v = [x + rng.gauss(0, 0.04) for x in old]
        else:
            v = [rng.gauss(0, 1) for _ in range(16)]
        rows.append((k, v, k // 40))
    rows += [(200, rows[0][1], 0), (201, rows[0][1], None), (202, None, 0), (203, [0.0] * 16, 0),
             (204, [float("nan")] * 16, 0), (205, [math.inf] + [1.0] * 15, 0), (206, [None] * 16, 0),
             (207, [2 * x for x in rows[0][1]], 0), (208, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    usable = {i: (v, g) for i, v, g in rows if g is not None and v and
              all(x is not None and math.isfinite(x) for x in v) and any(v)}

    def linked(a, b):
        if a not in usable or b not in usable or usable[a][1] != usable[b][1]:
            return False
        x, y = usable[a][0], usable[b][0]
        dot = sum(p * q for p, q in zip(x, y))
        return dot / math.sqrt(sum(p * p for p in x)) / math.sqrt(sum(q * q for q in y)) >= 0.98

    ids = [i for i, *_ in rows]
    part = smallest_reachable(sorted(ids), linked)
    links = {i: sum(linked(min(i, j), max(i, j)) for j in ids if j != i) for i in ids}
    got = {r.vec_id: r for r in near_vectors(df, Scratch(spark, "v")).collect()}
    assert {i: r.n_links for i, r in got.items()} == links
    assert {i: r.component_id for i, r in got.items()} == part
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_vectors_of_an_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert near_vectors(df, Scratch(spark, "v")).count() == 0


def test_labels_lengths_and_repeated_ids(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, a, "x", 9), (1, b, "x", 9), (2, [2.0, 0.001, 0.0], "x", 9), (3, [0.0, 3.0, 0.001], "x", 9), (4, a, "y", 9),
            (5, [1.0, 2.0], "x", 9), (6, [1.0, 2.0], "x", 9), (7, [1e200, 2e200], "x", 9), (8, [1.0], "x", 9),
            (None, a, "x", 9), (9, c, "x", 9), (9, c, "x", 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, head int")
    got = sorted((tuple(r) for r in near_vectors(df, Scratch(spark, "v")).collect()), key=repr)
    want = [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True), (5, 2, 5, True),
            (6, 2, 5, False), (7, 2, 5, False), (8, 0, 8, True), (None, 0, None, True), (9, 1, 9, True), (9, 1, 9, True)]
    assert got == sorted(want, key=repr)
    floats = spark.createDataFrame([(1, a, 1.2), (2, a, 1.7), (3, a, 1.2)], "vec_id long, embedding array<double>, label double")
    assert {r.vec_id: r.component_id for r in near_vectors(floats, Scratch(spark, "v")).collect()} == {1: 1, 2: 2, 3: 1}


def test_recall_over_splits(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    base = rng.normal(size=(3000, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    other = rng.normal(size=base.shape)
    other -= (other * base).sum(1)[:, None] * base
    other /= np.linalg.norm(other, axis=1)[:, None]
    pairs = 0.9805 * base + np.sqrt(1 - 0.9805 ** 2) * other  # planted just above the threshold
    x = np.concatenate([base, pairs])
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    forest = Forest(x, len(x), 6, 0.015, 64)
    assert len(forest.cuts) > 100  # leaves are split indeed
    got = {r.vec_id: r.n_links for r in near_vectors(df, Scratch(spark, "v"), leaf_rows=64).collect()}
    want = (x @ x.T >= 0.98).sum(1) - 1
    assert sum(got[k] for k in got) >= 0.97 * want.sum() and all(got[k] <= want[k] for k in got)
