"""Merkle manifest against a tree built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from bizcontacts.llm.common import Scratch
from bizcontacts.llm.merkle import folded_root, merkle_manifest, proof_digest, tampered_leaf
from bizcontacts.llm.ranking import ranked

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string, tree string, idx int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    doc, text, lang, source, n, *_ = row
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def tree_of(hashes, fanout):
    """(root, path of each leaf as (left, right) pairs)."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for k, place in enumerate(at):
            run = place // fanout * fanout
            paths[k].append(("".join(hashes[run:place]), "".join(hashes[place + 1:run + fanout])))
        hashes = [h(*hashes[k:k + fanout]) for k in range(0, len(hashes), fanout)]
        at = [p // fanout for p in at]
    return hashes[0], paths


def expected(rows, fanout=3):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        members = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        built[s] = (members, *tree_of([leaf_of(r) for r in members], fanout))
    root, tops = tree_of([built[s][1] for s in names], fanout)
    out = []
    for s, top in zip(names, tops):
        members, subroot, paths = built[s]
        for r, path in zip(members, paths):
            whole = path + top
            found = leaf_of((r[0], r[1].replace("\n", ""), *r[2:])) if r[1] is not None and r[0] is not None \
                and zlib.crc32(str(r[0]).encode()) % 2 == 0 else leaf_of(r)
            fold = found
            for left, right in whole:
                fold = h(left, fold, right)
            out.append((r[0], leaf_of(r), subroot, root, h(*(a + b for a, b in whole)), fold, fold == root))
    return sorted(out, key=repr)


def result(df, spark, **options):
    sealed = merkle_manifest(df, Scratch(spark, "t"), carry={"found": tampered_leaf()}, **options)
    folded = sealed.withColumn("fold", folded_root(F.coalesce("found", "leaf")))
    rows = folded.select("doc_id", "leaf", "subroot", "root", proof_digest().alias("proof"), "fold",
                         (F.col("fold") == F.col("root")).alias("ok")).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def made(n):
    sources = [None, "", "a", "b", "é", "z", "日"]
    rows = [(k, f"line {k}\nmore" if k % 3 else f"text {k}", "en", sources[k % 2 * (k % 7)], k, "x", "y", 1)
            for k in range(n)]
    rows += [(None, None, None, "a", None, None, None, None), (None, "t", "fr", "a", 1, None, None, None),
             (5, "", None, "a", 0, None, None, None), rows[5], rows[5], (-9, "x\n" * 50_000, "de", "only", 7, None, None, None)]
    return rows


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_manifest_equals_a_plain_tree(spark, fanout):
    rows = made(60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(df, spark, fanout=fanout) == expected(rows, fanout)


def test_one_row_one_group_and_no_rows(spark):
    one = [(3, "a\nb", "en", "s", 3, None, None, None)]
    got = result(spark.createDataFrame(one, SCHEMA), spark)
    assert got == expected(one) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == h()
    group = [(k, "t", "en", "s", 1, None, None, None) for k in range(10)]
    assert result(spark.createDataFrame(group, SCHEMA), spark) == expected(group)
    assert result(spark.createDataFrame([], SCHEMA), spark) == []


def test_equal_rows_spread_and_all_count(spark):
    rows = [(1, "same", "en", "s", 4, None, None, None)] * 200
    got = result(spark.createDataFrame(rows, SCHEMA).repartition(4), spark)
    assert sorted(got) == expected(rows)


def test_ranks_are_places_in_groups(spark):
    rows = [(None if k % 5 == 0 else f"g{k * k % 7}", k % 11, k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(7)
    got = ranked(df, "g", ["o", "v"], Scratch(spark, "t")).collect()
    names = sorted({r[0] for r in rows}, key=lambda s: (s is not None, s or ""))
    for no, name in enumerate(names):
        members = sorted((r[1], r[2]) for r in rows if r[0] == name)
        mine = {(r.o, r.v): r for r in got if r.g == name}
        assert {(r.group_no) for r in mine.values()} == {no}
        assert [mine[m].idx for m in members] == list(range(len(members)))
