"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a run of words: only the words under its ones are hashed, the others may
differ. Hashes of all positions of the texts meet those of the benchmark; around each hit the words
are compared one by one along the same alignment, and a leak is a window in which all but a few
substituted words agree. The two masks find every window of 13 words with at most two substitutions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizcontacts.llm.common import map_batches, word_hashes

# fixed masks; tests/llm proves that no two substitutions in 13 words escape both
MASKS = ("1101011001", "110010111")
WINDOW = 13
SUBSTITUTIONS = 2
# benchmark words compared in one pass over the documents; larger benchmarks take several passes
PASS_WORDS = 1_000_000
FILTER_BITS = 22
_MIX = [np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash at each position of the words under the ones of ``mask``."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            out = (out ^ words[k:k + n]) * _MIX[k % 5]
            out ^= out >> np.uint64(31)
    return out


class Seeds:
    """Seed tables of some benchmark items; an item shorter than a mask gets a solid mask of its length."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.items = [(i, word_hashes(t)) for i, t in items]
        self.items = [(i, w) for i, w in self.items if len(w)]
        masks = list(MASKS)
        short = {len(w) for _, w in self.items if len(w) < max(map(len, MASKS))}
        masks += ["1" * n for n in sorted(short)]
        self.tables = []
        for mask in masks:
            found = []
            for k, (_, w) in enumerate(self.items):
                if mask not in MASKS and len(w) != len(mask):
                    continue
                h = seed_hashes(w, mask)
                found.append(np.stack([h, np.full(len(h), k, np.uint64), np.arange(len(h), dtype=np.uint64)]))
            if found and (all_found := np.concatenate(found, 1)).shape[1]:
                all_found = all_found[:, np.argsort(all_found[0], kind="stable")]
                sieve = np.zeros(1 << FILTER_BITS, bool)
                sieve[all_found[0] >> np.uint64(64 - FILTER_BITS)] = True
                self.tables.append((mask, *all_found, sieve))

    def leaks(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, first word, end word, agreeing words) of each leaked stretch of a whole text."""
        words = word_hashes(text)
        found: dict[tuple[int, int], bool] = {}
        for mask, hashes, items, places, sieve in self.tables:
            h = seed_hashes(words, mask)
            at = np.flatnonzero(sieve[h >> np.uint64(64 - FILTER_BITS)])
            if not len(at):
                continue
            low, high = np.searchsorted(hashes, h[at]), np.searchsorted(hashes, h[at], "right")
            for p, a, b in zip(at, low, high, strict=True):
                for e in range(a, b):
                    found[int(items[e]), int(p) - int(places[e])] = True
        out = []
        for k, shift in sorted(found):
            item, w = self.items[k]
            first, last = max(0, shift), min(len(words), shift + len(w))
            same = words[first:last] == w[first - shift:last - shift]
            span = min(WINDOW, len(w))
            allowed = SUBSTITUTIONS * span // WINDOW
            if len(same) < span:
                continue
            c = np.concatenate([[0], np.cumsum(same)])
            good = np.flatnonzero(c[span:] - c[:-span] >= span - allowed)
            if len(good):
                a, b = int(good[0]), int(good[-1]) + span
                out.append((item, first + a, first + b, int(c[b] - c[a])))
        return out


def benchmark_parts(benchmark: DataFrame, pass_words: int = PASS_WORDS) -> list[DataFrame]:
    """The benchmark cut into parts of about ``pass_words`` words each, by hash of item and text."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(
        "item_id is not null and text is not null")
    words = rows.agg(F.sum(F.octet_length("text") / 5)).first()[0] or 0
    parts = max(1, int(-(-words // pass_words)))
    return [rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) for k in range(parts)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               carry: tuple[str, ...] = (), pass_words: int = PASS_WORDS) -> DataFrame:
    """One row per row of ``docs``: id, carried columns, contaminated, n_items, items, starts, ends.

    Words are those between ASCII white space, A-Z lowered. Each pass brings a bounded part of the benchmark to all documents and
    adds what it finds, so the size of the benchmark sets the number of passes only. Items shorter
    than the window must agree in proportion; very short ones word for word. Null and empty texts,
    null item ids and empty tables give no leak; repeated items or rows keep their own results.
    """
    keep = tuple(dict.fromkeys(("doc_id", *carry, "text")))
    base = docs.select(F.col(id_col).alias("doc_id"), *[c for c in carry if c != "text"], F.col(text_col).alias("text"),
                       F.lit(None).cast("array<struct<item:long,start:long,end:long,same:long>>").alias("leaks"))
    kinds = ", ".join(f"{c} {base.schema[c].dataType.simpleString()}" for c in keep)
    leak = "array<struct<item:long,start:long,end:long,same:long>>"
    for part in benchmark_parts(benchmark, pass_words):
        shared = docs.sparkSession.sparkContext.broadcast(Seeds([tuple(r) for r in part.collect()]))

        def scan(batch, shared=shared):
            seeds = shared.value
            before = batch.column("leaks").to_pylist()
            leaks = [(old or []) + [dict(zip(("item", "start", "end", "same"), x, strict=True)) for x in seeds.leaks(t)]
                     for old, t in zip(before, batch.column("text").to_pylist(), strict=True)]
            return {**{c: batch.column(c) for c in keep}, "leaks": leaks}

        base = map_batches(base, f"{kinds}, leaks {leak}", scan)
    leaks = F.array_sort(F.coalesce("leaks", F.array().cast(leak)))
    return base.select("doc_id", *carry, leaks.alias("leaks")).select(
        "doc_id", *carry, (F.size("leaks") > 0).alias("contaminated"),
        F.size(F.array_distinct(F.col("leaks.item"))).cast("long").alias("n_items"),
        F.col("leaks.item").alias("items"), F.col("leaks.start").alias("starts"), F.col("leaks.end").alias("ends"))
