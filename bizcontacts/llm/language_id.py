"""Language identification by multilingual mixture inference.

A text's letter n-grams (1 to 3 bytes of its lowered UTF-8) are hashed to a fixed number of bins; the training
rows give each language a smoothed distribution over the bins. Expectation-maximisation then
estimates the languages' proportions of each text, and the set of languages is the one whose
penalised likelihood is highest, grown one language at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizcontacts.llm.common import map_batches, ship

BINS = 1 << 14
UNKNOWN = "und"
ROUNDS = 12
# n-grams of a text overlap, so its sample counts for a third; a language must earn this share of log n
OVERLAP = 3.0
PENALTY = 3.0
# bytes that are no part of a word become a space
_WORDY = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def ngram_bins(text: str) -> np.ndarray:
    """Bins of all n-grams of the words of ``text``, with a space before and after."""
    data = b" " + text.lower().encode("utf-8", "surrogatepass").translate(_WORDY) + b" "
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    word = b != 32
    one = (b * np.uint32(0x9E3779B1))[word]
    two = ((b[:-1] << np.uint32(8) | b[1:]) * np.uint32(0x85EBCA6B))[word[:-1] | word[1:]]
    three = ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0xC2B2AE35))[word[1:-1]]
    return np.concatenate([one, two, three]) >> np.uint32(32 - 14)


def language_model(train: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-free probabilities by bin and language) from columns lang and text.

    Counts cover every row given; each task adds up its own before the shuffle. At most BINS rows
    per language reach the driver.
    """
    ship(train.sparkSession)

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = totals.setdefault(lang, np.zeros(BINS, np.int64))
                c += np.bincount(ngram_bins(text), minlength=BINS)
        for lang, c in totals.items():
            seen = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(c[seen], pa.int64())],
                names=["lang", "bin", "n"])

    rows = (train.select("lang", "text").filter("lang is not null and text is not null")
            .mapInArrow(count, "lang string, bin int, n long")
            .groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow())
    langs = sorted(set(rows.column("lang").to_pylist()))
    at = {x: k for k, x in enumerate(langs)}
    p = np.full((BINS, len(langs)), 0.5)
    if langs:
        p[rows.column("bin").to_numpy(), [at[x] for x in rows.column("lang").to_pylist()]] += \
            rows.column("n").to_numpy()
        p /= p.sum(0)
    return langs, p


def proportions(counts: np.ndarray, p: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(proportions, log-likelihood) of one text by expectation-maximisation."""
    share = np.full(p.shape[1], 1 / p.shape[1]) if start is None else start
    n = counts.sum()
    mix = p @ share
    for _ in range(ROUNDS if p.shape[1] > 1 else 0):
        share = share * (counts / mix @ p) / n
        mix = p @ share
    return share, float(counts @ np.log(mix))


def infer(text: str, p: np.ndarray) -> tuple[np.ndarray, list[int], float]:
    """(proportion of each language, chosen languages by falling proportion, posterior of the first of them).

    The posterior weighs the penalised likelihood of the chosen set against that of each language left out.
    """
    bins, counts = np.unique(ngram_bins(text), return_counts=True)
    part, counts = p[bins], counts.astype(float)
    single = counts @ np.log(part)
    full, _ = proportions(counts, part)
    chosen, best = [int(np.argmax(single))], float(single.max())
    share = np.ones(1)
    cost = PENALTY * np.log(counts.sum() + 1)
    for k in np.argsort(-full):
        if k in chosen or full[k] < 0.02:
            continue
        trial, value = proportions(counts, part[:, chosen + [int(k)]])
        if (value - best) / OVERLAP <= cost:
            break
        chosen, best, share = chosen + [int(k)], value, trial
    out = np.zeros(p.shape[1])
    out[chosen] = share
    order = sorted(chosen, key=lambda k: -out[k])
    rivals = np.delete(single, chosen) - best + OVERLAP * cost * (len(chosen) - 1)
    against = float(np.exp(np.clip(rivals / OVERLAP, -700, 50)).sum())
    return out, order, float(out[order[0]]) / (1 + against)


def identify_languages(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, carried columns, lang_pred, score, langs, shares.

    ``train`` has columns lang and text; rows with a null in either teach nothing. A text that is
    null or has no letter is ``und`` with score 0, as is every text where no language was learned. Ties between languages go to the first in
    alphabetical order. Map-only after training; repeated rows and null ids keep their rows.
    """
    langs, p = language_model(train)

    def predict(batch):
        pred, score, names, shares = [], [], [], []
        for text in batch.column("text").to_pylist():
            if not text or not langs or not any(map(str.isalpha, text)):
                pred.append(UNKNOWN), score.append(0.0), names.append([]), shares.append([])
                continue
            share, chosen, sure = infer(text, p)
            pred.append(langs[chosen[0]]), score.append(min(1.0, sure))
            names.append([langs[k] for k in chosen]), shares.append([float(share[k]) for k in chosen])
        return {**{c: batch.column(c) for c in ("doc_id", *carry)},
                "lang_pred": pred, "score": score, "langs": names, "shares": shares}

    source = docs.select(F.col(id_col).alias("doc_id"), *carry, F.col(text_col).alias("text"))
    kinds = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in ("doc_id", *carry))
    return map_batches(source, f"{kinds}, lang_pred string, score double, langs array<string>, shares array<double>",
                       predict)
