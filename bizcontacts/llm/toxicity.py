"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (with marked word ends), so unseen
misspellings share most of theirs with known words. A window of words is the mean of its words and
goes through a two-class softmax; vectors and softmax are trained together. A text is scored by its
most toxic window, so a few words count in a long text as in a short one; a one-dimensional fit on the training rows
turns that into a probability.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizcontacts.llm.common import ROWS_AT_ONCE, map_batches, ship

WORD = re.compile(r"[^\W_]+")
BUCKETS = 1 << 17
DIM = 4
WINDOW = 8
SIZES = (3, 4, 5, 6)
ROUND_WINDOWS = 150_000
# an n-gram learns only if that many training texts hold it; what fewer hold would be learned by heart
MIN_TEXTS = 15
DECAY = 1e-2
# bound of the training sample, in labelled rows
MAX_TRAIN_ROWS = 5_000


def features(word: str) -> list[int]:
    """Buckets of the character n-grams of a lowered word, its ends marked."""
    import xxhash

    w = f"<{word}>"
    grams = {w[i:i + n] for n in SIZES for i in range(len(w) - n + 1)} or {w}
    return [xxhash.xxh32_intdigest(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in sorted(grams)]


class Model:
    """Scores texts: one number per subword, since the softmax is linear in the averaged vectors."""

    def __init__(self, weights: np.ndarray, bias: float, scale: tuple[float, float], limit: int = 400_000):
        self.weights, self.bias, self.scale, self.limit = weights, bias, scale, limit
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def word(self, w: str) -> float:
        if len(self.known) >= self.limit:
            self.known.clear()
        v = self.known[w] = float(self.weights[features(w)].mean())
        return v

    def peak(self, text: str | None) -> float | None:
        """Logit of the most toxic window of a whole text; None without words."""
        words = bag_words(text)
        if not words:
            return None
        known, word = self.known, self.word
        v = np.fromiter((known[w] if w in known else word(w) for w in words), np.float64, len(words))
        return window_peak(v) + self.bias

    def score(self, text: str | None) -> float:
        x = self.peak(text)
        x = -30.0 if x is None else x
        return float(1 / (1 + np.exp(-np.clip(self.scale[0] * x + self.scale[1], -30, 30))))


def bag_words(text: str | None) -> list[str]:
    """Lowered words of a whole text; a word that repeats its predecessor adds nothing to the bag."""
    words = WORD.findall((text or "").lower())
    return [w for w, last in zip(words, [None, *words], strict=False) if w != last]


def window_peak(v: np.ndarray) -> float:
    """Highest mean over all runs of WINDOW words; shorter texts count as one padded window."""
    if len(v) <= WINDOW:
        return float(v.sum() / WINDOW)
    c = np.concatenate([[0.0], np.cumsum(v)])
    return float((c[WINDOW:] - c[:-WINDOW]).max() / WINDOW)


class Sample:
    """Labelled texts as word numbers, and the subwords of each word once.

    Every text keeps all of its words; what is held is one small number per word, not the texts.
    """

    def __init__(self):
        self.number: dict[str, int] = {}
        self.buckets, self.sizes = array("i"), array("i")
        self.rows: list[np.ndarray] = []
        self.labels: list[int] = []

    def add(self, text: str | None, label: int) -> None:
        numbers = np.empty(0, np.int32)
        words = bag_words(text)
        if words:
            numbers = np.fromiter(map(self._number, words), np.int32, len(words))
        self.rows.append(numbers)
        self.labels.append(label)

    def _number(self, word: str) -> int:
        n = self.number.get(word)
        if n is None:
            n = self.number[word] = len(self.number)
            found = features(word)
            self.buckets.extend(found)
            self.sizes.append(len(found))
        return n


class Lists:
    """Bucket numbers of all words, read in blocks of words, so that little is held besides them."""

    BLOCK = 400_000  # bucket numbers at once

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes = flat, sizes
        self.ends = np.cumsum(sizes, dtype=np.int64)
        cuts = np.searchsorted(self.ends, np.arange(0, len(flat) + self.BLOCK, self.BLOCK))
        self.blocks = [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
        if len(sizes) and (not self.blocks or self.blocks[-1][1] < len(sizes)):
            self.blocks.append((self.blocks[-1][1] if self.blocks else 0, len(sizes)))

    def of(self, word: int) -> np.ndarray:
        return self.flat[self.ends[word] - self.sizes[word]:self.ends[word]]

    def _block(self, a: int, b: int) -> tuple[np.ndarray, int]:
        start = self.ends[a] - self.sizes[a]
        return self.flat[start:self.ends[b - 1]], start

    def mean(self, of_bucket: np.ndarray) -> np.ndarray:
        """Mean over each word's buckets."""
        out = np.empty(len(self.sizes))
        for a, b in self.blocks:
            part, start = self._block(a, b)
            out[a:b] = np.add.reduceat(of_bucket[part], self.ends[a:b] - self.sizes[a:b] - start)
        return out / self.sizes

    def spread(self, of_word: np.ndarray) -> np.ndarray:
        """Sum per bucket of what each word passes on to its buckets in equal shares."""
        out, share = np.zeros(BUCKETS), of_word / self.sizes
        for a, b in self.blocks:
            part, _ = self._block(a, b)
            out += np.bincount(part, np.repeat(share[a:b], self.sizes[a:b]), BUCKETS)
        return out


def train(sample: Sample, seed: int = 7, rounds: int = 80) -> Model:
    """Joint training of vectors and softmax on the windows of labelled texts.

    A window carries its text's label. Words of clean windows occur under both labels and stay
    near the base rate; what only toxic texts hold stands out. Each round draws its windows anew. A
    fifth of the texts is kept back for the probability curve: on texts learned from, it would be too sure.
    """
    rng = np.random.default_rng(seed)
    back = np.arange(len(sample.rows)) % 5 == 0
    used = [(r, y) for r, y, b in zip(sample.rows, sample.labels, back, strict=True) if len(r) and not b]
    rows, y_text = [r for r, _ in used], np.array([y for _, y in used], float)
    if not rows or len(set(y_text)) < 2:
        base = float(np.clip(y_text.mean() if rows else 0.0, 1e-3, 1 - 1e-3))
        return Model(np.zeros(BUCKETS), 0.0, (0.0, float(np.log(base / (1 - base)))))
    lists = Lists(np.frombuffer(sample.buckets, np.int32), np.frombuffer(sample.sizes, np.int32))
    held, mark = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, bool)
    for r in rows:
        mark[:] = False
        for w in np.unique(r):
            mark[lists.of(w)] = True
        held += mark
    common = held >= min(MIN_TEXTS, max(1, len(rows) // 50))
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM)) * common[:, None]
    out = rng.normal(0, 0.1, DIM)
    positive = y_text.mean()
    bias = np.log(positive / (1 - positive))
    spans = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    words = np.concatenate(rows)
    # every run of WINDOW words within a text is a window; a shorter text is one, padded with nothing
    upto = np.cumsum([max(len(r) - WINDOW, 0) + 1 for r in rows])
    moments = [np.zeros_like(vectors), np.zeros_like(vectors), np.zeros(DIM), np.zeros(DIM)]
    offsets = np.concatenate([[0], upto])
    for step in range(1, rounds + 1):
        # a word is the mean of its subwords, and the softmax is linear in it: one number per subword will do
        value = lists.mean((vectors @ out).astype(np.float32))
        pick = np.arange(upto[-1]) if upto[-1] <= ROUND_WINDOWS else rng.integers(0, upto[-1], ROUND_WINDOWS)
        home = np.searchsorted(upto, pick, "right")
        place = (spans[home] + pick - offsets[home])[:, None] + np.arange(WINDOW)
        inside = place < spans[home + 1][:, None]
        held_words = words[np.minimum(place, len(words) - 1)]
        logit = (value[held_words] * inside).sum(1) / WINDOW + bias
        y = y_text[home]
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        z = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        g = weight * (z - y) / len(pick)
        # gradient of each word: the sum over the windows that hold it
        per_word = np.bincount(held_words.ravel(), (inside * g[:, None]).ravel(), len(value)) / WINDOW
        per_feature = lists.spread(per_word) * common
        grad_out = vectors.T @ per_feature
        grad_vec = per_feature[:, None] * out[None, :]
        rate = 0.1
        for k, (param, grad) in enumerate(((vectors, grad_vec), (out, grad_out))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad * grad
            param -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
            param *= 1 - DECAY
        bias -= 0.5 * float(g.sum())
    weights = vectors @ out
    value = lists.mean(weights)
    model = Model(weights, float(bias), (1.0, 0.0))
    for chosen in (back, ~back):  # texts learned from only where none was kept back
        found = [(window_peak(value[r]) + bias, y)
                 for r, y, c in zip(sample.rows, sample.labels, chosen, strict=True) if c and len(r)]
        x, y = (np.array([f[k] for f in found], float) for k in (0, 1))
        if 0 < y.sum() < len(y):
            model.scale = calibrate(x, y, float(y.mean()))
            break
    return model


def calibrate(x: np.ndarray, y: np.ndarray, positive: float) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (x, y), by Newton steps."""
    centre, spread = float(x.mean()), float(x.std()) or 1.0
    u = (x - centre) / spread
    a, b = 1.0, float(np.log(positive / (1 - positive)))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * u * u).sum() + 1.0, (w * u).sum()], [(w * u).sum(), w.sum() + 1e-6]])
        d = np.linalg.solve(h, np.array([((p - y) * u).sum() + a, (p - y).sum()]))
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-8:
            break
    a = max(a, 1e-6)
    return a / spread, b - a * centre / spread


def toxicity_model(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled rows (label columns doc_id, toxic), chosen by hash of the id.

    Only the chosen ids, bounded in number, are broadcast to find their texts. One task reads that
    bounded sample and trains; the driver gets one number per bucket. Null and other labels than 0
    and 1 teach nothing; of repeated ids the greatest label and text count; where one label is
    missing, every text scores its base rate.
    """
    ship(docs.sparkSession)
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(
        "doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = (docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
            .groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")))

    def fit(batches):
        sample = Sample()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    sample.add(text, label)
        m = train(sample)
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in ((m.weights.astype("<f8").tobytes(), pa.binary()), (m.bias, pa.float64()),
                                           (m.scale[0], pa.float64()), (m.scale[1], pa.float64()))],
            names=["weights", "bias", "slope", "offset"])

    got = (rows.repartition(1).sortWithinPartitions("doc_id").select("text", "toxic")
           .mapInArrow(fit, "weights binary, bias double, slope double, offset double").first())
    if got is None:  # no labelled row at all
        return train(Sample())
    return Model(np.frombuffer(got["weights"], "<f8"), got["bias"], (got["slope"], got["offset"]))


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.3, carry: tuple[str, ...] = ()) -> DataFrame:
    """Id, carried columns, score and predicted (score >= threshold) for each row.

    Map-only over whole texts. Null and empty texts, and those without words, get the lowest score;
    repeated rows and null ids keep their rows; equal texts score alike; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        m = shared.value
        score = np.fromiter((m.score(t) for t in batch.column("text").to_pylist()), np.float64, batch.num_rows)
        return {**{c: batch.column(c) for c in out}, "score": score,
                "predicted": (score >= threshold).astype(np.int32)}

    out = ("doc_id", *carry)
    source = docs.select(*dict.fromkeys((*out, "text")))
    kinds = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in out)
    return map_batches(source, f"{kinds}, score double, predicted int", run)
