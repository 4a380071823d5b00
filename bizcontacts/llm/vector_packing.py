"""Vector bin packing of training examples into token sequences.

A sequence has three limits at once: tokens, segments and loss-bearing tokens. Each task packs the
examples it encodes: a pool of them is held, and the open sequence takes the example that fits it
whole and has the greatest dot product of its demands with what the sequence has left, all in
shares of the limits. Where none fits whole, the best one is cut to size. What cannot be filled is
cut back to a power of two, which needs no padding. Nothing is shuffled, and a task holds no more
than its pool.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bizcontacts.llm.common import ROWS_AT_ONCE, ship, tokenizer_file

MODEL = "byte_bpe_50k.json"
END_ID = 1
POOL = 1024
# \p classes as the byte-level pre-tokenizer of the vocabulary file has them; a fixed value
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


class ByteIds:
    """Ids of whole texts under a byte-level BPE vocabulary file, as its own library gives them.

    The vocabulary is handed to a second, faster library; texts it cannot take go to the first.
    """

    def __init__(self, content: str):
        import os

        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        made = json.loads(content)
        if made["pre_tokenizer"].get("type") != "ByteLevel" or made["normalizer"] is not None:
            raise ValueError("not a byte-level vocabulary")
        # printable bytes stand for themselves in the file, the others for the characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        special = {t["content"]: t["id"] for t in made["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in made["model"]["vocab"].items() if token not in special}
        self.content, self.plain = content, None
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # the pattern's steps run out on some very long runs of white space
            return self.slow(text)

    def slow(self, text: str) -> np.ndarray:
        from tokenizers import Tokenizer

        if self.plain is None:
            self.plain = Tokenizer.from_str(self.content)
            self.plain.no_truncation()
            self.plain.no_padding()
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)


@dataclass
class Example:
    """What is left to place of one example: ids from ``start``; those from ``loss_from`` on bear loss."""

    row: tuple
    ids: np.ndarray
    loss_from: int
    start: int = 0

    def loss(self, length: int) -> int:
        return max(0, self.start + length - max(self.start, self.loss_from))

    def fitting(self, tokens: int, loss: int) -> int:
        """Greatest length within both limits, from the start on."""
        free = max(0, self.loss_from - self.start)
        return min(len(self.ids) - self.start, tokens, free + loss)


class Packer:
    """Sequences as lists of (example, start, length), from a stream of examples."""

    def __init__(self, limits: Limits, pool: int = POOL):
        self.limits, self.pool = limits, pool
        self.held: list[Example] = []
        self.size, self.loss = np.zeros(2 * pool + 4), np.zeros(2 * pool + 4)
        self.open: list[tuple[Example, int, int]] = []
        self.left = [limits.tokens, limits.segments, limits.loss]

    def add(self, e: Example) -> Iterator[list]:
        """Take an example in; full sequences of a long one leave at once."""
        t = self.limits.tokens
        while len(e.ids) - e.start >= t and e.fitting(t, self.limits.loss) == t:
            yield [(e, e.start, t)]
            e.start += t
        if e.start < len(e.ids):
            self._hold(e)
        while len(self.held) > self.pool:
            yield from self._place()

    def finish(self) -> Iterator[list]:
        while self.held or self.open:
            if self.held:
                yield from self._place()
            else:
                yield self._close()

    def _hold(self, e: Example) -> None:
        k = len(self.held)
        if k == len(self.size):
            self.size, self.loss = np.append(self.size, np.zeros(k)), np.append(self.loss, np.zeros(k))
        self.held.append(e)
        self.size[k] = n = len(e.ids) - e.start
        self.loss[k] = e.loss(n)

    def _drop(self, k: int) -> None:
        last = self.held.pop()
        if k < len(self.held):
            self.held[k] = last
            self.size[k], self.loss[k] = self.size[len(self.held)], self.loss[len(self.held)]

    def _put(self, e: Example, length: int) -> None:
        self.open.append((e, e.start, length))
        self.left[0] -= length
        self.left[1] -= 1
        self.left[2] -= e.loss(length)
        e.start += length

    def _place(self) -> Iterator[list]:
        """Put one more segment into the open sequence, or close it."""
        tokens, segments, loss = self.left
        k = None
        if segments:
            n = len(self.held)
            size, bear = self.size[:n], self.loss[:n]
            # dot product with what is left, in shares of the limits; the segment's share is the same for all
            score = size * (tokens / self.limits.tokens ** 2) + bear * (loss / self.limits.loss ** 2)
            whole = np.where((size <= tokens) & (bear <= loss), score, -1.0)
            k = int(whole.argmax())
            length = int(size[k])
            if whole[k] < 0:
                cut = np.array([e.fitting(tokens, loss) for e in self.held]) if loss < tokens else np.minimum(size, tokens)
                k = int(np.where(cut > 0, score, -1.0).argmax())
                length = int(cut[k])
            if not length:
                k = None
        if k is None:
            yield self._close()
            return
        e = self.held[k]
        self._put(e, length)
        if e.start == len(e.ids):
            self._drop(k)
        else:
            self.size[k] -= length
            self.loss[k] = e.loss(len(e.ids) - e.start)
        if not self.left[0]:
            yield self._close()

    def _close(self) -> list:
        """The open sequence; one that is not full is cut to a power of two, and the rest stays at hand."""
        n = self.limits.tokens - self.left[0]
        want = n if n == self.limits.tokens else 1 << (n.bit_length() - 1)
        out, rest, total = [], [], 0
        for e, start, length in self.open:
            take = min(length, want - total)
            if take:
                out.append((e, start, take))
                total += take
            if take < length:
                rest.append(Example(e.row, e.ids[:start + length], e.loss_from, start + take))
        self.open, self.left = [], [self.limits.tokens, self.limits.segments, self.limits.loss]
        for e in rest:
            self._hold(e)
        return out


def pack_examples(rows: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text",
                  prompt_col: str | None = None, end_id: int | None = END_ID, path: str | None = None,
                  pool: int = POOL) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, loss_tokens, ids (32-bit little-endian), sequence_id, segment, offset.

    An example is the ids of its prompt, which bear no loss, then those of its text and the end id,
    which do. Each id lies in exactly one piece. A sequence's pieces follow one another from offset 0, and
    none of its limits is passed; it is full, or its length is a power of two. Null texts count as
    empty; an example without any id (empty, no end id) has no piece; repeated and null ids keep all
    their rows; other columns are not read; no rows, no pieces. Sequence ids are unique; which examples
    meet depends on the partitions of the input, each of which is packed on its own.
    """
    if min(limits.tokens, limits.segments, limits.loss) < 1:
        raise ValueError("limits must be positive")
    spark = rows.sparkSession
    ship(spark)
    path = path or tokenizer_file(MODEL)
    with open(path, encoding="utf-8") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())  # one vocabulary file
    source = rows.select(F.col(id_col), F.col(text_col).alias("text"),
                         (F.col(prompt_col) if prompt_col else F.lit(None).cast("string")).alias("prompt"))
    longs = [T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "loss_tokens")]
    out = T.StructType([source.schema[id_col], *longs, T.StructField("ids", T.BinaryType()),
                        *[T.StructField(n, T.LongType()) for n in ("sequence_id", "segment", "offset")]])
    return source.mapInArrow(_packed(path, vocabulary, limits, end_id, pool, out), out)


_ENCODERS: dict[str, ByteIds] = {}


def _packed(path: str, vocabulary, limits: Limits, end_id: int | None, pool: int, out: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = _ENCODERS.get(path) or _ENCODERS.setdefault(path, ByteIds(vocabulary.value))
        packer, number = Packer(limits, pool), TaskContext.get().partitionId() << 40
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        made: list[tuple] = []

        def note(sequence: list) -> None:
            nonlocal number
            offset = 0
            for k, (e, start, length) in enumerate(sequence):
                loss = max(0, start + length - max(start, e.loss_from))
                made.append((*e.row[:1], start, length, e.row[1], loss,
                             e.ids[start:start + length].astype("<u4").tobytes(), number, k, offset))
                offset += length
            number += 1

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), target, strict=True)], schema=target)
            made.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                for key, text, prompt in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    first = encode(prompt)
                    ids = np.concatenate([first, encode(text), tail])
                    for sequence in packer.add(Example((key, len(ids)), ids, len(first))):
                        note(sequence)
                if made:
                    yield flush()
        for sequence in packer.finish():
            note(sequence)
        if made:
            yield flush()

    return run
