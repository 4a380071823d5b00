"""Token counts by heap-and-linked-list byte-pair merging.

A text becomes a linked list of symbols; a heap yields the pair whose merge ranks lowest, until no
pair merges. The count is the initial symbols minus the merges; no identifiers are made. Symbols
outside the vocabulary count as their UTF-8 bytes.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizcontacts.llm.common import map_batches, tokenizer_file

MODEL = "piece_bpe_32k.model"
SPACE = "▁"


class PairMerger:
    """Counts the pieces of a text under ranked merges.

    ``ranks`` maps each piece to its rank (lower merges first; equal ranks merge from the left).
    A text is cut where no piece can span: before a run of spaces, and around line breaks if the
    vocabulary has none. Counts of such cuts are remembered, up to ``limit`` of them.
    """

    def __init__(self, ranks: dict[str, int], limit: int = 600_000):
        if any(SPACE in p.lstrip(SPACE) for p in ranks):
            raise ValueError("a piece spans a word boundary: texts can't be cut before spaces")
        self.ranks, self.limit = ranks, limit
        self.lines = not any("\n" in p for p in ranks)
        self.known: dict[str, int] = {}

    @classmethod
    def load(cls, path: str) -> PairMerger:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size())
                 if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        scores = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        return cls({sp.id_to_piece(i): scores[sp.get_score(i)] for i in plain})

    def merge(self, text: str) -> int:
        """Pieces of ``text``, in which spaces are already marked."""
        ranks, n = self.ranks, len(text)
        count = n
        for ch in text:
            if ch not in ranks:
                count += len(ch.encode("utf-8", "surrogatepass")) - 1
        if n < 2:
            return count
        piece = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = ranks.get(text[i:i + 2])
            if r is not None:
                heap.append((r, i, 2))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, size = pop(heap)
            left = piece[i]
            if left is None:
                continue
            j = after[i]
            if j >= n or len(left) + len(piece[j]) != size:
                continue
            merged = piece[i] = left + piece[j]
            if size == 2:  # a symbol that only a merge knows no longer counts as bytes
                for ch in merged:
                    if ch not in ranks:
                        count -= len(ch.encode("utf-8", "surrogatepass")) - 1
            piece[j] = None
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = ranks.get(merged + piece[k])
                if r is not None:
                    push(heap, (r, i, size + len(piece[k])))
            k = before[i]
            if k >= 0:
                r = ranks.get(piece[k] + merged)
                if r is not None:
                    push(heap, (r, k, len(piece[k]) + size))
        return count

    def cut(self, chunk: str) -> int:
        if len(self.known) >= self.limit:
            self.known.clear()
        n = self.known[chunk] = self.merge(chunk)
        return n

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; null and empty give 0."""
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        known, cut, total = self.known, self.cut, 0
        lines = text.split("\n") if self.lines else [text]
        total += len(lines) - 1
        for line in lines:
            words = line.split(SPACE)
            if "" in words[1:]:  # runs of spaces stay with the word that follows
                words = re.findall(f"^[^{SPACE}]+|{SPACE}+[^{SPACE}]*", line)
                for w in words:
                    n = known.get(w)
                    total += cut(w) if n is None else n
                continue
            if words[0]:
                n = known.get(words[0])
                total += cut(words[0]) if n is None else n
            for w in words[1:]:
                w = SPACE + w
                n = known.get(w)
                total += cut(w) if n is None else n
        return total


_MERGERS: dict[str, PairMerger] = {}


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 path: str | None = None, limit: int = 4096) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit.

    Map-only. Null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids keep their
    rows; other columns are not read. An empty table gives an empty result.
    """
    path = path or tokenizer_file(MODEL)

    def count(batch):
        merger = _MERGERS.get(path) or _MERGERS.setdefault(path, PairMerger.load(path))
        texts = batch.column("text").to_pylist()
        n = np.fromiter((merger.count(t) for t in texts), np.int64, len(texts))
        return {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"),
                "n_tokens": n, "over_limit": n > limit}

    source = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return map_batches(source, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean", count)
