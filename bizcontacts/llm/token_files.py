"""Token-id files: frequency-ranked ids in byte-aligned variable-length code with control bytes.

Ids are replaced by their rank by corpus frequency, so common ids fit one byte. Four values share a
control byte that holds their byte lengths (two bits each); the value bytes follow in a stream of
their own. Decoding looks the control bytes up in a table and gathers the value bytes in numpy.
A file set is a folder of Parquet files: ``blocks`` (shard, block, document ids and lengths, control
and value bytes) in ascending document order, and ``ranks`` (the id of each rank).
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bizcontacts.llm.common import Scratch, map_batches, ship, tokenizer_file

MODEL = "word_bpe_49k.json"
END_ID = 1
BLOCK_TOKENS = 500_000
SHARD_BYTES = 16 << 20  # of encoded ids
BLOCKS = ("shard int, block int, doc_ids array<long>, doc_tokens array<long>, n_tokens long, "
          "control binary, data binary")

# byte lengths of the four values behind each control byte
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, value bytes) of non-negative integers below 2**32."""
    v = values.astype("<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[:len(v)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    keep = np.arange(4, dtype=np.uint8)[None, :] < size[:, None]
    return control.astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values that :func:`encode` was given."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4, dtype=np.uint8)[None, :] < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")


class WordPieces:
    """Ids of single words of Latin script under a vocabulary whose pieces may mark a word's end.

    The vocabulary goes to a second, faster library as byte strings, with the end mark as a character
    no Latin word holds. Its bytes join first, then join the last byte of the word, as the mark
    belongs to the last symbol from the start; all later merges come in the order of the file.
    """

    MARK = "\u07ff"
    LATIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")

    def __init__(self, made: dict):
        import regex
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        end, mark = made["model"]["end_of_word_suffix"], self.MARK.encode()
        # ids move up by one: the mark comes before all
        ranks = {mark: 0}
        for piece, i in made["model"]["vocab"].items():
            last = piece.endswith(end)
            ranks[bytes(byte[c] for c in (piece.removesuffix(end) if last else piece)) + (mark if last else b"")] = i + 1
        self.encoding = tiktoken.Encoding("words", pat_str=r"[^ \n]+|\n", mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special, self.cut = tuple(t["content"] for t in made["added_tokens"]), ranks[b"\n"]

    def covers(self, chunk: str) -> bool:
        """True for a chunk without white space that need not go to the vocabulary's own library."""
        return bool(self.LATIN.fullmatch(chunk)) and not ("<|" in chunk and any(s in chunk for s in self.special))

    def encode(self, chunks: list[str], dtype: np.dtype) -> Iterator[bytes]:
        """Ids of each chunk, all encoded in one call, with a line break between them."""
        marked = self.split.sub(rf"\g<0>{self.MARK} ", "\n".join(chunks).lower() + "\n")
        ids = self.encoding.encode_to_numpy(marked)
        ends = np.flatnonzero(ids == self.cut)
        data, width = (ids - np.uint32(1)).astype(dtype).tobytes(), dtype.itemsize
        starts = np.concatenate([[0], ends[:-1] + 1])
        for a, b in zip((starts * width).tolist(), (ends * width).tolist(), strict=True):
            yield data[a:b]


class ChunkIds:
    """Ids of texts as the tokenizers library gives them, remembered for each run of non-space characters.

    The vocabulary's rules never reach across a space or line break, so a text's ids are those of
    its pieces. New ones of Latin script are encoded word by word, others go to the library in one
    batch; the memory is emptied when full.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = file.read()
        self.tokenizer, self.limit = Tokenizer.from_str(content), limit
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words = WordPieces(json.loads(content))
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {"": b""}

    def learn(self, new: set[str]) -> None:
        if len(self.known) + len(new) > self.limit:
            self.known = {"": b""}
        latin = [p for p in new if self.words.covers(p)]
        odd = list(new.difference(latin))
        for k in range(0, len(latin), 20_000):
            part = latin[k:k + 20_000]
            self.known.update(zip(part, self.words.encode(part, self.dtype), strict=True))
        for k in range(0, len(odd), 20_000):
            part = odd[k:k + 20_000]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[p] = np.array(e.ids, self.dtype).tobytes()

    def texts(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for first in range(0, len(texts), 500):
            lines = pa.array([(t or "").replace("\n", " ") for t in texts[first:first + 500]], pa.large_string())
            split = pc.split_pattern(lines, " ")
            pieces = split.flatten().dictionary_encode()
            distinct, at = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), pieces.indices.to_numpy()
            found = list(map(self.known.get, distinct))
            new = [k for k, ids in enumerate(found) if ids is None]
            self.learn({distinct[k] for k in new})
            for k in new:
                found[k] = self.known[distinct[k]]
            ids = np.frombuffer(b"".join(found), self.dtype)
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
            starts, taken = (np.cumsum(sizes) - sizes)[at], sizes[at]
            ends = np.concatenate([[0], np.cumsum(taken)])
            # the ids of each piece in its place: an offset per piece, and places counted through
            flat = ids[np.repeat(starts - ends[:-1], taken) + np.arange(ends[-1])]
            bounds = ends[split.offsets.to_numpy()].tolist()
            yield from (flat[a:b] for a, b in zip(bounds, bounds[1:]))


_CHUNKS: dict[str, ChunkIds] = {}


def _chunks(path: str) -> ChunkIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return _CHUNKS.get(path) or _CHUNKS.setdefault(path, ChunkIds(path))


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) with the ids of whole texts as little-endian integers of the vocabulary's width."""

    def run(batch):
        texts = batch.column("text").to_pylist()
        return {"doc_id": batch.column("doc_id"), "ids": [ids.tobytes() for ids in _chunks(path).texts(texts)]}

    return map_batches(docs, "doc_id long, ids binary", run)


def id_ranks(encoded: DataFrame, dtype: np.dtype, end_id: int | None) -> np.ndarray:
    """Ids by falling corpus frequency. At most one row per vocabulary id is collected."""

    def count(batches):
        total = np.zeros(0, np.int64)
        ends = 0
        for batch in batches:
            c = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype), minlength=len(total))
            c[:len(total)] += total
            total, ends = c, ends + batch.num_rows
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, -1), pa.int64()), pa.array(np.append(total[seen], ends), pa.int64())],
            names=["id", "n"])

    got = dict(encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n")).collect())
    ends = got.pop(-1, 0)
    if end_id is not None:
        got[end_id] = got.get(end_id, 0) + ends
    return np.array(sorted(got, key=lambda i: (-got[i], i)), np.int64)


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text",
                      path: str | None = None, end_id: int | None = END_ID) -> None:
    """Encode whole texts in ascending id order into a new file set at ``folder``.

    Null and empty texts hold the end id alone; repeated ids keep all their rows, null ids come
    first; other columns are not read; an empty table gives a set without blocks. Texts are encoded
    once, into a scratch table of ids; frequencies are counted there, and ids, not texts, are dealt by
    range of document, so order costs one narrow shuffle and no task sees more than its range.
    """
    path = path or tokenizer_file(MODEL)
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scratch, dtype = Scratch(spark, "token_ids"), _chunks(path).dtype
    encoded = scratch.save(encode_texts(source, path), "encoded")
    order = id_ranks(encoded, dtype, end_id)
    size = encoded.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    rank = np.zeros(int(order.max(initial=0)) + 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)

    def pack(batches):
        from pyspark import TaskContext

        shard, block = TaskContext.get().partitionId(), 0
        ids, held, tokens = [], [], 0
        tail = np.array([] if end_id is None else [end_id], dtype)

        def flush():
            values = rank[np.concatenate(held)] if held else np.zeros(0, np.uint32)
            control, data = encode(values)
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in (
                    (shard, pa.int32()), (block, pa.int32()), (ids, pa.list_(pa.int64())),
                    ([len(h) for h in held], pa.list_(pa.int64())), (len(values), pa.int64()),
                    (control, pa.binary()), (data, pa.binary()))],
                names=["shard", "block", "doc_ids", "doc_tokens", "n_tokens", "control", "data"])

        for batch in batches:
            for doc, got in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc)
                held.append(np.concatenate([np.frombuffer(got, dtype), tail]))
                tokens += len(held[-1])
                if tokens >= BLOCK_TOKENS:
                    yield flush()
                    block, ids, held, tokens = block + 1, [], [], 0
        if ids:
            yield flush()

    shards = max(1, -(-size // SHARD_BYTES))
    dealt = encoded.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id")
    dealt.mapInArrow(pack, BLOCKS).write.parquet(f"{folder}/blocks")
    scratch.drop(encoded)
    ranked = spark.createDataFrame([(order.astype("<u4").tobytes(),)], "ids binary")
    ranked.coalesce(1).write.parquet(f"{folder}/ranks")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files of one set.

    ``start`` counts the ids of all documents before. Block totals are summed within shards, then
    over shards, of which there are as many as write tasks.
    """
    ship(spark)
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    order = np.frombuffer(spark.read.schema("ids binary").parquet(f"{folder}/ranks").first()[0], "<u4")

    def digest(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = order[decode(r["control"], r["data"], r["n_tokens"])].astype("<u4")
                sizes = np.array(r["doc_tokens"], np.int64)
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[e - s:e].tobytes()) for s, e in zip(sizes, ends, strict=True)]
                k = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array([r["shard"]] * k, pa.int32()),
                     pa.array([r["block"]] * k, pa.int32()), pa.array(ends - sizes, pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "shard", "block", "ahead", "n_tokens", "ids_crc32"])

    rows = blocks.mapInArrow(digest, "doc_id long, shard int, block int, ahead long, n_tokens long, ids_crc32 long")
    totals = blocks.select("shard", "block", "n_tokens")
    shards = totals.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    over = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (totals.join(shards, "shard")
              .select("shard", "block",
                      (F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("first")))
    return rows.join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("first") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")
