"""Vector bin packing: whole, within all limits, without padding; ids as the vocabulary's own library gives them."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bizcontacts.llm.common import tokenizer_file
from bizcontacts.llm.vector_packing import ByteIds, Limits, pack_examples

FILE = tokenizer_file("byte_bpe_50k.json")
ODD = ["<|endoftext|>a", "x<|endoftext|> <|endoftext|>", "  a\n\n b\t", "\u0000﻿é日本🙂", "'s 'S it's 'LL", "\r\n \x85 　x",
       "½²①", "a" * 5000, " " * 5000, "\n" * 3000 + "x", "٣٤ 12", "é", "<|endoftext|", "   b", "a" * 100_000]


def ids_of(text):
    return [*Tokenizer.from_file(FILE).encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_are_those_of_the_library():
    encode, rng = ByteIds(open(FILE, encoding="utf-8").read()), random.Random(2)
    signs = "ab cD'sé日🙂\n\t 12½.,!<|> ̀"
    texts = ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(500)]
    tok = Tokenizer.from_file(FILE)
    for t in texts:
        want = tok.encode(t, add_special_tokens=False).ids
        assert encode(t).tolist() == want and (not t or encode.slow(t).tolist() == want)


def test_very_long_white_space_is_encoded():
    encode = ByteIds(open(FILE, encoding="utf-8").read())
    text = " " * 1_500_000 + "x"
    assert encode(text).tolist() == encode.slow(text).tolist()


def check(rows, pieces, limits, tokens):
    """Every id once, in order; sequences gapless, within limits, full or a power of two long."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc, text in rows:
        want = tokens(text)
        parts = sorted(by_doc[doc], key=lambda p: p.start)
        assert [p.start for p in parts] == list(np.cumsum([0, *(p.length for p in parts)])[:-1])
        assert np.concatenate([np.frombuffer(bytes(p.ids), "<u4") for p in parts]).tolist() == want
        assert {p.doc_tokens for p in parts} == {len(want)}
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == list(np.cumsum([0, *(p.length for p in parts)])[:-1])
        assert [p.segment for p in parts] == list(range(len(parts)))
        total = sum(p.length for p in parts)
        assert total == limits.tokens or total & (total - 1) == 0
        assert total <= limits.tokens and len(parts) <= limits.segments
        assert sum(p.loss_tokens for p in parts) <= limits.loss
    return by_sequence


def test_documents_are_packed_whole(spark, docs, doc_rows):
    pieces = pack_examples(docs, pool=16).collect()
    rows = [r[:2] for r in doc_rows]
    sequences = check(rows, pieces, Limits(), ids_of)
    assert {p.doc_id for p in pieces} == {r[0] for r in rows}
    total = sum(p.length for p in pieces)
    assert len(sequences) <= total // 2048 + 12 * docs.rdd.getNumPartitions()


def test_three_limits_hold_at_once(spark):
    rng = random.Random(4)
    rows = [(k, "ask " * rng.randint(0, 90), "tell " * rng.randint(0, 60)) for k in range(400)]
    limits = Limits(tokens=512, segments=6, loss=150)
    df = spark.createDataFrame(rows, "doc_id long, prompt string, text string").coalesce(2)
    pieces = pack_examples(df, limits, prompt_col="prompt", pool=64).collect()
    tok = Tokenizer.from_file(FILE)
    whole = {k: tok.encode(p, add_special_tokens=False).ids + tok.encode(t, add_special_tokens=False).ids + [1] for k, p, t in rows}
    sequences = check([(k, k) for k, _, _ in rows], pieces, limits, lambda k: whole[k])
    loss = sum(p.loss_tokens for p in pieces)
    assert loss == sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for _, _, t in rows)
    # examples stay mostly whole, and the sequences are near the bound the scarcest limit sets
    assert len(pieces) < 2 * len(rows)
    need = max(sum(map(len, whole.values())) / 512, loss / 150, len(rows) / 6)
    assert len(sequences) < 2 * need


def test_short_and_repeated_rows(spark):
    rows = [(k // 2, "a") for k in range(1000)] + [(None, None), (None, "")]
    pieces = pack_examples(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sum(p.length for p in pieces) == 2 * 1000 + 2
    assert sum(p.doc_id is None for p in pieces) == 2
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pack_examples(none).count() == 0


def test_checksums_of_pieces(spark, docs, doc_rows):
    got = pack_examples(docs).select("doc_id", "start", "length", F.crc32("ids").alias("c")).collect()
    texts = {r[0]: r[1] for r in doc_rows}
    for p in got[:60]:
        ids = np.array(ids_of(texts[p.doc_id])[p.start:p.start + p.length], "<u4")
        assert p.c == zlib.crc32(ids.tobytes())
