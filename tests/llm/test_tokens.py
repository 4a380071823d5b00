"""Token counts and token files against the libraries themselves."""

import zlib

import numpy as np
import pytest

from bizcontacts.llm.common import Scratch, tokenizer_file
from bizcontacts.llm.token_counts import token_counts
from bizcontacts.llm.token_files import decode, encode, read_token_files, write_token_files


def test_counts_are_those_of_the_library(docs, doc_rows):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in token_counts(docs).collect()}
    assert len(got) == len(doc_rows)
    for doc, text, *_ in doc_rows:
        n = len(sp.encode(text or ""))
        assert (got[doc].n_bytes, got[doc].n_tokens) == (len((text or "").encode()), n), (doc, (text or "")[:60])
        assert got[doc].over_limit == (n > 4096)


def test_counts_of_odd_texts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    odd = ["<s> a </s>", "▁ ▁▁x", "a    b", "\u0000", "日本語のテキスト", "🙂🙂", "<0x41>", "  lead", "trail  ", "a\tb\r\nc", "<unk>"]
    got = dict(token_counts(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"))
               .select("doc_id", "n_tokens").collect())
    assert got == {k: len(sp.encode(t)) for k, t in enumerate(odd)}


def test_counts_keep_repeated_rows_and_empty_tables(docs, no_docs):
    assert token_counts(docs.unionAll(docs)).count() == 2 * docs.count()
    assert token_counts(no_docs).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1001])
def test_variable_length_code_returns_its_values(n):
    v = np.random.default_rng(n).integers(0, 1 << 32, n) >> np.random.default_rng(n + 1).integers(0, 32, n)
    control, data = encode(v)
    assert np.array_equal(decode(control, data, n), v)


def expected_files(rows):
    from tokenizers import Tokenizer

    tok, start, out = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), 0, {}
    for doc, text, *_ in sorted(rows):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out[doc] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


def test_files_give_back_the_ids_of_the_library(spark, docs, doc_rows):
    folder = Scratch(spark, "files").root
    write_token_files(docs, folder)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in read_token_files(spark, folder).collect()}
    assert got == expected_files([r[:2] for r in doc_rows])


def test_files_of_an_empty_table(spark, no_docs):
    folder = Scratch(spark, "files").root
    write_token_files(no_docs, folder)
    assert read_token_files(spark, folder).count() == 0


def test_files_keep_repeated_rows(spark, docs):
    folder = Scratch(spark, "files").root
    write_token_files(docs.unionAll(docs), folder)
    rows = sorted((r.start, r.n_tokens) for r in read_token_files(spark, folder).collect())
    assert len(rows) == 2 * docs.count()
    assert all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:]))


def test_ids_of_odd_texts():
    import random

    from tokenizers import Tokenizer

    from bizcontacts.llm.token_files import ChunkIds

    path, rng = tokenizer_file("word_bpe_49k.json"), random.Random(3)
    signs = "aBc'sdtré日🙂\t\n12½.,!<|>̀İΣſß²ªº-_߿   x y  "
    odd = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    odd += ["<|endoftext|>", "a<|startoftext|>b", "<|x|>", "I'll don'T we'RE ''s's", "ÀÉÎ ŠŽ ǅ ǈ", "ﬁ Å", "a" * 3000, "." * 3000, "ÿ" * 700, None]
    want = Tokenizer.from_file(path)
    for limit in (1_000_000, 50):  # the second memory is emptied again and again
        got = list(ChunkIds(path, limit).texts(odd))
        assert all(g.tolist() == want.encode(o or "", add_special_tokens=False).ids for o, g in zip(odd, got))


def test_a_piece_is_looked_up_once_however_often_it_comes():
    """Look-ups go with the distinct pieces of a batch of texts, not with all pieces."""
    from bizcontacts.llm.token_files import ChunkIds

    class Counted(dict):
        asked = 0

        def get(self, *args):
            self.asked += 1
            return super().get(*args)

    ids = ChunkIds(tokenizer_file("word_bpe_49k.json"))
    ids.known = Counted(ids.known)
    texts = ["the same words again\n" * 200, None, "", "the  words "] * 50
    want = [ids.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [got.tolist() for got in ids.texts(texts)] == want
    assert ids.known.asked <= 10
