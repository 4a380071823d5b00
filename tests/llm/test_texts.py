"""Decontamination, secret scan, chat formatting, packing, toxicity and language identification."""

import hashlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from bizcontacts.llm.chat_format import TIE, chat_digest, conversation_events, escape, parse_turns, render_chats, unescape
from bizcontacts.llm.common import held_out, table
from bizcontacts.llm.decontaminate import MASKS, SUBSTITUTIONS, WINDOW, find_leaks
from bizcontacts.llm.language_id import identify_languages
from bizcontacts.llm.packing import Packer, document_items, pack_documents
from bizcontacts.llm.secret_scan import labelled_findings, scan_secrets, secret_report, train_forest
from bizcontacts.llm.toxicity import score_toxicity, toxicity_model


def test_no_two_substitutions_escape_both_masks():
    places = [{p + k for k, c in enumerate(m) if c == "1"} for m in MASKS for p in range(WINDOW - len(m) + 1)]
    for gone in combinations(range(WINDOW), SUBSTITUTIONS):
        assert any(not seed & set(gone) for seed in places), gone


def test_leaks_with_substitutions_are_found(spark):
    item = " ".join(f"q{k}" for k in range(20))
    words = item.split()
    changed = [w if k not in (4, 11) else "zz" for k, w in enumerate(words)]
    every = [w if k % 3 else "zz" for k, w in enumerate(words)]
    rows = [(1, "pre " + item.upper() + " post"), (2, " ".join(["a"] * 3000 + changed + ["b"])), (3, " ".join(every)),
            (4, "nothing here"), (5, None), (6, ""), (7, " ".join(words[:6]))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, leaks string")
    bench = spark.createDataFrame([(9, item, "m"), (9, item, "m"), (None, item, "m"), (10, None, "m"), (11, "", "m")],
                                  "item_id long, text string, leaks string")
    got = {r.doc_id: r for r in find_leaks(docs, bench).collect()}
    assert {d for d, r in got.items() if r.contaminated} == {1, 2}
    assert set(got[2]["items"]) == {9} and got[2].n_items == 1
    assert not find_leaks(docs, bench.limit(0)).filter("contaminated").count()
    assert find_leaks(docs.limit(0), bench).count() == 0


@pytest.fixture(scope="module")
def forest(spark):
    return train_forest(labelled_findings(spark))


def test_forest_tells_secrets_from_look_alikes(spark, forest):
    key = hashlib.sha256(b"k").hexdigest()
    text = f"api_key = {key[:40]} and the commit sha1 {hashlib.sha1(b'c').hexdigest()} done"
    docs = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "", 0), (4, "plain words only", 0), (4, "plain words only", 0)],
                                 "doc_id long, text string, _candidates int")
    got = secret_report(docs, forest).collect()
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    assert by[1].n_candidates == 2 and by[1].secrets == [key[:40]]
    assert [text[s:s + 40] for s in by[1].starts] == [key[:40]]
    assert by[2].n_secrets == by[3].n_secrets == by[4].n_secrets == 0


def test_secret_scan_runs_without_python(spark, forest):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = scan_secrets(docs, forest)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("text", ["", "\\", "\\\\", "### a: b</turn>\n", "</turn>", "<\\/turn>", "x\n### y", "\\### Assistant: </turn> ok"])
def test_escape_is_reversible(text):
    assert unescape(escape(text)) == text
    assert parse_turns(f"### user: {escape(text)}</turn>\n")[0][:2] == ("user", text)


def test_chats_read_back_as_they_were(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", [None, "", "hi\n", "### user: x</turn>\n", "é🙂" * 9][(c + t) % 5], 1)
            for c in range(6) for t in range(c + 1)]
    rows += [(9, 0, "user", "b" * 300_000, 1), (9, 1, "assistant", "\\### Assistant: </turn> ok", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int").repartition(4)
    got = {r.conv_id: r for r in chat_digest(render_chats(conversation_events(df), TIE)).collect()}
    chats = defaultdict(list)
    for c, _, role, text, _ in sorted(rows, key=lambda r: r[:2]):
        chats[c].append((role, text or ""))
    assert set(got) == set(chats)
    for c, turns in chats.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_equal_rows_of_a_turn_stay_messages(spark):
    rows = [(1, 0, "user", "hi", "a"), (1, 0, "user", "hi", "b"), (1, 0, "assistant", "yo", "c"), (1, 1, "assistant", "yes", "d"),
            (1, 1, "assistant", "yes", "e"), (None, None, None, None, "f")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, _tie string").repartition(3)
    got = {r.conv_id: r for r in render_chats(conversation_events(df), TIE).collect()}
    assert [x[:2] for x in parse_turns(got[1].text)] == [
        ("assistant", "yo"), ("user", "hi"), ("user", "hi"), ("assistant", "yes"), ("assistant", "yes")]
    assert [x[:2] for x in parse_turns(got[None].text)] == [("", "")]
    log = [(1, 0, k, "delta", "user", t, str(k)) for k, t in enumerate("hello")]
    df = spark.createDataFrame(log, "conv_id long, msg long, seq long, kind string, role string, text string, _tie string")
    assert [x[:2] for x in parse_turns(render_chats(df).first().text)] == [("user", "hello")]


def test_edits_and_regenerations_fold(spark):
    log = [(1, 0, 0, "start", "user", None), (1, 0, 1, "delta", None, "he"), (1, 0, 2, "delta", None, "llo"),
           (1, 1, 0, "start", "assistant", None), (1, 1, 1, "delta", None, "bad"), (1, 1, 2, "regenerate", None, None),
           (1, 1, 3, "delta", None, "go"), (1, 1, 4, "delta", None, "od"), (1, 0, 3, "edit", None, "bye")]
    df = spark.createDataFrame(log[::-1], "conv_id long, msg long, seq long, kind string, role string, text string")
    (row,) = render_chats(df).collect()
    assert [x[:2] for x in parse_turns(row.text)] == [("user", "bye"), ("assistant", "good")]
    assert render_chats(df.limit(0)).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    p = Packer(10)
    assert [p.place(7, "a", 1)[0], p.place(6, "b", 2)[0]] == [0, 1]
    assert p.place(3, "c", 3)[0] == 0  # tightest
    assert p.place(4, "b", 4)[0] == 2  # the bin of residual 4 holds source b
    assert p.place(4, None, None)[0] == 1


def test_bins_hold_every_piece_once_and_no_conflict(docs, doc_rows, no_docs):
    items = document_items(docs)
    got = pack_documents(items, 100, shard_rows=20).collect()
    assert sum(r.length for r in got) == sum(len((t or "").split()) for _, t, *_ in doc_rows)
    assert {r.doc_id for r in got} == {r[0] for r in doc_rows}
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    for held in bins.values():
        assert sum(r.length for r in held) <= 100
        assert max(Counter(r.source for r in held if r.source is not None).values(), default=1) == 1
        assert max(Counter(r.cluster for r in held if r.cluster is not None).values(), default=1) == 1
    assert sorted(map(tuple, got), key=str) == sorted(
        map(tuple, pack_documents(items.repartition(5), 100, shard_rows=20).collect()), key=str)
    assert pack_documents(document_items(no_docs)).count() == 0


def test_toxicity_holds_out_and_ranks(spark):
    docs = [(k, " ".join(["fine day with work"] * 5 + (["you wretched scumbag"] if k % 3 == 0 else ["you kind friend"])))
            for k in range(240)]
    df = spark.createDataFrame([*docs, (900, None), (901, ""), (902, "a wretchedd scumbagg")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in docs], "doc_id long, toxic int")
    model = toxicity_model(df, labels.filter(~held_out("doc_id")))
    got = {r.doc_id: r for r in score_toxicity(df, model).collect()}
    assert len(got) == len(docs) + 3
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(got[k].predicted == int(k % 3 == 0) for k, _ in docs)
    assert got[902].score > got[901].score == got[900].score
    assert score_toxicity(df.limit(0), model).count() == 0


def test_languages_are_found_on_held_out_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id"))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "123 ... 456")], "doc_id long, text string")
    train = docs.filter("not held_out").select("lang", "text")
    got = identify_languages(docs, train, carry=("held_out", "lang")).filter("held_out")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("lang")).first()
    assert n and right / n > 0.8
    assert {r.lang_pred for r in identify_languages(odd, train).collect()} == {"und"}
    assert identify_languages(odd.limit(0), train).count() == 0
    signs = spark.createDataFrame([(1, "½ ² ①"), (2, "x"), (3, "٣٤"), (4, "日")], "doc_id long, text string")
    rows = {r.doc_id: r for r in identify_languages(signs, train).collect()}
    assert rows[1].lang_pred == rows[3].lang_pred == "und" and rows[1].score == 0
    assert rows[2].lang_pred != "und" and 0 < rows[2].score < 0.999 and rows[4].lang_pred != "und"
