"""The corpus pipeline, stage by stage, over the smallest tables."""

import corpus_pipeline
from bizcontacts.llm.common import Scratch, table


def test_stages_keep_rows_whole_and_the_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, scratch, kept = docs.columns, Scratch(spark, "t"), [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0
    assert kept[3] == kept[4]  # masking keeps documents
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_near_copies_leave_one_document(spark, sf_dir):
    text = " ".join(f"n{k}" for k in range(40))
    rows = [(5, text), (3, text), (8, text + " more"), (9, None), (10, ""), (11, "other words of its own here")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 9, 10, 11]


ODD = ("doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, "
       "contaminated boolean, component_id long, _found string")


def odd_docs(spark):
    rows = [(None, None), (None, "a text without an id"), (900001, None), (900002, ""), (900003, " \n\t"), (900004, "plain words"),
            (900005, "plain words of a row that is there twice"), (900005, "plain words of a row that is there twice"),
            (900006, "long " * 40_000), (900007, "é🙂 \x00 odd")]
    return spark.createDataFrame([(d, t, None, None, None, 0.5, 1, True, 7, "x") for d, t in rows], ODD).repartition(3)


def test_stages_take_odd_rows(spark, sf_dir):
    docs = odd_docs(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        assert out.count() == docs.count(), name  # none of them is toxic, a copy of another id, or a leak
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} >= {900004, 900005, 900006}


def test_stages_take_empty_tables(spark, sf_dir):
    none = odd_docs(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0, name


def test_toxic_documents_go_and_clean_ones_stay(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    kept = corpus_pipeline.drop_toxic(spark, docs, sf_dir).join(labels, "doc_id")
    before = {r.toxic: r["count"] for r in docs.join(labels, "doc_id").groupBy("toxic").count().collect()}
    after = {r.toxic: r["count"] for r in kept.groupBy("toxic").count().collect()}
    assert after[0] >= 0.9 * before[0] and after.get(1, 0) < before[1]
