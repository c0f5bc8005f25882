"""Every stage of the pipeline against a plain version, and on odd tables."""

import brute
import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import near_dup, pii, rules, toxicity

SF = "/root/testdata/sf0.01"
STAGES = dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def stored(spark):
    """What each stage was given and made."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        made = pipeline.materialize(stage(spark, docs, SF), f"test-{name}")
        out[name] = (docs, made)
        docs = made
    return out


def test_stages_keep_the_columns(stored):
    for name, (before, after) in stored.items():
        if name != "packing":
            assert after.dtypes == before.dtypes


def test_toxic_documents_go(spark, stored):
    before, after = stored["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = toxicity.classify(before, labels)
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scores.where("predicted = 0").collect()}


def test_bad_documents_go(spark, stored):
    before, after = stored["quality_rules"]
    learnt = rules.learn_rules(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in rules.judge(before, learnt).where("kept").collect()}
    assert not any(brute.statistics(r.text)["base_failed"] for r in after.collect())


def test_one_of_each_class_stays(stored):
    before, after = stored["near_dedup"]
    classes = near_dup.near_duplicates(before).where("doc_id = class_id")
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in classes.collect())


def test_personal_data_is_replaced(stored):
    before, after = stored["pii"]
    texts = {r.doc_id: r.text for r in after.collect()}
    changed = 0
    for r in before.collect():
        spans, out, at = brute.pii(r.text), "", 0
        if spans:
            changed += 1
            for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
                assert r.text[a:b] not in texts[r.doc_id]
        else:
            assert texts[r.doc_id] == r.text or "[IBAN]" in texts[r.doc_id]
    assert changed and all(r.n_chars == len(r.text) for r in after.collect())


def test_all_that_is_left_is_packed(spark, stored):
    before, after = stored["packing"]
    assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == {r.doc_id for r in before.collect()}
    sizes = after.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert sizes <= 2048


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_odd_and_empty_tables(spark, odd, name):
    docs = odd.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"),
                      F.length("text").cast("long").alias("n_chars"), "spans", "score", "n_words")
    out = STAGES[name](spark, docs, SF)
    assert name == "packing" or out.columns == docs.columns
    kept = out.count()
    assert STAGES[name](spark, docs.where("false"), SF).count() == 0
    if name == "near_dedup":
        assert kept == docs.count() - 3  # two copies and a repeated row go
    if name == "pii":
        assert kept == docs.count()
    if name == "quality_rules":
        assert all(len((r.text or "").split()) >= 50 for r in out.collect())


def test_texts_of_one_id_are_documents_of_their_own(spark):
    texts = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcd"}
    near = texts["c"].replace("c59", "other")
    rows = [(1, texts["a"], 9), (1, texts["b"], 9), (1, texts["b"], 8), (2, texts["c"], 9), (3, near, 9),
            (3, texts["d"], 9), (4, texts["a"], 9), (None, texts["a"], 9), (None, texts["a"], 9), (5, None, 9), (6, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long")
    want = [(1, texts["a"], 9), (1, texts["b"], 8), (2, texts["c"], 9), (3, texts["d"], 9), (5, None, 9), (6, "", 9),
            *[(None, texts["a"], 9)] * 2]
    for again in (docs, docs.orderBy(F.rand(1)).repartition(3)):
        got = [tuple(r) for r in STAGES["near_dedup"](spark, again, SF).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_unused(spark):
    assert pipeline.ORACLE_SQL is None and pii.THRESHOLD < 1
