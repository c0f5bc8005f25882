import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import ordering
from shelfmark.operators import search as ops
from shelfmark.plans import search
from shelfmark.sources import stored_index

QUERY_SCHEMA = (
    "query_id string, query string, modality string, license_class string, "
    "size_class string, language string, limit int, offset int"
)


def docs_of(spark, texts):
    return spark.createDataFrame([(f"d{i:04d}", t) for i, t in enumerate(texts)], "dataset_id string, content string")


def like(content, token):
    pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in token)
    return re.search(pattern, content, re.S) is not None


def run(catalog, query, **kw):
    datasets, artifacts = catalog
    hits, total = search.search_like(ops.build_search_docs(datasets), datasets, artifacts, query, **kw)
    return [r.asDict() for r in hits.collect()], total.first()["total"]


def test_hits_score_why_and_flag(catalog):
    hits, total = run(catalog, "River river levels nothing")
    assert total == 2
    assert [(h["id"], h["score"], h["has_schema"]) for h in hits] == [("lab/river-levels", 3, 1), ("plain", 2, 0)]
    assert hits[0]["why"] == ["river", "river", "levels"]
    assert hits[0]["downloads"] == "12" and hits[1]["downloads"] is None and hits[1]["tags"] == []


def test_unset_stale_mark_is_no_schema(catalog):
    hits, _ = run(catalog, "calls")
    assert hits[0]["has_schema"] == 0


def test_wildcards_and_backslash(catalog):
    hits, total = run(catalog, "%")
    assert total == 4 and [h["id"] for h in hits if h["why"]] == ["lab/bird-calls"]
    assert run(catalog, "a_b")[1] == 1 and run(catalog, "r_ver")[1] == 2
    assert [h["id"] for h in run(catalog, "\\maps")[0]] == ["lab/private-maps"]
    assert run(catalog, "größe")[1] == 1 and run(catalog, "VÖGELN")[1] == 1
    assert run(catalog, '\\"hi\\"')[1] == 1


def test_no_words_finds_nothing(catalog):
    assert run(catalog, "   ") == ([], 0) and run(catalog, "") == ([], 0)


def test_filters_and_pages(catalog):
    assert run(catalog, "e", filters={"modality": "AUDIO"})[1] == 0  # only the argument is lower-cased
    assert run(catalog, "e", filters={"modality": "tab"})[1] == 1
    assert run(catalog, "e", filters={"language": "", "license_class": None})[1] == run(catalog, "e")[1]
    assert run(catalog, "e", filters={"language": "e"})[1] == 3  # a NULL list never matches
    hits, total = run(catalog, "river", limit=1, offset=1)
    assert [h["id"] for h in hits] == ["plain"] and total == 2
    assert run(catalog, "river", limit=5, offset=50) == ([], 2)
    with pytest.raises(ValueError):
        run(catalog, "river", limit=101)


def test_all_like_joins_give_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcé% _\\😀") for _ in range(rng.randint(0, 40))) for _ in range(120)] + [""]
    tokens = ["a", "ab", "abc", "abca", "%", "_", "__%_", "a%c", "a_c", "é", "\\", "😀a", "zz", "c%a_b", "_é", "a%" * 3]
    docs = docs_of(spark, texts)
    frame = spark.createDataFrame([(t,) for t in tokens], "token string")
    want = {(t, f"d{i:04d}") for i, c in enumerate(texts) for t in tokens if like(c, t)}
    ways = [ops.like_join_inline(docs, tokens), ops.like_join_by_grams(docs, frame)]
    monkeypatch.setattr(ops, "_BROADCAST_ROWS", 3)
    ways.append(ops.like_join_by_grams(docs, frame))
    assert ["_part" in w._jdf.queryExecution().optimizedPlan().toString() for w in ways] == [False, False, True]
    for pairs in ways:
        rows = [tuple(r) for r in pairs.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_plain_tokens_are_found_without_comparing_texts(spark, monkeypatch):
    """Words, long tokens and tokens with gaps, in long words too; every row of an id counts."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 300))) for _ in range(60)] + ["ab" * 200, ""]
    tokens = ["a", "aba", "b" * 6, "ab" * 12, "ab" * 13, "a b", " ", "b\u00a0", "ab" * 150]
    docs = docs_of(spark, texts)
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, "aba")], docs.schema))
    frame = spark.createDataFrame([(t,) for t in tokens], "token string")
    rows = [(d["dataset_id"], d["content"]) for d in docs.collect()]
    want = Counter((t, i) for i, c in rows for t in tokens if t in c)
    assert Counter(tuple(r) for r in ops.like_join_by_grams(docs, frame).collect()) == want
    words = spark.createDataFrame([("aba",), ("b",)], "token string")
    executed = ops.like_join_by_grams(docs, words)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in executed and "concat(%" not in executed


def test_grams_take_linear_time(spark):
    """Twice the text must not take four times as long; the longest has 200,000 characters."""
    took = {}
    for n in (2_000, 50_000, 100_000, 200_000):
        docs = docs_of(spark, ["abcdefghij" * (n // 10)])
        begin = time.perf_counter()
        docs.select(F.size(ops._grams(F.col("content"), 3))).collect()
        took[n] = time.perf_counter() - begin
    assert took[200_000] < 8 * took[50_000] + 2


def test_long_vocabulary_takes_the_gram_join(spark, monkeypatch):
    monkeypatch.setattr(ops, "INLINE_TOKENS", 2)
    docs = docs_of(spark, ["one two", "two three"])
    frame = spark.createDataFrame([("one",), ("two",), ("hre",)], "token string")
    assert "LIKE" in ops.like_join(docs, frame)._jdf.queryExecution().toString()
    got = {tuple(r) for r in ops.like_join(docs, frame).collect()}
    assert got == {("one", "d0000"), ("two", "d0000"), ("two", "d0001"), ("hre", "d0001")}


def test_keyed_join_ways_agree(spark, monkeypatch):
    many = spark.createDataFrame([("hot", f"x{i}") for i in range(300)] + [("cold", "y")], "k string, id string")
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("none", 3)], "k string, n int")
    small = sorted(ops.keyed_join(many, few, "k", "id").select("k", "id", "n").collect())
    monkeypatch.setattr(ops, "_BROADCAST_ROWS", 1)
    large = sorted(ops.keyed_join(many, few, "k", "id").select("k", "id", "n").collect())
    assert small == large and len(small) == 600


def test_postings_count_terms(spark):
    texts = ["b a b, a!b", "", "…", "x1 é1 x1"]
    index = ops.build_inverted_index(docs_of(spark, texts))
    assert {tuple(r) for r in index.postings.collect()} == {
        ("a", "d0000", 2, 5), ("b", "d0000", 3, 5), ("x1", "d0003", 2, 3), ("é1", "d0003", 1, 3),
    }
    corpus = index.corpus.first()
    assert (corpus["docs"], corpus["avgdl"]) == (4, 2.0)


def test_stored_index_reads_only_needed_folders(spark, tmp_path):
    docs = docs_of(spark, [f"common w{i}" for i in range(50)])
    stored_index.write_inverted_index(docs, str(tmp_path / "ix"), buckets=8)
    index = stored_index.read_inverted_index(spark, str(tmp_path / "ix"), buckets=8)
    found = ops.postings_of(index, ["common", "w3"])
    assert found.count() == 51
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan


def test_batch_equals_single_searches(spark, catalog):
    datasets, artifacts = catalog
    docs = ops.build_search_docs(datasets)
    asked = [
        ("a", "river river", None, None, None, None, 30, 0), ("b", "e", None, "", None, "e", 2, 1),
        ("c", "100%", None, None, None, None, 30, 0), ("d", "", None, None, None, None, 30, 0),
    ]
    queries = spark.createDataFrame(asked, QUERY_SCHEMA)
    got = search.search_batch(docs, datasets, artifacts, queries).orderBy("query_id", "rn").collect()
    for query_id, query, modality, license_class, size_class, language, limit, offset in asked:
        filters = dict(modality=modality, license_class=license_class, size_class=size_class, language=language)
        hits, total = run(catalog, query, filters=filters, limit=limit, offset=offset)
        mine = [r for r in got if r["query_id"] == query_id]
        assert [(r["id"], r["score"], r["why"], r["has_schema"]) for r in mine] == [
            (h["id"], h["score"], h["why"], h["has_schema"]) for h in hits
        ]
        assert all(r["total"] == total for r in mine)


def test_batch_pages_are_checked(spark, catalog):
    datasets, artifacts = catalog
    docs = ops.build_search_docs(datasets)
    for limit, offset in ((0, 0), (101, 0), (5, -1)):
        queries = spark.createDataFrame([("a", "river", None, None, None, None, limit, offset)], QUERY_SCHEMA)
        with pytest.raises(ValueError):
            search.search_batch(docs, datasets, artifacts, queries)


def test_bm25_single_equals_batch_and_fallback(spark, catalog):
    datasets, artifacts = catalog
    docs = ops.build_search_docs(datasets)
    index = ops.build_inverted_index(docs)
    hits, total = search.search_bm25(index, datasets, artifacts, "river text")
    single = [(h["id"], h["score"]) for h in hits.collect()]
    assert total.first()["total"] == len(single) == 3
    asked = [("a", "river text", None, None, None, None, 30, 0), ("b", "ive", None, None, None, None, 30, 0),
             ("c", "river", None, "cc0-1.0", None, None, 30, 0)]
    got = search.search_with_fallback(
        index, docs, datasets, artifacts, spark.createDataFrame(asked, QUERY_SCHEMA)
    ).orderBy("query_id", "rn").collect()
    assert [(r["id"], r["score"]) for r in got if r["query_id"] == "a"] == single
    assert {r["id"] for r in got if r["query_id"] == "b"} == {"lab/river-levels", "plain"}
    assert not [r for r in got if r["query_id"] == "c"]


def test_rank_hits_batch_keeps_every_page_row(spark):
    rng = random.Random(5)
    rows = [("hot", f"i{n}", rng.randint(0, 3), 7, 20) for n in range(900)]
    rows += [("cold", f"i{n}", 1, 5, 0) for n in range(3)]
    df = spark.createDataFrame(rows, "query_id string, id string, score int, limit int, offset int")
    got = {(r["query_id"], r["rn"]): r["id"] for r in ordering.rank_hits_batch(df, 27).collect()}
    best = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (-r[2], r[1]))
    assert [got["hot", n] for n in range(21, 28)] == [r[1] for r in best[20:27]]
    assert len(got) == 10


def test_assign_docid_is_dense(spark):
    ids = spark.range(5000).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("id"))
    rows = ordering.assign_docid(ids).collect()
    assert sorted(r["docid"] for r in rows) == list(range(1, 5001))
    assert {r["id"]: r["docid"] for r in rows} == {r["id"]: r["docid"] for r in ordering.assign_docid(ids.repartition(3)).collect()}
