import random
import re

import numpy as np
import pytest
from odd_texts import ODD_TEXTS
from pyspark.sql import functions as F

from shelfmark.llm import decontaminate, queries
from shelfmark.llm.fm_index import FMIndex, suffix_array

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered)


def plain(texts, items, window=10):
    """For each text its covered words and its items, by comparing every place."""
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for item, item_text in items:
            v = words(item_text)
            size = min(window, len(v))
            if item is None or not size:
                continue
            grams = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)}
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in grams:
                    hit.update(range(i, i + size))
                    found.add(str(item))
        out.append((len(w), hit, sorted(found)))
    return out


def result(found):
    return [
        (r.n_words, {i for s in r["spans"] for i in range(s["start"], s["end"])}, r["items"])
        for r in found.collect()
    ]


def test_suffix_array_and_search_equal_plain_ones():
    rng = random.Random(3)
    for _ in range(40):
        symbols = [rng.choice([0, 1, 1, 2, 3]) for _ in range(rng.randint(0, 120))] + [0]
        text = np.array(symbols, dtype=np.int64)
        order = suffix_array(text)
        ends = np.cumsum(text == 0) - 1
        keys = [(int(ends[i]) if s == 0 else 1000 + s) for i, s in enumerate(symbols)]
        assert order.tolist() == sorted(range(len(keys)), key=lambda i: keys[i:])
        index = FMIndex(text, 4)
        for size in (1, 2, 5):
            phrases = np.array([[rng.randint(1, 3) for _ in range(size)] for _ in range(30)])
            got = {tuple(p): [] for p in phrases.tolist()}
            for which, low, high in zip(*index.search(phrases)):
                got[tuple(phrases[which].tolist())] = sorted(index.locate(np.arange(low, high)).tolist())
            for p, places in got.items():
                assert places == [i for i in range(len(symbols)) if tuple(symbols[i : i + size]) == p]


@pytest.mark.parametrize("block_bytes", [40, 2**22])
def test_passages_equal_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 64)
    rng = random.Random(7)
    vocabulary = ["a", "b", "c", "é", "x1", "Zz"]
    items = [(n, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 10, 11, 25])))) for n in range(12)]
    items += [(5, "b c b"), (None, "a"), (90, None), (91, "")]
    texts = [" ".join(rng.choices([*vocabulary, "...", "other"], k=rng.randint(0, 150))) for _ in range(60)]
    texts += [f"before {items[3][1]}, AFTER {items[4][1].upper().replace('É', 'é')}!", *ODD_TEXTS]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = result(decontaminate.find_passages(docs, bench, block_bytes=block_bytes).orderBy("doc_id"))
    assert got == plain(texts, items)


def test_null_and_repeated_rows_empty_tables_and_clashing_columns(spark, odd, none):
    bench = spark.createDataFrame([(1, "same text"), (2, "twice")], "item_id long, text string")
    found = decontaminate.find_passages(odd.withColumn("items", F.lit("x")), bench)
    assert found.columns == ["doc_id", "n_words", "spans", "items"]
    rows = found.collect()
    assert len(rows) == odd.count() and sum(r["items"] == ["1"] for r in rows) == 3
    assert sum(r.doc_id is None for r in rows) == 1
    assert decontaminate.find_passages(none, bench).count() == 0
    assert all(not r["spans"] for r in decontaminate.find_passages(odd, bench.where("false")).collect())


def test_removal_keeps_what_is_no_passage(spark, tables):
    bench = spark.createDataFrame([(1, "one two three"), (2, "Four FIVE")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "Keep: one, TWO three! and four five."), (2, "clean\ttext"), (3, None), (4, "one two three")],
        "doc_id long, text string",
    )
    texts = {r.doc_id: r.text for r in decontaminate.remove_passages(docs, bench).collect()}
    assert texts == {1: "Keep: ! and .", 2: "clean\ttext", 3: "", 4: ""}
    cut = decontaminate.remove_passages(tables("documents"), tables("benchmark"))
    again = decontaminate.find_passages(cut, tables("benchmark"))
    # What stood around a passage may meet after the cut, but no whole passage is left.
    assert again.where(F.size("spans") > 0).count() <= 2


def test_query_equals_brute_force(spark, tables):
    items = [(r.item_id, r.text) for r in tables("benchmark", "0.001").collect()]
    docs = {r.doc_id: r.text for r in tables("documents", "0.001").collect()}
    want = {i: (n, len(hit), len(found), bool(hit)) for i, (n, hit, found) in zip(docs, plain(docs.values(), items))}
    rows = queries.op13_decontaminate(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in rows} == want
