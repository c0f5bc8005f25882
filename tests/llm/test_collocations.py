import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from odd_texts import ODD_TEXTS
from pyspark.sql import functions as F

from shelfmark.llm import collocations


def plain(rows, reported, least):
    """The reported phrases of rows ``(lang, text)`` by counting everything."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n, found = totals[lang], []
        held = {}
        for p, a in f.items():
            for part in (p[1:], p[:-1]):
                held[part] = max(held.get(part, 0), a)
        for p, a in f.items():
            if len(p) < 2 or a < least or held.get(p, 0) >= a:
                continue
            score, _, l, r = min(
                (1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))
            )
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:reported], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def rows_of(found):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in found.collect())


@pytest.mark.parametrize("set_rows, chunk_bytes, reported", [(1 << 18, 1 << 24, 2000), (7, 900, 25)])
def test_phrases_equal_brute_force(spark, monkeypatch, set_rows, chunk_bytes, reported):
    monkeypatch.setattr(collocations, "SET_ROWS", set_rows)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", chunk_bytes)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)] + ["Zé", "a-long-word-of-many-bytes", "\x00", "中"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(120):
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", "\n"]) for w in rng.choices(words, weights, k=rng.randint(0, 60)))
        rows.append((rng.choice(["en", "de", None]), text + " a b c d e f g" * (i % 3 == 0)))
    rows += [("en", t) for t in ODD_TEXTS if t is None or len(t) < 1000]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert rows_of(collocations.mine_phrases(docs, reported, 6)) == plain(rows, reported, 6)


def test_passes_read_chunks_without_rare_words_one_at_a_time(spark, monkeypatch):
    """Memory of a pass: a row group is one chunk, and of its words only frequent ones are left."""
    read, grow = [], collocations.grow
    monkeypatch.setattr(collocations, "grow", lambda chunks, *rest: read.append(chunks) or grow(chunks, *rest))
    rows = [("en", f"a b rare{i} rarer{i} c a b, seldom{i} c a{i}") for i in range(100)] + [("en", "odd"), ("de", "a b")]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(8)
    made = collocations.numbered

    def together(texts):
        chunks, words = made(texts)
        return collocations.materialize(chunks.coalesce(1), "together", collocations._LAID), words

    monkeypatch.setattr(collocations, "numbered", together)
    assert rows_of(collocations.mine_phrases(docs, 25, 6)) == plain(rows, 25, 6)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in read[0].inputFiles()]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert len(files) < len(groups) and set(groups) == {1}
    chunks = [(np.frombuffer(r["seq"], np.int32), np.frombuffer(r["ids"], np.int64)) for r in read[0].collect()]
    assert len({i for _, ids in chunks for i in ids.tolist()}) == 3
    assert all((seq[1:] | seq[:-1]).all() and seq.max(initial=0) == len(ids) for seq, ids in chunks)


def test_ids_that_clash_take_another_salt(spark, monkeypatch):
    real = collocations._mixed

    def weak(key, word):
        return real(key, word) if (key.size and WEAK["tries"] > 2) else (key * 0 + word % 7)

    WEAK = {"tries": 0}
    monkeypatch.setattr(collocations, "_mixed", weak)
    batch = collocations._chunk(["en"], [b"alpha beta gamma delta alpha"], 0)
    assert set(batch.column("words")[0].values.field("id").to_pylist()) <= {0}
    WEAK["tries"] = 3
    batch = collocations._chunk(["en"], [b"alpha beta gamma delta alpha"], 0)
    ids = batch.column("words")[0].values
    assert len(set(ids.field("id").to_pylist())) == 4 and 0 not in ids.field("id").to_pylist()
    assert sorted(zip(ids.field("word").to_pylist(), ids.field("n").to_pylist())) == [
        ("alpha", 2), ("beta", 1), ("delta", 1), ("gamma", 1)
    ]


def test_long_texts_nulls_empty_tables_and_clashing_columns(spark, odd, none):
    docs = odd.withColumn("lang", F.lit(None).cast("string")).withColumns({"w1": F.lit(1), "phrase": F.lit("x")})
    rows = [("und", t) for t in ODD_TEXTS] + [("und", "no id here"), ("und", ODD_TEXTS[10])]
    assert rows_of(collocations.mine_phrases(docs)) == plain(rows, 2000, 100)
    assert collocations.mine_phrases(none.withColumn("lang", F.lit("en"))).count() == 0


def test_products_beyond_64_bits(spark):
    big = spark.createDataFrame([(10**13, 10**14, 10**13 + 1, 10**13)], "a long, n long, l long, r long")
    got = big.select(collocations.cut_score(*[F.col(c) for c in ("a", "n", "l", "r")])).first()[0]
    assert got == 1000 * 10**13 * 10**14 // ((10**13 + 1) * 10**13)


def test_frontier_takes_the_best_bounds_first(spark):
    words = spark.createDataFrame([("en", 20, 40), ("en", 21, 60), ("en", 30, 900)], "lang string, class long, n long")
    frontier = collocations.Frontier(words, spark.createDataFrame([("en", 1600)], "lang string, n long"))
    assert words.where(frontier.next()).count() == 2  # a sixteenth of all words
    frontier.settle({"en": 1000 * 1600 // 900 + 1})
    assert frontier.next() is None
