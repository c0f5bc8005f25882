"""Classifiers on held-out rows, exact search and near duplicates against brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import common, graph, near_dup, quality, queries, topk, toxicity


def auc(scores, truth):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    p = truth.sum()
    return (ranks[truth == 1].sum() - p * (p + 1) / 2) / (p * (len(truth) - p))


@pytest.mark.parametrize("module, label, least", [(toxicity, "toxic", 0.94), (quality, "quality", 0.98)])
def test_held_out(tables, module, label, least):
    docs, labels = tables("documents", "0.1"), tables("labels", "0.1")
    rows = module.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD) for r in rows)
    truth = {r.doc_id: r[label] for r in labels.collect()}
    seen = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert auc(np.array([s for s, _ in seen]), np.array([t for _, t in seen])) > least


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_on_odd_tables(odd, none, tables, module):
    labels = tables("labels")
    rows = module.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert module.classify(none, labels).count() == 0
    assert {r.score for r in module.classify(odd, labels.where("false")).collect()} <= {0.5}


def test_held_out_labels_teach_nothing(tables):
    docs, labels = tables("documents"), tables("labels")
    flipped = labels.selectExpr(
        "doc_id", "quality", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - toxic, toxic) as toxic"
    )
    one, two = (sorted(map(tuple, toxicity.train(docs, x).collect())) for x in (labels, flipped))
    assert one == two


def test_calibrated_network_learns():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 2 * quality.DIMENSIONS))
    y = ((x[:, 0] * x[:, 1]) > 0).astype(int)
    net = quality.fit(x, y)
    assert ((net.probabilities(x) > 0.5) == y).mean() > 0.9


def plain_top(rows, k):
    out = {}
    good = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, a in good:
        if q % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("cells", [(topk.CELL_CANDIDATES, topk.CELL_QUERIES), (20, 2)])
def test_top_k(spark, cells):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.integers(-2, 3, 6) / 4]) for i in range(350)]
    rows += [(351, None), (400, [1.0, None]), (500, [float("nan")] * 6), (501, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [(602, [0.5, 0.25]), (603, []), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 100 = 0"), 10, cell_candidates=cells[0], cell_queries=cells[1]).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = plain_top(rows, 10)
    assert {q: [v[i] for i in sorted(v)] for q, v in got.items()} == want
    assert topk.top_k(df.where("false"), df.where("false")).count() == 0
    assert topk.top_k(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0


def plain_classes(texts):
    words = {d: (t or "").split() for d, t in texts.items()}
    shingles = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items()}
    by = {}
    for d, s in shingles.items():
        if words[d]:
            for g in s:
                by.setdefault(g, []).append(d)
    parent = {d: d for d in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in {(a, b) for some in by.values() for i, a in enumerate(some) for b in some[i + 1 :]}:
        same = len(shingles[x] & shingles[y])
        if same >= 0.8 * (len(shingles[x]) + len(shingles[y]) - same):
            a, b = sorted((root(x), root(y)))
            parent[b] = a
    return {d: root(d) for d in texts}


@pytest.mark.parametrize("block_rows", [near_dup.BLOCK_ROWS, 4])
def test_near_duplicates(tables, block_rows):
    docs = tables("documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs, block_rows=block_rows).collect()}
    assert got == plain_classes(texts)


def test_chained_copies_of_few_words(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for n in (1, 4, 5, 8, 9, 12, 20, 60):
        base = [rng.choice(words) for _ in range(n)]
        for k in range(6):
            texts[len(texts)] = " ".join(base + [f"tail{j}" for j in range(k // 2)])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    assert got == plain_classes(texts)


def test_near_duplicates_on_odd_tables(odd, none):
    rows = near_dup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    found = {r.doc_id: r.class_id for r in rows}
    assert found[None] is None and found[11] == 10 and found[5] == 4
    assert all(found[i] == i for i in (0, 1, 2, 3))
    assert near_dup.near_duplicates(none).count() == 0


def test_texts_of_one_id_are_compared_each(spark):
    base = {k: [f"{k}{i}" for i in range(60)] for k in "abc"}
    texts = {k: " ".join(w) for k, w in base.items()}
    near = {k: " ".join(w[:-1] + ["other"]) for k, w in base.items()}
    rows = [(5, texts["a"]), (5, texts["b"]), (5, texts["b"]), (2, near["b"]), (7, near["a"]), (4, texts["c"]), (9, near["c"]),
            (4, ""), (4, "\x1f \u3000"), (None, texts["a"]), (8, "  "), (11, None)]
    want = {5: 2, 2: 2, 7: 5, 4: 4, 9: 4, 8: 8, 11: 11, None: None}
    for some in (rows, rows[5:]):  # the second has no id with two worded texts
        docs = spark.createDataFrame(some, "doc_id long, text string")
        got = near_dup.near_duplicates(docs).collect()
        assert len(got) == len(some)
        assert {r.doc_id: r.class_id for r in got} == {i: want[i] for i, _ in some}


def test_words_for_spark_are_those_of_python(spark):
    marks = [chr(i) for i in range(0x3100) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([(m,) for m in marks], "text string")
    found = {r.text for r in rows.where(F.col("text").rlike(near_dup.HAS_WORDS)).collect()}
    assert found == {m for m in marks if near_dup.words_of(m)}


def test_one_row_of_a_labelled_id_teaches(spark):
    rows = [(1, "b"), (1, "a"), (1, None), (2, "c"), (2, "c"), (3, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sample = spark.createDataFrame([(1, 0), (2, 1), (9, 1)], "doc_id long, label int")
    got = sorted(tuple(r) for r in common.labelled_texts(docs, sample).collect())
    assert got == [(1, "", 0), (2, "c", 1)]


def test_moved_blocks_are_near_duplicates(spark):
    texts = {}
    for size in (48, 60, 130):
        base = [f"m{size}w{i}" for i in range(400)]
        moved = base[100 : 100 + size]
        rest = base[:100] + base[100 + size :]
        texts |= {len(texts): " ".join(base), len(texts) + 1: " ".join(rest + moved)}
    for a in (0, 2, 4):
        numbers = {}
        assert near_dup.similar(near_dup.Text(texts[a], numbers), near_dup.Text(texts[a + 1], numbers))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4} == plain_classes(texts)


def test_repeated_lines_altered_alike_share_sketches(spark):
    texts = {}
    for k in range(60):
        unique = [f"r{k}u{i}" for i in range(120)]
        line = [f"r{k}l{i}" for i in range(10)]
        for word in ("one", "two"):
            texts[len(texts)] = " ".join(unique + (line[:5] + [word] + line[6:]) * (10, 20, 40)[k % 3])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(docs).collect()}
    assert got == {i: i - i % 2 for i in texts} == plain_classes(texts)


def test_similar_is_exact_jaccard():
    rng = random.Random(9)
    seen = set()
    for _ in range(3000):
        a = [rng.randint(0, 40) for _ in range(rng.randint(1, 60))] * rng.randint(1, 2)
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            b[rng.randrange(len(b))] = rng.randint(0, 40)
        cut = rng.randrange(len(b) + 1)
        b = b[cut:] + b[:cut] if rng.random() < 0.5 else b
        numbers = {}
        x, y = (near_dup.Text(" ".join(map(str, t)), numbers) for t in (a, b))
        same = len(x.shingles & y.shingles)
        want = same >= 0.8 * (len(x.shingles) + len(y.shingles) - same)
        seen.add(want)
        assert near_dup.similar(x, y) == want
    assert seen == {True, False}


def test_edit_distance_in_band():
    rng = random.Random(5)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(1500):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 25))]
        b = [x for x in a if rng.random() > 0.15]
        b.insert(rng.randint(0, len(b)), 9)
        most, d = rng.randint(0, 15), plain(a, b)
        assert near_dup.edit_distance(np.array(a, int), np.array(b, int), most) == (d if d <= most else None)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)] + [(200, x) for x in range(300, 360)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 102)}, 200: 200, **{i: 200 for i in range(300, 360)}}
    assert graph.components(df.where("false")).count() == 0


def test_top_k_query_equals_sql(spark):
    import check_queries

    sf = "/root/testdata/sf0.01"
    sql = queries.oracles()["op4_topk"]
    assert check_queries.compare(spark, check_queries.connect(sf), sf, queries.op4_topk, sql) == ""
