import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from odd_texts import ODD_TEXTS
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfmark.llm import alignment, queries
from shelfmark.llm.word_tokens import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(A, B, public_tokenizers.PATTERN)


def spans(libraries, text):
    """A and B tokens of a text as ``(id, bytes)`` by the libraries."""
    a, b = libraries
    letters = {letter: byte for byte, letter in byte_letters().items()}
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        byte = piece.startswith("<0x") and len(piece) == 6
        right.append((i, bytes([int(piece[3:5], 16)]) if byte else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (left, right) if all(b"".join(t for _, t in side) == whole for side in (left, right)) else ([], [])


def plain(libraries, texts):
    """The query's rows by sets of ends."""
    made, counts = [], Counter()
    for text in texts:
        left, right = spans(libraries, text) if text else ([], [])
        ends = [dict(zip(np.cumsum([len(t) for _, t in side]).tolist(), [i for i, _ in side])) for side in (left, right)]
        cuts = sorted(ends[0].keys() & ends[1].keys())
        links = [(ends[0][c], ends[1][c]) for c in cuts]
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(e[k]) for k in sorted(e) if low < k <= c) for e in ends) if len(text) < 5000 else "")
            low = c
        counts.update(links)
        made.append((len(left), len(right), links, ";".join(groups)))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [
        (n_a, n_b, len(links), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), groups)
        for n_a, n_b, links, groups in made
    ]


def odd_texts():
    rng = random.Random(4)
    parts = ["the", " ", "  ", "\n", "\t", "Straße", "▁", "中文", "\U0001f600", "'s", "1234", "<s>", "<|endoftext|>", "...", "İ", "é", " ", "<0x41>", "\r", "m²", ".", "²", "​", "tion", "xyzzy"]
    return ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(300)] + [" ", "   ", "▁", "a ", " a", "�"]


def test_words_are_encoded_as_whole_texts_are(aligner, libraries):
    a, b = libraries
    for text in [*odd_texts(), *[t for t in ODD_TEXTS if t]]:
        assert aligner.a.ids([text])[0].tolist() == a.encode(" " + text, add_special_tokens=False).ids
        found = aligner.b.ids([text])[0]
        if "▁" not in text:
            assert found is not None and found.tolist() == b.encode(text)
    assert aligner.b.ids(["a▁b", "a b"])[0] is None


@pytest.mark.parametrize("lane, batch", [(1024, 4 * 2**20), (3, 200)])
def test_alignment_equals_brute_force(spark, libraries, monkeypatch, lane, batch):
    monkeypatch.setattr(alignment, "LANE_BYTES", lane)
    monkeypatch.setattr(alignment, "BATCH_CHARS", batch)
    texts = [*odd_texts(), *[t for t in ODD_TEXTS if t is None or len(t) < 5000]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = alignment.align_documents(docs, A, B, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in found] == plain(libraries, texts)


def test_lanes_meet_where_slices_end():
    rng = np.random.default_rng(1)
    for _ in range(50):
        ends = [np.flatnonzero(rng.random(9000) < p) + 1 for p in (0.4, 0.3)]
        ends = [np.unique(np.append(e, [700, 9000])) for e in ends]
        i, j = alignment.merge_lockstep(*ends, np.array([0, 700, 700, 9000]))
        want = np.intersect1d(*ends)
        assert (ends[0][i] == want).all() and (ends[1][j] == want).all()


def test_all_linked_pairs_are_numbered(aligner):
    pairs = alignment.Pairs([b"ab", b"b", b"ca"], [b"b", b"xab", b"a", b"b"])
    assert pairs.keys.tolist() == [0, 1, 3, 4, 5, 7, 10]
    size = sum(map(len, aligner.a.tokens)) + sum(map(len, aligner.b.tokens))
    assert len(aligner.pairs.keys) < size


def test_long_and_repeated_rows_empty_tables_and_clashing_columns(spark, odd, none):
    clash = odd.withColumn("groups", F.lit("x"))
    rows = alignment.align_documents(clash, A, B, public_tokenizers.PATTERN).collect()
    assert len(rows) == odd.count() and sum(r.doc_id is None for r in rows) == 1
    twice = [r for r in rows if r.doc_id in (10, 11)]
    assert len({tuple(r)[1:] for r in twice}) == 1 and len(twice) == 3
    assert all((r.n_a, r.n_links, r.groups) == (0, 0, "") for r in rows if r.doc_id in (0, 1))
    assert alignment.align_documents(none, A, B, public_tokenizers.PATTERN).count() == 0


def test_query_equals_brute_force(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    rows = queries.op11_alignment(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect()
    want = plain(libraries, [d.text for d in docs])
    for d, r, w in zip(docs, rows, want, strict=True):
        assert (r.doc_id, *tuple(r)[1:7]) == (d.doc_id, *w[:6])
        if d.text and len(d.text) < 5000:
            assert r.groups_sha256 == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")
