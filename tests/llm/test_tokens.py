"""Encoding, counting and packing against the tokenizer libraries."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from shelfmark.llm import bpe, byte_bpe, common, packing, queries, token_counts, word_tokens

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = ["'", "'s", "'re", "'r", "'ll", "'l", "'ve", "'v", "'t", "d", " ", "  ", "\n", "\t", "a", "é", "中", "1",
         "²", "!", "-", "'m", " '", "e", "l", "<|endoftext|>", "😀", "_", "\x1c", "́", "\x00", "the", " "]


@pytest.fixture(scope="module")
def strange():
    rng = random.Random(1)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(4000)]


@pytest.fixture(scope="module")
def library():
    ranks = bpe.load_ranks(RANKS)
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check_encoding(rows, texts, library):
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert r.ids == ",".join(map(str, ids)) and r.n_tokens == len(ids)
        assert bytes(r.decoded) == text.encode()


@pytest.mark.parametrize("frequent", [byte_bpe.FREQUENT, 10])
def test_encoding(spark, odd, strange, library, frequent):
    many = spark.createDataFrame(list(enumerate(strange)), "doc_id long, text string")
    for docs in (odd, many):
        rows = byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, frequent).collect()
        assert len(rows) == docs.count()
        check_encoding(rows, {r.doc_id: r.text for r in docs.collect()}, library)


def test_folds_equal_heap(spark, library):
    words = [" the", "réeuxment", "'ll", "zzzzzzzz", "a", "123456789", "ééééé", "!?!?!?", " antidisestablishment"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    ranks = bpe.load_ranks(RANKS)
    for r in byte_bpe.encode_words(df, ranks).collect():
        assert list(r.ids) == bpe.encode_word(r.word.encode(), ranks) == library.encode_ordinary(r.word)
        assert bytes(r.decoded) == r.word.encode()


def test_long_words_stay_cheap(library):
    ranks = bpe.load_ranks(RANKS)
    for word in ("a" * 30_000, "ab" * 2000, "é" * 999):
        assert library.decode_bytes(bpe.encode_word(word.encode(), ranks)) == word.encode()
    assert bpe.encode_word(b"thethe" * 200, ranks) == library.encode_ordinary("thethe" * 200)


def test_counts(spark, odd, strange):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    want = [len(e.ids) for e in own.encode_batch(strange, add_special_tokens=False)]
    assert token_counts.count_texts(strange, token_counts.Lexicon(path)).tolist() == want
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    rows = token_counts.count_tokens(odd, path, 5).collect()
    assert len(rows) == odd.count()
    for r in rows:
        n = len(own.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 5)


def test_scan_over_chunks_equals_one_by_one():
    rng = np.random.default_rng(2)
    to, _ = token_counts.splitter()
    for n in (1, 63, 64, 65, 1000):
        kinds = rng.integers(0, 17, n).astype(np.uint8)
        state, want = token_counts.START, []
        for c in kinds:
            want.append(state)
            state = to[state, c]
        assert token_counts.states_before(kinds).tolist() == want


def test_word_ids(strange):
    path = public_tokenizers.path("word_bpe_49k.json")
    own, encode = Tokenizer.from_file(path), word_tokens.encoder(path)
    for text in strange[:1500] + ["", "Ünïcode ÀÉ Ǆ", "x" * 3000]:
        assert encode(text).tolist() == own.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kept", [word_tokens.KEPT, 3])
def test_word_ids_of_many_texts(strange, monkeypatch, kept):
    monkeypatch.setattr(word_tokens, "KEPT", kept)
    path = public_tokenizers.path("word_bpe_49k.json")
    own, encoder = Tokenizer.from_file(path), word_tokens.Encoder(path)
    plain = [c for c in map(chr, range(0x250)) if bpe.is_plain(c)]
    drawn = random.Random(7)
    mixed = ["".join(drawn.choices(plain, k=drawn.randint(0, 40))) for _ in range(1000)]
    mixed += ["".join(drawn.choices("aÉ'sldtmvre7 .,_×\n", k=30)) for _ in range(1000)]
    mixed += ["", " ", "İstanbul", "it's WE'LL ''s x'", "日本 the", "<|endoftext|>the", *strange[:500]]
    for low in range(0, len(mixed), 700):
        texts = mixed[low : low + 700]
        want = [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
        assert [ids.tolist() for ids in encoder.many(pa.array(texts, pa.string()))] == want
        assert kept > 3 or len(encoder._known) == len(encoder._sizes)
    assert encoder.many(pa.array([], pa.string())) == []


def test_a_piece_is_tokenized_once_whatever_stands_beside_it(monkeypatch):
    encoder = word_tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    asked, of_piece = [], encoder._of_piece
    monkeypatch.setattr(encoder, "_of_piece", lambda p: asked.append(p) or of_piece(p))
    texts = ["Packing, packing. (packing)", "PACKING packing's", "packing's, packing"]
    first = encoder.many(pa.array(texts * 50, pa.string()))
    second = encoder.many(pa.array(texts, pa.string()))
    assert sorted(filter(None, asked)) == ["'s", "(", ")", ",", ".", "packing"]
    assert [x.tolist() for x in first[:3]] == [x.tolist() for x in second]


def test_texts_are_dealt_by_their_bytes():
    texts = ["", "é" * 40, "x" * 500, "y" * 10, "", "z" * 60] * 7
    rows = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    for step in (1, 5, len(texts)):
        batches = [rows.slice(low, step) for low in range(0, len(texts), step)]
        dealt = list(common.text_batches(batches, "text", 300))
        assert pa.Table.from_batches(dealt).to_pydict() == rows.to_pydict()
        for batch in dealt:
            assert batch.num_rows == 1 or sum(len(t.encode()) + 64 for t in batch["text"].to_pylist()) <= 300
        assert len(dealt) == len(list(common.text_batches([rows], "text", 300)))
    assert list(common.text_batches([], "text", 300)) == []
    assert list(common.text_batches([rows.slice(0, 0)], "text", 300)) == []


def check_pieces(pieces, limits, documents):
    """``documents``: ids by (repeated) document; every id in one piece, sequences gapless."""
    sequences, found = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p[5]].append(p)
        found[p[0]].append((p[1], p[7], p[4]))
    for some in sequences.values():
        some.sort(key=lambda p: p[6])
        assert len(some) <= limits.segments and sum(p[3] for p in some) <= limits.loss
        assert sum(p[2] for p in some) <= limits.tokens
        at = 0
        for p in some:
            assert p[6] == at and p[2] > 0
            at += p[2]
        assert at == limits.tokens or at & (at - 1) == 0 or len(some) == limits.segments or limits.loss < limits.tokens
    for key, ids in documents.items():
        parts = sorted(found[key], key=lambda x: x[0])
        assert b"".join(x[1] for x in parts) == np.array(ids, dtype="<u4").tobytes()
        assert all(x[2] == len(ids) for x in parts)
    return sequences


@pytest.mark.parametrize("limits", [
    packing.Limits(), packing.Limits(64, 3, 64), packing.Limits(100, 5, 40), packing.Limits(1, 1, 1),
])
def test_packing_keeps_limits_and_ids(limits):
    rng = np.random.default_rng(4)
    ids = {k: rng.integers(0, 49_000, int(n)).astype("<u4") for k, n in enumerate(rng.geometric(0.02, 300))}
    loss = {k: (rng.random(len(v)) < 0.5).astype(np.int8) for k, v in ids.items()}
    examples = [packing.Example(k, ids[k], loss[k]) for k in ids]
    pieces = list(packing.pack_examples(examples, limits))
    check_pieces(pieces, limits, ids)
    assert sum(p[3] for p in pieces) == sum(int(x.sum()) for x in loss.values())


def test_query_packs_everything(spark, small):
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: own.encode(r.text, add_special_tokens=False).ids + [1] for r in small.collect()}
    pieces = packing.pack_documents(small, public_tokenizers.path("word_bpe_49k.json")).collect()
    sequences = check_pieces([tuple(p) for p in pieces], packing.Limits(), want)
    full = sum(len(v) for v in want.values()) // 2048
    assert len(sequences) <= full + 11 * small.rdd.getNumPartitions() + 1
    rows = queries.op9_packing(spark, SF).collect()
    for r in rows:
        part = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())


def test_packing_odd_texts(odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.pack_documents(odd.where("doc_id = 0"), path).collect()
    assert [(p.start, p.length, p.doc_tokens, bytes(p.ids)) for p in pieces] == [(0, 1, 1, b"\1\0\0\0")]
    assert packing.pack_documents(odd, path).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    assert packing.pack_documents(none, path).count() == 0


def test_instructions_bear_loss_on_answers(tables):
    turns = tables("conversations", "0.001")
    pieces = packing.pack_instructions(turns, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert 0 < sum(p.loss for p in pieces) < sum(p.length for p in pieces)


def test_turns_are_put_together_again(tables):
    path = public_tokenizers.path("word_bpe_49k.json")
    turns, encode = tables("conversations", "0.001"), word_tokens.encoder(path)
    limits = packing.Limits(tokens=512, segments=8, loss=100)
    pieces = packing.pack_instructions(turns, path, limits).collect()
    bearing, parts, totals = {}, defaultdict(list), defaultdict(lambda: [0, 0])
    for r in turns.collect():
        bearing[r.conv_id, r.turn] = r.role == "assistant"
    for p in pieces:
        parts[p.doc_id, p.turn].append(p)
        totals[p.sequence_id][0] += p.length
        totals[p.sequence_id][1] += p.loss
        assert p.loss == p.length * bearing[p.doc_id, p.turn]
    for r in turns.collect():
        own = sorted(parts[r.conv_id, r.turn], key=lambda p: p.start)
        ids = np.append(encode(r.text or ""), 1).astype("<u4")
        assert b"".join(bytes(p.ids) for p in own) == ids.tobytes()
        assert all(p.doc_tokens == len(ids) for p in own)
    assert all(tokens <= 512 and loss <= 100 for tokens, loss in totals.values())
    # The limit on loss closes sequences before they are full: without it there are fewer.
    free = packing.pack_instructions(turns, path, packing.Limits(tokens=512, segments=8, loss=512))
    assert free.select("sequence_id").distinct().count() < len(totals)


def test_queries(spark, small, library):
    texts = {r.doc_id: r.text for r in small.collect()}
    for r in queries.op3_byte_bpe(spark, SF).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert r.n_tokens == len(ids)
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in queries.op10_token_counts(spark, SF).collect():
        assert r.n_tokens == len(own.encode(texts[r.doc_id], add_special_tokens=False).ids)


def test_empty_tables(none):
    assert byte_bpe.encode_documents(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert token_counts.count_tokens(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_a_part_of_the_step_that_does_not_fit_is_folded(spark):
    rows = [(f"w{i}", 1000) for i in range(400)] + [("often", 10**6), ("once", 1), ("x" * 60, 10**7)]
    counts = spark.createDataFrame(rows, "word string, n long")
    some = {r.word for r in byte_bpe.frequent_words(counts, 100).collect()}
    assert "often" in some and 60 <= len(some) <= 140
    assert byte_bpe.frequent_words(counts, 10_000).count() == 402
    assert byte_bpe.frequent_words(counts.where("false"), 100).count() == 0


def test_merging_many_words_equals_merging_each():
    ranks = bpe.load_ranks(RANKS)
    letters = "ethnio srad'ß日\x00.7"
    drawn = random.Random(5)
    words = ["".join(drawn.choices(letters, k=drawn.randint(1, 60))).encode() for _ in range(3000)]
    words += [b"", b"a", b"the", b"aaaaaaaaaaaaaaa" * 40, *words[:5]]
    flat, sizes = bpe.Merger(ranks).encode(words)
    expected = [bpe.encode_word(w, ranks) if w else [] for w in words]
    assert sizes.tolist() == [len(ids) for ids in expected]
    assert flat.tolist() == [i for ids in expected for i in ids]
    flat, sizes = bpe.Merger(ranks).encode([])
    assert len(flat) == len(sizes) == 0


def test_plain_split_equals_the_pattern():
    split = bpe.Splitter(public_tokenizers.PATTERN)
    plain = [c for c in map(chr, range(0x250)) if bpe.is_plain(c)]
    texts = [f"{a}{c}{b}" for c in plain for a in ("", "a", " ", "7", "'") for b in ("", "s", "7", " ", "_.")]
    drawn = random.Random(6)
    texts += ["".join(drawn.choices("ab7 '\n\tsred.,_é×", k=30)) for _ in range(3000)]
    any_text = regex.compile(public_tokenizers.PATTERN)
    assert [split(t) for t in texts] == [any_text.findall(t) for t in texts]


def test_words_beyond_the_bound_are_merged_anew(monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT", 5 - byte_bpe.FREQUENT)
    names = ("word", "ids", "decoded")
    none = pa.table({n: pa.array([], pa.string()) for n in names} | {"n": pa.array([], pa.int32())})
    words = byte_bpe._Words(none.set_column(2, "decoded", pa.array([], pa.binary())), RANKS)
    ranks = bpe.load_ranks(RANKS)
    for low in range(0, 40, 4):
        texts = [[f" w{low + i}x" for i in range(4)], [], [" the"]]
        made = words.encode([1, None, 2], texts).to_pylist()
        for row, text in zip(made, texts):
            ids = [i for w in text for i in bpe.encode_word(w.encode(), ranks)]
            assert row["ids"] == ",".join(map(str, ids)) and row["n_tokens"] == len(ids)
            assert row["decoded"] == "".join(text).encode()
        assert len(words.places) == words.ids.n <= 5
