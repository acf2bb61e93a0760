import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridmill.llm import bpe, entries, pretoken, token_counts

ODD = [
    None, "", " ", "a", "ΑΣ ΣΟΦΟΣ", "İstanbul", "x²½ Ⅷ 12", "a\x1cb \x1f c", "é café  ñ", "<|endoftext|>a<|startoftext|> b <|endoftext|>",
    "don't WE'LL 'tis 's", "日本語テキスト 漢字一二三", " x　y\x85z", "a" * 20_000, "ab" * 9_000, "x" * 70_000 + " y" + " z" * 70_000,
    "<|endof text|>", "_a_b __ 1_2", "नमस्ते दुनिया", " \n\t  a  \n", "Ⅳ" * 5_000, "twice", "twice",
]


def frame(spark, rows):
    # more columns, one of them named as a result
    return spark.createDataFrame([(i, t, -1, "x") for i, t in rows], "doc_id long, text string, n_tokens int, chunk string")


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_counts_equal_the_library(spark):
    t = library(entries.COUNT_VOCABULARY)
    rows = [*enumerate(ODD), (None, "no id"), (3, "an id again")]
    got = token_counts.token_counts(frame(spark, rows), public_tokenizers.path(entries.COUNT_VOCABULARY), limit=5).collect()
    want = sorted((i if i is not None else -1, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 5) for i, x in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_counts_over_small_chunks_and_the_given_table(spark, sf, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK_CHARS", 50_000)
    docs = entries.table(spark, sf, "documents")
    t = library(entries.COUNT_VOCABULARY)
    got = {r.doc_id: r.n_tokens for r in entries.op1_token_counts(spark, sf).collect()}
    assert got == {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}


def test_counts_by_way_of_cells(spark, sf, monkeypatch):
    """Many ranges: groups of chunks merge their pre-tokens first, in rows of several blocks a chunk."""
    for name, value in (("CHUNK_CHARS", 20_000), ("TOKENS_A_ROW", 700), ("RANGE", 2_000), ("FAN", 3), ("CELL", 9_000)):
        monkeypatch.setattr(token_counts, name, value)
    t, path = library(entries.COUNT_VOCABULARY), public_tokenizers.path(entries.COUNT_VOCABULARY)
    rows = [*enumerate(ODD), (None, "no id"), (3, "an id again")] + [(1000 + r.doc_id, r.text) for r in entries.table(spark, sf, "documents").collect()]
    got = token_counts.token_counts(frame(spark, rows).repartition(5), path).collect()
    want = sorted((-1 if i is None else i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in got) == want
    assert token_counts.token_counts(frame(spark, []), path).count() == 0


@pytest.mark.parametrize("name", [entries.CODE_VOCABULARY, entries.COUNT_VOCABULARY])
def test_codes_equal_the_library(spark, name):
    t = library(name)
    rows = [*enumerate(ODD), (None, "no id")]
    got = bpe.encode_decode(frame(spark, rows), public_tokenizers.path(name), texts=True).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        ids = t.encode(text, add_special_tokens=False).ids
        said = t.decode(ids, skip_special_tokens=False)
        assert (r.ids, r.decoded, r.n_tokens) == (ids, said, len(ids)), text[:40]
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(said.encode()).hexdigest()


def every_character():
    """Texts that hold every code point: alone between blanks, within words, beside numbers and marks."""
    points = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    for i in range(0, len(points), 256):
        some = points[i : i + 256]
        yield " ".join(some)
        yield "".join(f"a{c}b1{c}2 !{c}" for c in some)


@pytest.mark.parametrize("name", [entries.CODE_VOCABULARY, entries.COUNT_VOCABULARY])
def test_every_code_point_is_split_and_encoded_as_by_the_library(name):
    t, path = library(name), public_tokenizers.path(name)
    m = bpe.Merges(path)
    encoder, texts = bpe.Encoder(m, pretoken.packed(path)), [*every_character()]
    for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert [i for s in pretoken.stretches(text) for i in encoder.feed(s)] == want.ids, ascii(text[:40])


def test_the_code_query_equals_the_library(spark, sf):
    t = library(entries.CODE_VOCABULARY)
    texts = {r.doc_id: r.text or "" for r in entries.table(spark, sf, "documents").collect()}
    got = entries.op7_bpe_round_trip(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        said = t.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())


def test_merging_by_heap_equals_merging_by_scan(monkeypatch):
    m = bpe.Merges(public_tokenizers.path(entries.CODE_VOCABULARY))
    rng = random.Random(6)
    for _ in range(300):
        word = [*rng.choices("thequickandbrs", k=rng.randrange(2, 90))]
        monkeypatch.setattr(bpe, "HEAP", 1)
        by_heap = m.merge([*word])
        monkeypatch.setattr(bpe, "HEAP", 1000)
        assert by_heap == m.merge([*word])


def test_byte_level_round_trip(spark, sf):
    docs = entries.table(spark, sf, "documents")
    got = bpe.encode_decode(docs, public_tokenizers.path(entries.COUNT_VOCABULARY), texts=True)
    assert got.join(docs, "doc_id").where("decoded <> text").count() == 0


def test_long_word_holds_little():
    m = bpe.Merges(public_tokenizers.path(entries.CODE_VOCABULARY))
    word, ids = bpe.LongWord(m), []
    for _ in range(60):
        ids += word.feed("thequick" * 64)
        assert len(word.held) <= 4 * m.lookahead
    ids += word.end()
    assert ids == library(entries.CODE_VOCABULARY).encode("thequick" * 64 * 60, add_special_tokens=False).ids


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert token_counts.token_counts(empty, public_tokenizers.path(entries.COUNT_VOCABULARY)).count() == 0
    assert bpe.encode_decode(empty, public_tokenizers.path(entries.CODE_VOCABULARY)).count() == 0
