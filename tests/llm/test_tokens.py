"""Encoding and counting against the public libraries, which are the brute force here."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from outcomelens.llm import byte_bpe, token_prefix
from outcomelens.llm.queries import BYTE_RANKS, PIECE_MODEL

ODD = ["", " ", "\n\n", "a" * 5000, "ab" * 3000, "é" * 1500, "\x00\x01 \n\n  \t", "<|endoftext|><s></s><unk>", " " * 3000, "=-" * 900, "A" * 1024,
       "B" * 1025, "▁ ▁▁a", "한국어 日本 ﬁé́", "中文😀 ñandú\r\n", "don't 12345 x"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(BYTE_RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECE_MODEL))


def ids_of(text):
    ((_, ids),) = byte_bpe.encode_rows([(0, text.encode())], BYTE_RANKS, public_tokenizers.PATTERN)
    return np.frombuffer(ids, "<u4").tolist()


@pytest.mark.parametrize("text", ODD, ids=range(len(ODD)))
def test_byte_bpe_on_odd_texts(library, text):
    assert ids_of(text) == library.encode_ordinary(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("etaoin shrdlu,.éñß中😀\n\t012"), max_size=200))
def test_byte_bpe_on_any_text(library, text):
    assert ids_of(text) == library.encode_ordinary(text)


def test_long_rows_take_the_same_merges():
    ranks = byte_bpe.load(BYTE_RANKS)
    rnd = random.Random(3)
    for _ in range(30):
        piece = "".join(rnd.choice("eta") for _ in range(rnd.randint(2, 400))).encode()
        assert ranks._encode_long(piece) == ranks._encode_rows([piece], len(piece))[0]


@pytest.fixture(scope="module")
def texts(spark, clashing):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(90, None), (None, "null id"), (91, "twice"), (91, "twice")]
    return clashing(spark.createDataFrame(rows, "doc_id long, text string"))


def test_round_trip_digests(texts, library):
    for row, source in zip(byte_bpe.round_trip(texts, "doc_id", "text", BYTE_RANKS).collect(), texts.collect()):
        text = source.text or ""
        ids = library.encode_ordinary(text)
        assert (row.doc_id, row.n_tokens) == (source.doc_id, len(ids))
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_encode_then_decode(texts):
    decoded = byte_bpe.decode(byte_bpe.encode(texts, "doc_id", "text", BYTE_RANKS), "doc_id", "token_ids", BYTE_RANKS)
    assert [bytes(r.decoded).decode() for r in decoded.collect()] == [r.text or "" for r in texts.collect()]


def test_counts_at_every_prefix(pieces):
    model, rnd = token_prefix.load(PIECE_MODEL), random.Random(1)
    alphabets = ["abcdeèÜ中文😀 \n\t", "etaoin  ", "the of  and▁ ing", "  ▁a", "<s></s><unk>▁ ab", "한국어 日本 ﬁé́ \x00", "==--  **##\n\n", "  0123"]
    for k in range(240):
        text = "".join(rnd.choice(alphabets[k % 8]) for _ in range(rnd.randint(0, 40)))
        counts = np.cumsum(np.frombuffer(model.text_changes(text), np.int8)).tolist()
        assert counts == [len(pieces.encode(text[:n + 1])) for n in range(len(text))]


def test_blocks_change_nothing(pieces, monkeypatch):
    monkeypatch.setattr(token_prefix, "BLOCK", 7)
    text = "The  quick brown ▁fox\n jumps   over" * 3
    changes = token_prefix.load(PIECE_MODEL).text_changes(text)
    assert len(changes) == len(text) and np.frombuffer(changes, np.int8).sum() == len(pieces.encode(text))


def test_prefix_table_answers_budgets(texts, pieces):
    table = token_prefix.prefix_counts(texts, "doc_id", "text", PIECE_MODEL)
    rows = table.select("*", token_prefix.longest_prefix("count_changes", F.lit(6)).alias("fit"),
                        token_prefix.count_at("count_changes", F.lit(5)).alias("five"),
                        token_prefix.longest_prefix("count_changes", F.lit(-1)).alias("none")).collect()
    for row, source in zip(rows, texts.collect()):
        text = source.text or ""
        assert (row.doc_id, row.n_tokens, row.n_bytes) == (source.doc_id, len(pieces.encode(text)), len(text.encode()))
        assert row.five == len(pieces.encode(text[:5])) and row.none is None
        if len(text) < 100:
            assert row.fit == max(n for n in range(len(text) + 1) if len(pieces.encode(text[:n])) <= 6)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.round_trip(none, "doc_id", "text", BYTE_RANKS).collect() == []
    assert token_prefix.prefix_counts(none, "doc_id", "text", PIECE_MODEL).collect() == []


def test_other_models_are_refused(tmp_path):
    with pytest.raises(ValueError):
        (tmp_path / "few.tiktoken").write_text("YQ== 0\n")
        byte_bpe.Ranks(str(tmp_path / "few.tiktoken"))
