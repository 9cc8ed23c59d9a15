"""SentencePiece encoding and decoding by merge rounds, against the sentencepiece library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from credence.llm import subwords
from credence.llm.queries import R

P = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, n int"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return subwords.Model.of(f.read())


def agree(model, library, texts):
    got = [np.frombuffer(b, "<i4").tolist() for b in subwords.Encoder(model)(texts)]
    assert got == library.encode(texts)
    assert model.decode_rows(pa.array(got, pa.list_(pa.int32()))).to_pylist() == [library.decode(ids) for ids in got]


def test_odd_texts(model, library):
    runs = [" " * n + after for n in range(1, 70) for after in ("", "\n", "the", "é x")]
    agree(model, library, ["", " ", "a  b ", "\n", "\x00x", "▁a", "▁▁ a▁", "é😀", "a\tb", "<s>a</s><0x0A><unk>", "﻿a", "éﬁ　", *runs])


@pytest.mark.parametrize("letters", ["ab", "the ", "=-", "0123456789", "aeiourstn", "abcdefghijklmnopqrstuvwxyz   ", "нсотвкр ", "的是不 日本語が", "=-/*# \t\n"])
def test_random_texts(model, library, letters):
    dice = random.Random(letters)
    agree(model, library, ["".join(dice.choice(letters) for _ in range(dice.randint(1, 60))) for _ in range(1500)])


def test_joined_pieces(model, library):
    """Neighbours that compete for letters, where a piece can at once grow into a better one."""
    dice = random.Random(7)
    pieces = [library.id_to_piece(i) for i in range(259, 32000)]
    agree(model, library, ["".join(dice.choice(pieces) for _ in range(dice.randint(1, 12))).replace("▁", " ") for _ in range(8000)])
    agree(model, library, ["".join(dice.choice(pieces[:1500]) for _ in range(dice.randint(1, 30))).replace("▁", "") for _ in range(8000)])


def test_very_long_units(model, library):
    dice = random.Random(3)
    pieces = [library.id_to_piece(i).replace("▁", "") for i in range(259, 5000)]
    agree(model, library, ["".join(dice.choice(pieces) for _ in range(20_000)), "a" * 100_000, " " * 100_000 + "x" + " " * 9_999, "th" * 50_000])


def test_a_full_store_starts_anew(model, library):
    encode = subwords.Encoder(model, kept=3)
    for texts in (["one two three"], ["one two three four five"], ["x", "one", "six " + "s" * 100]):
        assert [np.frombuffer(b, "<i4").tolist() for b in encode(texts)] == library.encode(texts)
    assert len(encode.store) <= 5 and all(len(u) <= subwords.KEPT_CHARS for u in encode.store)


def test_decoding_any_ids(model, library):
    dice = random.Random(5)
    rows = [[], [0, 5], [1, 264, 2], [1, 28705, 264], [28705, 28705, 264], [13, 264], [3 + 0xE2], [3 + 0xE2, 3 + 0x82, 3 + 0x20], [3 + 0xC3, 3 + 0xA9, 264, 3 + 0xFF]]
    rows += [[dice.choice([dice.randrange(32000), dice.randrange(260)]) for _ in range(dice.randint(1, 8))] for _ in range(500)]
    rows = [r for r in rows if all(3 <= i for i in r[1:])]  # of control ids inside a text the library keeps other rules
    got = model.decode_rows(pa.array(rows, pa.list_(pa.int32()))).to_pylist()
    assert got == [library.decode(r) for r in rows]
    with pytest.raises(ValueError):
        model.decode_rows(pa.array([[32000]], pa.list_(pa.int32())))


def test_odd_rows(spark, library):
    same = "one two  three"
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, same), (5, same), (5, same), (None, same), (6, "word and " * 40_000), (7, "É ñ 😀 ﬁ\x1c")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    found = subwords.decode(subwords.encode(docs, PATH), PATH)
    assert found.columns == ["doc_id", "ids", "text"]
    want = [(i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in rows]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.ids, r.text)) for r in found.collect())
    assert subwords.digest(subwords.decode(subwords.encode(docs.limit(0), PATH), PATH)).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [264, None])], "doc_id int, ids array<int>")
    assert {r.doc_id: r.text for r in subwords.decode(nulls, PATH).collect()} == {1: "", 2: library.decode([264, 0])}


def test_query(spark, folder, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = R.queries["op13_sentencepiece_rounds"](spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
