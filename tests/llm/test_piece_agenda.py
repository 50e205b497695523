"""The agenda against the sentencepiece library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tamiz.llm import piece_agenda

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=MODEL)
ODD = [None, "", " ", "  ", "\n", "\n\n a\n", " a  b ", "▁", "▁▁a ▁", "\0x\t", "日本🎉 é é", "<s>x</s><unk><0x41>", "a" * 3000, " " * 700, "日本" * 400, "x́" * 60, "same", "same"]


@pytest.fixture(scope="module")
def agenda():
    with open(MODEL, "rb") as f:
        return piece_agenda.PieceAgenda(f.read())


def test_texts_encode_and_decode_as_the_library_does(agenda):
    rng = random.Random(3)
    letters = " ▁abcdefgthéñ\n\t\0日本🎉.,'<>s/x0́�한Жж  "
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 10, 60, 300]))) for _ in range(3000)]
    ids = [agenda.encode(t) for t in texts]
    agenda.check_texts(texts, ids, [agenda.decode(i) for i in ids])
    agenda.check_words()


def test_any_ids_decode_as_the_library_does(agenda):
    rng = random.Random(4)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(260)]) for _ in range(rng.randrange(12))]
        assert agenda.decode(np.array(ids, "<u4").tobytes()) == LIB.decode(ids)


def test_a_wrong_merge_stops_the_job(agenda):
    agenda.unchecked["  wrong"] = agenda.word("  right")
    with pytest.raises(RuntimeError, match="otherwise"):
        agenda.check_words()
    agenda.unchecked.clear()


@pytest.mark.parametrize("check", ["words", "texts"])
def test_rows_are_encoded_whole(spark, check):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(ODD)] + [(0, "again", None)], "doc_id long, text string, n_tokens string")
    rows = piece_agenda.piece_round_trip(docs, MODEL, digests=True, check=check).collect()
    want = []
    for k, t in [*enumerate(ODD), (0, "again")]:
        ids = LIB.encode(t or "", add_bos=True, add_eos=True)
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIB.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, rows)) == sorted(want)
    assert piece_agenda.piece_round_trip(docs.limit(0), MODEL).count() == 0


def test_ids_and_texts_come_out_without_digests(spark):
    docs = spark.createDataFrame([(1, "two  words"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in piece_agenda.piece_round_trip(docs, MODEL).collect()}
    assert rows[1].ids == LIB.encode("two  words", add_bos=True, add_eos=True) and rows[1].decoded == "two  words"
    assert rows[2].ids == [1, 2] and rows[2].decoded == ""
