import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from llm_helpers import documents

from corpusloom.llm.sentence_pieces import PieceModel, decode_pieces, encode_pieces, encode_with_digests, piece_digests

PATH = public_tokenizers.path("piece_bpe_32k.model")
SYMBOLS = "abcdeést  \t\n▁'.,012😀字\x00  ßÄ<>ththeingonion "


def texts():
    rng = random.Random(3)
    out = ["".join(rng.choice(SYMBOLS) for _ in range(rng.randrange(60))) for _ in range(1500)]
    out += [None, "", " ", "\n", "  lead", "trail  ", "a" * 4000, "ab" * 2000, " " * 700, "the " * 400, "字" * 300, "<s> </s> <unk> <0x41>", "▁x ▁▁ y"]
    out += [" ".join(rng.choice(["reading", "Tests", "wörter", "été.\nUn"]) for _ in range(20_000))]
    return out + out[:5]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_rows_equal_the_library(spark, library):
    given = texts()
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = {}
    for i, text in enumerate(given):
        ids = library.encode(text or "")
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    docs = documents(spark, given)
    assert {r[0]: tuple(r[1:]) for r in piece_digests(docs, PATH).collect()} == want
    assert {r[0]: tuple(r[2:]) for r in encode_with_digests(docs, PATH).collect()} == want


def test_ids_decode_as_in_the_library(spark, library):
    rng = random.Random(4)
    model = PieceModel(PATH)
    for _ in range(1500):
        ids = [rng.randrange(32_000) if rng.random() < 0.6 else rng.randrange(260) for _ in range(rng.randrange(12))]
        assert model.decode(ids) == library.decode(ids)
    encoded = encode_pieces(documents(spark, ["one two", None, "zwölf"], [1, None, 1]), PATH)
    assert sorted((str(r.doc_id), r.text) for r in decode_pieces(encoded, PATH).collect()) == [("1", "one two"), ("1", "zwölf"), ("None", "")]
    assert encode_pieces(documents(spark, ["a"]).limit(0), PATH).count() == 0


def test_units_are_forgotten_when_there_are_too_many(monkeypatch, library):
    monkeypatch.setattr("corpusloom.llm.sentence_pieces.UNITS_KEPT", 10)
    monkeypatch.setattr("corpusloom.llm.sentence_pieces.PAIRS_KEPT", 50)
    model = PieceModel(PATH)
    for text in texts()[:300]:
        assert model.encode(text) == library.encode(text or "")
