import random

import pytest
from tokenizers import Tokenizer, models

from claimloom.llm import tokencount


def _reference(pieces):
    return Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], unk_id=0, byte_fallback=False))


def _size(tokenizer, text):
    return len(tokenizer.encode(tokencount.MARK + text.replace(" ", tokencount.MARK)).tokens) if text else 0


TEXTS = ["hello world", "", None, "  two  spaces ", "日本語のテキスト", "𝒜𝒷 x𝒜", "Das ist ein Satz.\nUnd noch einer, mit Ümläuten!", "a" * 3000, "x9#\t" * 50, "\u2581 marks \u2581\u2581here"]


@pytest.fixture(scope="module")
def pieces():
    return tokencount.load_pieces()


def test_equals_the_tokenizer(pieces):
    counter, reference = tokencount.Counter_(pieces), _reference(pieces)
    assert counter.by_word
    r = random.Random(3)
    made = ["".join(r.choice("aeinst hr.,é漢𝒜") for _ in range(r.randint(1, 200))) for _ in range(150)]
    for text in [*TEXTS, *made]:
        assert counter.count(text)[1] == _size(reference, text), text
        if text:
            marked = tokencount.MARK + text.replace(" ", tokencount.MARK)
            assert counter.viterbi(marked) == counter.count(text)


def test_ties_and_unknowns_equal_the_tokenizer():
    r = random.Random(4)
    for _ in range(40):
        pieces = {"".join(r.choice("ab▁") for _ in range(r.randint(1, 4))): float(-r.randint(0, 3)) for _ in range(9)}
        pieces = sorted(pieces.items())
        counter, reference = tokencount.Counter_(pieces), _reference(pieces)
        for _ in range(20):
            text = "".join(r.choice("abc ") for _ in range(r.randint(1, 14)))
            assert counter.count(text)[1] == _size(reference, text), (pieces, text)


def test_frame(spark, pieces, monkeypatch):
    monkeypatch.setattr(tokencount, "_MEMO", 3)
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(TEXTS)] + [(None, "hello world", "r")], "doc_id long, text string, best_score string")
    reference = _reference(pieces)
    found = tokencount.count_tokens(docs, pieces, ["doc_id"]).collect()
    assert len(found) == len(TEXTS) + 1
    assert all(r.n_pieces == _size(reference, TEXTS[r.doc_id] if r.doc_id is not None else "hello world") for r in found)
    assert tokencount.count_tokens(docs.limit(0), pieces, ["doc_id"]).count() == 0
    assert tokencount.count_tokens(docs.limit(2), [], ["doc_id"]).count() == 2
    clash = tokencount.count_tokens(docs, pieces, ["doc_id", "best_score"])
    assert clash.columns == ["doc_id", "n_pieces", "n_unknown", "best_score"] and dict(clash.dtypes)["best_score"] == "double"


def test_unbroken_text_needs_little_memory(pieces, monkeypatch):
    import tracemalloc

    counter = tokencount.Counter_(pieces)
    short = counter.viterbi("abcde漢x" * 300)
    monkeypatch.setattr(tokencount, "_KEPT", 50)  # positions are dropped in the middle of it
    assert counter.viterbi("abcde漢x" * 300) == short
    monkeypatch.undo()
    text = "thequickbrownfox" * 60_000
    tracemalloc.start()
    score, n, unknown = counter.count(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 60_000 and unknown == 0 and peak < 30_000_000
