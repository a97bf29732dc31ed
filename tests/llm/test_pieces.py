import hashlib
import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import pieces
from tessera.llm.queries import op11_piece_encoding, piece_model_path

MODEL = piece_model_path()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
OWN = pieces.model(MODEL)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁\tabcdehinorst.,01<>x漢é"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_any_text(text):
    assert OWN.encode(text).tolist() == LIBRARY.encode(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(sorted(OWN.ids)), max_size=12))
def test_pieces_side_by_side(parts):
    text = "".join(parts)
    assert OWN.encode(text).tolist() == LIBRARY.encode(text)


@pytest.mark.parametrize("text", ["a" * 30001, " " * 30001, "ab" * 20000, "the" * 9000 + "\n", "漢字" * 9000, "x" * 70 + " " * 300 + "y", "<s> </s> <0x0A> <unk>", "\x00 \x00"])
def test_long_runs_and_markers(text):
    assert OWN.encode(text).tolist() == LIBRARY.encode(text)


def test_stretches_against_plain_merging():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choices(["th", "e", "tion", "▁", "in", "g", "é", "x", "漢"], k=rng.randrange(1, 12)))
        assert OWN.split(text) == OWN.merged(text)


def test_windows_agree(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choices(["the", "tion", " ", "  ", ".", "7", "漢", "\n", "qz"], k=4000))
    want = LIBRARY.encode(text)
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(pieces, "WINDOW", size)
        assert OWN.encode(text).tolist() == want


def test_classes_cut_nothing_that_a_piece_joins():
    whole = pieces.stretches({"ab", "bc", "▁a", "..", "x▁"})
    assert "▁*" not in whole
    import re

    cut = re.compile(pieces.stretches({"ab", "bc", "▁a", ".."}))
    assert cut.findall("▁▁abca..▁z?▁") == ["▁▁abca", "..", "▁z?", "▁"]


def test_small_caches_agree(monkeypatch):
    monkeypatch.setattr(pieces, "KNOWN", 3)
    m = pieces.PieceModel(MODEL)
    text = "Several words of a text, seen again: several words of a text."
    assert m.encode(text).tolist() == LIBRARY.encode(text) and len(m.known) <= 3 and len(m.judged) <= 3


def test_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pieces, "FLUSH", 50)
    texts = [None, "", " ", "Hello  world\n", "日本語 and ▁ mixed", "again", "again", "word " * 500, "\U0001f600é"]
    rows = [(None if i == 3 else i // 2, t, "x", [1], 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, pieces array<int>, n_tokens int").repartition(2)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, (tuple(r) for r in op11_piece_encoding(spark, str(tmp_path)).collect())))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text, *_ in rows:
        ids = LIBRARY.encode(text or "")
        want.append(str((doc_id, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids)))))
    assert got == sorted(want)
    two = pieces.decode(pieces.encode(docs, MODEL), MODEL)
    assert sorted(map(str, two.collect())) == sorted(map(str, pieces.round_trip(docs, MODEL).collect()))
    empty = docs.limit(0)
    assert pieces.decode(pieces.encode(empty, MODEL), MODEL).count() == 0
    assert pieces.encode(docs, MODEL).select(F.sum(F.size("ids"))).first()[0] == sum(len(LIBRARY.encode(t or "")) for t in texts)
