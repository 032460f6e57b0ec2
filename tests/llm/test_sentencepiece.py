import hashlib
from array import array
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import registry
from tidewater.llm import sentencepiece_bpe as bpe

MODEL = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
OWN = bpe.encoder(MODEL)


def same(text):
    assert list(array("i", OWN.encode(text))) == LIBRARY.encode(text)


PARTS = ["the", "ing", " ", "  ", "\n", "é", "中", "😀", "▁", "▁▁", "\t", "a", "b", "er", "=", "<s>", "<0x0A>", "\x00", "ﬁ", "　", "0", "qzx", "."]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=20).map("".join))
def test_like_the_library_on_pieces(text):
    same(text)


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=60))
def test_like_the_library_on_any_text(text):
    same(text)


@pytest.mark.parametrize("text", [" " * 1000, "a" * 5000, "   leading and trailing   ", "x" + " " * 37 + "y", "▁" * 50 + "the", "aaaa" * 400 + "b"])
def test_long_runs(text):
    same(text)


def test_compatibility_is_what_the_merge_loop_says():
    pieces = [p for p in list(OWN.ids)[300:3000:7] if OWN.edges(p) and bpe.MARK not in p]
    for a, b in zip(pieces, pieces[1:]):
        assert OWN.stay_apart(a, b) == (OWN.merges(a + b)[0] == [a, b])


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNKS", 10)
    monkeypatch.setattr(bpe, "PAIRS", 10)
    code = bpe.Encoder(MODEL)
    text = " ".join(f"word{i} other{i}." for i in range(100))
    assert list(array("i", code.encode(text))) == LIBRARY.encode(text)
    assert len(code) <= 10 and len(code.chunks) <= 10 and len(code.apart) <= 10


def expected(text):
    ids = LIBRARY.encode(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_query_against_the_library(spark, small):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in registry.op1_sentencepiece(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert got == {d.doc_id: expected(d.text) for d in docs}


def test_edges_and_columns(spark, edges, none):
    out = bpe.decode(bpe.encode(edges, MODEL, ids="digest"), MODEL, ids="digest", text="back").collect()
    assert sorted(map(len, (r.digest for r in out))) == sorted(len(LIBRARY.encode(r.text or "")) for r in edges.collect())
    assert all(r.back == LIBRARY.decode(LIBRARY.encode(r.text or "")) for r in out)
    both = bpe.encode(edges, MODEL, decoded="back").collect()
    assert sorted(r.back for r in both) == sorted(r.back for r in out)
    assert bpe.encode(none, MODEL).count() == 0
