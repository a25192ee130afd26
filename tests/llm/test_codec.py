import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa
from pyspark.sql import functions as F

from evidentia.llm import sentencepiece_codec as C
from evidentia.llm.queries import vocabulary

MODEL = vocabulary("piece_bpe_32k.model")
TEXTS = [
    "", " ", "a", "  a  b", "x▁y", "a\n b", "日本 🤖 語", "a\0b", "　x", "▁", "▁▁ ▁", "a ", " \n", "<s> </s> <unk> <0x0A>", "x" * 4000, "é́ ﬁ", None,
    "word word  word " * 500, "\t\ttabs\r\n", "don't   stop", "�",
]


def library(text):
    sp = C.processor(MODEL)
    ids = sp.encode(text or "")
    return ids, sp.decode(ids)


def test_chunks_apply_to_this_vocabulary():
    assert C.chunks_are_independent(MODEL)


@pytest.mark.parametrize("size", [None, 1, 10_000])
def test_texts(size):
    got = C.encode_texts(pa.array(TEXTS), C.ChunkTable(MODEL, size), MODEL, block_chars=50).to_pylist()
    assert [(x["ids"], x["decoded"]) for x in got] == [library(t) for t in TEXTS]


def test_few_but_long_chunks(monkeypatch):
    monkeypatch.setattr(C, "TABLE_CHARS", 100)
    table = C.ChunkTable(MODEL, 10_000)
    got = C.encode_texts(pa.array(TEXTS), table, MODEL, block_chars=50).to_pylist()
    assert [(x["ids"], x["decoded"]) for x in got] == [library(t) for t in TEXTS]
    assert table.chars <= 100


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" ▁ab\n.é日🤖0"), max_size=30), max_size=5))
def test_any_text(texts):
    got = C.encode_texts(pa.array(texts, pa.string()), C.ChunkTable(MODEL, 100), MODEL).to_pylist()
    assert [(x["ids"], x["decoded"]) for x in got] == [library(t) for t in texts]


def test_whole_text_way_is_the_same():
    assert C.encode_texts(pa.array(TEXTS), None, MODEL).to_pylist() == C.encode_texts(pa.array(TEXTS), C.ChunkTable(MODEL, 99), MODEL).to_pylist()


@pytest.mark.parametrize(("way", "block"), [("tasks", 1), ("table", 4_000_000), ("table", 50)])
def test_documents_either_way(make, monkeypatch, way, block):
    monkeypatch.setattr(C, "BLOCK_CHARS", block)
    monkeypatch.setattr(C, "LISTED", 5)
    own = [*enumerate(TEXTS), (0, "again"), (None, "b c"), (None, "b c"), (7, None)]
    df = make(own).withColumns({"ids": F.lit(1), "decoded": F.lit(2), "_r": F.lit(3), "block": F.lit(4), "chunk": F.lit(5), "_t": F.lit(6), "_id": F.lit(7)})
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"], r["decoded"]) for r in C.encode_documents(df, MODEL, way=way).collect())
    assert got == sorted((i is None, i or 0, *library(t)) for i, t in own)
    assert C.encode_documents(make([]), MODEL, way=way).collect() == []
    assert C.encode_documents(make([(1, None), (2, "")]), MODEL, way=way).count() == 2


def test_every_chunk_is_segmented_once(make):
    got = [r["chunk"] for r in C.chunk_table(make([*enumerate(TEXTS), (0, TEXTS[5])]), MODEL).collect()]
    assert sorted(got) == sorted({c for t in TEXTS if t for c in C.split_chunks(t)})
