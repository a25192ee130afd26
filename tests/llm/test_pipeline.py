import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import cuckoo, mixing, neardup
from evidentia.llm.queries import vocabulary
from evidentia.llm.sentencepiece_codec import processor

DATA = "/root/testdata/sf0.001"


def test_stages_on_a_fixture(spark, make, prose, tmp_path):
    good = [(i, prose(i, 60 + i), "en", f"s{i % 3}") for i in range(40)]
    bad = [(100 + i, " ".join(w + "###$$" for w in prose(i, 50).split()), "en", "s0") for i in range(30)]
    copies = [(200, good[3][1].upper(), "en", "s1"), (201, good[3][1] + " more", "en", "s1")]
    make(good + bad + copies).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1) for i, *_ in good + copies] + [(i, 0) for i, *_ in bad]
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    state, seen = docs, []
    for _, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, str(tmp_path)).cache()
        seen.append(state)
    assert all(s.columns == docs.columns for s in seen[:-1])
    kept = {r["doc_id"] for r in seen[0].collect()}
    assert not kept & {i for i, *_ in bad} and len({i for i, *_ in good} - kept) <= 2
    assert {r["doc_id"] for r in seen[1].collect()} == {r["doc_id"] for r in cuckoo.deduplicate(seen[0]).filter("kept").collect()} and 3 not in {r["doc_id"] for r in seen[1].collect()}
    near = {r["doc_id"] for r in seen[2].collect()}
    assert near == {r["doc_id"] for r in neardup.near_duplicates(seen[1]).filter("kept").collect()} and 201 not in near
    size = lambda df: df.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert abs(size(seen[3]) - 1.5 * size(seen[2])) <= 3
    sp, texts = processor(vocabulary("piece_bpe_32k.model")), {}
    for r in seen[3].collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    for r in seen[4].collect():
        assert r["round_trip"] and r["ids"] in [sp.encode(t) for t in texts[r["doc_id"]]]
    assert seen[4].count() == seen[3].count()


def test_odd_rows_stage_by_stage(spark, make, tmp_path):
    rows = [(1, None, None, None), (2, "", "en", "s"), (2, "", "en", "s"), (None, "a b c", "en", "s"), (3, "x " * 30_000, "en", "s")]
    extra = {c: F.lit(7) for c in ("_key", "_digest", "_id", "_t", "_r", "block", "label", "taken", "ids", "stats")}
    make(rows).withColumns(extra).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    state, ids, words = docs, [], []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, str(tmp_path)).cache()
        assert state.columns == docs.columns
        ids.append(sorted({r["doc_id"] or 0 for r in state.collect()}))
        words.append(state.agg(F.sum(mixing.word_count(F.col("text")))).first()[0])
    assert state.count() >= 3 and ids == [[0, 1, 2, 3], [0, 2, 3], [0, 2, 3], [0, 2, 3]] and words == [30_003, 30_003, 30_003, 45_004]
    last = corpus_pipeline.STAGES[-1][1](spark, state, str(tmp_path)).collect()
    assert len(last) == state.count() and all(r["round_trip"] for r in last)


def test_empty_table(spark, make, tmp_path):
    make([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_whole_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 100 and out.filter("not round_trip").count() == 0
