"""Relational helpers, files and incremental sync."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from evidentia.operators import relational
from evidentia.sources import files
from evidentia.streaming import sync


def test_unknown_field_is_an_error(spark):
    with pytest.raises(ValueError, match="unknown field"):
        relational.scan(spark.range(3), {"nope": 1})
    with pytest.raises(ValueError, match="needs fields"):
        relational.search(spark.range(3), "x", [])


def test_search_reads_arrays_as_text(spark):
    df = spark.createDataFrame([(1, ["Generative AI"]), (2, ["SQL"])], "id int, skills array<string>")
    assert [r["id"] for r in relational.search(df, "generative ai", ["skills"]).collect()] == [1]


def test_latest_keeps_ties(spark):
    df = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (1, 1, "c")], "k int, rev int, v string")
    assert sorted(r["v"] for r in relational.latest(df, ["k"], "rev").collect()) == ["a", "b"]


def test_null_breaks_a_rule(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id int, x int")
    assert [(r["id"], r["rule"]) for r in relational.violations(df, ["id"], {"positive": F.col("x") > 0}).collect()] == [(1, "positive")]


def test_sync_plan_and_apply(spark):
    evidence = spark.createDataFrame([(1, "a"), (2, "b2"), (4, "d")], "id int, body string")
    hashed = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, body string").select("id", F.sha2("body", 256).alias("content_hash"), F.lit(0).alias("vector"))
    plan = {r["id"]: r["action"] for r in sync.plan_sync(evidence, hashed, "id", "body").collect()}
    assert plan == {1: "reused", 2: "changed", 3: "stale", 4: "new"}
    after = sync.apply_sync(evidence, hashed, "id", "body", lambda df: df.withColumn("vector", F.lit(1)))
    assert {r["id"]: r["vector"] for r in after.collect()} == {1: 0, 2: 1, 4: 1}


def test_stream_of_unseen_versions(spark, tmp_path):
    rows = [{"id": 1, "body": "a", "at": "2024-01-01T00:00:00"}, {"id": 1, "body": "a", "at": "2024-01-01T00:10:00"}, {"id": 1, "body": "b", "at": "2024-01-01T00:20:00"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text("\n".join(map(json.dumps, rows)))
    updates = spark.readStream.schema("id int, body string, at timestamp").json(str(tmp_path / "in"))
    sync.append_json(sync.stream_unseen(updates, "id", "body", "at"), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(120)
    assert sorted(r["body"] for r in files.read_ledger(spark, str(tmp_path / "out"), "id int, body string").collect()) == ["a", "b"]


def test_cases_and_metadata(spark, tmp_path):
    case = {"id": "c1", "category": "exact", "query": "q", "relevant": ["a"], "distractors": [], "expected_status": "matched"}
    (tmp_path / "c.json").write_text(json.dumps({"cases": [case]}))
    assert files.read_cases(spark, str(tmp_path / "c.json")).first()["relevant"] == ["a"]
    (tmp_path / "bad.json").write_text(json.dumps({"cases": [{**case, "category": "other"}]}))
    with pytest.raises(Exception, match="bad case"):
        files.read_cases(spark, str(tmp_path / "bad.json")).collect()
    meta = files.file_metadata(spark, str(tmp_path / "c.json")).first()
    assert meta["bytes"] == (tmp_path / "c.json").stat().st_size and len(meta["sha256"]) == 64


def test_docx(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = f'<w:document xmlns:w="{w}"><w:body>{p("Name")}{p("Skills")}<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr></w:tbl></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "r.docx", "w") as z:
        z.writestr("word/document.xml", body)
    assert files.read_docx(spark, str(tmp_path / "r.docx")).first()["text"] == "Name\nSkills\na | b"
    with pytest.raises(ValueError, match="not a DOCX"):
        files.docx_text(b"%PDF")


def test_markdown(spark, tmp_path):
    df = spark.createDataFrame([("T", [("H", ["x", "y"])])], "title string, sections array<struct<heading:string,bullets:array<string>>>")
    files.write_markdown(df, str(tmp_path / "md"))
    assert "".join(p.read_text() for p in (tmp_path / "md").glob("part*")).strip() == "# T\n\n## H\n- x\n- y"
