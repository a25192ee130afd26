"""Requirements, index sync, vector checks, nested redaction and reports on small cases."""

import pytest
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import analysis, drafting, evaluation, relational, requirements, retrieval
from evidentia.sources import files
from evidentia.streaming import sync

EVIDENCE = [(1, "deployed on amazon ec2 with docker"), (2, "set up continuous delivery"), (3, "fastapi endpoints and postgresql"), (4, "amazon s3 storage")]
ASKED = [(1, "AWS"), (2, "AWS and Kubernetes"), (3, "Kubernetes"), (4, "fastapi endpoints"), (5, "the and of"), (6, "quantum physics"), (7, "CI/CD on AWS")]


def tokens(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} bigint, body string").select(name, text.retrieval_tokens(F.col("body")).alias("tokens"))


def test_rules_decide_before_scores(spark):
    rows = requirements.matched(tokens(spark, ASKED, "query_id"), tokens(spark, EVIDENCE, "evidence_id"), 3)
    got = {r["query_id"]: (r["status"], r["branch"], r["citations"]) for r in requirements.single(rows).collect()}
    assert got[1] == ("matched", "explicit_phrase_matched", 2) and got[2] == ("partially_matched", "explicit_phrase_partial", 2)
    assert got[3] == ("not_evidenced", "explicit_phrase_absent", 0) and got[7][:2] == ("matched", "explicit_phrase_matched") and got[7][2] == 3
    assert got[4][:2] == ("matched", "lexical_matched_bar") and got[5] == ("not_applicable", "no_signal_tokens", 0) and got[6][0] == "not_evidenced"
    options = rows.withColumns({"group_id": F.when(F.col("query_id").isin(3, 4), 1).otherwise(2), "position": F.col("query_id")})
    best = {r["group_id"]: (r["position"], r["status"]) for r in requirements.of_any(options).collect()}
    assert best == {1: (4, "matched"), 2: (1, "matched")}  # the first of ties


def test_rules_without_evidence_or_requirements(spark):
    none = tokens(spark, [], "evidence_id")
    assert {r["status"] for r in requirements.matched(tokens(spark, ASKED[:3], "query_id"), none, 3).collect()} == {"not_evidenced"}
    assert requirements.matched(tokens(spark, [], "query_id"), tokens(spark, EVIDENCE, "evidence_id"), 3).count() == 0


INDEX = "owner_id string, evidence_id string, model string, dimensions int, content_hash string, embedding array<double>"


def hashed(spark, body):
    return spark.range(1).select(text.content_hash(F.lit(body))).first()[0]


def test_index_sync(spark):
    a, b, c = (hashed(spark, x) for x in "abc")
    index = spark.createDataFrame([("o", "1", "m", 2, a, [1.0, 0.0]), ("o", "2", "m", 2, b, [0.0, 1.0]), ("o", "3", "m", 3, c, [0.0] * 3), ("o", "9", "x", 2, a, [1.0, 1.0]), ("p", "7", "m", 2, b, [2.0, 1.0])], INDEX)
    evidence = spark.createDataFrame([("o", "1", "a"), ("o", "2", "new"), ("o", "3", "c")], "owner_id string, evidence_id string, text string")
    plan = sync.plan_index(evidence, index, "m", 2)
    assert sorted((r["evidence_id"], r["action"]) for r in plan.collect()) == [("1", "reused"), ("2", "deleted"), ("2", "embedded"), ("3", "deleted"), ("3", "embedded")]
    after = sync.apply_index(evidence, index, plan, "m", lambda df: df.withColumn("embedding", F.array(F.lit(5.0), F.lit(6.0))))
    got = sorted((r["owner_id"], r["evidence_id"], r["model"], r["embedding"]) for r in after.collect())
    assert got == [("o", "1", "m", [1.0, 0.0]), ("o", "2", "m", [5.0, 6.0]), ("o", "3", "m", [5.0, 6.0]), ("o", "9", "x", [1.0, 1.0]), ("p", "7", "m", [2.0, 1.0])]
    bad = sync.apply_index(evidence, index, plan, "m", lambda df: df.withColumn("embedding", F.array().cast("array<double>")))
    with pytest.raises(Exception, match="bad vector: empty"):
        bad.collect()
    twice = evidence.unionByName(evidence.limit(1))
    with pytest.raises(Exception, match="must be unique"):
        sync.plan_index(twice, index, "m").collect()
    foreign = spark.createDataFrame([("o", "7", "b")], evidence.schema)
    with pytest.raises(Exception, match="another owner"):
        sync.plan_index(foreign, index, "m").collect()


def test_index_by_model(spark, tmp_path):
    index = spark.createDataFrame([("o", "1", "m", 1, "h", [1.0]), ("o", "2", "x", 1, "h", [1.0])], INDEX)
    sync.write_index(index, str(tmp_path / "i"))
    assert [r["evidence_id"] for r in sync.read_index(spark, str(tmp_path / "i"), "m").collect()] == ["1"]


def test_vectors_of_unequal_length_are_an_error(spark):
    row = spark.createDataFrame([([1.0, 2.0], [1.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="same dimensions"):
        row.select(retrieval.cosine(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in row.select(retrieval.vector_fault(F.col("a"), 2)).collect()] == [None]
    with pytest.raises(Exception, match="bad vector: dimensions"):
        row.select(retrieval.valid_vector(F.col("a"), 3)).collect()


def test_nested_redaction(spark):
    kind = "s struct<api_key:string, n:struct<password:int, note:string>, tags:array<string>>, m map<string,string>"
    df = spark.createDataFrame([((("k", (5, "Bearer abcdefgh"), ["DB_PASSWORD=x", None])), {"Authorization": "y", "a": "sk-abcdefgh1"}), (None, None)], kind)
    got = df.select(*(text.redact_nested(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields)).collect()
    s = got[0]["s"]
    assert (s["api_key"], s["n"]["password"], s["n"]["note"], s["tags"]) == ("[REDACTED]", None, "Bearer [REDACTED]", ["DB_PASSWORD=[REDACTED]", None])
    assert got[0]["m"] == {"Authorization": "[REDACTED]", "a": "[REDACTED]"} and got[1]["s"] is None and got[1]["m"] is None


def test_report(spark, tmp_path):
    files.write_report(spark.createDataFrame([("b", 1), ("a", None)], "name string, n int"), str(tmp_path), ["name", "n"], "T")
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    lines = [x for p in sorted((tmp_path / "markdown").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ["# T", "", "| name | n |", "|-|-|", "| a |  |", "| b | 1 |"]


def test_words_about_scores(spark):
    row = spark.range(1).select(
        analysis.suggested_summary(F.lit("Dev"), F.lit("t"), F.array(F.lit("A"), F.lit("a"), F.lit("B"))).alias("backed"), analysis.suggested_summary(F.lit(None).cast("string"), F.lit("t"), F.array().cast("array<string>")).alias("bare"),
        analysis.weaknesses(F.array(F.lit("x")), F.array().cast("array<string>"), F.lit(1.5), F.lit(3)).alias("weak"), evaluation.ratio(F.lit(1), F.lit(3)).alias("third"), evaluation.ratio(F.lit(0), F.lit(0)).alias("none"),
        relational.is_subset(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("inside"), drafting.early_career_role(F.lit("Senior Dev")).alias("role"),
    ).first()
    assert row["backed"] == "Dev with knowledge-base evidence in A, B." and row["bare"].startswith("Candidate for t. Review")
    assert row["weak"] == ["Missing required skill evidence: x", "Estimated experience evidence is 1.50 years; role requests at least 3 years."]
    assert row["third"]["mean"] == 0.333333 and row["none"]["mean"] is None and row["inside"] and row["role"] == "Early-career Dev"


def test_recommendations_follow_evidence(spark):
    rows = [(1, "projects", "p", "API tool", "e", "api tool python", 5), (1, "skills", "s", "Python", "e", "python", 3), (2, "education", "d", "BSc", "e", "python", 1)]
    evidence = spark.createDataFrame(rows, "owner int, section string, source_id string, label string, excerpt string, body string, rank int")
    terms = spark.createDataFrame([(1, 0, "Python"), (1, 1, "APIs"), (2, 0, "python")], "owner int, position int, term string")
    got = {(r["owner"], r["section"]): r["recommendation"] for r in analysis.recommendations(analysis.strongest_by_section(evidence, terms)).collect()}
    assert got == {
        (1, "projects"): "Highlight Python, APIs in the projects section using the cited candidate evidence.", (1, "skills"): "Highlight Python in the skills section using the cited candidate evidence.",
    }
