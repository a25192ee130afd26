"""Literal cases of the text functions and scores."""

import pytest
from pyspark.sql import functions as F

from evidentia.functions import scores, text
from evidentia.operators import extraction, matching, pages


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens_are_runs_without_stops_at_their_ends(spark):
    texts = ["", None, "...", ".a..b. .c", "rag.", "..RAG..git", "fragments of rag", "openai.github github.", "a. .b", "x" + ".y" * 50_000 + "...", "#.+.#", "\u00dfe.\u0130.k"]
    low = text.replaced(text.casefold(F.coalesce(F.col("t"), F.lit(""))), text.RETRIEVAL_REPLACEMENTS)
    plain = F.filter(F.transform(F.regexp_extract_all(low, F.lit("[a-z0-9+#.]+"), F.lit(0)), lambda t: F.btrim(t, F.lit("."))), lambda t: t != "")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.retrieval_tokens(F.col("t")).alias("found"), plain.alias("plain")).collect()
    assert [r["found"] for r in rows] == [[x for t in r["plain"] for x in ([t, text.TOKEN_ALIASES[t]] if t in text.TOKEN_ALIASES else [t])] for r in rows]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("REST APIs and Databases", "rest api and database"),
        ("GitHub, RAG.", "github git rag llm"),
        ("Human-in-the-loop Workflows", "human review workflow"),
        ("C++ / C# straße", "c++ c# strasse"),
        ("... . ", ""),
        (None, ""),
    ],
)
def test_retrieval_text(spark, raw, expected):
    assert one(spark, text.retrieval_text(F.lit(raw).cast("string"))) == expected


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("Sr. AI Backend Engineer (Hybrid)", "Senior AI Backend Engineer"), ("Jr SWE [on-site]", "Junior Software Engineer"), (" - Lead | ", "Lead")],
)
def test_job_title(spark, raw, expected):
    assert one(spark, text.job_title(F.lit(raw))) == expected


def test_whole_words_are_unicode_words(spark):
    assert not one(spark, text.contains_word(F.lit("épython"), "python"))
    assert one(spark, text.contains_word(F.lit("Use C++, Python."), "c++"))


def test_phrases(spark):
    tokens = F.array(*map(F.lit, ["amazon", "web", "services"]))
    assert one(spark, text.contains_phrase(tokens, ["web", "services"]))
    assert not one(spark, text.contains_phrase(tokens, ["services", "web"]))
    assert not one(spark, text.contains_phrase(F.array().cast("array<string>"), ["a"]))


def test_redaction(spark):
    assert one(spark, text.redact(F.lit("MY_API_KEY=abc, x"))) == "MY_API_KEY=[REDACTED], x"
    assert one(spark, text.redact(F.lit('token = "x"'))) == 'token = "x"'
    assert one(spark, text.redact(F.lit("Bearer abc.def"))) == "Bearer [REDACTED]"


def test_scores_round_half_up_at_the_gate(spark):
    assert one(spark, scores.unit_score(F.lit(0.64996))) == 0.65
    assert one(spark, scores.percent(F.lit(3), F.lit(5), 0.0)) == 60.0
    assert one(spark, scores.percent(F.lit(0), F.lit(0), 50.0)) == 50.0
    assert [one(spark, scores.band(F.lit(x))) for x in (85, 84.99, 50, 30, 0)] == ["excellent", "strong", "moderate", "weak", "limited"]


def test_coverage_counts_context_but_does_not_weigh_it(spark):
    rows = [("a", "required", "matched"), ("a", "required", "partially_matched"), ("a", "preferred", "not_evidenced"), ("a", "context", "matched")]
    r = matching.coverage(spark.createDataFrame(rows, "k string, priority string, status string"), ["k"]).first()
    assert (r["earned_weight"], r["possible_weight"], r["score"]) == (3.0, 5, 60.0)
    assert (r["matched_count"], r["partially_matched_count"], r["not_evidenced_count"]) == (2, 1, 1)


def test_tenure_merges_overlaps(spark):
    rows = [("a", "2022-01-01", "2023-01-01"), ("a", "2022-07-01", "2024-01-01"), ("b", "2026-01-01", None), ("c", "2024-01-01", "2023-01-01")]
    df = spark.createDataFrame(rows, "k string, start_date string, end_date string").selectExpr("k", "date(start_date) start_date", "date(end_date) end_date")
    found = {r["k"]: r["years"] for r in matching.merged_tenure(df, "k", "2025-01-01").collect()}
    assert found == {"a": 2.0}


@pytest.mark.parametrize(
    ("requirement", "years", "history", "expected"),
    [
        ("2+ years", 2.0, True, "matched"), ("0-2 years", 3.0, True, "partially_matched"), ("0-2 years", 0.0, False, "not_evidenced"),
        ("4 years", 2.0, True, "partially_matched"), ("4 years", 1.9, True, "not_evidenced"), ("soon", 5.0, True, "not_applicable"),
    ],
)
def test_experience_status(spark, requirement, years, history, expected):
    least, most = matching.year_range(F.lit(requirement))
    assert one(spark, matching.experience_status(F.lit(years), least, most, F.lit(history))) == expected


def test_explicit_rules(spark):
    tokens = text.retrieval_tokens(F.col("t"))
    owned = spark.createDataFrame([(1, "Docker"), (2, "FastAPI")], "evidence_id int, t string").select("evidence_id", tokens.alias("tokens"))
    asked = spark.createDataFrame([(1, "AWS"), (2, "Kubernetes"), (3, "CI/CD"), (4, "Docker")], "requirement_id int, t string").select("requirement_id", tokens.alias("tokens"))
    assert {r["requirement_id"]: r["status"] for r in matching.explicit_status(asked, owned).collect()} == dict.fromkeys((1, 2, 3), "not_evidenced")
    named = spark.createDataFrame([(1, "Amazon Web Services, K8s, Continuous integration")], "evidence_id int, t string").select("evidence_id", tokens.alias("tokens"))
    assert {r["status"] for r in matching.explicit_status(asked, named).collect()} == {"matched"}


def test_best_alternative_takes_the_first_of_equals(spark):
    rows = [(1, 0, "partially_matched", 0.5), (1, 1, "matched", 0.7), (1, 2, "matched", 0.7)]
    best = matching.best_alternative(spark.createDataFrame(rows, "group_id int, position int, status string, best_lexical double")).first()
    assert (best["position"], best["status"]) == (1, "matched")


def test_bullets_keep_to_their_sections(spark):
    body = "Qualifications\n" + "\n".join(f"- Skill {i}" for i in range(12)) + "\nPreferred skills\n" + "\n".join(f"* Extra {i}" for i in range(4)) + "\nplain prose"
    rows = extraction.bullets(spark.createDataFrame([(1, body)], "job_id int, body string"), "job_id", "body").collect()
    assert sorted(r["priority"] for r in rows) == ["preferred"] * 4 + ["required"] * 12


@pytest.mark.parametrize(
    ("title", "expected"),
    [("AI Intern", "intern"), ("Junior Dev", "junior"), ("Senior Dev", "senior"), ("Team Lead", "lead"), ("Manager", "manager"), ("Developer", "unknown")],
)
def test_seniority(spark, title, expected):
    assert one(spark, extraction.seniority(F.lit(title), F.lit("text"), F.lit(None).cast("int"))) == expected


def test_page_lines(spark):
    df = spark.createDataFrame([(1, "Home\nBackend  Engineer\nBackend Engineer\n\nPlatform Labs")], "k int, t string")
    assert pages.distinct_lines(df, "k", "t").first()["body"] == "Home\nBackend Engineer\nPlatform Labs"
    assert one(spark, pages.visible_text(F.lit("<head><title>x</title></head><p>a &amp; b<script>c</script></p><!-- d --><p>e</p>"))) == "a & b\ne"
