"""What drafts show: role points, reasons, bullets, sections and summaries."""

import pytest
from pyspark.sql import functions as F

from evidentia.operators import drafting, drafts


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "role,body,context,points",
    [
        ("legal_ai", "ocr workflow automation", "x", 95), ("legal_ai", "legal document tool", "x", 95), ("legal_ai", "legal webhook", "x", 10), ("legal_ai", "agent", "x", 0),
        ("ai_automation", "workflow automation webhook", "x", 35), ("ai_automation", "incident agent webhook", "x", 63), ("ai_automation", "ocr", "x", -45), ("ai_automation", "ocr", "validation", 0),
        ("backend_python", "ocr", "x", 12), ("backend_python", "agent", "x", 0), ("machine_learning", "agent ocr", "x", -17), ("machine_learning", "agent ocr", "court", 8), ("general", "ocr agent", "x", 0), (None, "ocr agent", "x", 0),
    ],
)
def test_role_points(spark, role, body, context, points):
    assert one(spark, drafts.role_points(F.lit(role), F.lit(body), F.lit(context))) == points


def test_role_points_count(spark):
    projects = spark.createDataFrame([(1, 1, "A", "webhook"), (1, 2, "B", "plain")], "posting_id int, project_id int, title string, body string")
    posting = "1 AS posting_id, 'X' AS title, 'y' AS context, array(named_struct('term', 'none', 'weight', 1)) AS terms"
    scored = lambda sql: {r["project_id"]: r["score"] for r in drafting.project_scores(projects, spark.range(1).selectExpr(*sql)).collect()}
    assert scored(posting.split(", ", 3)) == {1: 0, 2: 0}
    assert scored([*posting.split(", ", 3), "'ai_automation' AS role"]) == {1: 35, 2: 0}


def test_reasons(spark):
    terms = F.array(*map(F.lit, ("Go", "go", "SQL", "AWS", "Rust", "C")))
    assert one(spark, drafts.selection_reason(terms)) == "Selected because the role asks for Go, SQL, AWS, Rust."
    none = F.array().cast("array<string>")
    assert one(spark, drafts.selection_reason(none)).startswith("Selected because it is among")
    assert "legal/OCR" in one(spark, drafts.exclusion_reason(terms, F.lit("ocr")))
    assert "stronger projects" in one(spark, drafts.exclusion_reason(terms, F.lit("x")))
    assert "lower relevance" in one(spark, drafts.exclusion_reason(none, F.lit("x")))


def test_bullets(spark):
    """As a stable sort by matched terms, words of doing and length."""
    values = ["Long text about something else entirely", "short", "Built a thing", "Used Workflows daily", "built A THING", "", None, "tracked workflows"]
    unique = list({v.casefold(): v for v in reversed([v for v in values if v])}.values())[::-1]
    want = sorted(unique, key=lambda v: ("workflow" not in v.lower().replace("workflows", "workflow"), not any(w in v.casefold() for w in drafts.DONE_WORDS), len(v)))[:3]
    assert one(spark, drafts.prioritized_bullets(F.array(*map(F.lit, values)), F.array(F.lit("Workflows"), F.lit("!")))) == want


def test_sections(spark):
    work = spark.createDataFrame(
        [([(1, "Acme", "Dev", None, None, "d", ["x", "y", "z"]), (2, "Learning Ltd", "Coach", None, None, "d", ["x", "y", "z"]), (3, "Home", "Tutor", None, None, None, ["x"])],)],
        "work array<struct<id: int, company: string, job_title: string, start_date: date, end_date: date, description: string, achievements: array<string>>>",
    )
    show = lambda flag: [(e["source_id"], e["description"], e["achievements"], e["is_additional"]) for e in work.select(drafts.experience_section(F.col("work"), F.array(F.lit("1")), F.lit(flag)).alias("v")).first()["v"]]
    assert show(False) == [("1", "d", ["x", "y", "z"], False)]
    assert show(True) == [("1", "d", ["x", "y", "z"], False), ("2", None, ["x", "y"], True), ("3", None, ["x"], True)]
    assert one(spark, drafts.additional_bullets(F.lit("Maths TUTORING"), F.array(F.lit("x")))) == list(drafts.TUTORING)
    order = lambda **has: one(spark, drafts.section_order(**{n: F.lit(n in has) for n in ("experience", "projects", "education", "certifications")}))
    assert order() == ["summary", "skills"] and order(education=1, projects=1) == ["summary", "skills", "projects", "education"]


def certificates(name="x", issuer="y"):
    return F.array(F.struct(F.lit(1).alias("id"), F.lit(name).alias("name"), F.lit(issuer).alias("issuing_organization"), F.lit(None).cast("string").alias("credential_id"), F.lit(None).cast("string").alias("credential_url")))


def test_summary(spark):
    terms = F.array(*map(F.lit, ("Python", "python", "Teamwork", "APIs", "OCR tools")))
    said = lambda role, titles, **c: one(spark, drafts.summary(F.lit(None).cast("string"), F.lit("Lead Engineer"), F.array(*map(F.lit, titles)), terms, certificates(**c), F.lit(role)))
    assert said("backend_python", ["x"]) == f"Early-career Engineer with hands-on project experience building {drafts.ROLE_THEMES['backend_python']} using Python, APIs."
    assert said("legal_ai", ["x"], name="Vertex AI").endswith(f"using OCR tools. {drafts.CLOUD_SENTENCE}")
    assert said("general", ["Career", "Workflows"], name="Vertex AI").endswith(f"{drafts.TITLE_THEMES[0][1]} using Python, Teamwork, APIs, OCR tools.")
    assert drafts.TITLE_THEMES[3][1] in said("general", ["Documents"]) and drafts.TITLE_THEMES[-1][1] in said("general", [])


def test_claims(spark):
    """A skill cites itself, else the last project that names it, else nothing; a draft without any source cites the first skill."""
    row = spark.range(1).selectExpr(
        "7 AS id", "array(named_struct('id', 1, 'name', 'SQL'), named_struct('id', 2, 'name', 'sql'), named_struct('id', 3, 'name', 'Java')) AS skills",
        "array(named_struct('id', 4, 'title', 'Go', 'technologies', array('Rust')), named_struct('id', 5, 'title', 'X', 'technologies', array('RUST'))) AS projects",
        "array(named_struct('category', 'A', 'skills', array('sql', 'Rust', 'go', 'C'))) AS groups", "array(named_struct('source_id', '9', 'job_title', 'Dev'), named_struct('source_id', cast(null AS string), 'job_title', 'lost')) AS work",
    )
    none = F.array().cast("array<string>")
    empty = F.lit("")
    made = lambda headline, matched, projects: row.select(
        drafts.claim_manifest(
            {"id": F.col("id"), "headline": headline, "summary": empty, "location": F.lit(None).cast("string"), "skills": F.col("skills"), "projects": F.col("projects")},
            F.lit("S"), matched, projects, none, F.col("groups"), {"experience": F.col("work")},
        ).alias("c")
    ).first()["c"]
    claims = [tuple(c) for c in made(F.lit("Dev"), F.array(F.lit("SQL"), F.lit("Sql"), F.lit("none")), F.array(F.lit("4")))]
    assert claims == [
        ("summary", "S", ["profile-7-summary", "skill-2", "project-4"]), ("skill", "sql", ["skill-2"]), ("skill", "Rust", ["project-5"]), ("skill", "go", ["project-4"]), ("skill", "C", []), ("experience", "Dev", ["experience-9"]),
    ]
    assert tuple(made(empty, none, none)[0]) == ("summary", "S", ["skill-1"])
