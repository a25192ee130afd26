"""Résumé fields and draft rules on literal cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from evidentia.operators import drafting as D
from evidentia.operators import profiles as P
from evidentia.plans.profiles import RESUMES


@pytest.fixture(scope="module")
def lines(spark):
    return P.resume_lines(spark.createDataFrame(RESUMES, "id bigint, body string"), "id", "body").cache()


def test_header_and_skills(lines):
    header = {r["id"]: r for r in P.resume_header(lines, "id").collect()}
    assert (header[1]["full_name"], header[1]["headline"], header[1]["email"], header[1]["urls"]) == ("Ada Example", "Data Engineer", "ada@example.org", ["https://github.com/ada", "https://ada.dev"])
    skills = [(r["skill"], r["category"]) for r in P.resume_skills(lines, "id").orderBy("position").collect()]
    assert skills == [("Python", "Languages"), ("SQL", "Languages"), ("Docker", "Developer Tools"), ("Git", "Developer Tools")]


def test_jobs_and_entries(lines):
    jobs = {r["line_no"]: r for r in P.resume_jobs(lines, "id").collect()}
    first, second, third = (jobs[k] for k in sorted(jobs))
    assert (first["job_title"], first["company"], first["start_date"], first["end_date"]) == ("Engineer", "Acme", datetime.date(2020, 1, 1), datetime.date(2022, 3, 1))
    assert (second["company"], second["end_date"], second["is_current"]) == ("Initech", None, True) and third["job_title"] is None
    assert [(r["first"], r["second"], r["year"]) for r in P.resume_entries(lines, "id", "education").orderBy("line_no").collect()] == [("BSc Physics", "Uni of X", 2019), (None, None, None)]


def test_skill_groups(spark):
    rows = [("o", "backend_python", n, "c", m, p) for n, m, p in [("FastAPI", True, False), ("Python", False, False), ("SQL", False, True), ("Git", False, False), ("GitHub", True, False), ("fastapi", False, False), ("Cooking", True, True), ("REST APIs", False, False)]]
    got = D.grouped_skills(spark.createDataFrame(rows, "owner string, role string, name string, category string, matched boolean, in_project boolean"), "owner").orderBy("group_no").collect()
    assert [(r["category"], r["skills"]) for r in got] == [("Languages", ["Python"]), ("Backend", ["FastAPI"]), ("Databases", ["SQL"]), ("Developer Tools", ["GitHub", "Git"])]


def test_skill_groups_stop_at_sixteen(spark):
    rows = [("o", "general", f"python {i:02d}", "c", False, False) for i in range(20)] + [("o", "general", "docker", "c", True, True)]
    got = D.grouped_skills(spark.createDataFrame(rows, "owner string, role string, name string, category string, matched boolean, in_project boolean"), "owner").collect()
    assert [(r["category"], len(r["skills"])) for r in got] == [("Languages", 16)]


def test_claims_prefer_skills_and_the_last_project(spark):
    skills = spark.createDataFrame([("o", "Python"), ("o", "Kafka"), ("o", "Rust")], "owner string, name string")
    owned = spark.createDataFrame([("o", "python", "s1", 1)], "owner string, name string, id string, position int")
    projects = spark.createDataFrame([("o", 1, "p1", "Kafka", ["Python"]), ("o", 2, "p2", "Other", ["kafka"])], "owner string, position int, id string, title string, technologies array<string>")
    got = {r["text"]: r["evidence_ids"] for r in D.skill_claims(skills, owned, projects, "owner").collect()}
    assert got == {"Python": ["skill-s1"], "Kafka": ["project-p2"], "Rust": []}


def test_small_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(D.two_sentences(F.lit("A. B. C."))) == "A. B." and one(D.two_sentences(F.lit(" "))) == ""
    assert one(D.group_name(F.lit("Cloud APIs"))) == "Backend" and one(D.group_name(F.lit("x"))) == "Developer Tools"
    assert one(D.date_span(F.lit("2020-01-01").cast("date"), F.lit(None).cast("date"), F.lit(True))) == "Jan 2020 - Present"
    stages = F.array(*(F.struct(F.lit(s).alias("stage"), F.lit("waiting").alias("status"), F.lit(None).cast("string").alias("finished_at")) for s in ("a", "review", "review", "b")))
    assert [s["status"] for s in one(D.complete_last(stages, "review", F.lit("t")))] == ["waiting", "waiting", "completed", "waiting"]
    assert [s["status"] for s in one(D.complete_last(stages, "zz", F.lit("t")))] == ["waiting"] * 4
