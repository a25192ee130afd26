"""Résumé previews against a line-by-line reading in plain Python."""

import datetime as dt
import random
import re

import pytest

from evidentia.operators import profiles as P
from evidentia.operators import resumes as R

EMAIL, URL, PHONE = re.compile(P.EMAIL), re.compile(P.URL), re.compile(P.PHONE)
DATES = re.compile(P.DATES)


def day(value):
    month = 1 if re.fullmatch(r"\d{4}", value) else "jan feb mar apr may jun jul aug sep oct nov dec".split().index(value[:3].lower()) + 1
    return dt.date(int(value[-4:]), month, 1)


def read(body, file):
    """(full_name, headline, email, phone, skills, jobs, education, sections, number of warnings) as a reader takes line after line."""
    sections, active = {}, "header"
    for raw in body.splitlines():
        line = re.sub(r"\s+", " ", raw).strip(" \t•")
        heading = re.sub(r"[^a-z ]", "", line.casefold()).strip()
        if line and heading in P.RESUME_HEADINGS:
            active = P.RESUME_HEADINGS[heading]
        elif line:
            sections.setdefault(active, []).append(line)
    header = sections.pop("header", [])
    plain = [x for x in header if not EMAIL.search(x) and not URL.search(x) and not PHONE.fullmatch(x)]
    stem = re.sub(r"(?<=.)\.[^.]*$", "", file.split("/")[-1]).replace("_", " ").replace("-", " ").strip()
    name = next((x for x in plain if len(x) <= 100), stem or "Candidate")
    skills = {}
    for line in sections.get("skills", []):
        for value in re.split(r"[,;|•]", re.sub(r"^[^:]{1,30}:\s*", "", line)):
            value = value.strip(" .")
            if value and len(value) <= 150:
                skills.setdefault(value.casefold(), value)
    jobs, ignored = [], 0
    for line in sections.get("experience", []):
        found = DATES.search(line)
        parts = [p.strip() for p in re.split(r"\s*\|\s*|\s+at\s+", line[: found.start()].strip(" |-–—")) if p] if found else []
        if len(parts) < 2:
            ignored += 1
            continue
        current = found[2].casefold() in ("present", "current")
        jobs.append((parts[0], parts[1], day(found[1]), None if current else day(found[2]), current))
    schools, bad = [], 0
    for line in sections.get("education", []):
        parts = [p.strip() for p in line.split("|") if p.strip()]
        if len(parts) < 2:
            bad += 1
        else:
            year = re.search(r"\b(?:19|20)\d{2}\b", line)
            schools.append((parts[0], parts[1], dt.date(int(year[0]), 12, 31) if year else None))
    first = lambda pattern: next((m[0] for x in header if (m := pattern.search(x))), None)
    headline = next((x[:250] for x in plain if x != name), None)
    return (name, headline, first(EMAIL), first(PHONE), list(skills.values()), jobs, schools, sorted(sections), 2 + bool(ignored) + bool(bad))


LINES = [
    "Ada Example", "ada@example.org | +44 20 1234 5678", "+44 20 1234 5678", "https://github.com/ada.", "Data  Engineer\t", "x" * 120, "SKILLS:", "Technical skills", "Languages: Python, SQL; python•Go", "• Docker | Git.",
    "Work Experience", "Engineer at Acme Jan 2020 - Mar 2022", "Lead | Initech | 2019 – Present", "Lead  at  X  September 2001 to current", "no dates", "2001 - 2002", "Education", "BSc | Uni | 2019", "Evening class", " | ", "", "   ",
    "Summary", "One.", "Projects", "A | B | c, d", "Certificates", "straße Name", "Straße name, STRASSE NAME", "A B", "T ea, t ea",
]


@pytest.fixture(scope="module")
def previews(spark):
    rng = random.Random(3)
    made = [(i, "\n".join(rng.choices(LINES, k=rng.randint(1, 25))), rng.choice(["cv.pdf", "a/My_CV-2.DOCX"])) for i in range(300)]
    made = [(i, b, f) for i, b, f in made if b.strip()]
    df = R.previews(spark.createDataFrame(made, "id int, body string, file string"), "body", "file")
    return made, {r["id"]: r for r in df.collect()}


def test_previews(previews):
    made, got = previews
    for i, body, file in made:
        p = got[i]["preview"]
        shown = (
            p["full_name"], p["headline"], p["email"], p["phone"], [s["name"] for s in p["skills"]], [tuple(x) for x in p["work_experiences"]], [tuple(x) for x in p["education"]],
            p["extracted_sections"], sum(not w.endswith(R.IGNORED["certifications"]) for w in p["warnings"]),
        )
        assert shown == read(body, file), body
        assert got[i]["error"] is None


@pytest.mark.parametrize(
    "body,file,error",
    [("", "a.pdf", "empty"), (None, "a.pdf", "empty"), ("x", "a.txt", "kind"), ("x", None, "kind"), ("x", ".pdf", "kind"), (" \n  ", "a.docx", "blank"), ("x" * 100_001, "a.pdf", "long"), ("x" * 100_000, "a.pdf", None)],
)
def test_errors(spark, body, file, error):
    row = R.previews(spark.createDataFrame([(body, file)], "body string, file string"), "body", "file").first()
    assert row["error"] == (R.ERRORS[error] if error else None) and (row["preview"] is None) == (error is not None)


def test_other_fields(spark):
    body = "Ada\nhttps://x.dev, https://LinkedIn.com/in/a; https://github.com/a.\nProfile\nOne.\nTwo.\nProjects\nA | B | c, , d\nno\nE | F\nCertificates\nC | V | in 2021\nalone"
    p = R.previews(spark.createDataFrame([(body, "a.pdf")], "body string, file string"), "body", "file").first()["preview"]
    assert (p["summary"], p["linkedin_url"], p["github_url"], p["portfolio_url"]) == ("One. Two.", "https://LinkedIn.com/in/a", "https://github.com/a", "https://x.dev")
    assert [tuple(x) for x in p["projects"]] == [("A", "B", ["c", "d"]), ("E", "F", [])]
    assert [tuple(x) for x in p["certifications"]] == [("C", "V", dt.date(2021, 1, 1))] and p["warnings"][2] == f"1 {R.IGNORED['certifications']}"
