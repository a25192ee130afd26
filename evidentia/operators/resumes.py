"""Résumé texts as reviewable profiles: one row in, one row out, all in column functions.

Lines belong to the last heading before them.  What cannot be read is counted and told as a warning, never guessed.  A text that is
empty, blank or longer than ``MAX_CHARACTERS``, or whose file is of another kind, has an error and no profile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import profiles
from evidentia.operators.markup import let

MAX_CHARACTERS = 100_000
MAX_NAME, MAX_HEADLINE, MAX_SKILL = 100, 250, 150
#: What reviewers enter for skills that nothing proves.
SKILL_RATING, SKILL_YEARS = 3, 0
#: Errors of an import, and what it warns of; counts stand before the last three.
ERRORS = {
    "kind": "Upload a PDF or DOCX resume.",
    "empty": "The uploaded resume is empty.",
    "blank": "No readable text was found in the resume.",
    "long": "The extracted resume text exceeds the safe processing limit.",
}
NOTES = (
    "Review every extracted field before saving; the original resume was not stored.",
    "Skill levels and years cannot be proven from resume text and default to review values.",
)
IGNORED = {
    "experience": "experience line(s) need manual dates or employer review.",
    "education": "education line(s) need manual review.",
    "certifications": "certification line(s) need an issuing organization.",
}
BREAKS = r"\r\n|[\n\x0B\x0C\r\x1C-\x1E\x85\u2028\u2029]"


def placed_lines(body: Column) -> Column:
    """(section, line) of each line that is no heading; those before the first heading are ``header``."""
    cleaned = F.transform(F.split(body, BREAKS), lambda x: F.btrim(F.regexp_replace(x, r"(?U)\s+", " "), F.lit(" \t•")))
    headings = F.create_map(*(F.lit(x) for pair in profiles.RESUME_HEADINGS.items() for x in pair))

    def named(lines: Column) -> Column:
        return F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line"), F.element_at(headings, F.btrim(F.regexp_replace(text.casefold(x), "[^a-z ]", ""))).alias("opens")))

    def placed(rows: Column) -> Column:
        opened = F.filter(rows, lambda r: r["opens"].isNotNull())

        def within(marks: Column) -> Column:
            own = lambda r: F.get(F.reverse(F.filter(marks, lambda m: m["at"] < r["at"])), F.lit(0))["opens"]
            return F.transform(F.filter(rows, lambda r: r["opens"].isNull()), lambda r: F.struct(F.coalesce(own(r), F.lit("header")).alias("section"), r["line"].alias("line")))

        return let(opened, within)

    return let(named(F.filter(cleaned, lambda x: x != "")), placed)


def lines_of(placed: Column, section: str) -> Column:
    return F.transform(F.filter(placed, lambda p: p["section"] == section), lambda p: p["line"])


def _contact(line: Column) -> Column:
    return F.rlike(line, F.lit(profiles.EMAIL)) | F.rlike(line, F.lit(profiles.URL)) | F.rlike(line, F.lit(rf"^(?:{profiles.PHONE})$"))


def _first(lines: Column, pattern: str) -> Column:
    return F.get(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, pattern, 0)), lambda x: x != ""), F.lit(0))


def full_name(header: Column, file_name: Column) -> Column:
    """The first short header line that is no contact, else the name of the file."""
    stem = F.btrim(F.translate(F.regexp_replace(F.regexp_replace(F.coalesce(file_name, F.lit("")), r"^.*/", ""), r"(?<=.)\.[^.]*$", ""), "_-", "  "))
    named = F.filter(header, lambda x: (F.length(x) <= MAX_NAME) & ~_contact(x))
    return F.coalesce(F.get(named, F.lit(0)), F.nullif(stem, F.lit("")), F.lit("Candidate"))


def skills(lines: Column) -> Column:
    values = F.flatten(F.transform(lines, lambda x: F.split(F.regexp_replace(x, r"^[^:]{1,30}:\s*", ""), r"[,;|•]")))
    kept = F.filter(F.transform(values, lambda v: F.btrim(v, F.lit(" ."))), lambda v: (v != "") & (F.length(v) <= MAX_SKILL))
    keys = lambda a: F.transform(a, text.casefold)
    once = let(F.struct(kept.alias("v"), keys(kept).alias("k")), lambda s: F.filter(s["v"], lambda v, i: F.array_position(s["k"], text.casefold(v)) == i + 1))

    def category(value: Column) -> Column:
        out = F.lit("General")
        for name, terms in reversed(profiles.SKILL_CATEGORIES):
            out = F.when(text.casefold(value).isin(*terms), name).otherwise(out)
        return out

    return F.transform(once, lambda v: F.struct(v.alias("name"), category(v).alias("category"), F.lit(SKILL_RATING).alias("self_rating"), F.lit(SKILL_YEARS).alias("years_of_experience")))


def experiences(lines: Column) -> Column:
    """The lines that name a title, an employer and a range of dates."""
    dated = rf"^(?s)(.*?){profiles.DATES.replace('(?i)', '(?i:', 1)})"

    def read(x: Column) -> Column:
        heading = F.btrim(F.regexp_extract(x, dated, 1), F.lit(" |-–—"))
        parts = F.transform(F.filter(F.split(heading, r"\s*\|\s*|\s+at\s+"), lambda p: p != ""), lambda p: F.btrim(p))
        start, end = F.regexp_extract(x, dated, 2), F.regexp_extract(x, dated, 3)
        current = text.casefold(end).isin("present", "current")
        return F.struct(
            F.get(parts, F.lit(0)).alias("job_title"), F.get(parts, F.lit(1)).alias("company"), F.when(start != "", profiles.month_start(start)).alias("start_date"),
            F.when((end != "") & ~current, profiles.month_start(end)).alias("end_date"), current.alias("is_current"), ((start != "") & (F.size(parts) >= 2)).alias("ok"),
        )

    names = ("job_title", "company", "start_date", "end_date", "is_current")
    return F.transform(F.filter(F.transform(lines, read), lambda s: s["ok"]), lambda s: F.struct(*(s[n].alias(n) for n in names)))


def _parts(line: Column) -> Column:
    return F.filter(F.transform(F.split(line, r"\|"), lambda p: F.btrim(p)), lambda p: p != "")


def _entries(lines: Column, build) -> Column:
    """``build(line, parts)`` of the lines with two parts or more."""
    both = F.transform(lines, lambda x: F.struct(x.alias("line"), _parts(x).alias("parts")))
    return F.transform(F.filter(both, lambda s: F.size(s["parts"]) >= 2), lambda s: build(s["line"], s["parts"]))


def _year(line: Column, day: str) -> Column:
    found = F.regexp_extract(line, r"\b(?:19|20)\d{2}\b", 0)
    return F.when(found != "", F.to_date(F.concat(found, F.lit(day))))


def education(lines: Column) -> Column:
    return _entries(lines, lambda x, p: F.struct(F.get(p, F.lit(0)).alias("degree"), F.get(p, F.lit(1)).alias("institution"), _year(x, "-12-31").alias("end_date")))


def certifications(lines: Column) -> Column:
    return _entries(lines, lambda x, p: F.struct(F.get(p, F.lit(0)).alias("name"), F.get(p, F.lit(1)).alias("issuing_organization"), _year(x, "-01-01").alias("issue_date")))


def projects(lines: Column) -> Column:
    tools = lambda p: F.filter(F.transform(F.split(F.coalesce(F.get(p, F.lit(2)), F.lit("")), ","), lambda t: F.btrim(t)), lambda t: t != "")
    return _entries(lines, lambda x, p: F.struct(F.get(p, F.lit(0)).alias("title"), F.get(p, F.lit(1)).alias("description"), tools(p).alias("technologies")))


def import_error(body: Column, file_name: Column) -> Column:
    """Why a text is not imported; null where it is."""
    kind = F.rlike(F.coalesce(file_name, F.lit("")), F.lit(r"(?i)[^/.][^/]*\.(?:pdf|docx)$"))
    return (
        F.when(F.coalesce(F.length(body), F.lit(0)) == 0, ERRORS["empty"]).when(~kind, ERRORS["kind"]).when(~F.rlike(body, F.lit(r"(?U)\S")), ERRORS["blank"])
        .when(F.length(body) > MAX_CHARACTERS, ERRORS["long"])
    )


def preview(body: Column, file_name: Column) -> Column:
    """(error, full_name, email, phone, headline, summary, three links, five sections, extracted_sections, warnings) of a résumé text."""

    def read(placed: Column) -> Column:
        parts = {n: lines_of(placed, n) for n in ("header", "summary", "skills", "experience", "projects", "education", "certifications")}
        return let(F.struct(*(c.alias(n) for n, c in parts.items())), profile)

    def profile(s: Column) -> Column:
        header = s["header"]
        urls = F.transform(F.flatten(F.transform(header, lambda x: F.regexp_extract_all(x, F.lit(profiles.URL), F.lit(0)))), lambda u: F.rtrim(u, F.lit(".,;)")))
        name = full_name(header, file_name)
        headline = F.substring(F.get(F.filter(header, lambda x: (x != name) & ~_contact(x)), F.lit(0)), 1, MAX_HEADLINE)
        found = F.struct(
            name.alias("full_name"), _first(header, profiles.EMAIL).alias("email"), _first(header, profiles.PHONE).alias("phone"), headline.alias("headline"),
            F.nullif(F.array_join(s["summary"], " "), F.lit("")).alias("summary"), profiles.url_for(urls, "linkedin.com").alias("linkedin_url"), profiles.url_for(urls, "github.com").alias("github_url"),
            profiles.portfolio_url(urls).alias("portfolio_url"), skills(s["skills"]).alias("skills"), experiences(s["experience"]).alias("work_experiences"), projects(s["projects"]).alias("projects"),
            education(s["education"]).alias("education"), certifications(s["certifications"]).alias("certifications"),
        )
        return let(found, lambda f: warned(s, f))

    def warned(s: Column, f: Column) -> Column:
        lost = {"experience": "work_experiences", "education": "education", "certifications": "certifications"}
        told = [F.when(F.size(s[n]) > F.size(f[c]), F.concat((F.size(s[n]) - F.size(f[c])).cast("string"), F.lit(f" {IGNORED[n]}"))) for n, c in lost.items()]
        opened = [F.when(F.size(s[n]) > 0, n) for n in sorted({*profiles.RESUME_HEADINGS.values()})]
        names = ("full_name", "email", "phone", "headline", "summary", "linkedin_url", "github_url", "portfolio_url", "skills", "work_experiences", "projects", "education", "certifications")
        return F.struct(*(f[n].alias(n) for n in names), F.array_compact(F.array(*opened)).alias("extracted_sections"), F.array_compact(F.array(*map(F.lit, NOTES), *told)).alias("warnings"))

    return F.when(import_error(body, file_name).isNull(), let(placed_lines(body), read))


def previews(df: DataFrame, body: str, file_name: str) -> DataFrame:
    """The rows with ``error`` and ``preview``, one of them null."""
    return df.withColumn("error", import_error(F.col(body), F.col(file_name))).withColumn("preview", preview(F.col(body), F.col(file_name)))
