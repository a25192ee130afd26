"""Candidate profiles: evidence chunks from child tables, and fields of a résumé text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Contact data and date ranges of a résumé.
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
URL = r"(?i)https?://[^\s|]+"
PHONE = r"\+?\d[\d ()-]{7,}\d"
DATES = r"(?i)((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4}|\d{4})\s*(?:-|–|—|to)\s*(Present|Current|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4}|\d{4})"
#: Headings of a résumé and what they open.
RESUME_HEADINGS = {
    "summary": "summary", "professional summary": "summary", "profile": "summary", "skills": "skills", "technical skills": "skills",
    "core skills": "skills", "experience": "experience", "work experience": "experience", "professional experience": "experience",
    "projects": "projects", "selected projects": "projects", "education": "education", "certifications": "certifications",
    "certificates": "certifications",
}
#: Categories of skills, the first that lists a skill counts.
SKILL_CATEGORIES = (
    ("Languages", ("python", "sql", "javascript", "typescript", "java", "c++", "c#")),
    ("Backend", ("fastapi", "django", "flask", "api", "apis", "rest", "graphql")),
    ("AI / Machine Learning", ("machine learning", "deep learning", "langchain", "langgraph", "rag", "openai", "llm", "large language models", "pytorch", "tensorflow")),
    ("Databases", ("postgresql", "mysql", "sqlite", "mongodb", "redis")),
    ("Developer Tools", ("git", "github", "docker", "kubernetes", "ci/cd")),
    ("Automation", ("automation", "playwright", "selenium", "n8n", "zapier")),
)


def sentence(*parts: Column) -> Column:
    """Parts with something in them, one blank between."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " ")


def listed(prefix: str, items: Column, separator: str) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(prefix), F.array_join(items, separator)))


def evidence_chunks(tables: dict[str, DataFrame]) -> DataFrame:
    """(profile_id, evidence_id, category, label, text) from the child tables that are given, one row for each record."""
    makers = {
        "profile": lambda d: (
            F.concat(F.lit("profile-"), F.col("id"), F.lit("-summary")), F.coalesce("headline", F.lit("Candidate profile summary")),
            sentence(F.col("headline"), F.col("summary"), F.col("location")), F.col("id")),
        "skill": lambda d: (
            F.concat(F.lit("skill-"), F.col("id")), F.col("name"),
            F.concat("name", F.lit(". Category: "), "category", F.lit(". Candidate-reported experience: "), F.col("years_of_experience").cast("string"), F.lit(" years.")), F.col("profile_id")),
        "project": lambda d: (
            F.concat(F.lit("project-"), F.col("id")), F.col("title"),
            sentence(F.col("title"), F.col("description"), listed("Technologies: ", F.col("technologies"), ", "), listed("Verified outcomes: ", F.col("outcomes"), "; ")), F.col("profile_id")),
        "experience": lambda d: (
            F.concat(F.lit("experience-"), F.col("id")), F.concat_ws(" at ", "job_title", "company"),
            sentence(F.concat(F.col("job_title"), F.lit(" at "), F.col("company"), F.lit(".")), F.col("description"), listed("Verified achievements: ", F.col("achievements"), "; ")), F.col("profile_id")),
        "education": lambda d: (
            F.concat(F.lit("education-"), F.col("id")), F.concat_ws(" at ", "degree", "institution"),
            sentence(F.col("degree"), F.col("field_of_study"), F.concat(F.lit("at "), F.col("institution")), F.col("description")), F.col("profile_id")),
        "certification": lambda d: (
            F.concat(F.lit("certification-"), F.col("id")), F.col("name"), F.concat("name", F.lit(" issued by "), "issuing_organization", F.lit(".")), F.col("profile_id")),
    }
    rows = []
    for category, df in tables.items():
        evidence_id, label, body, profile = makers[category](df)
        rows.append(df.select(profile.alias("profile_id"), evidence_id.alias("evidence_id"), F.lit(category).alias("category"), label.alias("label"), body.alias("text")).filter("text != ''"))
    return reduce(DataFrame.unionByName, rows)


def resume_lines(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, line_no, section, line): blanks squeezed, bullets and empty lines dropped, headings open sections."""
    parts = df.select(key, F.posexplode(F.split(F.col(body), r"\r\n|\r|\n")).alias("line_no", "raw"))
    parts = parts.withColumn("line", F.btrim(F.regexp_replace("raw", r"\s+", " "), F.lit(" \t•"))).filter("line != ''")
    headings = F.create_map(*(F.lit(x) for pair in RESUME_HEADINGS.items() for x in pair))
    opened = F.element_at(headings, F.btrim(F.regexp_replace(F.lower("line"), "[^a-z ]", "")))
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.withColumn("_o", opened).withColumn("section", F.coalesce(F.last("_o", ignorenulls=True).over(order), F.lit("header")))
    return placed.filter("_o is null").select(key, "line_no", "section", "line")


def resume_header(lines: DataFrame, key: str) -> DataFrame:
    """(key, full_name, headline, email, phone, urls) from the header lines, each the first that fits."""
    rows = lines.filter("section = 'header'")
    contact = F.col("line").rlike(EMAIL) | F.col("line").rlike(URL) | F.col("line").rlike(f"^(?:{PHONE})$")
    first = lambda c: F.get(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct("line_no", c.alias("v"))))), lambda s: s["v"]), F.lit(0))
    plain = F.array_sort(F.collect_list(F.when(~contact, F.struct("line_no", "line"))))
    hit = lambda p: F.when(F.regexp_extract("line", p, 0) != "", F.regexp_extract("line", p, 0))
    urls = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.regexp_extract_all("line", F.lit(URL), F.lit(0)).alias("u")))), lambda s: s["u"]))
    out = rows.groupBy(key).agg(first(hit(EMAIL)).alias("email"), first(hit(PHONE)).alias("phone"), plain.alias("_p"), F.transform(urls, lambda u: F.rtrim(u, F.lit(".,;)"))).alias("urls"))
    names = F.transform("_p", lambda s: s["line"])
    name = F.get(F.filter(names, lambda x: F.length(x) <= 100), F.lit(0))
    headline = F.substring(F.get(F.filter(names, lambda x: ~x.eqNullSafe(name)), F.lit(0)), 1, 250)
    return out.select(key, F.coalesce(name, F.lit("Candidate")).alias("full_name"), headline.alias("headline"), "email", "phone", "urls")


def url_for(urls: Column, host: str) -> Column:
    return F.get(F.filter(urls, lambda u: F.contains(F.lower(u), F.lit(host))), F.lit(0))


def portfolio_url(urls: Column) -> Column:
    return F.get(F.filter(urls, lambda u: ~F.lower(u).rlike(r"linkedin\.com|github\.com")), F.lit(0))


def resume_skills(lines: DataFrame, key: str) -> DataFrame:
    """(key, position, skill, category): values of the skill lines, labels dropped, the first of equal ones."""
    values = F.split(F.regexp_replace("line", r"^[^:]{1,30}:\s*", ""), r"[,;|•]")
    rows = lines.filter("section = 'skills'").select(key, "line_no", F.posexplode(values).alias("_at", "skill")).withColumn("skill", F.btrim("skill", F.lit(" .")))
    rows = rows.filter((F.col("skill") != "") & (F.length("skill") <= 150))
    first = Window.partitionBy(key, F.lower("skill")).orderBy("line_no", "_at")
    rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    position = F.row_number().over(Window.partitionBy(key).orderBy("line_no", "_at")).cast("bigint")
    category = F.lit("General")
    for name, terms in reversed(SKILL_CATEGORIES):
        category = F.when(F.lower("skill").isin(*terms), F.lit(name)).otherwise(category)
    return rows.select(key, position.alias("position"), "skill", category.alias("category"))


def month_start(value: Column) -> Column:
    """First day of "Mon YYYY" or "YYYY"."""
    return F.when(value.rlike(r"^\d{4}$"), F.to_date(F.concat(value, F.lit("-01-01")))).otherwise(
        F.to_date(F.concat(F.initcap(F.substring(value, 1, 3)), F.lit(" "), F.substring(value, -4, 4)), "MMM yyyy")
    )


def resume_jobs(lines: DataFrame, key: str) -> DataFrame:
    """(key, line_no, job_title, company, start_date, end_date, is_current) of the experience lines; null title where unreadable."""
    rows = lines.filter("section = 'experience'").withColumn("_s", F.regexp_extract("line", DATES, 1)).withColumn("_e", F.regexp_extract("line", DATES, 2))
    heading = F.btrim(F.substring_index(F.concat(F.regexp_replace("line", DATES, "\u0001"), F.lit("\u0001")), "\u0001", 1), F.lit(" |-–—"))
    parts = F.filter(F.transform(F.split(heading, r"\s*\|\s*|\s+at\s+"), lambda p: F.btrim(p)), lambda p: p != "")
    readable = (F.col("_s") != "") & (F.size(parts) >= 2)
    current = F.lower("_e").isin("present", "current")
    when = lambda c: F.when(readable, c)
    return rows.select(
        key, "line_no", when(F.get(parts, F.lit(0))).alias("job_title"), when(F.get(parts, F.lit(1))).alias("company"), when(month_start(F.col("_s"))).alias("start_date"),
        when(F.when(~current, month_start(F.col("_e")))).alias("end_date"), when(current).alias("is_current"),
    )


def resume_entries(lines: DataFrame, key: str, section: str) -> DataFrame:
    """(key, line_no, first, second, third, year) of lines "a | b | c" in a section; null parts where there are fewer than two."""
    parts = F.filter(F.transform(F.split("line", r"\|"), lambda p: F.btrim(p)), lambda p: p != "")
    year = F.regexp_extract("line", r"\b(?:19|20)\d{2}\b", 0)
    ok = F.size(parts) >= 2
    picked = [F.when(ok, F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(("first", "second", "third"))]
    return lines.filter(F.col("section") == section).select(key, "line_no", *picked, F.when(ok & (year != ""), year.cast("int")).alias("year"))
