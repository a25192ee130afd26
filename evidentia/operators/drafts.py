"""What a draft shows of a candidate: role points, chosen sections as nested records, reasons, and a summary in fixed words.

All of it is column functions over one row for each draft, whose sections are arrays of structs: nothing is exploded or shuffled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import drafting
from evidentia.operators.analysis import unique_terms

MAX_BULLETS, MAX_TECHNOLOGIES, MAX_REASON_TERMS, MAX_SUMMARY_TERMS = 3, 8, 4, 4
#: Words of a posting that asks for work with documents.
DOCUMENT_TERMS = ("legal", "law", "court", "ocr", "document", "document extraction", "structured extraction", "legal filing", "validation", "document review")
#: Words of a bullet that tells what was done.
DONE_WORDS = ("built", "generated", "tracked", "automated", "extracted")
#: Terms that a summary for a role takes; other roles take all.
SUMMARY_TERMS = {
    "backend_python": ("python", "fastapi", "api", "postgresql", "sql", "docker", "backend"),
    "machine_learning": ("machine learning", "deep learning", "neural", "computer vision", "vertex ai", "bigquery ml", "mlops", "google cloud", "python"),
    "legal_ai": ("ocr", "document", "structured", "validation", "legal", "fastapi"),
}
#: What a summary says of the projects chosen, by role, else by words of their titles, the first that fits.
ROLE_THEMES = {
    "legal_ai": "OCR, document extraction, validation systems, and legal workflow tools",
    "backend_python": "FastAPI services, APIs, PostgreSQL-backed systems, and backend workflows",
    "machine_learning": "ML-focused tools, Python systems, and cloud machine learning concepts",
    "ai_automation": "AI-assisted workflow automation, API integrations, and backend tools",
}
TITLE_THEMES = (
    (("career", "workflow"), "Python automation systems, FastAPI backends, job extraction workflows, and career automation products"),
    (("workflow",), "workflow automation tools, API-based systems, and backend services"),
    (("ocr",), "document-processing platforms and backend services"),
    (("document",), "document-processing platforms and backend services"),
    ((), "Python-based backend systems and automation tools"),
)
#: What certificates must name for the sentence about them, and the roles that tell it.
CLOUD_WORDS = ("google cloud", "vertex ai", "bigquery ml")
CLOUD_ROLES = ("machine_learning", "legal_ai")
CLOUD_SENTENCE = "Certified in Google Cloud machine learning with exposure to Vertex AI, BigQuery ML, MLOps, and production ML concepts."
#: How tutoring is told.
TUTORING = (
    "Runs an online tutoring service supporting international students in math, physics, and English.",
    "Manages student communication, scheduling, delivery quality, and academic support.",
)


def is_document_project(body: Column) -> Column:
    """True for a normalised project about legal documents or OCR."""
    return F.contains(body, F.lit("ocr")) | (F.contains(body, F.lit("legal")) & F.contains(body, F.lit("document")))


def role_points(role: Column, body: Column, context: Column) -> Column:
    """Points that a normalised project gets or loses for the role of a normalised posting; points for single products are left out."""
    says = lambda *terms: drafting.any_term(body, terms)
    documents = is_document_project(body)
    unasked = documents & ~drafting.any_term(context, DOCUMENT_TERMS)
    when = lambda c, points: F.when(c, points).otherwise(0)
    points = {
        "legal_ai": F.when(documents, 95).when(says("workflow automation", "webhook"), 10).otherwise(0),
        "ai_automation": when(says("workflow automation", "webhook"), 35) + when(says("agent", "incident"), 28) + when(unasked, -45),
        "backend_python": when(documents, 12),
        "machine_learning": when(says("workflow automation", "agent"), 8) + when(unasked, -25),
    }
    return reduce(lambda out, item: F.when(role == item[0], item[1]).otherwise(out), points.items(), F.lit(0))


def selection_reason(matched: Column) -> Column:
    terms = F.slice(unique_terms(matched), 1, MAX_REASON_TERMS)
    named = F.concat(F.lit("Selected because the role asks for "), F.array_join(terms, ", "), F.lit("."))
    return F.when(F.size(terms) > 0, named).otherwise("Selected because it is among the strongest project matches for this role.")


def exclusion_reason(matched: Column, body: Column) -> Column:
    return (
        F.when(is_document_project(body), "Excluded because its legal/OCR focus is less relevant to this role.")
        .when(F.size(matched) > 0, "Excluded because stronger projects matched more target requirements.")
        .otherwise("Excluded because it has lower relevance for this role.")
    )


def prioritized_bullets(values: Column, matched: Column) -> Column:
    """At most ``MAX_BULLETS`` distinct outcomes: those that name a matched term first, then those that tell what was done, then the shorter."""
    terms = F.filter(F.transform(matched, text.project_text), lambda t: t != "")
    rank = lambda v, i: F.struct(
        (~F.exists(terms, lambda t: F.contains(text.project_text(v), t))).alias("a"), (~drafting.any_term(text.casefold(v), DONE_WORDS)).alias("b"), F.length(v).alias("c"), i.alias("d"), v.alias("v")
    )
    return F.transform(F.slice(F.array_sort(F.transform(unique_terms(values), rank)), 1, MAX_BULLETS), lambda s: s["v"])


def skills_section(skills: Column, matched: Column) -> Column:
    """(source_id, name, category, self_rating, years_of_experience): skills that the posting matched first, by name."""
    keys = F.transform(matched, text.casefold)
    rank = lambda s, i: F.struct((~F.array_contains(keys, text.casefold(s["name"]))).alias("a"), s["name"].alias("b"), i.alias("c"), s.alias("s"))
    show = lambda x: F.struct(
        x["s"]["id"].cast("string").alias("source_id"), x["b"].alias("name"), x["s"]["category"].alias("category"), x["s"]["self_rating"].alias("self_rating"),
        x["s"]["years_of_experience"].cast("string").alias("years_of_experience"),
    )
    return F.transform(F.array_sort(F.transform(skills, rank)), show)


def additional_bullets(description: Column, achievements: Column) -> Column:
    """How experience of another kind is told: tutoring in fixed words, other work by its first two achievements."""
    said = text.casefold(F.concat_ws(" ", F.coalesce(description, F.lit("")), F.array_join(achievements, " ")))
    return F.when(F.contains(said, F.lit("tutor")), F.array(*map(F.lit, TUTORING))).otherwise(F.slice(achievements, 1, 2))


def experience_section(experiences: Column, relevant: Column, include_additional: Column) -> Column:
    """Relevant work in its order, and work of another kind where it is to be told, without its description."""
    other = lambda e: drafting.other_experience(e["job_title"], e["company"])
    kept = F.filter(experiences, lambda e: F.array_contains(relevant, e["id"].cast("string")) | (include_additional & other(e)))
    show = lambda e: F.struct(
        e["id"].cast("string").alias("source_id"), e["company"].alias("company"), e["job_title"].alias("job_title"), F.date_format(e["start_date"], "yyyy-MM-dd").alias("start_date"),
        F.date_format(e["end_date"], "yyyy-MM-dd").alias("end_date"), F.when(~other(e), e["description"]).alias("description"),
        F.when(other(e), additional_bullets(e["description"], e["achievements"])).otherwise(e["achievements"]).alias("achievements"), other(e).alias("is_additional"),
    )
    return F.transform(kept, show)


def projects_section(projects: Column, relevant: Column) -> Column:
    """Relevant projects in their order, with their facts."""
    kept = F.filter(projects, lambda p: F.array_contains(relevant, p["id"].cast("string")))
    names = ("title", "description", "technologies", "outcomes", "github_url", "portfolio_url")
    return F.transform(kept, lambda p: F.struct(p["id"].cast("string").alias("source_id"), *(p[n].alias(n) for n in names)))


def education_section(education: Column) -> Column:
    return F.transform(education, lambda e: F.struct(e["id"].cast("string").alias("source_id"), *(e[n].alias(n) for n in ("institution", "degree", "field_of_study"))))


def certifications_section(certifications: Column) -> Column:
    """Certificates with their issuers in one word group and without credential ids."""
    return F.transform(
        certifications,
        lambda c: F.struct(
            c["id"].cast("string").alias("source_id"), c["name"].alias("name"), F.replace(c["issuing_organization"], F.lit(" / "), F.lit("/")).alias("issuing_organization"),
            F.lit(None).cast("string").alias("credential_id"), c["credential_url"].alias("credential_url"),
        ),
    )


def project_entry(project: Column, matched: Column, score: Column, reason: Column, generic_links: Column) -> Column:
    """A chosen project as a draft shows it: some technologies, its best bullets, and links that are its own."""
    return F.struct(
        project["id"].cast("string").alias("source_id"), project["title"].alias("title"), project["description"].alias("description"),
        F.slice(unique_terms(project["technologies"]), 1, MAX_TECHNOLOGIES).alias("technologies"), prioritized_bullets(project["outcomes"], matched).alias("outcomes"),
        drafting.specific_link(project["github_url"], generic_links).alias("github_url"), drafting.specific_link(project["portfolio_url"], generic_links).alias("portfolio_url"),
        score.alias("relevance_score"), reason.alias("selection_reason"),
    )


def section_order(**has: Column) -> Column:
    """The sections of a draft in order: summary and skills always, ``experience``, ``projects``, ``education`` and ``certifications`` where there is any."""
    rest = [F.when(has[n], n) for n in ("experience", "projects", "education", "certifications")]
    return F.array_compact(F.array(F.lit("summary"), F.lit("skills"), *rest))


def project_themes(titles: Column, role: Column) -> Column:
    said = F.lower(F.array_join(titles, " "))
    out = F.lit(None).cast("string")
    for words, theme in reversed(TITLE_THEMES):
        out = F.when(reduce(lambda a, b: a & b, (F.contains(said, F.lit(w)) for w in words), F.lit(True)), theme).otherwise(out)
    return reduce(lambda c, item: F.when(role == item[0], item[1]).otherwise(c), ROLE_THEMES.items(), out)


def certification_sentence(certifications: Column, role: Column) -> Column:
    """The sentence about cloud certificates, for the roles that tell it and where a certificate names one; else empty."""
    parts = F.flatten(F.transform(certifications, lambda c: F.array(c["name"], c["issuing_organization"], F.coalesce(c["credential_id"], F.lit("")))))
    named = drafting.any_term(text.casefold(F.array_join(parts, " ")), CLOUD_WORDS)
    return F.when(role.isin(*CLOUD_ROLES) & named, CLOUD_SENTENCE).otherwise("")


def summary_terms(values: Column, role: Column) -> Column:
    """The terms that fit a role, distinct in any case, at most ``MAX_SUMMARY_TERMS``."""
    chosen = values
    for name, terms in SUMMARY_TERMS.items():
        chosen = F.when(role == name, _holding(values, terms)).otherwise(chosen)
    return F.slice(unique_terms(chosen), 1, MAX_SUMMARY_TERMS)


def _holding(values: Column, terms: tuple[str, ...]) -> Column:
    return F.filter(values, lambda v: drafting.any_term(text.project_text(v), terms))


def summary(title: Column, headline: Column, titles: Column, terms: Column, certifications: Column, role: Column) -> Column:
    """A summary in fixed words: role, themes of the chosen projects, terms that fit, and certificates."""
    name = F.coalesce(F.nullif(title, F.lit("")), F.nullif(headline, F.lit("")), F.lit("AI Engineer"))
    using = summary_terms(terms, role)
    used = F.when(F.size(using) > 0, F.concat(F.lit(" using "), F.array_join(using, ", "))).otherwise("")
    first = F.concat(drafting.early_career_role(name), F.lit(" with hands-on project experience building "), project_themes(titles, role), used, F.lit("."))
    return F.concat_ws(" ", first, F.nullif(certification_sentence(certifications, role), F.lit("")))


def claim_manifest(
    candidate: dict[str, Column], summary_text: Column, matched_skills: Column, relevant_projects: Column, relevant_experiences: Column, groups: Column, sections: dict[str, Column]
) -> Column:
    """(claim_type, text, evidence_ids) of every claim of a draft, in the order of its sections.

    ``candidate`` has id, headline, summary, location, skills (id, name) and projects (id, title, technologies).  The summary cites the profile
    if there is anything in it, matched skills, relevant projects and work, else the first skill; a skill of a group cites the candidate's
    skill of that name, else the last project that names it, else nothing; entries of ``sections`` (experience, project, education and
    certification, by claim type) cite themselves, those without a source are no claims."""
    ids = lambda kind, values: F.transform(values, lambda v: F.concat(F.lit(f"{kind}-"), v.cast("string")))
    none = F.array().cast("array<string>")
    last = lambda values: F.get(F.reverse(values), F.lit(0))

    def cited_skill(key: Column) -> Column:
        own = F.filter(candidate["skills"], lambda s: text.casefold(s["name"]) == key)
        return F.when(F.size(own) > 0, F.concat(F.lit("skill-"), last(own)["id"].cast("string")))

    def cited_project(key: Column) -> Column:
        own = F.filter(candidate["projects"], lambda p: F.exists(F.concat(F.array(p["title"]), p["technologies"]), lambda t: text.casefold(t) == key))
        return F.when(F.size(own) > 0, F.concat(F.lit("project-"), last(own)["id"].cast("string")))

    found = F.array_compact(F.transform(matched_skills, lambda t: cited_skill(text.casefold(t))))
    told = F.array_distinct(F.concat(found, ids("project", relevant_projects), ids("experience", relevant_experiences)))
    filled = reduce(lambda a, b: a | b, (F.coalesce(candidate[n], F.lit("")) != "" for n in ("headline", "summary", "location")))
    profile = F.when(filled, F.array(F.concat(F.lit("profile-"), candidate["id"].cast("string"), F.lit("-summary")))).otherwise(none)
    cited = F.concat(profile, told)
    first = F.when(F.size(candidate["skills"]) > 0, F.array(F.concat(F.lit("skill-"), F.get(candidate["skills"], F.lit(0))["id"].cast("string")))).otherwise(none)
    claim = lambda kind, said, evidence: F.struct(F.lit(kind).alias("claim_type"), said.alias("text"), evidence.alias("evidence_ids"))

    def skill_claim(name: Column) -> Column:
        hit = F.coalesce(cited_skill(text.casefold(name)), cited_project(text.casefold(name)))
        return claim("skill", name, F.when(hit.isNotNull(), F.array(hit)).otherwise(none))

    names = {"experience": "job_title", "project": "title", "education": "degree", "certification": "name"}
    parts = [F.array(claim("summary", summary_text, F.when(F.size(cited) > 0, cited).otherwise(first))), F.flatten(F.transform(groups, lambda g: F.transform(g["skills"], skill_claim)))]
    for kind, entries in sections.items():
        sourced = F.filter(entries, lambda e: F.coalesce(e["source_id"], F.lit("")) != "")
        parts.append(_own_claims(kind, sourced, names[kind]))
    return F.concat(*parts)


def _own_claims(kind: str, entries: Column, name: str) -> Column:
    return F.transform(entries, lambda e: F.struct(F.lit(kind).alias("claim_type"), e[name].alias("text"), F.array(F.concat(F.lit(f"{kind}-"), e["source_id"])).alias("evidence_ids")))
