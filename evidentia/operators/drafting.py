"""Draft building: role classification, skill grouping, project re-ranking, claim manifests and lifecycle rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text

MAX_SKILLS, MAX_GROUPS = 16, 5
#: Terms that speak for a role.
ROLE_TERMS = {
    "legal_ai": ("legal", "law", "court", "document processing", "ocr", "document extraction", "structured extraction", "legal filings", "validation", "document review"),
    "machine_learning": ("machine learning", "deep learning", "neural networks", "computer vision", "reinforcement learning", "vertex ai", "bigquery ml", "mlops", "model training", "model deployment", "ml pipelines"),
    "ai_automation": ("ai automation", "workflow automation", "webhook", "openai", "make", "n8n", "zapier", "internal tools", "operations automation"),
    "general": ("large language model", "llm", "rag", "natural language processing"),
    "backend_python": ("backend", "python", "fastapi", "api", "postgresql", "sql", "docker", "backend services", "backend architecture"),
}
#: Hits that a role needs, in the order in which roles are tried.
ROLE_ORDER = (("legal_ai", 2), ("machine_learning", 3), ("ai_automation", 2), ("general", 2), ("backend_python", 3))
#: Groups of skills with the terms that belong to them.
SKILL_GROUPS = {
    "Languages": ("python",),
    "Backend": ("fastapi", "api", "apis", "microservices", "backend architecture"),
    "Databases": ("sql", "postgresql", "database", "databases"),
    "AI / Machine Learning": ("machine learning", "deep learning", "neural networks", "computer vision", "reinforcement learning", "vertex ai", "bigquery ml", "langchain", "langgraph", "rag", "openai api", "mlops"),
    "Cloud / MLOps": ("google cloud", "vertex ai", "bigquery ml", "mlops", "sagemaker", "azure ml"),
    "Document AI / Extraction": ("ocr", "document extraction", "structured extraction", "structured data extraction", "validation", "legal technology", "document review"),
    "Automation": ("automation", "playwright", "selenium", "webhooks", "webhook", "make", "zapier", "n8n", "workflow automation", "resume automation", "job extraction", "document generation"),
    "Developer Tools": ("git", "github", "docker", "devops basics", "dataops"),
}
#: The groups of each role, in order.
ROLE_GROUPS = {
    "legal_ai": ("Languages", "Backend", "Document AI / Extraction", "Databases", "Automation"),
    "ai_automation": ("Languages", "Backend", "Automation", "AI / Machine Learning", "Developer Tools"),
    "backend_python": ("Languages", "Backend", "Databases", "Developer Tools", "Automation"),
    "machine_learning": ("Languages", "AI / Machine Learning", "Cloud / MLOps", "Backend", "Developer Tools"),
    "general": ("Languages", "Backend", "AI / Machine Learning", "Databases", "Developer Tools"),
}
#: Terms that only match themselves; "api" and "apis" match each other.
EXACT_TERMS = {"api": ("api", "apis"), "apis": ("api", "apis"), "sql": ("api", "apis", "sql"), "git": ("git",)}


def term_hits(body: Column, terms) -> Column:
    """How many of the terms a normalised text holds, each counted once."""
    return sum((F.contains(body, F.lit(t)).cast("int") for t in terms), F.lit(0))


def role(context: Column) -> Column:
    """The role of a posting from its normalised context: the first in order with enough hits."""
    out = F.lit("general")
    for name, least in reversed(ROLE_ORDER):
        hit = term_hits(context, ROLE_TERMS[name]) >= least
        if name == "general":
            hit = hit | F.contains(context, F.lit("applied ai"))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def belongs(key: Column, terms) -> Column:
    """True where a normalised skill belongs to a group: a term contains it or it contains a term, but for the exact ones."""
    out = F.lit(False)
    for term in terms:
        hit = key.isin(*EXACT_TERMS[term]) if term in EXACT_TERMS else F.contains(key, F.lit(term)) | F.contains(F.lit(term), key)
        out = out | hit
    return out


def grouped_skills(skills: DataFrame, owner: str) -> DataFrame:
    """(owner, group_no, category, skills) from (owner, role, name, category, matched, in_project).

    A skill goes to the first group of its role that it fits.  Groups are filled in order, skills by relevance, until
    ``MAX_SKILLS`` are placed; at most ``MAX_GROUPS`` groups are returned.  Only the skills of one owner are ever ordered."""
    key = text.project_text(F.col("name"))
    keyed = skills.withColumn("_k", key).filter("_k != ''")

    def group(k: Column) -> Column:
        options = []
        for name, groups in ROLE_GROUPS.items():
            fits = [F.when((F.col("role") == name) & (k != text.project_text(F.lit(g))) & belongs(k, SKILL_GROUPS[g]), F.struct(F.lit(i).alias("group_no"), F.lit(g).alias("group"))) for i, g in enumerate(groups)]
            options.append(F.coalesce(*fits))
        return F.coalesce(*options)

    # the key is the variable of a lambda, so that it is made once and not in each of the many comparisons
    placed = keyed.withColumn("_g", F.element_at(F.transform(F.array("_k"), group), 1)).filter("_g is not null")
    relevance = [F.desc("matched"), F.desc("in_project"), F.lower("category"), F.lower("name"), "name"]
    once = Window.partitionBy(owner, "_k").orderBy(*relevance)
    placed = placed.withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    order = Window.partitionBy(owner).orderBy("_g.group_no", *relevance)
    kept = placed.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= MAX_SKILLS)
    rows = kept.groupBy(owner, "_g.group_no", F.col("_g.group").alias("category")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "name"))), lambda s: s["name"]).alias("skills"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(owner).orderBy("group_no")))
    return ranked.filter(F.col("_r") <= MAX_GROUPS).select(owner, "group_no", "category", "skills")


def reranked(projects: DataFrame, owner: str, limit: int = 3) -> DataFrame:
    """(owner, title, score, position, selected) from (owner, title, base, external, protection): external points count 0.8, rounded
    half to even."""
    score = F.col("base") + F.bround(F.coalesce("external", F.lit(0)) * F.lit(0.8).cast("decimal(3,1)")).cast("int") + F.coalesce("protection", F.lit(0))
    rows = projects.withColumn("score", score.cast("bigint"))
    order = Window.partitionBy(owner).orderBy(F.desc("score"), F.lower("title"), "title")
    rows = rows.withColumn("position", F.row_number().over(order).cast("bigint"))
    return rows.select(owner, "title", "score", "position", (F.col("position") <= min(max(1, limit), 3)).alias("selected"))


def skill_claims(skills: DataFrame, owned: DataFrame, projects: DataFrame, owner: str) -> DataFrame:
    """(owner, claim_type, text, evidence_ids): a drafted skill cites the owner's skill of that name, else the last project that
    names it, else nothing."""
    by_skill = owned.select(owner, text.casefold(F.col("name")).alias("_k"), F.concat(F.lit("skill-"), F.col("id")).alias("_skill"), "position")
    by_skill = by_skill.groupBy(owner, "_k").agg(F.max_by("_skill", "position").alias("_skill"))
    terms = projects.select(owner, "position", F.concat(F.lit("project-"), F.col("id")).alias("_project"), F.explode(F.concat(F.array("title"), "technologies")).alias("_t"))
    by_project = terms.groupBy(owner, text.casefold(F.col("_t")).alias("_k")).agg(F.max_by("_project", "position").alias("_project"))
    rows = skills.withColumn("_k", text.casefold(F.col("name"))).join(by_skill, [owner, "_k"], "left").join(by_project, [owner, "_k"], "left")
    cited = F.coalesce("_skill", "_project")
    return rows.select(owner, F.lit("skill").alias("claim_type"), F.col("name").alias("text"), F.when(cited.isNotNull(), F.array(cited)).otherwise(F.array().cast("array<string>")).alias("evidence_ids"))


def group_name(value: Column) -> Column:
    """Preferred group for a free category name; rules are tried in order."""
    low = text.casefold(value)
    return (
        F.when(F.contains(low, F.lit("language")) | (low == "programming"), "Languages").when(low.rlike("backend|database|api"), "Backend")
        .when(low.rlike("ai|machine|ml|cloud|data"), "AI / Machine Learning").when(low.rlike("automation|browser|workflow"), "Automation").otherwise("Developer Tools")
    )


def two_sentences(value: Column) -> Column:
    parts = F.filter(F.transform(F.split(value, r"\."), lambda p: F.btrim(p)), lambda p: p != "")
    return F.when(F.size(parts) == 0, F.btrim(value)).otherwise(F.concat(F.array_join(F.slice(parts, 1, 2), ". "), F.lit(".")))


def display_date(value: Column) -> Column:
    return F.date_format(value, "MMM yyyy")


def date_span(start: Column, end: Column, current: Column) -> Column:
    """"Mon YYYY - Mon YYYY", or Present for a current one."""
    return F.concat_ws(" - ", display_date(start), F.when(current, F.lit("Present")).otherwise(display_date(end)))


def applied_at(status: Column, held: Column, now: Column) -> Column:
    """The application date after a change of status: none before applying, set once, kept afterwards."""
    return F.when(status.isin("saved", "not_applied"), None).when(status == "applied", F.coalesce(held, now)).otherwise(held)


def complete_last(stages: Column, name: str, finished: Column) -> Column:
    """Stage records (stage, status, finished_at) with the last one of a name completed."""
    at = F.size(stages) - F.array_position(F.reverse(F.transform(stages, lambda s: s["stage"])), name)
    done = lambda s: F.struct(s["stage"].alias("stage"), F.lit("completed").alias("status"), finished.alias("finished_at"))
    return F.transform(stages, lambda s, i: F.when(i == at, done(s)).otherwise(s))


def first_available(candidates: DataFrame, key: str) -> DataFrame:
    """(key, candidate, fallback): the first available of each key by position, and whether it wasn't the first choice."""
    return candidates.groupBy(key).agg(
        F.min_by(F.when(F.col("available"), F.col("candidate")), F.when(F.col("available"), F.col("position"))).alias("candidate"),
        (F.min(F.when(F.col("available"), F.col("position"))) > F.min("position")).alias("fallback"),
    )


#: Words that mark a posting as one that other experience helps, and employers or titles that are such.
USEFUL_TERMS = ("communication", "teaching", "training", "mentor", "education", "management", "client", "customer", "operations", "leadership")
OTHER_EXPERIENCE = ("tutor", "tutoring", "learning")
#: Words too general for two descriptions to have in common.
GENERIC_WORDS = ("experience", "strong", "required", "preferred", "working", "systems")
#: Themes of a title, the words of a project that fit them, and the points for that.
THEMES = {
    "ai": ("ai", "machine learning", "llm", "agent", "automation", "workflow"), "automation": ("automation", "workflow", "webhook", "playwright"),
    "backend": ("api", "fastapi", "postgresql", "backend"), "mlops": ("mlops", "docker", "cloud", "vertex", "sagemaker"),
}
THEME_POINTS, SYSTEM_POINTS, AGENT_POINTS, OFF_TOPIC_POINTS = 12, 6, 24, -20


def any_term(body: Column, terms) -> Column:
    return term_hits(body, terms) > 0


def context_overlap(context: Column, body: Column) -> Column:
    """Two points for each word of five letters or more that two normalised texts share, at most 24."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: (F.length(w) >= 5) & ~w.isin(*GENERIC_WORDS)))
    return F.least(F.lit(24), 2 * F.size(F.array_intersect(words(context), words(body))))


def title_points(title: Column, body: Column) -> Column:
    """Five points for each word of three letters or more that a normalised title and text share."""
    return 5 * F.size(F.array_intersect(F.array_distinct(F.filter(F.split(title, " "), lambda w: F.length(w) >= 3)), F.split(body, " ")))


def theme_points(title: Column, context: Column, body: Column) -> Column:
    """Points for themes that a normalised title and project share, and for projects off the posting's topic."""
    points = sum((F.when(F.contains(title, F.lit(t)) & any_term(body, terms), THEME_POINTS).otherwise(0) for t, terms in THEMES.items()), F.lit(0))
    points = points + F.when(F.contains(title, F.lit("engineer")) & any_term(body, ("system", "backend", "workflow", "platform")), SYSTEM_POINTS).otherwise(0)
    points = points + F.when(F.contains(body, F.lit("agent")) & any_term(context, ("ai", "llm", "workflow", "automation")), AGENT_POINTS).otherwise(0)
    off = any_term(body, ("ocr", "legal", "document")) & ~any_term(context, ("ocr", "legal", "document", "extraction"))
    return points + F.when(off, OFF_TOPIC_POINTS).otherwise(0)


def project_scores(projects: DataFrame, postings: DataFrame) -> DataFrame:
    """(posting_id, project_id, title, score, matched_terms) of each posting's projects, from (posting_id, project_id, title, body) and (posting_id,
    title, context, terms array<struct<term, weight>>).

    Bodies, titles and contexts are normalised once.  Of terms with one normalised form the first counts, with its weight.  Postings with
    a ``role`` also give and take the points of that role (``drafts.role_points``)."""
    from evidentia.operators import drafts

    norm = text.project_text
    roles = F.col("role") if "role" in postings.columns else F.lit(None).cast("string")
    asked = postings.select("posting_id", roles.alias("_role"), norm(F.col("title")).alias("_title"), norm(F.col("context")).alias("_context"), F.transform("terms", lambda t: F.struct(norm(t["term"]).alias("k"), t["term"].alias("term"), t["weight"].alias("weight"))).alias("_terms"))
    keys = F.transform("_terms", lambda t: t["k"])
    asked = asked.withColumn("_terms", F.filter("_terms", lambda t, i: (t["k"] != "") & (F.array_position(keys, t["k"]) == i + 1)))
    rows = projects.select("posting_id", "project_id", "title", norm(F.col("body")).alias("_body")).join(asked, "posting_id")
    rows = rows.withColumn("_hits", F.filter("_terms", lambda t: F.contains(F.col("_body"), t["k"])))
    weight = F.aggregate("_hits", F.lit(0), lambda s, t: s + t["weight"].cast("int"))
    score = weight + title_points(F.col("_title"), F.col("_body")) + context_overlap(F.col("_context"), F.col("_body")) + theme_points(F.col("_title"), F.col("_context"), F.col("_body"))
    score = score + drafts.role_points(F.col("_role"), F.col("_body"), F.col("_context"))
    return rows.select("posting_id", "project_id", "title", score.cast("bigint").alias("score"), F.transform("_hits", lambda t: t["term"]).alias("matched_terms"))


def selection_review(scored: DataFrame, drafted: DataFrame) -> DataFrame:
    """Projects that a draft leaves out: those whose title, in any case, it does not have, best first within a posting."""
    out = scored.withColumn("_t", text.casefold(F.col("title"))).join(drafted.select("posting_id", text.casefold(F.col("title")).alias("_t")).distinct(), ["posting_id", "_t"], "left_anti").drop("_t")
    order = Window.partitionBy("posting_id").orderBy(F.desc("score"), F.lower("title"), "project_id")
    return out.withColumn("position", F.row_number().over(order).cast("bigint"))


def specific_link(value: Column, generic: Column) -> Column:
    """A link, unless it is empty or one of the generic ones, in any case and with or without a last slash."""
    bare = lambda c: F.lower(F.rtrim(c, F.lit("/")))
    return F.when((value != "") & ~F.exists(generic, lambda g: bare(F.coalesce(g, F.lit(""))) == bare(value)), value)


def early_career_role(role_name: Column) -> Column:
    """A role without its senior prefix, marked as early-career unless it says so itself."""
    clean = F.replace(F.replace(role_name, F.lit("Senior "), F.lit("")), F.lit("Lead "), F.lit(""))
    return F.when(F.contains(F.lower(clean), F.lit("early")), clean).otherwise(F.concat(F.lit("Early-career "), clean))


def other_experience(job_title: Column, company: Column) -> Column:
    return any_term(F.lower(F.concat_ws(" ", job_title, company)), OTHER_EXPERIENCE)


def includes_other_experience(selected: Column, limit: int, posting: Column, has_other: Column) -> Column:
    """Other experience is told where fewer projects than the limit were chosen, the posting asks for people skills and there is any."""
    return (selected < limit) & any_term(posting, USEFUL_TERMS) & has_other
