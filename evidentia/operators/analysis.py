"""Component scores of a candidate for a posting, gaps, recommendations and warnings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import scores, text
from evidentia.operators import patterns
from evidentia.operators.profiles import sentence
from evidentia.operators.requirements import names_degree

#: How much a record of each kind counts beside its supported terms.
RANKS = {"skills": 3, "projects": 5, "experience": 5, "certifications": 2, "education": 1}
#: The order in which recommendations are made.
RECOMMENDED = ("experience", "projects", "skills", "certifications")
#: Terms about one cloud, and what evidence must say for the milder warning.
CLOUD_TERMS = ("gcp", "google cloud", "vertex ai", "bigquery ml", "cloud infrastructure", "cloud ai")
CLOUD_EVIDENCE = ("google cloud", "vertex ai", "bigquery ml")
CLOUD_NOTE = "Can mention Google Cloud ML certifications and coursework, but avoid claiming production GCP deployment experience unless supported."
TERM_LISTS = ("required_skills", "required_technologies", "preferred_skills", "preferred_technologies", "ats_keywords")


def evidence_items(tables: dict[str, DataFrame]) -> DataFrame:
    """(owner, section, source_id, label, excerpt, body, rank) of the records of each kind; ``body`` is normalised once, here."""
    none = F.lit(None).cast("string")
    makers = {
        "skills": lambda: (F.col("name"), sentence(F.col("name"), F.col("category")),
            F.concat("name", F.lit(": "), F.col("years_of_experience").cast("string"), F.lit(" years, rating "), F.col("self_rating").cast("string"), F.lit("/5"))),
        "projects": lambda: (F.col("title"), sentence(F.col("title"), F.col("description"), F.array_join("technologies", " "), F.array_join("outcomes", " ")), F.col("description")),
        "experience": lambda: (F.concat_ws(" at ", "job_title", "company"), sentence(F.col("job_title"), F.col("company"), F.col("description"), F.array_join("achievements", " ")),
            F.coalesce(F.when(F.col("description") != "", F.col("description")), F.array_join("achievements", "; "))),
        "certifications": lambda: (F.col("name"), sentence(F.col("name"), F.col("issuing_organization"), F.col("credential_id")), F.concat_ws(" from ", "name", "issuing_organization")),
        "education": lambda: (F.concat_ws(" at ", "degree", "institution"), sentence(F.col("institution"), F.col("degree"), F.col("field_of_study"), F.col("description")), F.coalesce(F.col("description"), none)),
    }
    rows = []
    for section, df in tables.items():
        label, body, excerpt = makers[section]()
        rows.append(df.select("owner", F.lit(section).alias("section"), F.col("id").alias("source_id"), label.alias("label"), excerpt.alias("excerpt"), text.scorecard_text(body).alias("body"), F.lit(RANKS[section]).alias("rank")))
    return reduce(DataFrame.unionByName, rows)


def unique_terms(values: Column) -> Column:
    """Distinct terms in any case, the first spelling of each, in order; blank ones dropped."""
    filled = F.filter(values, lambda v: v.isNotNull() & (F.btrim(v) != ""))
    lowered = lambda a: F.transform(a, text.casefold)
    return F.filter(filled, lambda v, i: F.array_position(lowered(filled), text.casefold(v)) == i + 1)


def term_support(postings: DataFrame, evidence: DataFrame, lists=TERM_LISTS) -> DataFrame:
    """(posting_id, owner, list, position, term, records): how many records of the owner support each term of each list.

    Postings (posting_id, owner, term lists) are cut into terms; the distinct ones of an owner are found in all of that owner's
    records at once, however many postings name them."""
    each = F.array(*(F.struct(F.lit(n).alias("list"), unique_terms(F.coalesce(n, F.array().cast("array<string>"))).alias("terms")) for n in lists))
    terms = postings.select("posting_id", "owner", F.inline(each)).select("posting_id", "owner", "list", F.posexplode("terms").alias("position", "term"))
    terms = terms.withColumn("_n", text.scorecard_text(F.col("term")))
    found = patterns.count_texts(terms, evidence, "owner", "_n", "body", F.xxhash64("section", "source_id", "body"))
    return terms.join(found, ["owner", "_n"], "left").select(*terms.columns[:-1], F.coalesce("records", F.lit(0)).alias("records"))


def gap_report(support: DataFrame) -> DataFrame:
    """(posting_id, owner, and four lists): required terms that are missing, preferred ones that are unverified, in their order."""
    names = {"missing_required_skills": "required_skills", "missing_required_technologies": "required_technologies", "unverified_preferred_skills": "preferred_skills", "unverified_preferred_technologies": "preferred_technologies"}
    lacking = lambda of: F.transform(F.array_sort(F.collect_list(F.when((F.col("list") == of) & (F.col("records") == 0), F.struct("position", "term")))), lambda s: s["term"])
    return support.groupBy("posting_id", "owner").agg(*(lacking(of).alias(name) for name, of in names.items()))


def candidate_years(work: DataFrame, skills: DataFrame, as_of) -> DataFrame:
    """(owner, years): the most of all work, overlaps counted twice, and of any one skill; six decimals."""
    days = F.greatest(F.datediff(F.coalesce("end_date", F.lit(as_of).cast("date")), F.col("start_date")), F.lit(0))
    worked = work.groupBy("owner").agg((F.sum(days) / F.lit(scores.DAYS_SUMMED)).alias("_work"))
    longest = skills.groupBy("owner").agg(F.max("years_of_experience").cast("double").alias("_skill"))
    rows = worked.join(longest, "owner", "full_outer")
    return rows.select("owner", F.round(F.greatest(F.coalesce("_work", F.lit(0.0)), F.coalesce("_skill", F.lit(0.0))), 6).alias("years"))


def experience_score(years: Column, required: Column) -> Column:
    """100 for enough years, the share of them otherwise; without a requirement 100 for any and 50 for none."""
    share = scores.percent(years, required, 100.0)
    return F.when(required.isNull(), F.when(years == 0, 50.0).otherwise(100.0)).when((required == 0) | (years >= required), 100.0).otherwise(F.least(share, F.lit(100.0)))


def education_score(qualifications: Column, has_education: Column) -> Column:
    """50 unless a degree is asked for, then 100 or 0."""
    return F.when(~names_degree(F.array_join(qualifications, " ")), 50.0).when(has_education, 100.0).otherwise(0.0)


def component_scores(postings: DataFrame, evidence: DataFrame, years: DataFrame) -> DataFrame:
    """(posting_id, owner, six component scores, missing, overall, quality) of postings with term lists, qualifications and years_min."""
    lists = ("required_skills", "required_technologies")
    wanted = postings.withColumn("_wanted", F.concat(*lists)).withColumn("_keywords", F.concat("_wanted", "ats_keywords"))
    support = term_support(wanted, evidence, (*lists, "_keywords"))
    required = F.col("list").isin("required_skills", "required_technologies")
    share = lambda name: scores.percent(F.count_if((F.col("list") == name) & (F.col("records") > 0)), F.count_if(F.col("list") == name), 50.0)
    cover = support.groupBy("posting_id", "owner").agg(
        share("_keywords").alias("keyword"), share("required_skills").alias("skill"), share("required_technologies").alias("technology"),
        F.count_if(required & (F.col("records") == 0)).alias("missing"),
    )
    in_projects = term_support(wanted, evidence.filter("section = 'projects'"), ("_wanted",))
    project = in_projects.groupBy("posting_id", "owner").agg(scores.percent(F.count_if(F.col("records") > 0), F.count("*"), 50.0).alias("project"))
    educated = evidence.filter("section = 'education'").select("owner").distinct().withColumn("_educated", F.lit(True))
    rows = postings.select("posting_id", "owner", "qualifications", "years_min").join(cover, ["posting_id", "owner"], "left").join(project, ["posting_id", "owner"], "left")
    rows = rows.join(educated, "owner", "left").join(years, "owner", "left")
    fifty = lambda n: F.coalesce(n, F.lit(50.0)).alias(n)
    rows = rows.select(
        "posting_id", "owner", *map(fifty, ("keyword", "skill", "technology")), experience_score(F.coalesce("years", F.lit(0.0)), F.col("years_min")).alias("experience"), fifty("project"),
        education_score(F.coalesce("qualifications", F.array().cast("array<string>")), F.coalesce("_educated", F.lit(False))).alias("education"), F.coalesce("missing", F.lit(0)).alias("missing"),
    )
    total = sum((F.col(n).cast("decimal(10,2)") * w for n, w in scores.SCORECARD_WEIGHTS.items()), F.lit(0).cast("decimal(12,2)")) / 100
    rows = rows.withColumn("overall", scores.bounded(total - F.least(F.lit(20), F.col("missing") * 4)))
    return rows.withColumn("quality", scores.band(F.col("overall")))


def strongest_by_section(evidence: DataFrame, terms: DataFrame, limit: int = 3) -> DataFrame:
    """(owner, section, position, source_id, label, matched_terms) of the records that support most of their owner's terms (owner, position, term)."""
    wanted = terms.select("owner", F.col("position").alias("_at"), "term", text.scorecard_text(F.col("term")).alias("_n")).filter("_n != ''")
    keys = ["section", "source_id", "label", "rank"]
    hits = patterns.terms_in_texts(wanted, evidence, "owner", "_n", "body", keys).join(wanted, ["owner", "_n"]).groupBy("owner", *keys)
    rows = hits.agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "term"))), lambda s: s["term"]).alias("matched_terms"))
    order = Window.partitionBy("owner", "section").orderBy(F.desc(F.col("rank") + F.size("matched_terms")), F.lower("label"), "source_id")
    ranked = rows.withColumn("position", F.row_number().over(order).cast("bigint")).filter(F.col("position") <= limit)
    return ranked.select("owner", "section", "position", "source_id", "label", "matched_terms")


def strongest_for_postings(postings: DataFrame, evidence: DataFrame, terms: str, limit: int = 3) -> DataFrame:
    """(posting_id, owner, section, position, source_id, label, matched_terms): of each posting the records of each section that support most of its terms.

    Postings that ask for the same terms have the same records, and records of a section that hold the same terms of their owner stand by rank, label
    and id alone.  So each set of terms is ranked once, against classes of records with their first ``limit`` rows; postings meet the few rows found."""
    listed = postings.select("posting_id", "owner", F.posexplode(unique_terms(F.coalesce(terms, F.array().cast("array<string>")))).alias("_at", "term"))
    wanted = listed.withColumn("_n", text.scorecard_text(F.col("term"))).filter("_n != ''")
    asked = wanted.groupBy("posting_id", "owner").agg(F.array_sort(F.collect_list("_n")).alias("_asked"), F.array_sort(F.collect_list(F.struct("_at", "term", "_n"))).alias("_terms"))
    sets = asked.select("owner", "_asked").distinct()
    keys = ["section", "source_id", "label", "rank"]
    hits = patterns.terms_in_texts(wanted, evidence, "owner", "_n", "body", keys).groupBy("owner", *keys).agg(F.array_sort(F.collect_set("_n")).alias("_held"))
    same = ["owner", "section", "rank", "_held"]
    order = Window.partitionBy(*same).orderBy(F.lower("label"), "source_id")
    firsts = hits.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= limit)
    classes = firsts.groupBy(*same).agg(F.array_sort(F.collect_list(F.struct(F.lower("label").alias("_low"), "source_id", "label"))).alias("_rows"))
    # a class and a set meet by each distinct term that both have; a term counts as often as the set has it
    each = sets.withColumn("_n", F.explode(F.array_distinct("_asked")))
    weight = F.size(F.filter("_asked", lambda x: x == F.col("_n")))
    met = each.withColumn("_w", weight).join(classes.withColumn("_n", F.explode("_held")), ["owner", "_n"])
    scored = met.groupBy("owner", "_asked", "section", "rank", "_held").agg(F.sum("_w").alias("_count"), F.first("_rows").alias("_rows")).withColumn("_strength", F.col("rank") + F.col("_count"))
    within = Window.partitionBy("owner", "_asked", "section")
    # no class whose first row is behind those of ``limit`` others has a row among the first
    best = scored.withColumn("_place", F.row_number().over(within.orderBy(F.desc("_strength"), F.get("_rows", F.lit(0))["_low"], F.get("_rows", F.lit(0))["source_id"]))).filter(F.col("_place") <= limit)
    rows = best.select("owner", "_asked", "section", "_held", "_strength", F.inline("_rows"))
    placed = rows.withColumn("position", F.row_number().over(within.orderBy(F.desc("_strength"), "_low", "source_id")).cast("bigint")).filter(F.col("position") <= limit)
    matched = F.transform(F.filter("_terms", lambda t: F.array_contains("_held", t["_n"])), lambda t: t["term"])
    return asked.join(placed, ["owner", "_asked"]).select("posting_id", "owner", "section", "position", "source_id", "label", matched.alias("matched_terms"))


def strengths(skills: Column, technologies: Column, projects: Column, experiences: Column) -> Column:
    """Sentences about what evidence backs, in order: supported skills and technologies, labels of relevant projects and work."""
    some = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ", ")))
    return F.array_compact(F.array(
        some("Supported required skills: ", skills), some("Supported required technologies: ", technologies), some("Relevant project evidence: ", projects), some("Relevant work evidence: ", experiences),
    ))


def recommendations(strongest: DataFrame, key: str = "owner") -> DataFrame:
    """(key, section, keywords, recommendation): what to highlight in each section that has supported terms."""
    rows = strongest.filter(F.col("section").isin(*RECOMMENDED)).groupBy(key, "section")
    rows = rows.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", "matched_terms"))), lambda s: s["matched_terms"])).alias("_t"))
    rows = rows.withColumn("keywords", unique_terms(F.col("_t")))
    return rows.select(key, "section", "keywords", F.concat(F.lit("Highlight "), F.array_join("keywords", ", "), F.lit(" in the "), F.col("section"), F.lit(" section using the cited candidate evidence.")).alias("recommendation"))


def warnings(support: DataFrame, evidence: DataFrame) -> DataFrame:
    """(posting_id, owner, term, warning) for each required or preferred term without evidence; required ones are told first."""
    clouds = evidence.groupBy("owner").agg(F.bool_or(reduce(lambda a, b: a | b, (F.contains(text.casefold(F.concat_ws(" ", "label", "excerpt")), F.lit(v)) for v in CLOUD_EVIDENCE))).alias("_cloud"))
    rank = F.when(F.col("list").startswith("required"), 0).when(F.col("list").startswith("preferred"), 1)
    lacking = support.filter((F.col("records") == 0) & rank.isNotNull()).withColumns({"_rank": rank, "_order": F.col("list").endswith("technologies").cast("int")})
    once = lacking.groupBy("posting_id", "owner", "_rank", text.casefold(F.col("term")).alias("_k")).agg(F.min_by("term", F.struct("_order", "position")).alias("term"))
    rows = once.join(clouds, "owner", "left")
    about_cloud = reduce(lambda a, b: a | b, (F.contains(text.scorecard_text(F.col("term")), F.lit(v)) for v in CLOUD_TERMS))
    told = (
        F.when(about_cloud & F.coalesce("_cloud", F.lit(False)), CLOUD_NOTE)
        .when(F.col("_rank") == 0, F.concat(F.lit("Do not claim "), F.col("term"), F.lit("; no supporting Candidate Knowledge Base evidence was found.")))
        .otherwise(F.concat(F.lit("Preferred requirement "), F.col("term"), F.lit(" is unverified; omit it unless the candidate adds evidence.")))
    )
    return rows.select("posting_id", "owner", (F.col("_rank") == 0).alias("required"), "term", told.alias("warning"))


def weaknesses(missing_skills: Column, missing_technologies: Column, years: Column, required: Column) -> Column:
    """Sentences about what evidence lacks, in order."""
    some = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ", ")))
    short = F.when(required.isNotNull() & (years < required), F.concat(F.lit("Estimated experience evidence is "), F.format_string("%.2f", years), F.lit(" years; role requests at least "), required.cast("string"), F.lit(" years.")))
    found = F.array(some("Missing required skill evidence: ", missing_skills), some("Missing required technology evidence: ", missing_technologies), short)
    return F.filter(found, lambda x: x.isNotNull())


def suggested_summary(headline: Column, title: Column, matched: Column) -> Column:
    """A conservative summary of at most five supported terms."""
    base = F.coalesce(F.when(headline != "", headline), F.concat(F.lit("Candidate for "), title))
    terms = F.slice(unique_terms(matched), 1, 5)
    backed = F.concat(base, F.lit(" with knowledge-base evidence in "), F.array_join(terms, ", "), F.lit("."))
    return F.when(F.size(terms) > 0, backed).otherwise(F.concat(base, F.lit(". Review the knowledge base before adding role-specific claims.")))
