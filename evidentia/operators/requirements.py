"""Requirements of a posting: their list, their match with evidence, and the roll-up that explains a match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import scores, text
from evidentia.operators import matching, retrieval

#: Terms that make a requirement one about AI, back ends or the cloud.
CATALOGS = {
    "ai_ml": ("ai", "artificial intelligence", "machine learning", "ml", "llm", "rag", "langchain", "pytorch", "tensorflow", "scikit learn", "openai"),
    "backend": ("api", "fastapi", "django", "flask", "python", "postgresql", "sql", "redis", "backend"),
    "cloud": ("aws", "azure", "gcp", "google cloud", "docker", "kubernetes", "cloud", "deployment", "ci cd"),
}
#: Words that mark a qualification as one of education.
DEGREE_WORDS = ("degree", "bachelor", "master")
ITEM = "struct<seq:int,text:string,kind:string,priority:string,logic:string,alternatives:array<string>>"
SCORED = ("required", "preferred")


def in_catalog(values: Column, catalog) -> Column:
    """The distinct values, in order, whose normalised form holds a term of the catalog."""
    holds = lambda v: reduce(lambda a, b: a | b, (F.contains(text.retrieval_text(v), F.lit(t)) for t in catalog))
    return F.array_distinct(F.filter(values, holds))


def names_degree(value: Column) -> Column:
    low = text.casefold(value)
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in DEGREE_WORDS))


def _items(values: Column, kind: str | Column, priority: str | Column) -> Column:
    """Single requirements of one kind from an array of texts."""
    part = lambda c, v: c(v) if callable(c) else F.lit(c)
    none = F.array().cast("array<string>")
    return F.transform(values, lambda v: F.struct(v.alias("text"), part(kind, v).alias("kind"), part(priority, v).alias("priority"), F.lit("all").alias("logic"), none.alias("alternatives")))


def structured(analyses: DataFrame, key: str = "analysis_id") -> DataFrame:
    """(key, seq, requirement_id, text, kind, priority, logic, alternatives): the requirements of each analysis, in order.

    Bullets taken from the posting (``canonical``: array of text, kind, priority, logic, alternatives) are the requirements where any is
    valid.  Otherwise they are put together from the term lists: groups of alternatives first, which take their terms out of
    the lists; then required and preferred skills and technologies, years, education not told by a group, and duties as context."""
    empty = F.array().cast("array<string>")
    arrays = lambda c: F.coalesce(c, empty)
    norm = text.retrieval_text
    filled = lambda values: F.filter(F.coalesce(values, empty), lambda a: a.isNotNull() & (F.btrim(a) != ""))

    def bullet(c):
        options = F.transform(filled(c["alternatives"]), lambda a: F.btrim(a))
        any_of = (c["logic"] == "any") & (F.size(options) >= 2)
        return F.struct(
            F.btrim(c["text"]).alias("text"), F.coalesce(c["kind"], F.lit("skill")).alias("kind"), c["priority"].alias("priority"),
            F.when(any_of, "any").otherwise("all").alias("logic"), F.when(any_of, options).otherwise(empty).alias("alternatives"),
        )

    valid = F.filter("canonical", lambda c: c["text"].isNotNull() & (F.btrim(c["text"]) != "") & c["priority"].isin(*SCORED))
    groups = F.filter("groups", lambda g: F.size(filled(g["alternatives"])) >= 2)
    rows = analyses.withColumns({"_bullets": F.transform(F.coalesce(valid, F.expr("array()")), bullet), "_groups": groups})
    group_text = lambda g: F.coalesce(g["text"], F.array_join(filled(g["alternatives"]), " or "))
    rows = rows.withColumns({
        "_terms": F.flatten(F.transform("_groups", lambda g: F.transform(filled(g["alternatives"]), norm))),
        "_texts": F.transform("_groups", lambda g: norm(group_text(g))),
        "_preferred": F.transform(arrays(F.col("preferred_qualifications")), norm),
        "_items": F.transform("_groups", lambda g: F.struct(
            group_text(g).alias("text"), F.coalesce(g["kind"], F.lit("skill")).alias("kind"), F.coalesce(g["priority"], F.lit("required")).alias("priority"),
            F.lit("any").alias("logic"), filled(g["alternatives"]).alias("alternatives"))),
    })
    alone = lambda name: F.filter(arrays(F.col(name)), lambda v: ~F.array_contains(F.col("_terms"), norm(v)))
    told = lambda v: F.array_contains(F.col("_terms"), norm(v)) | F.exists("_texts", lambda t: F.contains(norm(v), t) | F.contains(t, norm(v)))
    years = F.when(F.col("years_min").isNotNull(), F.array(F.concat(F.lit("At least "), F.col("years_min").cast("string"), F.lit(" years of relevant experience")))).otherwise(empty)
    education = F.filter(arrays(F.col("qualifications")), lambda v: names_degree(v) & ~told(v))
    legacy = F.concat(
        F.col("_items"), _items(alone("required_skills"), "skill", "required"), _items(alone("required_technologies"), "technology", "required"),
        _items(alone("preferred_skills"), "skill", "preferred"), _items(alone("preferred_technologies"), "technology", "preferred"), _items(years, "experience", "required"),
        _items(education, "education", lambda v: F.when(F.array_contains(F.col("_preferred"), norm(v)), "preferred").otherwise("required")),
        _items(arrays(F.col("responsibilities")), "responsibility", "context"),
    )
    chosen = rows.select(key, F.posexplode(F.when(F.size("_bullets") > 0, F.col("_bullets")).otherwise(legacy)).alias("seq", "r")).select(key, "seq", "r.*")
    named = matching.requirement_id(F.col(key).cast("string"), F.col("priority"), F.col("kind"), F.col("logic"), F.col("text"))
    return chosen.withColumn("requirement_id", named)


def rule_mask(tokens: Column, rules: dict) -> Column:
    """A bit for each rule of which the tokens hold an alias as a phrase; the tokens are joined once, as the variable of a lambda."""
    joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    holds = lambda s, aliases: reduce(lambda a, b: a | b, (F.contains(s, F.lit(f" {a} ")) for a in aliases))
    bits = F.transform(F.array(joined), lambda s: sum((F.when(holds(s, a), 1 << i).otherwise(0) for i, a in enumerate(rules.values())), F.lit(0)))
    return F.get(bits, F.lit(0))


def held_rules(evidence: DataFrame, rules: dict) -> DataFrame:
    """(held, n): the sets of rules that evidence names together, as masks, and how much evidence names just those.

    Evidence is counted by the rules it names, so there is at most a row for each combination that occurs, and never more than rows of evidence."""
    return evidence.select(rule_mask(F.col("tokens"), rules).alias("held")).groupBy("held").agg(F.count("*").alias("n")).filter("held > 0")


def named_evidence(masks: DataFrame, evidence: DataFrame, rules: dict) -> DataFrame:
    """(mask, met, named): for each distinct mask that requirements ask for, the rules of it that evidence meets and how much evidence cites any.

    Each asked mask and each held one is cut into its rules, and meets the others by rule; a held set is counted once for a mask."""
    bits = lambda c: F.filter(F.transform(F.sequence(F.lit(0), F.lit(len(rules) - 1)), lambda i: F.when(F.getbit(c, i) == 1, i)), lambda i: i.isNotNull())
    asked = masks.select(F.col("mask").cast("bigint").alias("mask")).filter("mask > 0").distinct().withColumn("rule", F.explode(bits(F.col("mask"))))
    held = held_rules(evidence, rules).withColumn("held", F.col("held").cast("bigint")).withColumn("rule", F.explode(bits(F.col("held"))))
    met = asked.join(held, "rule").select("mask", "held", "n").distinct()
    return met.groupBy("mask").agg(F.bit_or(F.col("mask").bitwiseAND(F.col("held"))).alias("met"), F.sum("n").alias("named"))


def matched(requirements: DataFrame, evidence: DataFrame, k: int, rules: dict = matching.EXPLICIT_RULES) -> DataFrame:
    """(query_id, status, branch, best_lexical, citations) of texts (query_id, tokens) against evidence (evidence_id, tokens).

    A text that names a rule is decided by rules alone: all met, some or none, with every naming evidence as a citation of score
    1.  Any other text is decided by its best ``k`` hits: admitted by a shared token or a vector score of ``ADMITTED_VECTOR``,
    matched by its whole wording in a citation or the lexical bar.  ``branch`` tells which rule decided.  Whether a text has
    anything to verify (``has_signal``) is left to the caller: it counts for single requirements only."""
    masks = requirements.select("query_id", "tokens", rule_mask(F.col("tokens"), rules).alias("mask"), (F.size(text.signal_tokens(F.col("tokens"))) > 0).alias("has_signal"))
    found = named_evidence(masks, evidence, rules)
    by_rule = masks.filter("mask > 0").join(found, "mask", "left")
    met = F.coalesce("met", F.lit(0))
    rule_status = F.when(met == F.col("mask"), "matched").when(met > 0, "partially_matched").otherwise("not_evidenced")
    rule_branch = F.when(met == F.col("mask"), "explicit_phrase_matched").when(met > 0, "explicit_phrase_partial").otherwise("explicit_phrase_absent")
    ruled = by_rule.select(
        "query_id", rule_status.alias("status"), rule_branch.alias("branch"), F.when(met > 0, 1.0).otherwise(0.0).alias("best_lexical"),
        F.coalesce("named", F.lit(0)).cast("bigint").alias("citations"), "has_signal",
    )
    free = masks.filter("mask = 0").select("query_id", "tokens", "has_signal")
    hits = matching.held(retrieval.rank(evidence, free, k))
    admitted = hits.filter((F.col("lexical_score") > 0) | (F.col("vector_score") >= scores.ADMITTED_VECTOR))
    wording = free.select("query_id", F.array_join("tokens", " ").alias("_q"))
    cited = matching.with_words(admitted, evidence, ["evidence_id"]).withColumn("_e", F.array_join("tokens", " ")).drop("tokens")
    graded = cited.join(wording, "query_id").groupBy("query_id").agg(
        F.max("lexical_score").alias("best"), F.bool_or(F.contains("_e", "_q")).alias("exact"), F.count("*").alias("n")
    )
    rows = free.select("query_id", "has_signal").join(graded, "query_id", "left")
    best, has = F.coalesce("best", F.lit(0.0)), F.col("n").isNotNull()
    status = scores.status_of(best, has, F.coalesce("exact", F.lit(False)))
    branch = (
        F.when(~has, "citation_filter_empty").when(status == "matched", "lexical_matched_bar").when(status == "partially_matched", "lexical_partial_below_matched_bar")
        .otherwise("lexical_below_partial_bar")
    )
    cited = F.when(status.isin("matched", "partially_matched"), F.col("n")).otherwise(F.lit(0)).cast("bigint")
    return ruled.unionByName(rows.select("query_id", status.alias("status"), branch.alias("branch"), best.alias("best_lexical"), cited.alias("citations"), "has_signal"))


def single(rows: DataFrame) -> DataFrame:
    """The verdicts of requirements taken alone: one without a word to verify is not applicable, whatever was found."""
    none = ~F.col("has_signal") & ~F.col("branch").startswith("explicit")
    return rows.select(
        "query_id", F.when(none, "not_applicable").otherwise(F.col("status")).alias("status"), F.when(none, "no_signal_tokens").otherwise(F.col("branch")).alias("branch"),
        "best_lexical", F.when(none, F.lit(0)).otherwise(F.col("citations")).cast("bigint").alias("citations"),
    )


def of_any(rows: DataFrame) -> DataFrame:
    """The verdicts of requirements with alternatives, from (group_id, position) and the verdict of each: the best, first of ties."""
    admitted = F.when(F.col("citations") > 0, F.col("best_lexical")).otherwise(F.lit(0.0))
    return matching.best_alternative(rows.withColumn("best_lexical", admitted))


def unique_evidence(hits: DataFrame, key: str) -> DataFrame:
    """(key, evidence_id, retrieval_score, position): each evidence once with its best score, best first, then by id."""
    best = hits.groupBy(key, "evidence_id").agg(F.max("retrieval_score").alias("retrieval_score"))
    order = Window.partitionBy(key).orderBy(F.desc("retrieval_score"), "evidence_id")
    return best.withColumn("position", F.row_number().over(order).cast("bigint"))


def explanation(matches: DataFrame, keywords: DataFrame, key: str) -> DataFrame:
    """(key, strongest, partial, missing, supported_keywords, unsupported_keywords, learning, interview, summary).

    ``matches`` has (key, seq, text, priority, status), ``keywords`` (key, keywords).  A keyword is supported if it holds, or is held by, a
    requirement that is met at least in part.  Context never counts among the lists."""
    listed = lambda status: F.transform(F.array_sort(F.collect_list(F.when((F.col("status") == status) & (F.col("priority") != "context"), F.struct("seq", "text")))), lambda s: s["text"])
    met = F.collect_set(F.when(F.col("status").isin("matched", "partially_matched"), text.retrieval_text(F.col("text"))))
    cover = matching.coverage(matches, [key]).select(key, "score")
    rows = matches.groupBy(key).agg(listed("matched").alias("_matched"), listed("partially_matched").alias("partial"), listed("not_evidenced").alias("missing"), met.alias("_met"))
    rows = rows.join(cover, key).join(keywords, key, "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    held = lambda k: F.exists("_met", lambda m: F.contains(m, text.retrieval_text(k)) | F.contains(text.retrieval_text(k), m))
    rows = rows.withColumn("supported_keywords", F.filter("keywords", held))
    return rows.select(
        key, F.slice("_matched", 1, 5).alias("strongest"), "partial", "missing", "supported_keywords",
        F.filter("keywords", lambda k: ~F.array_contains(F.col("supported_keywords"), k)).alias("unsupported_keywords"),
        F.transform(F.slice("missing", 1, 5), lambda m: F.concat(F.lit("Build or document verified evidence for "), m, F.lit("."))).alias("learning"),
        F.slice(F.concat("partial", "missing"), 1, 6).alias("interview"), fit_summary(F.col("score"), F.size("_matched"), F.size("partial"), F.size("missing")).alias("summary"),
    )


def fit_summary(score: Column, full: Column, partial: Column, missing: Column) -> Column:
    return F.concat(
        F.lit("Evidence Coverage Score: "), F.format_string("%.2f", score), F.lit("%. Verified evidence fully supports "), full.cast("string"), F.lit(" scored requirements, partially supports "),
        partial.cast("string"), F.lit(", and does not evidence "), missing.cast("string"), F.lit("."),
    )


def relevant_projects(citations: DataFrame, key: str, limit: int = 5) -> DataFrame:
    """(key, projects): the project evidence that the requirements of each key cite, each once, the best first; at most ``limit``."""
    best = unique_evidence(citations.filter("category = 'project'"), key).filter(F.col("position") <= limit)
    return best.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "evidence_id"))), lambda s: s["evidence_id"]).alias("projects"))
