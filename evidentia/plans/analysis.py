"""Requirement, score, gap, index and page queries over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import analysis as A
from evidentia.operators import drafting as D
from evidentia.operators import drafts
from evidentia.operators import evaluation as E
from evidentia.operators import matching as M
from evidentia.operators import pages as P
from evidentia.operators import relational as L
from evidentia.operators import requirements as Q
from evidentia.operators import retrieval as V
from evidentia.plans import retrieval as R
from evidentia.plans.common import percent_sql, table, tokens_sql
from evidentia.plans.scoring import AS_OF
from evidentia.streaming import sync

#: Rules as the tables' texts can name them.
RULES = {"of_the": ("of the",), "in_the": ("in the", "and the"), "que_de": ("que de", "de que")}


def _verdicts(spark, d):
    return Q.matched(R._requirements(spark, d), R._evidence(spark, d), R.K, RULES)


def requirement_match(spark, d):
    return Q.single(_verdicts(spark, d))


def requirement_any(spark, d):
    rows = _verdicts(spark, d).withColumns({"group_id": F.floor(F.col("query_id") / 3).cast("bigint"), "position": F.col("query_id")})
    return Q.of_any(rows).select("group_id", "position", "status", F.col("best_lexical").alias("best"))


def _analyses(spark, d):
    none = F.array().cast("array<string>")
    words, size = F.split("p_name", " "), F.col("p_size")
    group = F.struct(F.lit(None).cast("string").alias("text"), F.lit("skill").alias("kind"), F.lit("required").alias("priority"), F.slice(words, 1, 2).alias("alternatives"))
    bullets = F.array(
        F.struct(F.concat(F.lit(" "), F.col("p_name"), F.lit(" ")).alias("text"), F.lit("technology").alias("kind"), F.lit("preferred").alias("priority"), F.lit("any").alias("logic"), F.array(F.lit("a"), F.lit(" b ")).alias("alternatives")),
        F.struct(F.lit("x").alias("text"), F.lit("skill").alias("kind"), F.lit("context").alias("priority"), F.lit("all").alias("logic"), none.alias("alternatives")),
    )
    degree = F.array(F.concat(F.lit("Bachelor degree: "), F.col("p_type")))
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("analysis_id"), words.alias("required_skills"), F.array("p_brand").alias("required_technologies"), F.split("p_type", " ").alias("preferred_skills"), none.alias("preferred_technologies"),
        F.filter(F.array(F.when(size % 3 == 0, group)), lambda g: g.isNotNull()).alias("groups"), F.filter(F.when(size % 7 == 0, bullets).otherwise(F.slice(bullets, 1, 0)), lambda b: b.isNotNull()).alias("canonical"),
        F.when(size % 2 == 0, degree).otherwise(F.array(F.lit("own tools"))).alias("qualifications"), F.when(size % 4 == 0, degree).otherwise(none).alias("preferred_qualifications"),
        F.array("p_type").alias("responsibilities"), F.when(size % 5 == 0, size.cast("int")).alias("years_min"),
    )


def structured_requirements(spark, d):
    return Q.structured(_analyses(spark, d)).select("analysis_id", F.col("seq").cast("bigint").alias("seq"), "requirement_id", "text", "kind", "priority", "logic", F.array_join("alternatives", "|").alias("alternatives"))


def requirement_catalogs(spark, d):
    words = F.split(F.concat_ws(" ", "p_type", "p_name"), " ")
    return table(spark, d, "part").select("p_partkey", F.array_join(Q.in_catalog(words, ("steel", "plated", "ed")), "|").alias("found"))


def match_explanation(spark, d):
    status = F.element_at(F.array(*map(F.lit, ("matched", "partially_matched", "not_evidenced", "not_applicable"))), (F.col("l_quantity").cast("int") % 4 + 1))
    priority = F.element_at(F.create_map(*map(F.lit, ("A", "required", "N", "preferred", "R", "context"))), F.col("l_returnflag"))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("seq")).agg(
        F.min(F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).alias("text"), F.min(priority).alias("priority"), F.min(status).alias("status")
    )
    keywords = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.array(F.concat(F.lit("part "), (F.col("o_custkey") % 10).cast("string")), F.lit("Part"), F.lit("none")).alias("keywords"))
    out = Q.explanation(rows, keywords, "order_id")
    lists = ("strongest", "partial", "missing", "supported_keywords", "unsupported_keywords", "learning", "interview")
    return out.select("order_id", *(F.array_join(c, "|").alias(c) for c in lists), "summary")


def unique_evidence(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("evidence_id"), F.round(F.col("l_discount").cast("double"), 2).alias("retrieval_score"))
    return Q.unique_evidence(rows, "owner").filter("position <= 5")


def _records(spark, d):
    part = table(spark, d, "part").withColumns({"owner": F.col("p_partkey") % 100, "id": F.col("p_partkey").cast("string")})
    skills = part.filter("p_size % 2 = 0").select("owner", "id", F.col("p_brand").alias("name"), F.col("p_type").alias("category"), F.col("p_size").alias("years_of_experience"), F.lit(3).alias("self_rating"))
    projects = part.filter("p_size % 3 = 0").select("owner", "id", F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.array("p_brand").alias("technologies"), F.array().cast("array<string>").alias("outcomes"))
    education = part.filter("p_size = 50").select("owner", "id", F.lit("Uni").alias("institution"), F.lit("BSc").alias("degree"), F.col("p_brand").alias("field_of_study"), F.lit(None).cast("string").alias("description"))
    return {"skills": skills, "projects": projects, "education": education}


def _postings(spark, d):
    words = F.split("p_type", " ")
    return table(spark, d, "part").filter("p_size % 5 = 1").select(
        F.col("p_partkey").alias("posting_id"), (F.col("p_partkey") % 100).alias("owner"), F.array(F.col("p_brand"), F.get(words, F.lit(0)), F.upper(F.get(words, F.lit(0)))).alias("required_skills"),
        F.array(F.get(words, F.lit(1)), F.lit("vertex ai")).alias("required_technologies"), F.split("p_name", " ").alias("preferred_skills"), F.array(F.lit("zzz")).alias("preferred_technologies"),
        F.array(F.get(words, F.lit(2)), F.col("p_brand")).alias("ats_keywords"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("A Degree"))).otherwise(F.array().cast("array<string>")).alias("qualifications"),
        F.when(F.col("p_size") % 4 == 0, None).otherwise(F.col("p_size")).cast("int").alias("years_min"),
    )


def evidence_projection(spark, d):
    return A.evidence_items(_records(spark, d)).select("owner", "section", "source_id", "label", "excerpt", "body", F.col("rank").cast("bigint").alias("rank"))


def gap_report(spark, d):
    out = A.gap_report(A.term_support(_postings(spark, d), A.evidence_items(_records(spark, d))))
    lists = ("missing_required_skills", "missing_required_technologies", "unverified_preferred_skills", "unverified_preferred_technologies")
    return out.select("posting_id", *(F.array_join(c, "|").alias(c) for c in lists))


def term_warnings(spark, d):
    evidence = A.evidence_items(_records(spark, d))
    return A.warnings(A.term_support(_postings(spark, d), evidence), evidence).select("posting_id", "required", "term", "warning")


def posting_advice(spark, d):
    """Recommendations by section, and what backs each posting."""
    postings, evidence = _postings(spark, d), A.evidence_items(_records(spark, d))
    wanted = postings.withColumn("_all", F.concat("required_skills", "required_technologies", "ats_keywords"))
    best = A.strongest_for_postings(wanted, evidence, "_all", 5)
    told = A.recommendations(best.filter("position <= 3"), "posting_id").groupBy("posting_id").agg(F.array_join(F.array_sort(F.collect_list("recommendation")), "|").alias("recommendations"))
    named = lambda of: F.transform(F.array_sort(F.collect_list(F.when((F.col("list") == of) & (F.col("records") > 0), F.struct("position", "term")))), lambda s: s["term"])
    met = A.term_support(postings, evidence, ("required_skills", "required_technologies")).groupBy("posting_id").agg(named("required_skills").alias("s"), named("required_technologies").alias("t"))
    labels = lambda of: F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == of, F.struct("position", "label")))), lambda s: s["label"])
    shown = best.groupBy("posting_id").agg(labels("projects").alias("p"), labels("education").alias("e"))
    rows = met.join(shown, "posting_id", "left").join(told, "posting_id", "left")
    none = F.array().cast("array<string>")
    backed = A.strengths(F.col("s"), F.col("t"), F.coalesce("p", none), F.coalesce("e", none))
    return rows.select("posting_id", F.array_join(backed, "|").alias("strengths"), F.coalesce("recommendations", F.lit("")).alias("recommendations"))


def relevant_projects(spark, d):
    category = F.when(F.col("l_linenumber") % 2 == 0, "project").otherwise("skill")
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("evidence_id"), F.round(F.col("l_discount").cast("double"), 2).alias("retrieval_score"), category.alias("category"))
    return Q.relevant_projects(rows, "owner").select("owner", F.array_join(F.transform("projects", lambda x: x.cast("string")), ",").alias("projects"))


def candidate_years(spark, d):
    work = table(spark, d, "events").select(F.col("user_id").alias("owner"), F.to_date("ts").alias("start_date"), F.when(F.col("event_id") % 7 == 0, None).otherwise(F.date_add(F.to_date("ts"), F.floor("value").cast("int"))).alias("end_date"))
    skills = table(spark, d, "part").select((F.col("p_partkey") % 100).alias("owner"), (F.col("p_size") / 10).alias("years_of_experience"))
    return A.candidate_years(work, skills, AS_OF)


def component_scores(spark, d):
    years = table(spark, d, "part").groupBy((F.col("p_partkey") % 100).alias("owner")).agg(F.max(F.col("p_size").cast("double") / 2).alias("years"))
    out = A.component_scores(_postings(spark, d), A.evidence_items(_records(spark, d)), years)
    return out.select("posting_id", "keyword", "skill", "technology", "experience", "project", "education", F.col("missing").cast("bigint").alias("missing"), "overall", "quality")


def project_scores(spark, d):
    """Ten parts are the projects of an owner, and the first of them is the posting; texts and roles go round."""
    part, owner = table(spark, d, "part"), F.floor(F.col("p_partkey") / 10).cast("bigint").alias("posting_id")
    extra = F.element_at(F.array(*map(F.lit, PROJECT_WORDS)), (F.col("p_size") % len(PROJECT_WORDS) + 1).cast("int"))
    projects = part.select(owner, F.col("p_partkey").alias("project_id"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_name", "p_type", "p_brand", extra).alias("body"))
    terms = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(w).alias("weight")) for t, w in (("Steel", 14), ("small", 12), ("steel", 10), ("widget", 9), ("large", 5))))
    role = F.element_at(F.array(*map(F.lit, D.ROLE_GROUPS)), (F.floor(F.col("p_partkey") / 10) % len(D.ROLE_GROUPS) + 1).cast("int"))
    context = F.concat_ws(" ", F.when(F.col("p_size") % 2 == 0, "court filings").otherwise(F.lit("workflow systems")), "p_type", "p_name")
    postings = part.filter("p_partkey % 10 = 0").select(owner, F.concat(F.lit("AI Engineer "), F.col("p_name")).alias("title"), context.alias("context"), role.alias("role"), terms.alias("terms"))
    return D.project_scores(projects, postings).select("project_id", "score", F.array_join("matched_terms", "|").alias("matched_terms"))


def selection_review(spark, d):
    title = F.concat_ws(" ", "o_orderpriority", (F.col("o_orderkey") % 9).cast("string"))
    scored = table(spark, d, "orders").select(F.col("o_custkey").alias("posting_id"), F.col("o_orderkey").alias("project_id"), title.alias("title"), F.floor("o_totalprice").alias("score"))
    drafted = scored.filter("score > 400000").select("posting_id", F.upper("title").alias("title"))
    return D.selection_review(scored, drafted).select("posting_id", "project_id", "position")


#: Words of projects that roles give and take points for.
PROJECT_WORDS = ("plain", "Workflow automation", "OCR", "legal document review", "incident agent", "webhooks")


def draft_wording(spark, d):
    rows = table(spark, d, "customer")
    generic = F.array(F.lit("https://HOST/1/"), F.lit(None).cast("string"))
    link = F.concat(F.lit("https://host/"), (F.col("c_custkey") % 3).cast("string"))
    role = F.element_at(F.array(*map(F.lit, ("Senior Engineer", "Lead Early Analyst", "Tutor"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    other = D.other_experience(role, F.col("c_name"))
    return rows.select("c_custkey", D.specific_link(link, generic).alias("link"), D.early_career_role(role).alias("role"), other.alias("other"), D.includes_other_experience(F.col("c_custkey") % 4, 3, F.lower("c_mktsegment"), other).alias("included"))


def _index(spark, d):
    docs = table(spark, d, "documents")
    evidence = docs.filter("doc_id % 11 <> 0").select((F.col("doc_id") % 5).alias("owner_id"), F.col("doc_id").alias("evidence_id"), F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" v2"))).otherwise(F.col("text")).alias("text"))
    held = docs.select(
        (F.col("doc_id") % 5).alias("owner_id"), F.col("doc_id").alias("evidence_id"), F.when(F.col("doc_id") % 13 == 0, "other").otherwise("m1").alias("model"),
        F.when(F.col("doc_id") % 17 == 0, 32).otherwise(64).alias("dimensions"), text.content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"),
    )
    return evidence.filter("owner_id <> 4"), held


def index_plan(spark, d):
    evidence, held = _index(spark, d)
    return sync.plan_index(evidence, held, "m1", 64)


def vector_faults(spark, d):
    strange = F.when(F.col("vec_id") % 10 == 3, F.array(F.lit(float("nan")))).when(F.col("vec_id") % 10 == 4, F.array().cast("array<double>")).when(F.col("vec_id") % 10 == 5, F.slice("vec", 1, 3))
    rows = R._vectors(spark, d).withColumn("vec", strange.otherwise(F.col("vec")))
    return rows.select("vec_id", V.vector_fault(F.col("vec"), 64).alias("fault"))


def owner_vectors(spark, d):
    rows = R._vectors(spark, d).select(F.col("vec_id").alias("evidence_id"), (F.col("vec_id") % 3).cast("string").alias("owner_id"), F.lit("m").alias("model"), F.size("vec").alias("dimensions"), F.col("label").cast("string").alias("category"))
    own = sync.owned_vectors(rows, "1", "m", 64, ["0", "1", "2"])
    scope = sync.in_scope(rows, "2", rows.filter("evidence_id % 20 = 0"))
    return own.select("evidence_id", F.lit("own").alias("part")).unionByName(scope.select("evidence_id", F.lit("scope").alias("part")))


def evaluation_flags(spark, d):
    hits = R.vector_topk(spark, d).select(F.col("query_id").alias("case_id"), F.col("vec_id").alias("evidence_id"), "rank", F.lit(0.0).alias("lexical_score"), F.col("cosine").alias("vector_score"))
    near = hits.filter("evidence_id % 2 = 0").select("case_id", "evidence_id")
    category = F.element_at(F.array(*map(F.lit, ("exact", "paraphrase", "near_miss", "unsupported"))), (F.floor(F.col("case_id") / 20) % 4 + 1).cast("int"))
    flags = E.neighbor_first(hits, near, "hybrid").withColumn("category", category)
    predicted = F.when(F.floor(F.col("case_id") / 20) % 3 == 0, "not_evidenced").otherwise("matched")
    flags = flags.withColumns({"near_miss_fp": E.false_positive(category, "near_miss", F.lit("not_evidenced"), predicted), "unsupported_fp": E.false_positive(category, "unsupported", F.lit("not_evidenced"), predicted)})
    share = E.ratio(F.count_if("neighbor_first"), F.count("*"))
    out = flags.groupBy("category").agg(share.alias("r"), F.count_if("near_miss_fp").alias("near_miss_fp"), F.count_if("unsupported_fp").alias("unsupported_fp"))
    return out.select("category", F.col("r.hits").alias("neighbors"), F.col("r.cases").alias("cases"), F.col("r.mean").alias("mean"), "near_miss_fp", "unsupported_fp")


def threshold_separability(spark, d):
    best = R.vector_topk(spark, d).groupBy(F.col("query_id").alias("case_id")).agg(F.max("cosine").alias("max_vector"))
    category = F.element_at(F.array(*map(F.lit, ("exact", "paraphrase", "near_miss", "unsupported"))), (F.floor(F.col("case_id") / 20) % 4 + 1).cast("int"))
    return E.separability(best.withColumns({"category": category, "explicit": F.col("case_id") % 60 == 0}))


def full_ranking(spark, d):
    """Every item of the search set against all documents, in full: a case's whole order."""
    docs = V.tokens_of(V.spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", "evidence_id")
    cases = V.tokens_of(table(spark, d, "benchmark").filter("item_id % 20 = 0"), "item_id", "text", "query_id")
    return V.full_order(docs, cases).select("query_id", "evidence_id", "rank", "lexical_score")


def owner_rank(spark, d):
    """Items rank the documents of one language each: language as owner, source as model."""
    scope = [F.col("lang").alias("owner"), F.col("source").alias("model")]
    docs = table(spark, d, "documents").select(*scope, F.col("doc_id").alias("evidence_id"), text.retrieval_tokens(F.col("text")).alias("tokens"))
    owner = F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es", "none"))), (F.col("item_id") % 5 + 1).cast("int")).alias("owner")
    items = table(spark, d, "benchmark").select(owner, F.lit("src3").alias("model"), F.col("item_id").alias("query_id"), text.retrieval_tokens(F.col("text")).alias("tokens"))
    hits = V.rank(docs, items, R.K, vector_weight=0.0, lexical_weight=1.0, scope=["owner", "model"])
    judged = M.gate(hits, items, docs, scope=["owner", "model"]).select("query_id", "status", "citations")
    return hits.join(judged, "query_id").select("owner", "query_id", "evidence_id", "rank", "lexical_score", "status", "citations")


def owner_topk(spark, d):
    """Each vector of the search set among those of its owner, model and dimensions."""
    scope = lambda key: [(F.col(key) % 7).alias("owner"), F.lit("m").alias("model")]
    rows = R._vectors(spark, d).select(*scope("vec_id"), F.size("vec").alias("dimensions"), "vec_id", "vec")
    queries = R._query_vectors(spark, d).select(*scope("query_id"), F.size("query").alias("dimensions"), "query_id", "query")
    return V.vector_topk(rows, queries, R.K, scope=["owner", "model", "dimensions"]).select("owner", "query_id", "vec_id", "cosine", "rank")


def page_lines(spark, d):
    lines = P.without_noise(F.regexp_replace("text", r"[.,] ", "\n"), ("the", "of", "and", "home"))
    return table(spark, d, "documents").select("doc_id", F.size(lines).cast("bigint").alias("n_lines"), text.content_hash(F.array_join(lines, "\n")).alias("digest"))


def posting_fields(spark, d):
    rows = table(spark, d, "conversations").withColumn("_l", P.without_noise(F.regexp_replace("text", r"[.,] ", "\n")))
    title = F.when(F.col("turn") % 3 == 0, F.concat(F.col("role"), F.lit(" - Acme | LinkedIn"))).when(F.col("turn") % 3 == 1, F.lit("Job search - x")).otherwise(F.lit(""))
    found = P.fields(F.col("_l"), title)
    named = {n: c.isNotNull() for n, c in found.items()}
    body = F.col("text")
    return rows.select(
        "conv_id", "turn", *(c.alias(n) for n, c in found.items()), P.first_said(body, P.EMPLOYMENT).alias("employment"),
        P.confidence(named["title"], named["company"], named["location"], body, F.lit(False)).cast("double").alias("confidence"),
    )


def title_decisions(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"))
    ruled = rows.select(F.upper("title").alias("title"), F.when(F.col("p_partkey") % 3 == 0, "unsupported").otherwise("kept").alias("decision")).filter("title < 'M'").groupBy("title").agg(F.min("decision").alias("decision"))
    return L.by_title(rows, ruled).select("p_partkey", "decision")


def conditional_update(spark, d):
    after, touched = L.update_where(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "O", {"o_orderstatus": F.lit("X")})
    return after.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")).unionByName(touched.select(F.lit("updated").alias("status"), F.col("updated").alias("n")))


def cascade_delete(spark, d):
    orders, lines = table(spark, d, "orders").withColumnRenamed("o_orderkey", "k"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "k")
    left, counts = L.delete_cascade({"lineitem": lines, "orders": orders}, "k", orders.filter("o_totalprice < 100000"))
    kept = left["orders"].agg(F.lit(9).alias("position"), F.lit("left").alias("table"), F.count("*").alias("deleted"))
    return counts.unionByName(kept).select("table", F.col("deleted").alias("n"))


def owner_filtered_aggregate(spark, d):
    children = {"orders": table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")}
    rows = L.owned_aggregate(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey", 7, children)
    return rows.select("c_custkey", F.array_join(F.transform("orders", lambda o: o["o_orderkey"].cast("string")), ",").alias("orders"))


QUERIES = {
    f.__name__: f
    for f in (
        requirement_match, requirement_any, structured_requirements, requirement_catalogs, match_explanation, unique_evidence, evidence_projection, gap_report, term_warnings, posting_advice, relevant_projects,
        candidate_years, component_scores, project_scores, selection_review, draft_wording, index_plan, vector_faults, owner_vectors, evaluation_flags, threshold_separability,
        full_ranking, owner_rank, owner_topk, page_lines, posting_fields, title_decisions, conditional_update, cascade_delete, owner_filtered_aggregate,
    )
}


def _phrase(tokens: str, aliases) -> str:
    return "(" + " OR ".join(f"contains(' ' || array_to_string({tokens}, ' ') || ' ', ' {a} ')" for a in aliases) + ")"


def _mask(tokens: str) -> str:
    return " + ".join(f"CASE WHEN {_phrase(tokens, a)} THEN {1 << i} ELSE 0 END" for i, a in enumerate(RULES.values()))


def _norm(value: str) -> str:
    return f"array_to_string({tokens_sql(value)}, ' ')"


_CARD = "trim(regexp_replace(replace(replace(replace(replace(lower({0}), 'apis', 'api'), 'databases', 'database'), 'workflows', 'workflow'), 'technologies', 'technology'), '[^a-z0-9+#.]+', ' ', 'g'))"
_PROJECT = "trim(regexp_replace(replace(replace(replace(replace(lower({0}), 'apis', 'api'), 'workflows', 'workflow'), 'technologies', 'technology'), 'google cloud ai', 'google cloud'), '[^a-z0-9+#.]+', ' ', 'g'))"
_VERDICT = R._hybrid_sql(R.K) + R._STATUS + f""",
        qm AS (SELECT query_id, {_mask("t")} AS mask FROM q), em AS (SELECT {_mask("t")} AS held FROM e),
        ruled AS (SELECT query_id, mask, coalesce(bit_or(mask & held), 0) AS met, count(*) FILTER (mask & held > 0) AS named FROM qm JOIN em ON mask > 0 GROUP BY 1, 2),
        verdict AS (
            SELECT query_id, CASE WHEN met = mask THEN 'matched' WHEN met > 0 THEN 'partially_matched' ELSE 'not_evidenced' END AS status,
                   CASE WHEN met = mask THEN 'explicit_phrase_matched' WHEN met > 0 THEN 'explicit_phrase_partial' ELSE 'explicit_phrase_absent' END AS branch,
                   CASE WHEN met > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END AS best_lexical, named AS citations, signal FROM ruled JOIN wording USING (query_id)
            UNION ALL
            SELECT query_id, s, CASE WHEN n IS NULL THEN 'citation_filter_empty' WHEN s = 'matched' THEN 'lexical_matched_bar' WHEN s = 'partially_matched' THEN 'lexical_partial_below_matched_bar'
                   ELSE 'lexical_below_partial_bar' END, best_lexical, CASE WHEN s IN ('matched', 'partially_matched') THEN n ELSE 0 END, signal
            FROM (SELECT query_id, coalesce(c.best_lexical, 0::DOUBLE) AS best_lexical, n, signal, CASE WHEN n IS NULL THEN 'not_evidenced' WHEN exact OR c.best_lexical >= 0.65::DOUBLE THEN 'matched'
                         WHEN c.best_lexical >= 0.25::DOUBLE THEN 'partially_matched' ELSE 'not_evidenced' END AS s
                  FROM wording JOIN qm USING (query_id) LEFT JOIN cited c USING (query_id) WHERE mask = 0)
        )"""
_PART = """
        WITH a AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS words, p_size AS size, p_name, p_type, p_brand, 'Bachelor degree: ' || p_type AS degree FROM part),
        b AS (SELECT *, CASE WHEN size % 3 = 0 THEN words[1:2] ELSE [] END AS alts FROM a)"""
_RECORDS = f"""
        WITH p AS (SELECT *, p_partkey % 100 AS owner FROM part),
        ev AS (
            SELECT owner, 'skills' AS section, CAST(p_partkey AS VARCHAR) AS source_id, p_brand AS label, p_brand || ': ' || p_size || ' years, rating 3/5' AS excerpt, p_brand || ' ' || p_type AS raw, 3 AS rank FROM p WHERE p_size % 2 = 0
            UNION ALL SELECT owner, 'projects', CAST(p_partkey AS VARCHAR), p_name, p_type, concat_ws(' ', p_name, p_type, p_brand), 5 FROM p WHERE p_size % 3 = 0
            UNION ALL SELECT owner, 'education', CAST(p_partkey AS VARCHAR), 'BSc at Uni', NULL, 'Uni BSc ' || p_brand, 1 FROM p WHERE p_size = 50
        ),
        item AS (SELECT owner, section, source_id, label, excerpt, {_CARD.format("raw")} AS body, rank FROM ev)"""
_SUPPORT = _RECORDS + f""",
        post AS (
            SELECT p_partkey AS posting_id, owner, p_size AS size, [p_brand, string_split(p_type, ' ')[1], upper(string_split(p_type, ' ')[1])] AS rs, [string_split(p_type, ' ')[2], 'vertex ai'] AS rt,
                   string_split(p_name, ' ') AS ps, ['zzz'] AS pt, [string_split(p_type, ' ')[3], p_brand] AS ats FROM p WHERE p_size % 5 = 1
        ),
        listed AS (
            SELECT posting_id, owner, 'rs' AS l, unnest(rs) AS term, unnest(range(len(rs))) AS i FROM post UNION ALL SELECT posting_id, owner, 'rt', unnest(rt), unnest(range(len(rt))) FROM post
            UNION ALL SELECT posting_id, owner, 'ps', unnest(ps), unnest(range(len(ps))) FROM post UNION ALL SELECT posting_id, owner, 'pt', unnest(pt), unnest(range(len(pt))) FROM post
            UNION ALL SELECT posting_id, owner, 'kw', unnest(rs || rt || ats), unnest(range(len(rs || rt || ats))) FROM post UNION ALL SELECT posting_id, owner, 'pr', unnest(rs || rt), unnest(range(len(rs || rt))) FROM post
        ),
        terms AS (SELECT * FROM listed WHERE trim(term) <> '' QUALIFY row_number() OVER (PARTITION BY posting_id, l, lower(term) ORDER BY i) = 1),
        support AS (
            SELECT t.posting_id, t.owner, l, term, i, count(body) AS records FROM terms t
            LEFT JOIN item ON item.owner = t.owner AND {_CARD.format("term")} <> '' AND contains(body, {_CARD.format("term")}) AND (l <> 'pr' OR section = 'projects') GROUP BY ALL
        )"""
_LACKING = "coalesce(string_agg(term, '|' ORDER BY i) FILTER (l = '{0}' AND records = 0), '') AS {1}"
_SHARE = "coalesce(CAST(round(CAST(100.0 * count(*) FILTER (l = '{0}' AND records > 0) / nullif(count(*) FILTER (l = '{0}'), 0) AS DECIMAL(28,12)), 2) AS DOUBLE), 50) AS {1}"
_CASES = "['exact', 'paraphrase', 'near_miss', 'unsupported'][CAST(query_id // 20 % 4 + 1 AS INT)]"
_SPLIT = "list_filter(list_transform(string_split(regexp_replace(text, '[.,] ', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '' AND lower(x) NOT IN ({0}))"
_ONCE = "list_filter({0}, lambda x, i: list_position(list_transform({0}, lambda y: lower(y)), lower(x)) = i)"


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


ORACLE_SQL = {
    "requirement_match": _VERDICT + """
        SELECT query_id, CASE WHEN quiet THEN 'not_applicable' ELSE status END AS status, CASE WHEN quiet THEN 'no_signal_tokens' ELSE branch END AS branch, best_lexical,
               CASE WHEN quiet THEN 0 ELSE citations END AS citations FROM (SELECT *, NOT signal AND NOT starts_with(branch, 'explicit') AS quiet FROM verdict)""",
    "requirement_any": _VERDICT + """
        SELECT query_id // 3 AS group_id, query_id AS position, status, CASE WHEN citations > 0 THEN best_lexical ELSE 0::DOUBLE END AS best FROM verdict
        QUALIFY row_number() OVER (PARTITION BY query_id // 3 ORDER BY CASE status WHEN 'matched' THEN 2 WHEN 'partially_matched' THEN 1 WHEN 'not_evidenced' THEN 0 ELSE -1 END DESC, best DESC, query_id) = 1""",
    "structured_requirements": _PART + f""",
        legacy AS (
            SELECT id, 0 AS block, 0 AS i, array_to_string(alts, ' or ') AS text, 'skill' AS kind, 'required' AS priority, 'any' AS logic, array_to_string(alts, '|') AS alternatives FROM b WHERE len(alts) >= 2
            UNION ALL SELECT id, 1, i, v, 'skill', 'required', 'all', '' FROM (SELECT id, alts, unnest(words) AS v, unnest(range(len(words))) AS i FROM b) WHERE NOT list_contains(list_transform(alts, lambda x: {_norm("x")}), {_norm("v")})
            UNION ALL SELECT id, 2, 0, p_brand, 'technology', 'required', 'all', '' FROM b WHERE NOT list_contains(list_transform(alts, lambda x: {_norm("x")}), {_norm("p_brand")})
            UNION ALL SELECT id, 3, i, v, 'skill', 'preferred', 'all', '' FROM (SELECT id, alts, unnest(string_split(p_type, ' ')) AS v, unnest(range(len(string_split(p_type, ' ')))) AS i FROM b) WHERE NOT list_contains(list_transform(alts, lambda x: {_norm("x")}), {_norm("v")})
            UNION ALL SELECT id, 5, 0, 'At least ' || size || ' years of relevant experience', 'experience', 'required', 'all', '' FROM b WHERE size % 5 = 0
            UNION ALL SELECT id, 6, 0, degree, 'education', CASE WHEN size % 4 = 0 THEN 'preferred' ELSE 'required' END, 'all', '' FROM b WHERE size % 2 = 0 AND NOT list_contains(list_transform(alts, lambda x: {_norm("x")}), {_norm("degree")})
                AND NOT (len(alts) >= 2 AND (contains({_norm("degree")}, {_norm("array_to_string(alts, ' or ')")}) OR contains({_norm("array_to_string(alts, ' or ')")}, {_norm("degree")})))
            UNION ALL SELECT id, 7, 0, p_type, 'responsibility', 'context', 'all', '' FROM b
        ), chosen AS (
            SELECT id, 0 AS block, 0 AS i, trim(p_name) AS text, 'technology' AS kind, 'preferred' AS priority, 'any' AS logic, 'a|b' AS alternatives FROM b WHERE size % 7 = 0
            UNION ALL SELECT l.* FROM legacy l JOIN b USING (id) WHERE size % 7 <> 0
        )
        SELECT id AS analysis_id, row_number() OVER (PARTITION BY id ORDER BY block, i) - 1 AS seq,
               'req-' || substr(sha256(id || ':' || priority || ':' || kind || ':' || logic || ':' || {_norm("text")}), 1, 16) AS requirement_id, text, kind, priority, logic, alternatives FROM chosen""",
    "requirement_catalogs": f"""
        SELECT p_partkey, coalesce((SELECT string_agg(v, '|' ORDER BY i) FROM (SELECT v, min(i) AS i FROM (SELECT unnest(w) AS v, unnest(range(len(w))) AS i) GROUP BY v)
               WHERE contains({_norm("v")}, 'steel') OR contains({_norm("v")}, 'plated') OR contains({_norm("v")}, 'ed')), '') AS found
        FROM (SELECT p_partkey, string_split(p_type || ' ' || p_name, ' ') AS w FROM part)""",
    "match_explanation": f"""
        WITH m AS (
            SELECT l_orderkey AS order_id, l_linenumber AS seq, min('part ' || l_partkey) AS text, min(CASE l_returnflag WHEN 'A' THEN 'required' WHEN 'N' THEN 'preferred' WHEN 'R' THEN 'context' END) AS priority,
                   min(['matched', 'partially_matched', 'not_evidenced', 'not_applicable'][CAST(CAST(floor(l_quantity) AS INT) % 4 + 1 AS INT)]) AS status FROM lineitem GROUP BY 1, 2
        ), w AS (SELECT *, CASE WHEN priority = 'context' OR status = 'not_applicable' THEN 0 WHEN priority = 'required' THEN 2 ELSE 1 END AS weight, CASE status WHEN 'matched' THEN 1.0 WHEN 'partially_matched' THEN 0.5 ELSE 0 END AS v FROM m),
        g AS (
            SELECT order_id, list(text ORDER BY seq) FILTER (status = 'matched' AND priority <> 'context') AS f, list(text ORDER BY seq) FILTER (status = 'partially_matched' AND priority <> 'context') AS p,
                   list(text ORDER BY seq) FILTER (status = 'not_evidenced' AND priority <> 'context') AS n, list(text) FILTER (status IN ('matched', 'partially_matched')) AS met,
                   {percent_sql("sum(weight * v)", "sum(weight)", "0")} AS score FROM w GROUP BY 1
        ), k AS (
            SELECT g.*, coalesce(f, []) AS ff, coalesce(p, []) AS pp, coalesce(n, []) AS nn, ['part ' || o_custkey % 10, 'Part', 'none'] AS kw FROM g JOIN orders ON o_orderkey = order_id
        ), s AS (
            SELECT *, list_filter(kw, lambda x: len(list_filter(coalesce(met, []), lambda y: contains(y, lower(x)) OR contains(lower(x), y))) > 0) AS ok FROM k
        )
        SELECT order_id, array_to_string(ff[1:5], '|') AS strongest, array_to_string(pp, '|') AS partial, array_to_string(nn, '|') AS missing, array_to_string(ok, '|') AS supported_keywords,
               array_to_string(list_filter(kw, lambda x: NOT list_contains(ok, x)), '|') AS unsupported_keywords,
               array_to_string(list_transform(nn[1:5], lambda x: 'Build or document verified evidence for ' || x || '.'), '|') AS learning, array_to_string((pp || nn)[1:6], '|') AS interview,
               'Evidence Coverage Score: ' || printf('%.2f', score) || '%. Verified evidence fully supports ' || len(ff) || ' scored requirements, partially supports ' || len(pp) || ', and does not evidence ' || len(nn) || '.' AS summary
        FROM s""",
    "unique_evidence": """
        SELECT owner, evidence_id, retrieval_score, row_number() OVER (PARTITION BY owner ORDER BY retrieval_score DESC, evidence_id) AS position
        FROM (SELECT l_suppkey AS owner, l_partkey AS evidence_id, max(round(CAST(l_discount AS DOUBLE), 2)) AS retrieval_score FROM lineitem GROUP BY 1, 2) QUALIFY position <= 5""",
    "evidence_projection": _RECORDS + " SELECT owner, section, source_id, label, excerpt, body, CAST(rank AS BIGINT) AS rank FROM item",
    "gap_report": _SUPPORT + f"""
        SELECT posting_id, {_LACKING.format("rs", "missing_required_skills")}, {_LACKING.format("rt", "missing_required_technologies")}, {_LACKING.format("ps", "unverified_preferred_skills")},
               {_LACKING.format("pt", "unverified_preferred_technologies")} FROM support GROUP BY 1""",
    "term_warnings": _SUPPORT + f""",
        cloud AS (SELECT owner, bool_or(regexp_matches(lower(concat_ws(' ', label, excerpt)), 'google cloud|vertex ai|bigquery ml')) AS c FROM item GROUP BY 1),
        lack AS (SELECT *, l IN ('rs', 'rt') AS required FROM support WHERE l IN ('rs', 'rt', 'ps', 'pt') AND records = 0
                 QUALIFY row_number() OVER (PARTITION BY posting_id, l IN ('rs', 'rt'), lower(term) ORDER BY l IN ('rt', 'pt'), i) = 1)
        SELECT posting_id, required, term, CASE WHEN regexp_matches({_CARD.format("term")}, 'gcp|google cloud|vertex ai|bigquery ml|cloud infrastructure|cloud ai') AND coalesce(c, FALSE) THEN '{A.CLOUD_NOTE}'
               WHEN required THEN 'Do not claim ' || term || '; no supporting Candidate Knowledge Base evidence was found.'
               ELSE 'Preferred requirement ' || term || ' is unverified; omit it unless the candidate adds evidence.' END AS warning FROM lack LEFT JOIN cloud USING (owner)""",
    "candidate_years": f"""
        WITH w AS (SELECT user_id AS owner, sum(greatest(coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(ts AS DATE) + CAST(floor(value) AS INT) END, DATE '{AS_OF}') - CAST(ts AS DATE), 0)) / 365.25::DOUBLE AS y FROM events GROUP BY 1),
        s AS (SELECT p_partkey % 100 AS owner, max(p_size / 10) AS z FROM part GROUP BY 1)
        SELECT coalesce(w.owner, s.owner) AS owner, round(greatest(coalesce(y, 0), coalesce(z, 0)), 6) AS years FROM w FULL JOIN s ON w.owner = s.owner""",
    "component_scores": _SUPPORT + f""",
        y AS (SELECT owner, max(p_size::DOUBLE / 2) AS years FROM p GROUP BY 1), ed AS (SELECT DISTINCT owner FROM item WHERE section = 'education'),
        c AS (SELECT posting_id, owner, {_SHARE.format("kw", "keyword")}, {_SHARE.format("rs", "skill")}, {_SHARE.format("rt", "technology")}, {_SHARE.format("pr", "project")},
                     count(*) FILTER (l IN ('rs', 'rt') AND records = 0) AS missing FROM support GROUP BY 1, 2),
        f AS (
            SELECT c.*, CASE WHEN size % 4 = 0 THEN CASE WHEN coalesce(years, 0) = 0 THEN 50 ELSE 100 END WHEN coalesce(years, 0) >= size THEN 100
                        ELSE CAST(round(CAST(100 * years / size AS DECIMAL(28,12)), 2) AS DOUBLE) END::DOUBLE AS experience,
                   CASE WHEN size % 2 = 1 THEN 50 WHEN ed.owner IS NOT NULL THEN 100 ELSE 0 END::DOUBLE AS education
            FROM c JOIN post USING (posting_id, owner) LEFT JOIN y USING (owner) LEFT JOIN ed USING (owner)
        ), o AS (
            SELECT *, CAST(round(CAST(least(greatest(CAST(CAST(keyword AS DECIMAL(10,2)) * 20 + CAST(skill AS DECIMAL(10,2)) * 25 + CAST(technology AS DECIMAL(10,2)) * 25 + CAST(experience AS DECIMAL(10,2)) * 15
                   + CAST(project AS DECIMAL(10,2)) * 10 + CAST(education AS DECIMAL(10,2)) * 5 AS DECIMAL(18,4)) / 100 - least(20, missing * 4), 0), 100) AS DECIMAL(28,12)), 2) AS DOUBLE) AS overall FROM f
        )
        SELECT posting_id, keyword, skill, technology, experience, project, education, missing, overall,
               CASE WHEN overall >= 85 THEN 'excellent' WHEN overall >= 70 THEN 'strong' WHEN overall >= 50 THEN 'moderate' WHEN overall >= 30 THEN 'weak' ELSE 'limited' END AS quality FROM o""",
    "project_scores": f"""
        WITH pr AS (SELECT p_partkey // 10 AS posting_id, p_partkey AS project_id,
                           {_PROJECT.format(f"concat_ws(' ', p_name, p_type, p_brand, [{_quoted(PROJECT_WORDS)}][CAST(p_size % {len(PROJECT_WORDS)} + 1 AS INT)])")} AS body FROM part),
        po AS (SELECT p_partkey // 10 AS posting_id, {_PROJECT.format("'AI Engineer ' || p_name")} AS title, [{_quoted(D.ROLE_GROUPS)}][CAST(p_partkey // 10 % {len(D.ROLE_GROUPS)} + 1 AS INT)] AS role,
                      {_PROJECT.format("concat_ws(' ', CASE WHEN p_size % 2 = 0 THEN 'court filings' ELSE 'workflow systems' END, p_type, p_name)")} AS ctx FROM part WHERE p_partkey % 10 = 0),
        w AS (SELECT *, list_distinct(list_filter(string_split(body, ' '), lambda w: len(w) >= 5 AND w NOT IN ({_quoted(D.GENERIC_WORDS)}))) AS bw,
                     list_distinct(list_filter(string_split(ctx, ' '), lambda w: len(w) >= 5 AND w NOT IN ({_quoted(D.GENERIC_WORDS)}))) AS cw FROM pr JOIN po USING (posting_id)),
        j AS (SELECT *, regexp_matches(body, 'workflow automation|webhook') AS wf, contains(body, 'ocr') OR (contains(body, 'legal') AND contains(body, 'document')) AS doc,
                     regexp_matches(ctx, '{"|".join(drafts.DOCUMENT_TERMS)}') AS asked FROM w)
        SELECT project_id, CAST(CASE WHEN contains(body, 'steel') THEN 14 ELSE 0 END + CASE WHEN contains(body, 'small') THEN 12 ELSE 0 END + CASE WHEN contains(body, 'widget') THEN 9 ELSE 0 END
               + CASE WHEN contains(body, 'large') THEN 5 ELSE 0 END + 5 * len(list_intersect(list_distinct(list_filter(string_split(title, ' '), lambda w: len(w) >= 3)), string_split(body, ' ')))
               + least(24, 2 * len(list_intersect(cw, bw)))
               + {" + ".join(f"CASE WHEN contains(title, '{t}') AND regexp_matches(body, '{'|'.join(words)}') THEN 12 ELSE 0 END" for t, words in D.THEMES.items())}
               + CASE WHEN contains(title, 'engineer') AND regexp_matches(body, 'system|backend|workflow|platform') THEN 6 ELSE 0 END
               + CASE WHEN contains(body, 'agent') AND regexp_matches(ctx, 'ai|llm|workflow|automation') THEN 24 ELSE 0 END
               - CASE WHEN regexp_matches(body, 'ocr|legal|document') AND NOT regexp_matches(ctx, 'ocr|legal|document|extraction') THEN 20 ELSE 0 END
               + CASE role WHEN 'legal_ai' THEN CASE WHEN doc THEN 95 WHEN wf THEN 10 ELSE 0 END
                           WHEN 'ai_automation' THEN CASE WHEN wf THEN 35 ELSE 0 END + CASE WHEN regexp_matches(body, 'agent|incident') THEN 28 ELSE 0 END - CASE WHEN doc AND NOT asked THEN 45 ELSE 0 END
                           WHEN 'backend_python' THEN CASE WHEN doc THEN 12 ELSE 0 END
                           WHEN 'machine_learning' THEN CASE WHEN regexp_matches(body, 'workflow automation|agent') THEN 8 ELSE 0 END - CASE WHEN doc AND NOT asked THEN 25 ELSE 0 END
                           ELSE 0 END AS BIGINT) AS score,
               concat_ws('|', CASE WHEN contains(body, 'steel') THEN 'Steel' END, CASE WHEN contains(body, 'small') THEN 'small' END, CASE WHEN contains(body, 'widget') THEN 'widget' END, CASE WHEN contains(body, 'large') THEN 'large' END) AS matched_terms
        FROM j""",
    "selection_review": """
        WITH s AS (SELECT o_custkey AS posting_id, o_orderkey AS project_id, o_orderpriority || ' ' || o_orderkey % 9 AS title, floor(o_totalprice) AS score FROM orders)
        SELECT posting_id, project_id, row_number() OVER (PARTITION BY posting_id ORDER BY score DESC, lower(title), project_id) AS position FROM s
        WHERE NOT EXISTS (SELECT 1 FROM s d WHERE d.score > 400000 AND d.posting_id = s.posting_id AND lower(d.title) = lower(s.title))""",
    "draft_wording": f"""
        SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN NULL ELSE 'https://host/' || c_custkey % 3 END AS link, ['Early-career Engineer', 'Early Analyst', 'Early-career Tutor'][CAST(c_custkey % 3 + 1 AS INT)] AS role,
               c_custkey % 3 = 2 OR regexp_matches(lower(c_name), 'tutor|learning') AS other,
               c_custkey % 4 < 3 AND regexp_matches(lower(c_mktsegment), '{"|".join(D.USEFUL_TERMS)}') AND (c_custkey % 3 = 2 OR regexp_matches(lower(c_name), 'tutor|learning')) AS included FROM customer""",
    "index_plan": """
        WITH n AS (SELECT doc_id % 5 AS owner_id, doc_id AS evidence_id, sha256(coalesce(CASE WHEN doc_id % 7 = 0 THEN text || ' v2' ELSE text END, '')) AS content_hash FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 5 <> 4),
        h AS (SELECT doc_id % 5 AS owner_id, doc_id AS evidence_id, CASE WHEN doc_id % 17 = 0 THEN 32 ELSE 64 END AS dims, sha256(coalesce(text, '')) AS content_hash FROM documents WHERE doc_id % 13 <> 0)
        SELECT owner_id, evidence_id, content_hash, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.owner_id = n.owner_id AND h.evidence_id = n.evidence_id AND h.content_hash = n.content_hash AND dims = 64) THEN 'reused' ELSE 'embedded' END AS action FROM n
        UNION ALL SELECT owner_id, evidence_id, content_hash, 'deleted' FROM h WHERE owner_id <> 4 AND NOT EXISTS (SELECT 1 FROM n WHERE h.owner_id = n.owner_id AND h.evidence_id = n.evidence_id AND h.content_hash = n.content_hash AND dims = 64)""",
    "vector_faults": "SELECT vec_id, CASE vec_id % 10 WHEN 3 THEN 'not finite' WHEN 4 THEN 'empty' WHEN 5 THEN 'dimensions' END AS fault FROM embeddings",
    "owner_vectors": """
        SELECT vec_id AS evidence_id, 'own' AS part FROM embeddings WHERE vec_id % 3 = 1 AND label IN (0, 1, 2) AND len(embedding) = 64
        UNION ALL SELECT vec_id, 'scope' FROM embeddings WHERE vec_id % 3 = 2 OR vec_id % 20 = 0""",
    "evaluation_flags": f"""
        WITH {R._VECTORS}, t AS (SELECT query_id, {_CASES} AS category, vec_id % 2 = 0 AND cosine >= 0.45 AS near, query_id // 20 % 3 <> 0 AS positive FROM top WHERE rank = 1)
        SELECT category, count(*) FILTER (near) AS neighbors, count(*) AS cases, round(count(*) FILTER (near) / count(*), 6) AS mean, count(*) FILTER (category = 'near_miss' AND positive) AS near_miss_fp,
               count(*) FILTER (category = 'unsupported' AND positive) AS unsupported_fp FROM t GROUP BY 1""",
    "threshold_separability": f"""
        WITH {R._VECTORS}, b AS (SELECT query_id AS id, {_CASES} AS category, query_id % 60 = 0 AS explicit, max(cosine) AS m FROM top GROUP BY 1),
        e AS (SELECT max(m) FILTER (category IN ('near_miss', 'unsupported') AND NOT explicit) AS floor, min(m) FILTER (category = 'paraphrase') AS weakest FROM b)
        SELECT floor, (SELECT min(id) FROM b WHERE m = floor AND category IN ('near_miss', 'unsupported') AND NOT explicit) AS strongest_negative, weakest,
               count(*) FILTER (category = 'paraphrase' AND m > floor) AS above_floor, count(*) FILTER (category = 'paraphrase' AND m >= 0.45) AS at_citation_bar,
               count(*) FILTER (category IN ('near_miss', 'unsupported') AND NOT explicit AND m >= weakest) AS caught FROM b, e GROUP BY floor, weakest""",
    "full_ranking": f"""
        WITH q AS (SELECT item_id AS query_id, list_distinct({tokens_sql("text")}) AS t FROM benchmark WHERE item_id % 20 = 0), e AS (SELECT doc_id AS evidence_id, {tokens_sql("text")} AS t FROM documents),
        s AS (SELECT query_id, evidence_id, CAST(len(list_intersect(q.t, e.t)) AS DOUBLE) / greatest(len(q.t), 1) AS x FROM q, e)
        SELECT query_id, evidence_id, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, evidence_id) AS rank, {R.unit_sql("x")} AS lexical_score FROM s""",
    "owner_rank": f"""
        WITH q AS (SELECT ['en', 'de', 'fr', 'es', 'none'][CAST(item_id % 5 + 1 AS INT)] AS owner, item_id AS query_id, {tokens_sql("text")} AS w FROM benchmark),
        e AS (SELECT lang AS owner, doc_id AS evidence_id, {tokens_sql("text")} AS w FROM documents WHERE source = 'src3'),
        s AS (SELECT owner, query_id, evidence_id, CAST(len(list_intersect(list_distinct(q.w), e.w)) AS DOUBLE) / greatest(len(list_distinct(q.w)), 1) AS x,
                     contains(array_to_string(e.w, ' '), array_to_string(q.w, ' ')) AS whole FROM q JOIN e USING (owner)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, {R.unit_sql("x")} DESC, evidence_id) AS rank, {R.unit_sql("x")} AS lexical_score FROM s),
        t AS (SELECT * FROM r WHERE rank <= {R.K}),
        g AS (SELECT query_id, count(*) FILTER (lexical_score > 0) AS n, coalesce(max(lexical_score) FILTER (lexical_score > 0), 0) AS best, coalesce(bool_or(whole) FILTER (lexical_score > 0), false) AS exact FROM t GROUP BY 1),
        j AS (SELECT *, CASE WHEN n = 0 THEN 'not_evidenced' WHEN exact OR best >= 0.65::DOUBLE THEN 'matched' WHEN best >= 0.25::DOUBLE THEN 'partially_matched' ELSE 'not_evidenced' END AS status FROM g)
        SELECT owner, query_id, evidence_id, rank, lexical_score, status, CASE WHEN status = 'not_evidenced' THEN 0 ELSE n END AS citations FROM t JOIN j USING (query_id)""",
    "owner_topk": """
        WITH v AS (SELECT vec_id, vec_id % 7 AS owner, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
        s AS (SELECT q.owner, q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS cosine FROM v q JOIN v ON q.owner = v.owner AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s)
        SELECT * FROM r WHERE rank <= 3""",
    "posting_advice": _SUPPORT + f""",
        h AS (SELECT posting_id, section, source_id, label, rank, list(term ORDER BY i) AS m FROM terms t JOIN item ON item.owner = t.owner AND {_CARD.format("term")} <> '' AND contains(body, {_CARD.format("term")}) WHERE l = 'kw' GROUP BY ALL),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY posting_id, section ORDER BY rank + len(m) DESC, lower(label), source_id) AS pos FROM h) WHERE pos <= 5),
        w AS (SELECT posting_id, section, flatten(list(m ORDER BY pos) FILTER (pos <= 3)) AS a FROM b WHERE section IN ('skills', 'projects') GROUP BY ALL),
        c AS (SELECT posting_id, string_agg('Highlight ' || array_to_string(list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: lower(y)), lower(x)) = i), ', ') || ' in the ' || section || ' section using the cited candidate evidence.', '|'
                     ORDER BY 'Highlight ' || array_to_string(list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: lower(y)), lower(x)) = i), ', ') || ' in the ' || section) AS recommendations FROM w GROUP BY 1),
        s AS (SELECT posting_id, 'Supported required skills: ' || string_agg(term, ', ' ORDER BY i) FILTER (l = 'rs' AND records > 0) AS a, 'Supported required technologies: ' || string_agg(term, ', ' ORDER BY i) FILTER (l = 'rt' AND records > 0) AS t FROM support GROUP BY 1),
        e AS (SELECT posting_id, 'Relevant project evidence: ' || string_agg(label, ', ' ORDER BY pos) FILTER (section = 'projects') AS p, 'Relevant work evidence: ' || string_agg(label, ', ' ORDER BY pos) FILTER (section = 'education') AS x FROM b GROUP BY 1)
        SELECT posting_id, concat_ws('|', a, t, p, x) AS strengths, coalesce(recommendations, '') AS recommendations FROM s LEFT JOIN e USING (posting_id) LEFT JOIN c USING (posting_id)""",
    "relevant_projects": """
        WITH u AS (SELECT l_suppkey AS owner, l_partkey AS id, max(round(CAST(l_discount AS DOUBLE), 2)) AS s FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY s DESC, id) AS n FROM u)
        SELECT owner, string_agg(CAST(id AS VARCHAR), ',' ORDER BY n) AS projects FROM r WHERE n <= 5 GROUP BY 1""",
    "page_lines": f"""
        WITH l AS (SELECT doc_id, {_SPLIT.format("'the', 'of', 'and', 'home'")} AS a FROM documents), u AS (SELECT doc_id, {_ONCE.format("a")} AS b FROM l)
        SELECT doc_id, CAST(len(b) AS BIGINT) AS n_lines, sha256(array_to_string(b, chr(10))) AS digest FROM u""",
    "posting_fields": f"""
        WITH l AS (SELECT conv_id, turn, role, text, {_SPLIT.format(_quoted(P.NOISE_LINES))} AS a FROM conversations), u AS (SELECT *, {_ONCE.format("a")} AS b FROM l),
        f AS (SELECT *, CASE turn % 3 WHEN 0 THEN role WHEN 1 THEN 'x' ELSE list_filter(b, lambda x: len(x) <= 250)[1] END AS title FROM u),
        c AS (SELECT *, list_position(b, coalesce(title, '')) AS pos FROM f),
        g AS (SELECT *, CASE WHEN turn % 3 = 0 THEN 'Acme' ELSE coalesce(CASE WHEN pos > 0 THEN b[pos + 1] END, b[2]) END AS company FROM c),
        h AS (SELECT *, greatest(coalesce(pos, 0), coalesce(list_position(b, coalesce(company, '')), 0)) AS s FROM g),
        k AS (SELECT *, list_filter(b[s + 1 : s + 4], lambda x: len(x) <= 120 AND NOT regexp_matches(x, '[.!?]$'))[1] AS location FROM h)
        SELECT conv_id, turn, title, company, location, CASE {" ".join(f"WHEN contains(lower(text), '{a}') THEN '{b}'" for a, b in P.EMPLOYMENT)} END AS employment,
               (CASE WHEN title IS NULL THEN 0 ELSE 25 END + CASE WHEN company IS NULL THEN 0 ELSE 25 END + CASE WHEN location IS NULL THEN 0 ELSE 10 END + CASE WHEN len(text) >= 80 THEN 30 ELSE 0 END) / 100::DOUBLE AS confidence FROM k""",
    "title_decisions": """
        WITH r AS (SELECT upper(p_name) AS t, min(CASE WHEN p_partkey % 3 = 0 THEN 'unsupported' ELSE 'kept' END) AS decision FROM part WHERE upper(p_name) < 'M' GROUP BY 1)
        SELECT p_partkey, decision FROM part LEFT JOIN r ON lower(t) = lower(p_name) WHERE decision IS DISTINCT FROM 'unsupported'""",
    "conditional_update": """
        SELECT CASE WHEN o_orderstatus = 'O' THEN 'X' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'updated', count(*) FROM orders WHERE o_orderstatus = 'O'""",
    "cascade_delete": """
        SELECT 'lineitem' AS table, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice < 100000)
        UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_totalprice < 100000 UNION ALL SELECT 'left', count(*) FROM orders WHERE o_totalprice >= 100000""",
    "owner_filtered_aggregate": """
        SELECT c_custkey, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 7 GROUP BY 1""",
}
