"""Queries that take pages, runs, corpora and nested records apart or put them together."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evidentia.operators import corpus as C
from evidentia.functions import text
from evidentia.operators import drafting, drafts, embedding, markup, nested, pages, relational, runs
from evidentia.operators.retrieval import spread
from evidentia.plans.common import table
from evidentia.plans.postings import _DROPPED, _entities_sql, _redact_sql

#: Where the pages of the tables keep their fields; the first selector of each is for pages of other makers.
SELECTORS = {
    "raw_title": (".headline", "article h1"),
    "company_name": ("[itemprop='publisher'] .name", "footer"),
    "location": ("div.ad",),
    "description_text": ("#content", "article"),
}
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "evidentia/corpus")
SHAPE = nested.Shape("c_custkey", "c_nationkey", ("c_name", "c_acctbal"), ("open", "urgent", "large"), NAMESPACE)


def page_fields(spark, d):
    found = markup.postings(table(spark, d, "pages"), by_selector=markup.select_texts(F.col("html"), SELECTORS), any_platform=True)
    p = "posting."
    return found.select(
        "page_id", *(p + n for n in ("outcome", "raw_title", "company_name", "location", "employment_type", "workplace_type", "confidence")),
        F.sha2(F.col(p + "description_text").cast("binary"), 256).alias("description"), F.array_join(p + "warnings", "|").alias("warnings"),
    )


def page_platform(spark, d):
    url = F.col("url")
    gate = pages.page_gate(pages.visible_text(F.col("html")), pages.title(F.col("html")), url)
    return table(spark, d, "pages").select("page_id", pages.platform(url).alias("platform"), gate.alias("gate"), pages.job_url(url).alias("job_url"))


def _run_events(spark, d):
    e = table(spark, d, "events")
    name = F.when(F.col("value") > 95, "finish").when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "view", "complete").when(F.col("event_type") == "click", "wait")
    name = name.when(F.col("event_type") == "purchase", "approve").when(F.col("value") < 30, "fail").otherwise("reject")
    run = F.col("user_id") * 100 + F.month("ts")
    stage = F.concat(F.lit("stage-"), (F.col("event_id") % 3).cast("string"))
    return e.select(run.alias("run_id"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), name.alias("event"), stage.alias("stage"), F.lit("Timeout").alias("error_type"), F.col("props").alias("message"))


def run_lifecycle(spark, d):
    found = runs.lifecycle(_run_events(spark, d), "run_id")
    return found.select(
        "run_id", "status", "current_stage", "moves", "refused", "first_refused", F.col("failure.stage").alias("failed_stage"), F.col("failure.message").alias("message"),
        "latency_ms", F.unix_micros("finished_at").alias("finished_at"),
    )


def run_read_model(spark, d):
    """Orders as runs: the latest line as draft, all lines as documents, the latest event of the same number as application, its events as stages."""
    lines, events = table(spark, d, "lineitem"), table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    children = {
        "draft": runs.Child(lines, "l_orderkey", ("l_shipdate", "l_linenumber", "l_quantity"), ("l_linenumber", "l_quantity")),
        "documents": runs.Child(lines, "l_orderkey", ("l_linenumber",), ("l_linenumber",), many=True),
        "application": runs.Child(events, "user_id", ("at", "event_id"), ("event_type",)),
        "stages": runs.Child(events, "user_id", ("at", "event_id"), ("at", "event_type"), many=True),
    }
    found = runs.read_model(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), "o_orderkey", children)
    first, last = F.element_at("stages", 1)["at"], F.element_at("stages", -1)["at"]
    return found.select(
        "o_orderkey", "o_orderstatus", F.col("draft.l_linenumber").cast("bigint").alias("draft_line"), F.col("draft.l_quantity").cast("double").alias("draft_quantity"),
        F.array_join(F.transform("documents", lambda x: x["l_linenumber"].cast("string")), ",").alias("documents"), F.col("application.event_type").alias("application"),
        F.size("stages").cast("bigint").alias("n_stages"), F.when(F.size("stages") > 0, runs.latency_ms(first, last)).alias("latency_ms"),
        runs.reviewable(F.when(F.col("o_orderstatus") == "O", "awaiting_review").otherwise("running"), F.col("draft.l_linenumber"), F.col("application").isNotNull()).alias("not_reviewable"),
    )


def _corpus(spark, d):
    kind = F.when(F.col("source") == "src0", "project").when(F.col("source") == "src1", "skill").otherwise("experience")
    label = F.concat(kind, F.lit(" no. "), F.col("doc_id").cast("string"), F.lit(" of "), F.coalesce("lang", F.lit("?")))
    return C.corpus(table(spark, d, "documents").select("doc_id", kind.alias("kind"), label.alias("label")), "kind", "label", NAMESPACE)


def corpus_ids(spark, d):
    return _corpus(spark, d).select("doc_id", "key", "record_id")


def corpus_cases(spark, d):
    """Benchmark items as cases that name three documents each, of which some are missing."""
    at = F.col("item_id") * 7
    keys = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.concat(F.lit("project:project no. "), (at + i).cast("string"), F.lit(" of en")))
    cases = table(spark, d, "benchmark").select("item_id", keys.alias("relevant"))
    return C.resolve(cases, _corpus(spark, d), "item_id", "relevant")


def _payloads(spark, d, least: int):
    """Customers with their orders in three sections; a section is null where the customer's number says so."""
    orders = table(spark, d, "orders").filter(F.col("o_orderkey") >= least)
    row = F.struct("o_orderkey", F.col("o_totalprice").cast("double").alias("price"))
    tests = {"open": F.col("o_orderstatus") == "O", "urgent": F.col("o_orderpriority") == "1-URGENT", "large": F.col("o_totalprice") > 250_000}
    lists = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(*(F.array_sort(F.collect_list(F.when(t, row))).alias(n) for n, t in tests.items()))
    customers = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("c_nationkey"), "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    return customers.join(lists, "c_custkey", "left")


def _created(spark, d):
    return nested.create(_payloads(spark, d, 0), SHAPE)


def nested_create(spark, d):
    made = _created(spark, d).children
    rows = [t.select(F.lit(n).alias("section"), F.col("record_id").alias("id"), "c_custkey", "position", "o_orderkey", "price") for n, t in made.items()]
    return rows[0].union(rows[1]).union(rows[2])


def _updates(spark, d):
    """Partial payloads: names of some, balances of others, sections that are null, empty or new; some come from the wrong owner."""
    p = _payloads(spark, d, 1000)
    n = F.col("c_custkey")
    return p.select(
        "c_custkey", F.when(n % 11 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("c_nationkey"),
        F.when(n % 2 == 0, F.upper("c_name")).alias("c_name"), F.when(n % 3 == 0, F.col("c_acctbal") + 1).alias("c_acctbal"),
        F.when(n % 3 != 0, F.col("open")).alias("open"), F.when(n % 4 == 0, F.slice("urgent", 1, 0)).otherwise(F.col("urgent")).alias("urgent"), F.lit(None).cast(p.schema["large"].dataType).alias("large"),
    )


def nested_update(spark, d):
    _, counts = nested.update(_created(spark, d), _updates(spark, d), SHAPE)
    return counts


def nested_read(spark, d):
    after, _ = nested.update(_created(spark, d), _updates(spark, d), SHAPE)
    listed = [F.array_join(F.transform(s, lambda x: x["o_orderkey"].cast("string")), ",").alias(s) for s in SHAPE.sections]
    return nested.read(after, SHAPE).select("c_custkey", "c_name", "c_acctbal", *listed)


def _draft_rows(spark, d):
    """Customers as candidates: their orders are skills, work and projects, of which dear ones are relevant."""
    key, text = F.col("o_orderkey"), lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    none = F.lit(None).cast("string")
    skill = F.struct(key.alias("id"), text(F.col("o_orderpriority"), " ", key % 7).alias("name"), F.col("o_orderstatus").alias("category"), (key % 5).alias("self_rating"), (key % 11).alias("years_of_experience"))
    work = F.struct(
        key.alias("id"), text("Firm ", F.col("o_orderstatus")).alias("company"), F.when(key % 4 == 0, "Math tutor").otherwise("Engineer").alias("job_title"), F.col("o_orderdate").alias("start_date"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("end_date"), F.when(key % 8 == 0, "teaching").otherwise("Tutors pupils").alias("description"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("achievements"),
    )
    outcomes = F.array(text("Saved ", key % 100, " hours"), F.lit("Built it"), text("Ran ", F.col("o_orderpriority")), F.lit("built IT"), F.lit("Tracked orders"))
    project = F.struct(
        key.alias("id"), text("Workflow ", key % 3).alias("title"), F.lit("d").alias("description"), F.array(F.lit("SQL"), F.lit("sql"), F.lit("Go")).alias("technologies"), outcomes.alias("outcomes"),
        text("https://host/", key % 2).alias("github_url"), none.alias("portfolio_url"),
    )
    lists = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        *(F.array_sort(F.collect_list(x)).alias(n) for n, x in (("skills", skill), ("work", work), ("projects", project))),
        F.collect_list(F.when(F.col("o_totalprice") > 250_000, key.cast("string"))).alias("relevant"),
    )
    n = F.col("c_custkey")
    role = F.element_at(F.array(*map(F.lit, ("legal_ai", "machine_learning", "ai_automation", "backend_python", "general"))), (n % 5 + 1).cast("int"))
    certificate = F.struct(n.alias("id"), F.when(n % 2 == 0, "Google Cloud ML").otherwise("Other").alias("name"), F.lit("A / B").alias("issuing_organization"), none.alias("credential_id"), none.alias("credential_url"))
    matched = F.array(F.lit("1-urgent 3"), F.lit("Python"), F.lit("5-LOW 2"), F.lit("FastAPI"), F.lit("python"))
    rows = table(spark, d, "customer").join(lists, "c_custkey").select("*", role.alias("role"), F.array(certificate).alias("certificates"), matched.alias("matched"))
    chosen = drafts.projects_section(F.col("projects"), F.col("relevant"))
    return rows.withColumns({
        "skill_list": drafts.skills_section(F.col("skills"), F.col("matched")), "work_list": drafts.experience_section(F.col("work"), F.col("relevant"), n % 3 == 0), "chosen": chosen,
        "certificate": drafts.certifications_section(F.col("certificates"))[0],
    })


def draft_sections(spark, d):
    rows, first = _draft_rows(spark, d), F.get("chosen", F.lit(0))
    entry = drafts.project_entry(F.get(F.filter("projects", lambda p: F.array_contains(F.col("relevant"), p["id"].cast("string"))), F.lit(0)), F.array(F.lit("urgent"), F.lit("Hours")), F.lit(1), drafts.selection_reason(F.col("matched")), F.array(F.lit("https://HOST/1/")))
    rows = rows.withColumn("entry", F.when(first.isNotNull(), entry))
    return rows.select(
        "c_custkey", F.array_join(F.transform("skill_list", lambda x: F.concat(x["source_id"], F.lit("/"), x["name"])), ",").alias("skills"),
        F.array_join(F.transform("work_list", lambda x: F.concat_ws("/", x["source_id"], x["start_date"], x["end_date"], x["description"], F.array_join(x["achievements"], "+"), x["is_additional"].cast("string"))), ",").alias("work"),
        F.array_join(F.transform("chosen", lambda x: x["source_id"]), ",").alias("projects"), F.array_join("entry.technologies", "+").alias("technologies"), F.array_join("entry.outcomes", "|").alias("outcomes"),
        F.col("entry.github_url").alias("link"), F.col("entry.selection_reason").alias("reason"), F.col("certificate.issuing_organization").alias("issuer"),
        F.array_join(drafts.section_order(experience=F.size("work_list") > 0, projects=F.size("chosen") > 0, education=F.lit(False), certifications=F.lit(True)), ",").alias("sections"),
        drafts.summary(F.lit(""), F.lit("Senior Engineer"), F.transform("chosen", lambda x: x["title"]), F.col("matched"), F.col("certificates"), F.col("role")).alias("summary"),
    )


def claim_manifest(spark, d):
    """Claims of those drafts: two skills of each candidate, a technology of a project and a skill that nothing backs."""
    rows = _draft_rows(spark, d)
    n = F.col("c_custkey")
    candidate = {"id": n, "headline": F.when(n % 2 == 0, F.col("c_mktsegment")), "summary": F.lit(""), "location": F.lit(None).cast("string"), "skills": F.col("skills"), "projects": F.col("projects")}
    named = F.transform(F.slice("skill_list", 1, 2), lambda s: F.upper(s["name"]))
    groups = F.array(F.struct(F.lit("A").alias("category"), named.alias("skills")), F.struct(F.lit("B").alias("category"), F.array(F.lit("go"), F.lit("COBOL")).alias("skills")))
    sections = {"experience": F.col("work_list"), "project": F.col("chosen"), "certification": F.array("certificate")}
    claims = drafts.claim_manifest(candidate, F.col("c_name"), F.col("matched"), F.slice(F.array_sort("relevant"), 1, 1), F.array().cast("array<string>"), groups, sections)
    found = rows.select("c_custkey", F.posexplode(claims).alias("position", "claim"))
    return found.select("c_custkey", F.col("position").cast("bigint").alias("position"), "claim.claim_type", "claim.text", F.array_join("claim.evidence_ids", ",").alias("evidence_ids"))


def part_subsets(spark, d):
    words, more = F.split("p_name", " "), F.split(F.concat_ws(" ", "p_type", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.lit("red bolt"))), " ")
    return table(spark, d, "part").select("p_partkey", relational.is_subset(words, more).alias("subset"))


def redact_values(spark, d):
    """Nested values: a text, a list and a map with a secret key."""
    text_of = F.col("text")
    value = F.struct(text_of.alias("body"), F.array(text_of, F.lit("Bearer abcdef")).alias("items"), F.create_map(F.lit("api_key"), text_of, F.lit("note"), text_of).alias("fields"), F.length(text_of).alias("password"))
    rows = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", value.alias("value"))
    rows = rows.select("doc_id", text.redact_nested(F.col("value"), rows.schema["value"].dataType).alias("v"))
    hashed = lambda c: text.content_hash(c)
    return rows.select(
        "doc_id", hashed(F.col("v.body")).alias("body"), hashed(F.array_join("v.items", "|")).alias("items"), F.element_at("v.fields", "api_key").alias("api_key"), hashed(F.element_at("v.fields", "note")).alias("note"),
        F.col("v.password").isNull().alias("hidden"),
    )


def short_texts(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", drafting.two_sentences(F.col("text")).alias("short"))


def date_spans(spark, d):
    open_ = F.col("o_orderstatus") == "O"
    return table(spark, d, "orders").select("o_orderkey", drafting.date_span(F.col("o_orderdate"), F.date_add("o_orderdate", 100), open_).alias("span"))


def stage_completion(spark, d):
    """Lines as stages of an order: the last one of a name is completed."""
    stage = F.struct(F.col("l_returnflag").alias("stage"), F.col("l_linestatus").alias("status"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("finished_at"))
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", stage.alias("s")))), lambda x: x["s"]).alias("stages"))
    done = drafting.complete_last(F.col("stages"), "R", F.lit("today"))
    return lists.select("l_orderkey", F.array_join(F.transform(done, lambda x: F.concat_ws("/", x["stage"], x["status"], x["finished_at"])), ",").alias("stages"))


def cited_skills(spark, d):
    """Drafted skills of suppliers' parts, against the skills and projects of their owner."""
    part, owner = table(spark, d, "part"), F.floor(F.col("p_partkey") / 10).cast("bigint").alias("owner")
    words = F.split("p_name", " ")
    drafted = part.select(owner, F.upper(F.get(words, F.lit(1))).alias("name")).distinct()
    owned = part.filter("p_size % 3 = 0").select(owner, F.col("p_partkey").cast("string").alias("id"), F.get(words, F.lit(1)).alias("name"), F.col("p_partkey").alias("position"))
    projects = part.filter("p_size % 2 = 0").select(owner, F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("position"), F.col("p_type").alias("title"), words.alias("technologies"))
    claims = drafting.skill_claims(drafted, owned, projects, "owner")
    return claims.select("owner", "claim_type", "text", F.array_join("evidence_ids", ",").alias("evidence_ids"))


#: Skills as parts: terms of all groups, and names that belong to none.
SKILL_NAMES = tuple(t for terms in drafting.SKILL_GROUPS.values() for t in terms[:5]) + ("Fast API", "gardening", "Advanced Python", "Git")


def skill_groups(spark, d):
    """Twenty-four parts are the skills of an owner; roles go round."""
    k = F.col("p_partkey")
    owner = F.floor(k / 24).cast("bigint").alias("owner")
    name = F.element_at(F.array(*map(F.lit, SKILL_NAMES)), (k * 7 % len(SKILL_NAMES) + 1).cast("int")).alias("name")
    role = F.element_at(F.array(*map(F.lit, drafting.ROLE_GROUPS)), (F.floor(k / 24) % len(drafting.ROLE_GROUPS) + 1).cast("int")).alias("role")
    skills = table(spark, d, "part").select(owner, role, name, F.col("p_brand").alias("category"), (F.col("p_size") % 2 == 0).alias("matched"), (F.col("p_size") % 3 == 0).alias("in_project"))
    return drafting.grouped_skills(skills, "owner").select("owner", F.col("group_no").cast("bigint").alias("group_no"), "category", F.array_join("skills", ",").alias("skills"))


class LetterCounts:
    """A service for the query below: three counts of each text, answered from the last to the first."""

    def embed(self, texts: list[str]) -> embedding.Response:
        items = [embedding.Item(i, (len(t), t.count(" "), t.count("e"))) for i, t in enumerate(texts)]
        return embedding.Response(items[::-1], sum(map(len, texts)))


def batched_embeddings(spark, d):
    embed = embedding.Embedder(LetterCounts, dimensions=3, batch_rows=32, batch_chars=100_000)
    rows = embed(table(spark, d, "documents").select("doc_id", "text"))
    return rows.select("doc_id", *(F.col("embedding")[i].alias(n) for i, n in enumerate(("chars", "blanks", "es"))))


QUERIES = {
    f.__name__: f
    for f in (
        page_fields, page_platform, run_lifecycle, run_read_model, corpus_ids, corpus_cases, nested_create, nested_update, nested_read, batched_embeddings, draft_sections, claim_manifest, part_subsets, redact_values, short_texts, date_spans, stage_completion,
        cited_skills, skill_groups,
    )
}


def _inner_sql(value: str) -> str:
    breaks = "|".join((*markup.BLOCKS, "br", "li", "dt", "dd", "tr"))
    lines = rf"regexp_replace(regexp_replace({value}, '\s+', ' ', 'g'), '</?(?:{breaks})(?:\s[^>]*)?/?>', chr(10), 'gi')"
    plain = _entities_sql(f"regexp_replace({lines}, '<[/!?a-zA-Z][^>]*>', '', 'g')")
    return rf"nullif(trim(regexp_replace(regexp_replace({plain}, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)), '')"


def _said(column: str, pairs) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({column}), '{a}') THEN '{b}'" for a, b in pairs) + " END"


def _any(column: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({column}), '{w}') AS INT)" for w in words) + ")"


_VISIBLE = rf"""
        WITH v AS (
            SELECT page_id, url, html, trim(regexp_replace(regexp_replace({_entities_sql("regexp_replace(x, '<[^>]*>', ' ', 'g')")}, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), ' ' || chr(10)) AS body,
                   coalesce(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), '') AS page_title, lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) AS path
            FROM (SELECT *, regexp_replace(regexp_replace(html, '{_DROPPED}', ' ', 'gis'), '<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>', chr(10), 'gi') AS x FROM pages)
        ), gated AS (
            SELECT *, CASE WHEN {_any("body", pages.LOGIN_MARKERS)} >= 2 OR contains(lower(page_title), '{pages.LOGIN_TITLE}') OR {_any("path", pages.LOGIN_PATHS)} > 0 THEN 'login'
                           WHEN {_any("body", pages.BLOCK_MARKERS)} > 0 THEN 'blocked' END AS gate
            FROM v
        )"""
_PAYLOAD_SQL = """
            SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_name, CAST(c_acctbal AS DOUBLE) AS c_acctbal, open, urgent, large
            FROM customer LEFT JOIN (
                SELECT o_custkey, list({{'k': o_orderkey, 'p': CAST(o_totalprice AS DOUBLE)}} ORDER BY o_orderkey) FILTER (o_orderstatus = 'O') AS open,
                       list({{'k': o_orderkey, 'p': CAST(o_totalprice AS DOUBLE)}} ORDER BY o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS urgent,
                       list({{'k': o_orderkey, 'p': CAST(o_totalprice AS DOUBLE)}} ORDER BY o_orderkey) FILTER (o_totalprice > 250000) AS large
                FROM orders WHERE o_orderkey >= {0} GROUP BY 1
            ) ON o_custkey = c_custkey"""
_LISTS = """
        WITH held AS (SELECT c_custkey, c_nationkey, c_name, c_acctbal, coalesce(open, []) AS open, coalesce(urgent, []) AS urgent, coalesce(large, []) AS large FROM ({0})),
        sent AS (
            SELECT c_custkey AS key, upper(c_name) AS name, c_acctbal + 1 AS balance,
                   CASE WHEN o_custkey IS NOT NULL AND c_custkey % 3 <> 0 THEN coalesce(open, []) END AS new_open,
                   CASE WHEN o_custkey IS NULL THEN NULL WHEN c_custkey % 4 = 0 THEN [] ELSE coalesce(urgent, []) END AS new_urgent
            FROM ({1}) WHERE c_custkey % 11 <> 0
        )"""
_HELD = _PAYLOAD_SQL.format(0)
_SENT = _PAYLOAD_SQL.format(1000).replace("SELECT c_custkey,", "SELECT c_custkey, o_custkey,", 1)
_UPDATED = _LISTS.format(_HELD, _SENT)


def _uuid5_sql(name: str) -> str:
    h = f"sha1(from_hex('{NAMESPACE.hex}') || encode({name}))"
    variant = f"translate({h}[17:17], '0123456789abcdef', '89ab89ab89ab89ab')"
    return f"{h}[1:8] || '-' || {h}[9:12] || '-5' || {h}[14:16] || '-' || {variant} || {h}[18:20] || '-' || {h}[21:32]"


def _listed_sql(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _project_text_sql(value: str) -> str:
    low = f"lower({value})"
    for old, new in text.PROJECT_REPLACEMENTS:
        low = f"replace({low}, '{old}', '{new}')"
    return f"trim(regexp_replace({low}, '[^a-z0-9+#.]+', ' ', 'g'))"


def _group_sql() -> str:
    """The first group of a skill's role that it fits."""

    def fits(group: str) -> str:
        hits = [f"k IN ({_listed_sql(drafting.EXACT_TERMS[t])})" if t in drafting.EXACT_TERMS else f"contains(k, '{t}') OR contains('{t}', k)" for t in drafting.SKILL_GROUPS[group]]
        return f"k <> {_project_text_sql(repr(group))} AND ({' OR '.join(hits)})"

    cases = " ".join(f"WHEN role = '{n}' AND {fits(g)} THEN {i}" for n, groups in drafting.ROLE_GROUPS.items() for i, g in enumerate(groups))
    return f"CASE {cases} END"


_KIND = "CASE source WHEN 'src0' THEN 'project' WHEN 'src1' THEN 'skill' ELSE 'experience' END"
_KEYED = f"""(SELECT doc_id, {_KIND} || ':' || {_KIND} || ' no. ' || doc_id || ' of ' || coalesce(lang, '?') AS key FROM documents)"""
_STEP = "list_position([{0}], e.event)".format(", ".join(f"'{e}'" for e in runs.EVENTS))
_MOVES = "CASE s.status || '/' || e.event " + " ".join(f"WHEN '{a}/{b}' THEN '{c}'" for (a, b), c in runs.MOVES.items()) + " END"

ORACLE_SQL = {
    "page_fields": _VISIBLE + rf""",
        a AS (SELECT page_id, gate, body, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS art, html FROM gated),
        f AS (
            SELECT page_id, gate, body, {_inner_sql("regexp_extract(art, '<h1>(.*?)</h1>', 1, 's')")} AS t, {_inner_sql("regexp_extract(html, '<footer>(.*?)</footer>', 1, 's')")} AS c,
                   {_inner_sql("""regexp_extract(html, '<div class="ad">(.*?)</div>', 1, 's')""")} AS l, coalesce({_inner_sql("art")}, body) AS x FROM a
        ), r AS (SELECT *, t IS NOT NULL AND c IS NOT NULL AND length(x) >= 80 AND gate IS NULL AS ready FROM f)
        SELECT page_id, CASE WHEN ready THEN 'success' ELSE 'extraction_failure' END AS outcome, CASE WHEN ready THEN t END AS raw_title, CASE WHEN ready THEN c END AS company_name,
               CASE WHEN ready THEN l END AS location, CASE WHEN ready THEN {_said("body", pages.EMPLOYMENT)} END AS employment_type, CASE WHEN ready THEN {_said("body", pages.WORKPLACE)} END AS workplace_type,
               CASE WHEN ready THEN CASE WHEN l IS NULL THEN 0.9::DOUBLE ELSE 1::DOUBLE END ELSE 0::DOUBLE END AS confidence, sha256(CASE WHEN ready THEN x ELSE '' END) AS description,
               concat_ws('|', CASE gate WHEN 'login' THEN '{markup.WARNINGS["login"]}' WHEN 'blocked' THEN '{markup.WARNINGS["blocked"]}' END,
                         CASE WHEN gate IS NULL AND t IS NULL THEN '{markup.WARNINGS["title"]}' END, CASE WHEN gate IS NULL AND c IS NULL THEN '{markup.WARNINGS["company"]}' END,
                         CASE WHEN gate IS NULL AND length(x) < 80 THEN '{markup.WARNINGS["description"]}' END, CASE WHEN NOT ready THEN '{markup.MANUAL}' END) AS warnings
        FROM r""",
    "page_platform": _VISIBLE + f""",
        h AS (SELECT *, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM gated)
        SELECT page_id, CASE {" ".join(f"WHEN host = '{a}' OR ends_with(host, '.{a}') THEN '{b}'" for a, b in pages.PLATFORMS)} ELSE 'unknown' END AS platform, gate, url AS job_url FROM h""",
    "run_lifecycle": f"""
        WITH RECURSIVE mapped AS (
            SELECT user_id * 100 + month(ts) AS run_id, event_id AS id, ts AS moment, 'stage-' || event_id % 3 AS stage, props AS message,
                   CASE WHEN value > 95 THEN 'finish' WHEN event_type = 'signup' THEN 'start' WHEN event_type = 'view' THEN 'complete' WHEN event_type = 'click' THEN 'wait'
                        WHEN event_type = 'purchase' THEN 'approve' WHEN value < 30 THEN 'fail' ELSE 'reject' END AS event
            FROM events
        ), e AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY moment, id) AS n FROM mapped),
        s AS (
            SELECT DISTINCT run_id, 0::BIGINT AS n, 'none' AS status, NULL::VARCHAR AS current_stage, 0::BIGINT AS moves, 0::BIGINT AS refused, NULL::BIGINT AS first_refused,
                   NULL::VARCHAR AS failed_stage, NULL::VARCHAR AS message, NULL::TIMESTAMP AS opened, 0::BIGINT AS latency_ms, NULL::BIGINT AS finished_at
            FROM e
            UNION ALL
            SELECT s.run_id, e.n, coalesce(m, s.status), CASE WHEN m IS NOT NULL AND e.event = 'start' THEN e.stage ELSE s.current_stage END, s.moves + CAST(m IS NOT NULL AS BIGINT),
                   s.refused + CAST(m IS NULL AS BIGINT), coalesce(s.first_refused, CASE WHEN m IS NULL THEN e.id END), CASE WHEN m = 'failed' THEN s.current_stage ELSE s.failed_stage END,
                   CASE WHEN m = 'failed' THEN e.message[1:400] ELSE s.message END, CASE WHEN m IS NULL THEN s.opened WHEN e.event = 'start' THEN e.moment WHEN e.event IN ('complete', 'wait', 'fail') THEN NULL ELSE s.opened END,
                   s.latency_ms + CASE WHEN m IS NOT NULL AND e.event IN ('complete', 'wait', 'fail') AND s.opened IS NOT NULL THEN (epoch_us(e.moment) - epoch_us(s.opened)) // 1000 ELSE 0 END,
                   CASE WHEN m IN ('completed', 'rejected', 'failed') THEN epoch_us(e.moment) ELSE s.finished_at END
            FROM s JOIN e ON s.run_id = e.run_id AND e.n = s.n + 1 CROSS JOIN LATERAL (SELECT {_MOVES} AS m) t
        )
        SELECT run_id, status, current_stage, moves, refused, first_refused, failed_stage, message, latency_ms, finished_at
        FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC) AS r FROM s) WHERE r = 1""",
    "run_read_model": """
        WITH l AS (
            SELECT l_orderkey, arg_max(CAST(l_linenumber AS BIGINT), (l_shipdate, l_linenumber, l_quantity)) AS draft_line, arg_max(CAST(l_quantity AS DOUBLE), (l_shipdate, l_linenumber, l_quantity)) AS draft_quantity,
                   string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS documents FROM lineitem GROUP BY 1
        ), e AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS application, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS latency_ms FROM events GROUP BY 1)
        SELECT o_orderkey, o_orderstatus, draft_line, draft_quantity, coalesce(documents, '') AS documents, application, coalesce(n, 0) AS n_stages, latency_ms,
               CASE WHEN o_orderstatus <> 'O' THEN 'not awaiting review' WHEN draft_line IS NULL THEN 'no draft' WHEN application IS NULL THEN 'not grounded' END AS not_reviewable
        FROM orders LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN e ON user_id = o_orderkey""",
    "corpus_ids": f"SELECT doc_id, key, {_uuid5_sql('key')} AS record_id FROM {_KEYED} AS t",
    "corpus_cases": f"""
        WITH k AS (SELECT key, {_uuid5_sql("key")} AS record_id FROM {_KEYED} AS t),
        c AS (SELECT item_id, unnest([0::BIGINT, 1::BIGINT, 2::BIGINT]) AS position FROM benchmark), n AS (SELECT *, 'project:project no. ' || (item_id * 7 + position) || ' of en' AS key FROM c)
        SELECT item_id, position, n.key, record_id FROM n LEFT JOIN k USING (key)""",
    "nested_create": f"""
        WITH p AS ({_HELD}), s AS (
            SELECT 'open' AS section, c_custkey, open AS rows FROM p UNION ALL SELECT 'urgent', c_custkey, urgent FROM p UNION ALL SELECT 'large', c_custkey, large FROM p
        ), r AS (SELECT section, c_custkey, unnest(rows) AS x, unnest(range(len(rows))) AS position FROM s WHERE rows IS NOT NULL)
        SELECT section, {_uuid5_sql("(c_custkey || ':' || section || ':' || position)")} AS id, c_custkey, position, x.k AS o_orderkey, x.p AS price FROM r""",
    "nested_update": _UPDATED + """
        SELECT 'root' AS table, count(*) FILTER (key % 2 = 0 OR key % 3 = 0) AS updated, 0::BIGINT AS deleted, 0::BIGINT AS inserted FROM sent
        UNION ALL SELECT 'open', 0, CAST(coalesce(sum(len(open)), 0) AS BIGINT), CAST(coalesce(sum(len(new_open)), 0) AS BIGINT) FROM held JOIN sent ON key = c_custkey AND new_open IS NOT NULL
        UNION ALL SELECT 'urgent', 0, CAST(coalesce(sum(len(urgent)), 0) AS BIGINT), CAST(coalesce(sum(len(new_urgent)), 0) AS BIGINT) FROM held JOIN sent ON key = c_custkey AND new_urgent IS NOT NULL
        UNION ALL SELECT 'large', 0, 0, 0""",
    "nested_read": _UPDATED + """
        SELECT c_custkey, CASE WHEN key % 2 = 0 THEN name ELSE c_name END AS c_name, CASE WHEN key % 3 = 0 THEN balance ELSE c_acctbal END AS c_acctbal,
               array_to_string(list_transform(coalesce(new_open, open), lambda x: x.k), ',') AS open, array_to_string(list_transform(coalesce(new_urgent, urgent), lambda x: x.k), ',') AS urgent,
               array_to_string(list_transform(large, lambda x: x.k), ',') AS large
        FROM held LEFT JOIN sent ON key = c_custkey""",
    "batched_embeddings": """
        SELECT doc_id, CAST(length(t) AS DOUBLE) AS chars, CAST(length(t) - length(replace(t, ' ', '')) AS DOUBLE) AS blanks, CAST(length(t) - length(replace(t, 'e', '')) AS DOUBLE) AS es
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "draft_sections": f"""
        WITH o AS (SELECT *, o_totalprice > 250000 AS relevant, o_orderpriority || ' ' || o_orderkey % 7 AS skill, o_orderkey % 4 = 0 AS other, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
        g AS (
            SELECT o_custkey AS c_custkey, string_agg(o_orderkey || '/' || skill, ',' ORDER BY lower(skill) NOT IN ('1-urgent 3', '5-low 2'), skill, o_orderkey) AS skills,
                   string_agg(concat_ws('/', o_orderkey, day, CASE WHEN o_orderstatus <> 'O' THEN day END, CASE WHEN NOT other THEN 'Tutors pupils' END,
                              CASE WHEN NOT other THEN 'a+b+c' WHEN o_orderkey % 8 = 0 THEN 'a+b' ELSE '{"+".join(drafts.TUTORING)}' END, other), ',' ORDER BY o_orderkey) FILTER (relevant OR (o_custkey % 3 = 0 AND other)) AS work,
                   string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FILTER (relevant) AS projects, min(o_orderkey) FILTER (relevant) AS first, bool_or(relevant) AS any_project
            FROM o GROUP BY 1
        ), f AS (SELECT g.*, o_orderpriority, c_custkey % 5 AS role FROM g LEFT JOIN orders ON o_orderkey = first),
        b AS (SELECT *, CASE WHEN first IS NOT NULL THEN array_to_string(list_transform(list_sort(list_filter([
                     {{'a': false, 'b': true, 'c': length('Saved ' || first % 100 || ' hours'), 'd': 0, 'v': 'Saved ' || first % 100 || ' hours'}}, {{'a': true, 'b': false, 'c': 8, 'd': 1, 'v': 'Built it'}},
                     {{'a': o_orderpriority <> '1-URGENT', 'b': true, 'c': length('Ran ' || o_orderpriority), 'd': 2, 'v': 'Ran ' || o_orderpriority}}, {{'a': true, 'b': false, 'c': 14, 'd': 3, 'v': 'Tracked orders'}}], lambda x: true))[1:3], lambda x: x.v), '|') END AS outcomes FROM f)
        SELECT c_custkey, skills, coalesce(work, '') AS work, coalesce(projects, '') AS projects, CASE WHEN first IS NOT NULL THEN 'SQL+Go' END AS technologies, outcomes,
               CASE WHEN first % 2 = 0 THEN 'https://host/0' END AS link, CASE WHEN first IS NOT NULL THEN 'Selected because the role asks for 1-urgent 3, Python, 5-LOW 2, FastAPI.' END AS reason, 'A/B' AS issuer,
               concat_ws(',', 'summary', 'skills', CASE WHEN work IS NOT NULL THEN 'experience' END, CASE WHEN projects IS NOT NULL THEN 'projects' END, 'certifications') AS sections,
               'Early-career Engineer with hands-on project experience building ' || CASE role WHEN 0 THEN '{drafts.ROLE_THEMES["legal_ai"]} using FastAPI' WHEN 1 THEN '{drafts.ROLE_THEMES["machine_learning"]} using Python'
               WHEN 2 THEN '{drafts.ROLE_THEMES["ai_automation"]} using 1-urgent 3, Python, 5-LOW 2, FastAPI' WHEN 3 THEN '{drafts.ROLE_THEMES["backend_python"]} using Python, FastAPI'
               ELSE CASE WHEN any_project THEN '{drafts.TITLE_THEMES[1][1]}' ELSE '{drafts.TITLE_THEMES[-1][1]}' END || ' using 1-urgent 3, Python, 5-LOW 2, FastAPI' END || '.'
               || CASE WHEN role < 2 AND c_custkey % 2 = 0 THEN ' {drafts.CLOUD_SENTENCE}' ELSE '' END AS summary
        FROM b""",
    "claim_manifest": f"""
        WITH o AS (SELECT *, o_totalprice > 250000 AS relevant, o_orderpriority || ' ' || o_orderkey % 7 AS skill, o_orderkey % 4 = 0 AS other FROM orders),
        g AS (
            SELECT o_custkey AS k, list({{'id': o_orderkey, 'name': skill}} ORDER BY o_orderkey) AS skills, list({{'id': o_orderkey, 'name': skill}} ORDER BY lower(skill) NOT IN ('1-urgent 3', '5-low 2'), skill, o_orderkey)[1:2] AS shown,
                   max(o_orderkey) AS last_project, min(CAST(o_orderkey AS VARCHAR)) FILTER (relevant) AS first_relevant,
                   list({{'id': o_orderkey, 'said': CASE WHEN other THEN 'Math tutor' ELSE 'Engineer' END}} ORDER BY o_orderkey) FILTER (relevant OR (o_custkey % 3 = 0 AND other)) AS work,
                   list({{'id': o_orderkey, 'said': 'Workflow ' || o_orderkey % 3}} ORDER BY o_orderkey) FILTER (relevant) AS projects
            FROM o GROUP BY 1
        ), c AS (
            SELECT k, c_name, skills, list_concat(CASE WHEN k % 2 = 0 THEN ['profile-' || k || '-summary'] ELSE [] END, list_concat(
                       list_filter(list_transform(['1-urgent 3', '5-low 2'], lambda t: 'skill-' || list_filter(skills, lambda s: lower(s.name) = t)[-1].id), lambda x: x IS NOT NULL),
                       CASE WHEN first_relevant IS NULL THEN [] ELSE ['project-' || first_relevant] END)) AS cited,
                   list_concat(list_transform(shown, lambda x: {{'t': 'skill', 'x': upper(x.name), 'e': 'skill-' || list_filter(skills, lambda s: lower(s.name) = lower(x.name))[-1].id}}),
                       [{{'t': 'skill', 'x': 'go', 'e': 'project-' || last_project}}, {{'t': 'skill', 'x': 'COBOL', 'e': ''}}]) AS named,
                   list_transform(coalesce(work, []), lambda x: {{'t': 'experience', 'x': x.said, 'e': 'experience-' || x.id}}) AS jobs,
                   list_transform(coalesce(projects, []), lambda x: {{'t': 'project', 'x': x.said, 'e': 'project-' || x.id}}) AS works
            FROM g JOIN customer ON c_custkey = k
        ), a AS (
            SELECT k, list_concat(list_concat(list_concat(list_concat([{{'t': 'summary', 'x': c_name, 'e': CASE WHEN len(cited) > 0 THEN array_to_string(cited, ',') ELSE 'skill-' || skills[1].id END}}], named), jobs), works),
                       [{{'t': 'certification', 'x': CASE WHEN k % 2 = 0 THEN 'Google Cloud ML' ELSE 'Other' END, 'e': 'certification-' || k}}]) AS claims FROM c
        ), u AS (SELECT k, unnest(claims) AS c, unnest(range(len(claims))) AS position FROM a)
        SELECT k AS c_custkey, position, c.t AS claim_type, c.x AS text, c.e AS evidence_ids FROM u""",
    "part_subsets": """
        SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda w: NOT list_contains(string_split(p_type || ' ' || CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'red bolt' END, ' '), w))) = 0 AS subset FROM part""",
    "redact_values": f"""
        WITH r AS (SELECT doc_id, {_redact_sql("text")} AS t, {_redact_sql("'Bearer abcdef'")} AS b FROM documents)
        SELECT doc_id, sha256(t) AS body, sha256(t || '|' || b) AS items, '[REDACTED]' AS api_key, sha256(t) AS note, true AS hidden FROM r""",
    "short_texts": """
        WITH p AS (SELECT conv_id, turn, text, list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: x <> '') AS a FROM conversations)
        SELECT conv_id, turn, CASE WHEN len(a) = 0 THEN trim(text) ELSE array_to_string(a[1:2], '. ') || '.' END AS short FROM p""",
    "date_spans": """
        SELECT o_orderkey, strftime(o_orderdate, '%b %Y') || ' - ' || CASE WHEN o_orderstatus = 'O' THEN 'Present' ELSE strftime(CAST(o_orderdate AS DATE) + 100, '%b %Y') END AS span FROM orders""",
    "stage_completion": """
        WITH s AS (SELECT l_orderkey, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d') AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus, l_shipdate) AS n FROM lineitem),
        m AS (SELECT l_orderkey, max(n) FILTER (l_returnflag = 'R') AS last FROM s GROUP BY 1)
        SELECT l_orderkey, string_agg(l_returnflag || '/' || CASE WHEN n = last THEN 'completed/today' ELSE l_linestatus || '/' || f END, ',' ORDER BY n) AS stages FROM s JOIN m USING (l_orderkey) GROUP BY 1""",
    "cited_skills": """
        WITH p AS (SELECT *, p_partkey // 10 AS owner, string_split(p_name, ' ') AS w FROM part), d AS (SELECT DISTINCT owner, upper(w[2]) AS text FROM p),
        o AS (SELECT owner, lower(w[2]) AS k, 'skill-' || max(p_partkey) AS skill FROM p WHERE p_size % 3 = 0 GROUP BY 1, 2),
        t AS (SELECT owner, p_partkey, unnest([p_type, w[1], w[2]]) AS term FROM p WHERE p_size % 2 = 0), j AS (SELECT owner, lower(term) AS k, 'project-' || max(p_partkey) AS project FROM t GROUP BY 1, 2)
        SELECT d.owner, 'skill' AS claim_type, text, coalesce(skill, project, '') AS evidence_ids FROM d LEFT JOIN o ON o.owner = d.owner AND o.k = lower(text) LEFT JOIN j ON j.owner = d.owner AND j.k = lower(text)""",
    "skill_groups": f"""
        WITH s AS (
            SELECT p_partkey // 24 AS owner, [{_listed_sql(SKILL_NAMES)}][CAST(p_partkey * 7 % {len(SKILL_NAMES)} + 1 AS INT)] AS name, [{_listed_sql(drafting.ROLE_GROUPS)}][CAST(p_partkey // 24 % {len(drafting.ROLE_GROUPS)} + 1 AS INT)] AS role,
                   p_brand AS category, p_size % 2 = 0 AS matched, p_size % 3 = 0 AS in_project FROM part
        ), k AS (SELECT *, {_project_text_sql("name")} AS k FROM s), g AS (SELECT *, {_group_sql()} AS g FROM k WHERE k <> ''),
        u AS (SELECT * FROM g WHERE g IS NOT NULL QUALIFY row_number() OVER (PARTITION BY owner, k ORDER BY matched DESC, in_project DESC, lower(category), lower(name), name) = 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY g, matched DESC, in_project DESC, lower(category), lower(name), name) AS n FROM u),
        a AS (SELECT owner, role, g, string_agg(name, ',' ORDER BY n) AS skills FROM r WHERE n <= {drafting.MAX_SKILLS} GROUP BY 1, 2, 3)
        SELECT owner, CAST(g AS BIGINT) AS group_no, CASE role {" ".join(f"WHEN '{n}' THEN [{_listed_sql(v)}]" for n, v in drafting.ROLE_GROUPS.items())} END[g + 1] AS category, skills
        FROM a QUALIFY row_number() OVER (PARTITION BY owner ORDER BY g) <= {drafting.MAX_GROUPS}""",
}
