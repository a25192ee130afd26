"""Matching, scorecard, grounding and incremental queries; clocks are fixed dates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidentia.functions import scores, text
from evidentia.operators import matching as M
from evidentia.operators import scorecard as C
from evidentia.operators.retrieval import spread
from evidentia.plans.common import fixture, percent_sql, scorecard_text_sql, table, tokens_sql, values
from evidentia.streaming import sync

AS_OF = "2024-02-15"
TERMS = ["The", "and", "of thth", "que", "der", "las", "zzz missing", "THE"]
REQUIREMENTS = [
    (1, "2+ years of experience"), (2, "0-2 years"), (3, "At least 0.05 years"), (4, "0.01 to 0.05 years"), (5, "no number"), (6, "10 – 12 years"),
]
NAMED = [
    (1, "Amazon Web Services and K8s"), (2, "Continuous integration"), (3, "AWS"), (4, "Git"), (5, "kubernetes, AWS, CI/CD"),
]
OWNED = [(1, "Deployed on Amazon EC2 with Docker"), (2, "Set up continuous delivery"), (3, "githubs and awsome tools"), (4, "Used K8s daily")]
PRICES = [("click", 0.5), ("view", 0.02), ("purchase", 2.0)]


def _statuses(spark, d):
    """(doc_id, lang, priority, status): a deterministic stand-in for matched requirements."""
    status = F.element_at(F.array(*map(F.lit, ("matched", "partially_matched", "not_evidenced", "not_applicable"))), (F.col("n_chars") % 4 + 1).cast("int"))
    priority = F.element_at(F.array(*map(F.lit, ("required", "preferred", "context"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", "lang", "source", priority.alias("priority"), status.alias("status"))


def _intervals(spark, d):
    start = F.to_date("ts")
    end = F.date_add(start, F.floor("value").cast("int"))
    return table(spark, d, "events").select("user_id", start.alias("start_date"), F.when(F.col("event_id") % 7 == 0, None).otherwise(end).alias("end_date"))


def coverage_score(spark, d):
    return M.coverage(_statuses(spark, d), ["source"])


def status_rollup(spark, d):
    rows = _statuses(spark, d)
    return rows.groupingSets([[], [rows.lang], [rows.lang, rows.priority]], "lang", "priority").agg(F.count("*").alias("requirements"), F.count_if(F.col("status") == "matched").alias("matched"))


def tenure_merged(spark, d):
    return M.merged_tenure(_intervals(spark, d), "user_id", AS_OF).select("user_id", "islands", "days", "years")


def tenure_summed(spark, d):
    return M.summed_tenure(_intervals(spark, d), "user_id", AS_OF)


def experience_status(spark, d):
    asked = F.array(*(F.struct(F.lit(i).cast("bigint").alias("requirement_id"), F.lit(r).alias("requirement")) for i, r in REQUIREMENTS))
    pairs = tenure_merged(spark, d).select("user_id", "years", F.inline(asked))
    least, most = M.year_range(F.col("requirement"))
    pairs = pairs.withColumns({"least": least, "most": most})
    status = M.experience_status(F.col("years"), F.col("least"), F.col("most"), F.lit(True))
    return pairs.select("user_id", "requirement_id", status.alias("status"))


def explicit_phrase_status(spark, d):
    tokens = text.retrieval_tokens(F.col("body"))
    asked = fixture(spark, NAMED, "requirement_id bigint, body string").select("requirement_id", tokens.alias("tokens"))
    owned = fixture(spark, OWNED, "evidence_id bigint, body string").select("evidence_id", tokens.alias("tokens"))
    return M.explicit_status(asked, owned)


def phrase_documents(spark, d):
    rules = {"of_the": ("of the",), "que_de": ("que de", "de que"), "der_die": ("der die", "die der")}
    tokens = text.retrieval_tokens(F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", tokens.alias("tokens"))
    return rows.select("doc_id", *(M.names_rule(F.col("tokens"), a).alias(n) for n, a in rules.items()))


def explicit_documents(spark, d):
    """Items that name a rule, against all documents."""
    rules = {"of_the": ("of the",), "que_de": ("que de", "de que"), "der_die": ("der die", "die der"), "none": ("zzz zzz",)}
    tokens = text.retrieval_tokens(F.col("text"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("requirement_id"), tokens.alias("tokens"))
    return M.explicit_status(asked, table(spark, d, "documents").select(tokens.alias("tokens")), rules)


def any_logic_best_alternative(spark, d):
    rows = _statuses(spark, d).select((F.col("doc_id") % 100).alias("group_id"), F.col("doc_id").alias("position"), "status", (F.length("source") / 8).alias("best_lexical"))
    return M.best_alternative(rows).select("group_id", "position", "status")


def term_coverage(spark, d):
    return C.term_coverage(spread(table(spark, d, "documents").select("source", "text")), "source", TERMS, "text")


def scorecard(spark, d):
    cover = term_coverage(spark, d).select("source", F.col("score").alias("kw"), "missing")
    years = F.lit(40.0)
    parts = {"keyword": F.col("kw"), "skill": F.col("kw"), "technology": F.lit(50.0), "experience": years, "project": F.lit(50.0), "education": F.lit(100.0)}
    rows = cover.withColumn("overall", C.scorecard(parts, F.col("missing")))
    return rows.select("source", "overall", scores.band(F.col("overall")).alias("quality"))


def strongest_evidence(spark, d):
    rows = C.supported_terms(table(spark, d, "documents"), TERMS, "text").withColumn("label", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")))
    best = C.strongest(rows, "source", "label", (F.col("doc_id") % 5).cast("int"))
    return best.select("source", "position", "label", "strength")


def project_topk(spark, d):
    body = text.project_text(F.concat_ws(" ", "p_name", "p_type"))
    weighted = [("steel", 14), ("brass", 12), ("large", 8), ("brushed", 7), ("economy", 5), ("Steel", 4)]
    rows = table(spark, d, "part").withColumn("_b", body)
    rows = rows.withColumn("score", (C.weighted_terms_score(F.col("_b"), weighted) + C.title_overlap("large plated part", F.col("_b"))).cast("bigint"))
    order = Window.partitionBy("p_brand").orderBy(F.desc("score"), F.lower("p_name"), "p_partkey")
    return rows.withColumn("rank", F.row_number().over(order).cast("bigint")).filter("rank <= 3").select("p_brand", "rank", "p_partkey", "score")


def _claims(spark, d):
    cited = F.when(F.col("l_quantity") > 5, F.col("l_partkey"))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.collect_set(cited).alias("evidence_ids"))


def grounding_check(spark, d):
    valid = table(spark, d, "part").filter("p_size <= 45").select(F.col("p_partkey").alias("evidence_id"))
    return C.grounding(_claims(spark, d), valid)


def grounding_summary(spark, d):
    owner = table(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("owner_id"))
    rows = C.grounding_summary(grounding_check(spark, d).join(owner, "claim_id"), ["owner_id"])
    return rows.select("owner_id", "checked_claims", "cited_claims", "citation_coverage", "valid", "recoverable")


def incremental_sync(spark, d):
    now = table(spark, d, "documents").filter("doc_id % 11 != 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" v2"))).otherwise(F.col("text")))
    held = table(spark, d, "documents").filter("doc_id % 13 != 0").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))
    return sync.plan_sync(now, held, "doc_id", "text").select(F.col("id").alias("doc_id"), "action", "content_hash")


def usage_rollup(spark, d):
    tokens = F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0))
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"))


def cost_estimate(spark, d):
    prices = fixture(spark, PRICES, "event_type string, price double")
    rows = usage_rollup(spark, d).join(F.broadcast(prices), "event_type", "left")
    return rows.select("event_type", F.round(F.col("price") * F.col("tokens") / 1_000_000, 8).alias("cost"))


def usage_by_day(spark, d):
    rows = table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "calls", "total")


def budgeted_prefix(spark, d):
    """Files of a source in order of id, at most 4,000 characters of each and 60,000 in all; the last is cut.

    Sizes are summed by range of ids first; only ranges that begin within the budget are ordered, each by itself."""
    rows = table(spark, d, "documents").select("source", "doc_id", F.least(F.col("n_chars"), F.lit(4000)).alias("size"), F.floor(F.col("doc_id") / 10_000).alias("range"))
    along = Window.partitionBy("source").orderBy("range")
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("s")).withColumn("before", F.sum("s").over(along) - F.col("s")).filter("before < 60000").drop("s")
    order = Window.partitionBy("source", "range").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(sums, ["source", "range"]).withColumn("_before", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    return placed.withColumn("taken", F.least("size", F.lit(60000) - F.col("_before"))).filter("taken > 0").select("source", "doc_id", F.col("taken").cast("bigint").alias("taken"))


QUERIES = {
    f.__name__: f
    for f in (
        coverage_score, status_rollup, tenure_merged, tenure_summed, experience_status, explicit_phrase_status, explicit_documents, phrase_documents, any_logic_best_alternative,
        term_coverage, scorecard, strongest_evidence, project_topk, grounding_check, grounding_summary, incremental_sync, usage_rollup, cost_estimate,
        usage_by_day, budgeted_prefix,
    )
}

_STATUS = """
        WITH s AS (SELECT doc_id, lang, source, ['matched', 'partially_matched', 'not_evidenced', 'not_applicable'][CAST(n_chars % 4 + 1 AS INT)] AS status,
                          ['required', 'preferred', 'context'][CAST(doc_id % 3 + 1 AS INT)] AS priority FROM documents)"""
_INTERVALS = f"""
        WITH i AS (SELECT user_id, CAST(ts AS DATE) AS s, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(ts AS DATE) + CAST(floor(value) AS INT) END AS e FROM events),
        c AS (SELECT user_id, s, least(coalesce(e, DATE '{AS_OF}'), DATE '{AS_OF}') AS e FROM i WHERE s <= DATE '{AS_OF}'),
        r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c WHERE e >= s),
        g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r),
        spans AS (SELECT user_id, island, max(e) - min(s) AS days FROM g GROUP BY ALL),
        t AS (SELECT user_id, count(*) AS islands, CAST(sum(days) AS BIGINT) AS days,
                     CAST(round(CAST(sum(days) / 365.2425::DOUBLE AS DECIMAL(28,12)), 2) AS DOUBLE) AS years FROM spans GROUP BY 1)"""
_UNIQUE_TERMS = C._unique(TERMS)
_SUPPORTED = f"""list_filter([{", ".join(f"CASE WHEN contains({scorecard_text_sql('text')}, '{t.lower()}') THEN '{t}' END" for t in _UNIQUE_TERMS)}], lambda x: x IS NOT NULL)"""
_COVERAGE = f"""
        found AS (SELECT source, unnest({_SUPPORTED}) AS term FROM documents),
        cover AS (SELECT s.source, count(DISTINCT term) AS matched, CAST({len(_UNIQUE_TERMS)} - count(DISTINCT term) AS BIGINT) AS missing
                  FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN found USING (source) GROUP BY 1),
        scored AS (SELECT *, {percent_sql("matched", "(matched + missing)", "50")} AS score FROM cover)"""
_GROUNDING = """
        WITH claims AS (SELECT l_orderkey AS claim_id, list_filter(list(DISTINCT CASE WHEN l_quantity > 5 THEN l_partkey END), lambda x: x IS NOT NULL) AS ids FROM lineitem GROUP BY 1),
        u AS (SELECT claim_id, unnest(ids) AS evidence_id FROM claims),
        k AS (SELECT claim_id, count(*) AS cited, count(*) FILTER (p_partkey IS NULL) AS unknown
              FROM u LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 45) ON p_partkey = evidence_id GROUP BY 1),
        g AS (SELECT claim_id, coalesce(cited, 0) AS cited, coalesce(unknown, 0) AS unknown,
                     CASE WHEN coalesce(cited, 0) = 0 THEN 'no evidence citation' WHEN unknown > 0 THEN 'unknown evidence' END AS reason FROM claims LEFT JOIN k USING (claim_id))"""


def _phrase_sql(tokens: str, aliases) -> str:
    return "(" + " OR ".join(f"contains(' ' || array_to_string({tokens}, ' ') || ' ', ' {a} ')" for a in aliases) + ")"


_RULES = list(M.EXPLICIT_RULES.values())
ORACLE_SQL = {
    "coverage_score": _STATUS + f""",
        w AS (SELECT source, status, CASE WHEN priority = 'context' OR status = 'not_applicable' THEN 0 WHEN priority = 'required' THEN 2 ELSE 1 END AS weight,
                     CASE status WHEN 'matched' THEN 1.0::DOUBLE WHEN 'partially_matched' THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS v FROM s),
        a AS (SELECT source, sum(weight * v) AS earned_weight, CAST(sum(weight) AS BIGINT) AS possible_weight, count(*) FILTER (status = 'matched') AS matched_count,
                     count(*) FILTER (status = 'partially_matched') AS partially_matched_count, count(*) FILTER (status = 'not_evidenced') AS not_evidenced_count,
                     count(*) FILTER (status = 'not_applicable') AS not_applicable_count FROM w GROUP BY 1)
        SELECT *, {percent_sql("earned_weight", "possible_weight", "0")} AS score FROM a""",
    "status_rollup": _STATUS + """
        SELECT lang, priority, count(*) AS requirements, count(*) FILTER (status = 'matched') AS matched FROM s GROUP BY GROUPING SETS ((), (lang), (lang, priority))""",
    "tenure_merged": _INTERVALS + " SELECT user_id, islands, days, years FROM t",
    "tenure_summed": f"""
        SELECT user_id, round(sum(greatest(coalesce(CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(ts AS DATE) + CAST(floor(value) AS INT) END, DATE '{AS_OF}')
               - CAST(ts AS DATE), 0)) / 365.25::DOUBLE, 6) AS years FROM events GROUP BY 1""",
    "experience_status": _INTERVALS + f""",
        q AS (SELECT requirement_id, lower(requirement) AS x FROM {values(REQUIREMENTS, "v", "requirement_id, requirement")}),
        n AS (SELECT requirement_id, nullif(regexp_extract(x, '\\b(\\d+(?:\\.\\d+)?)\\s*(?:-|–|—|to)\\s*(\\d+(?:\\.\\d+)?)\\s*years?\\b', 1), '') AS lo,
                     nullif(regexp_extract(x, '\\b(\\d+(?:\\.\\d+)?)\\s*(?:-|–|—|to)\\s*(\\d+(?:\\.\\d+)?)\\s*years?\\b', 2), '') AS hi,
                     nullif(regexp_extract(x, '\\b(\\d+(?:\\.\\d+)?)\\s*\\+?\\s*years?\\b', 1), '') AS only_lo FROM q),
        b AS (SELECT requirement_id, CAST(coalesce(lo, only_lo) AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi FROM n)
        SELECT user_id, requirement_id, CASE WHEN lo IS NULL THEN 'not_applicable' WHEN hi IS NOT NULL AND years > hi THEN 'partially_matched' WHEN years >= lo THEN 'matched'
               WHEN lo > 0 AND years >= lo / 2 THEN 'partially_matched' ELSE 'not_evidenced' END AS status FROM t CROSS JOIN b""",
    "explicit_phrase_status": f"""
        WITH q AS (SELECT requirement_id, {tokens_sql("body")} AS t FROM {values(NAMED, "v", "requirement_id, body")}),
        e AS (SELECT {tokens_sql("body")} AS t FROM {values(OWNED, "w", "evidence_id, body")}),
        m AS (SELECT {", ".join(f"bool_or({_phrase_sql('t', a)}) AS m{i}" for i, a in enumerate(_RULES))} FROM e),
        n AS (SELECT requirement_id, CAST({" + ".join(f"CAST({_phrase_sql('t', a)} AS INT)" for a in _RULES)} AS BIGINT) AS rules_named,
                     CAST({" + ".join(f"CAST({_phrase_sql('t', a)} AND m{i} AS INT)" for i, a in enumerate(_RULES))} AS BIGINT) AS rules_met FROM q, m)
        SELECT *, CASE WHEN rules_met = rules_named THEN 'matched' WHEN rules_met > 0 THEN 'partially_matched' ELSE 'not_evidenced' END AS status
        FROM n WHERE rules_named > 0""",
    "explicit_documents": f"""
        WITH q AS (SELECT item_id AS requirement_id, {tokens_sql("text")} AS t FROM benchmark), e AS (SELECT {tokens_sql("text")} AS t FROM documents),
        m AS (SELECT bool_or({_phrase_sql("t", ("of the",))}) AS m0, bool_or({_phrase_sql("t", ("que de", "de que"))}) AS m1, bool_or({_phrase_sql("t", ("der die", "die der"))}) AS m2 FROM e),
        n AS (SELECT requirement_id, {_phrase_sql("t", ("of the",))} AS n0, {_phrase_sql("t", ("que de", "de que"))} AS n1, {_phrase_sql("t", ("der die", "die der"))} AS n2 FROM q),
        c AS (SELECT requirement_id, CAST(n0 AS BIGINT) + CAST(n1 AS BIGINT) + CAST(n2 AS BIGINT) AS rules_named, CAST(n0 AND m0 AS BIGINT) + CAST(n1 AND m1 AS BIGINT) + CAST(n2 AND m2 AS BIGINT) AS rules_met FROM n, m)
        SELECT *, CASE WHEN rules_met = rules_named THEN 'matched' WHEN rules_met > 0 THEN 'partially_matched' ELSE 'not_evidenced' END AS status FROM c WHERE rules_named > 0""",
    "phrase_documents": f"""
        WITH q AS (SELECT doc_id, {tokens_sql("text")} AS t FROM documents)
        SELECT doc_id, {_phrase_sql("t", ("of the",))} AS of_the, {_phrase_sql("t", ("que de", "de que"))} AS que_de,
               {_phrase_sql("t", ("der die", "die der"))} AS der_die FROM q""",
    "any_logic_best_alternative": _STATUS + """
        SELECT doc_id % 100 AS group_id, doc_id AS position, status FROM s QUALIFY row_number() OVER (PARTITION BY doc_id % 100 ORDER BY
            CASE status WHEN 'matched' THEN 2 WHEN 'partially_matched' THEN 1 WHEN 'not_evidenced' THEN 0 ELSE -1 END DESC, length(source) DESC, doc_id) = 1""",
    "term_coverage": f"WITH {_COVERAGE} SELECT source, matched, missing, score FROM scored",
    "scorecard": f"""
        WITH {_COVERAGE},
        o AS (SELECT source, CAST(round(CAST(least(greatest(CAST((CAST(score AS DECIMAL(10,2)) * 45 + 50.00 * 25 + 40.00 * 15 + 50.00 * 10 + 100.00 * 5) AS DECIMAL(18,4)) / 100
                     - least(20, missing * 4), 0), 100) AS DECIMAL(28,12)), 2) AS DOUBLE) AS overall FROM scored)
        SELECT source, overall, CASE WHEN overall >= 85 THEN 'excellent' WHEN overall >= 70 THEN 'strong' WHEN overall >= 50 THEN 'moderate'
               WHEN overall >= 30 THEN 'weak' ELSE 'limited' END AS quality FROM o""",
    "strongest_evidence": f"""
        WITH r AS (SELECT source, 'Doc ' || doc_id AS label, doc_id % 5 AS k, len({_SUPPORTED}) AS n FROM documents)
        SELECT source, row_number() OVER (PARTITION BY source ORDER BY k + n DESC, lower(label), label) AS position, label, CAST(k + n AS BIGINT) AS strength
        FROM r WHERE n > 0 QUALIFY position <= 5""",
    "project_topk": r"""
        WITH b AS (SELECT p_brand, p_partkey, p_name, trim(regexp_replace(replace(replace(replace(replace(lower(p_name || ' ' || p_type), 'apis', 'api'), 'workflows', 'workflow'),
                          'technologies', 'technology'), 'google cloud ai', 'google cloud'), '[^a-z0-9+#.]+', ' ', 'g')) AS t FROM part),
        s AS (SELECT *, CAST(CASE WHEN contains(t, 'steel') THEN 14 ELSE 0 END + CASE WHEN contains(t, 'brass') THEN 12 ELSE 0 END + CASE WHEN contains(t, 'large') THEN 8 ELSE 0 END
                     + CASE WHEN contains(t, 'brushed') THEN 7 ELSE 0 END + CASE WHEN contains(t, 'economy') THEN 5 ELSE 0 END
                     + 5 * len(list_intersect(['large', 'part', 'plated'], string_split(t, ' '))) AS BIGINT) AS score FROM b)
        SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, lower(p_name), p_partkey) AS rank, p_partkey, score FROM s QUALIFY rank <= 3""",
    "grounding_check": _GROUNDING + " SELECT claim_id, cited, unknown, reason FROM g",
    "grounding_summary": _GROUNDING + f""",
        a AS (SELECT o_custkey AS owner_id, count(*) AS checked_claims, count(*) FILTER (reason IS NULL) AS cited_claims, count(*) FILTER (reason = 'no evidence citation') AS bare
              FROM g JOIN orders ON o_orderkey = claim_id GROUP BY 1)
        SELECT owner_id, checked_claims, cited_claims, {percent_sql("cited_claims", "checked_claims", "0")} AS citation_coverage, checked_claims = cited_claims AS valid,
               checked_claims > cited_claims AND checked_claims - cited_claims = bare AS recoverable FROM a""",
    "incremental_sync": """
        WITH n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || ' v2' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0),
        c AS (SELECT doc_id, sha256(text) AS g FROM documents WHERE doc_id % 13 <> 0)
        SELECT coalesce(n.doc_id, c.doc_id) AS doc_id, CASE WHEN h IS NULL THEN 'stale' WHEN g IS NULL THEN 'new' WHEN g = h THEN 'reused' ELSE 'changed' END AS action,
               coalesce(h, g) AS content_hash FROM n FULL JOIN c ON n.doc_id = c.doc_id""",
    "usage_rollup": "SELECT event_type, count(*) AS calls, CAST(sum(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS tokens FROM events GROUP BY 1",
    "cost_estimate": f"""
        SELECT event_type, round(price * tokens / 1000000, 8) AS cost
        FROM (SELECT event_type, CAST(sum(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS tokens FROM events GROUP BY 1)
        LEFT JOIN (SELECT event_type, CAST(price AS DOUBLE) AS price FROM {values(PRICES, "v", "event_type, price")}) USING (event_type)""",
    "usage_by_day": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS calls, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "budgeted_prefix": """
        SELECT source, doc_id, CAST(least(size, 60000 - before) AS BIGINT) AS taken FROM (
            SELECT source, doc_id, least(n_chars, 4000) AS size, coalesce(sum(least(n_chars, 4000)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM documents) WHERE least(size, 60000 - before) > 0""",
}
