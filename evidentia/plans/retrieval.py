"""Retrieval and evaluation queries: benchmark items are requirements, documents evidence, embeddings semantic vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.functions import scores, text
from evidentia.operators import evaluation as E
from evidentia.operators import matching as M
from evidentia.operators import retrieval as V
from evidentia.plans.common import table, tokens_sql, unit_sql

K = 3


def _evidence(spark, d):
    return V.tokens_of(V.spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", "evidence_id")


def _requirements(spark, d):
    return V.tokens_of(table(spark, d, "benchmark"), "item_id", "text", "query_id")


def lexical_topk(spark, d):
    return V.lexical_topk(_evidence(spark, d), _requirements(spark, d), K)


def hybrid_topk(spark, d):
    return V.rank(_evidence(spark, d), _requirements(spark, d), K)


def hybrid_topk_filtered(spark, d):
    docs = table(spark, d, "documents").filter(F.col("lang").isin("en", "de") & (F.col("source") == "src3"))
    return V.rank(V.tokens_of(V.spread(docs.select("doc_id", "text")), "doc_id", "text", "evidence_id"), _requirements(spark, d), K)


def _vectors(spark, d):
    return table(spark, d, "embeddings").withColumn("vec", F.transform("embedding", lambda x: x.cast("double"))).select("vec_id", "vec", "label")


def _query_vectors(spark, d):
    """The stated search set: every row whose id is divisible by 20."""
    return _vectors(spark, d).filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query"), F.col("label").alias("query_label"))


def vector_topk(spark, d):
    return V.vector_topk(_vectors(spark, d).select("vec_id", "vec"), _query_vectors(spark, d).drop("query_label"), K)


def vector_topk_same_label(spark, d):
    rows, queries = _vectors(spark, d), _query_vectors(spark, d).withColumnRenamed("query_label", "label")
    best = V.vector_topk(rows, queries, 1).select("query_id", F.col("cosine").alias("best"))
    labelled = rows.groupBy("label").agg(F.count("*").alias("n"))
    own = rows.groupBy(F.col("vec_id").alias("query_id"), "label").agg(F.count("*").alias("own"))
    counted = own.join(labelled, "label").select("query_id", (F.col("n") - F.col("own")).alias("candidates"))
    return best.join(counted, "query_id")


def feature_hash_sparse(spark, d):
    rows = _evidence(spark, d).select("evidence_id", F.posexplode(V.feature_hash("tokens")).alias("bucket", "value"))
    return rows.filter("value != 0").select("evidence_id", F.col("bucket").cast("bigint").alias("bucket"), "value")


def requirement_status(spark, d):
    evidence, requirements = _evidence(spark, d), _requirements(spark, d)
    return M.gate(V.rank(evidence, requirements, K), requirements, evidence)


def requirement_ids(spark, d):
    items = table(spark, d, "benchmark")
    return items.select("item_id", M.requirement_id(F.lit("a1"), F.lit("required"), F.lit("skill"), F.lit("all"), F.col("text")).alias("requirement_id"))


def _cases(spark, d):
    labels = _vectors(spark, d).select(F.col("vec_id").alias("hit"), F.col("label").alias("hit_label"))
    queries = _query_vectors(spark, d).select("query_id", "query_label")
    hits = vector_topk(spark, d).join(labels, F.col("vec_id") == F.col("hit")).join(queries, "query_id")
    hits = hits.select(F.col("query_id").alias("case_id"), "rank", (F.col("hit_label") == F.col("query_label")).alias("relevant"))
    cases = queries.select(F.col("query_id").alias("case_id"), F.col("query_label").alias("category"), (F.floor(F.col("query_id") / 20) % 5 != 0).alias("graded"))
    return hits, cases


def recall_mrr(spark, d):
    hits, cases = _cases(spark, d)
    return E.case_metrics(hits, cases).select("case_id", "first_rank", "recall_at_1", "recall_at_3", F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


def recall_rollup(spark, d):
    hits, cases = _cases(spark, d)
    return E.rolled_up(E.case_metrics(hits, cases), "category")


def mode_compare(spark, d):
    firsts = V.rank_modes(_evidence(spark, d), _requirements(spark, d), 1, {"lexical": (scores.LEXICAL_WEIGHT, 0.0), "hybrid": (scores.LEXICAL_WEIGHT, 0.3)})
    first = [F.max(F.when(F.col("mode") == mode, F.col("evidence_id"))).alias(f"{mode}_first") for mode in ("lexical", "hybrid")]
    return firsts.groupBy("query_id").agg(*first).withColumn("same", F.col("lexical_first") == F.col("hybrid_first"))


def threshold_whatif(spark, d):
    evidence, requirements = _evidence(spark, d), _requirements(spark, d)
    hits = M.held(V.rank(evidence, requirements, K))
    by_vector, by_both = E.promoted(F.col("status"), F.col("lexical_score"), F.col("vector_score"))
    best = hits.filter("rank = 1").join(M.gate(hits, requirements, evidence), "query_id")
    counted = best.select("status", by_vector.alias("by_vector"), by_both.alias("by_both"))
    return counted.groupBy("status", "by_vector", "by_both").agg(F.count("*").alias("requirements"))


QUERIES = {
    f.__name__: f
    for f in (
        lexical_topk, hybrid_topk, hybrid_topk_filtered, vector_topk, vector_topk_same_label, feature_hash_sparse, requirement_status, requirement_ids,
        recall_mrr, recall_rollup, mode_compare, threshold_whatif,
    )
}
#: Earlier names of the same queries.
ALIASES = {"search_topk": "vector_topk", "search_topk_same_label": "vector_topk_same_label", "search_recall_mrr": "recall_mrr", "search_recall_rollup": "recall_rollup"}
QUERIES |= {name: QUERIES[of] for name, of in ALIASES.items()}


def _hybrid_sql(k: int, where: str = "TRUE", weight: float = 0.3) -> str:
    """CTEs that end in ``ranked``: the same ranking over all pairs."""
    return f"""
        WITH q AS (SELECT item_id AS query_id, {tokens_sql("text")} AS t FROM benchmark),
        e AS (SELECT doc_id AS evidence_id, {tokens_sql("text")} AS t FROM documents WHERE {where}),
        f AS (
            SELECT 'q' AS side, query_id AS id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1]))) AS x FROM q
            UNION ALL
            SELECT 'e', evidence_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1]))) FROM e
        ),
        h AS (SELECT side, id, sha256(x) AS s FROM f),
        v AS (
            SELECT side, id, CAST('0x' || substr(s, 1, 8) AS BIGINT) % 256 AS bucket,
                   sum(CASE WHEN CAST('0x' || substr(s, 9, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS value
            FROM h GROUP BY ALL
        ),
        n AS (SELECT side, id, sqrt(CAST(sum(value * value) AS DOUBLE)) AS norm FROM v GROUP BY ALL),
        dots AS (
            SELECT a.id AS query_id, b.id AS evidence_id, CAST(sum(a.value * b.value) AS DOUBLE) AS dot
            FROM v a JOIN v b ON a.bucket = b.bucket WHERE a.side = 'q' AND b.side = 'e' GROUP BY ALL
        ),
        qt AS (SELECT query_id, unnest(list_distinct(t)) AS x FROM q), et AS (SELECT evidence_id, unnest(list_distinct(t)) AS x FROM e),
        shared AS (SELECT query_id, evidence_id, count(*) AS shared FROM qt JOIN et USING (x) GROUP BY ALL),
        scored AS (
            SELECT q.query_id, e.evidence_id, CAST(coalesce(shared, 0) AS DOUBLE) / greatest(len(list_distinct(q.t)), 1) AS lexical,
                   greatest(coalesce(CASE WHEN nq.norm * ne.norm > 0 THEN dot / (nq.norm * ne.norm) END, 0::DOUBLE), 0::DOUBLE) AS vector
            FROM q CROSS JOIN e
            LEFT JOIN shared USING (query_id, evidence_id) LEFT JOIN dots USING (query_id, evidence_id)
            LEFT JOIN n nq ON nq.side = 'q' AND nq.id = q.query_id LEFT JOIN n ne ON ne.side = 'e' AND ne.id = e.evidence_id
        ),
        combined AS (SELECT *, least(1::DOUBLE, lexical * 0.7::DOUBLE + vector * {weight}::DOUBLE) AS score FROM scored),
        ranked AS (
            SELECT query_id, evidence_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {unit_sql("lexical")} DESC, evidence_id) AS rank,
                   {unit_sql("lexical")} AS lexical_score, {unit_sql("vector")} AS vector_score, {unit_sql("score")} AS retrieval_score
            FROM combined QUALIFY rank <= {k}
        )"""


_VECTORS = """
        v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec, label FROM embeddings),
        q AS (SELECT vec_id AS query_id, vec AS query, label AS query_label FROM v WHERE vec_id % 20 = 0),
        hits AS (
            SELECT query_id, vec_id, round(list_cosine_similarity(query, vec), 6) AS cosine, label, query_label FROM q JOIN v ON vec_id <> query_id
        ),
        top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM hits QUALIFY rank <= 3)"""
_METRICS = """,
        firsts AS (SELECT query_id, min(rank) AS r FROM top WHERE label = query_label GROUP BY 1),
        m AS (
            SELECT query_id AS case_id, query_label AS category, query_id // 20 % 5 <> 0 AS graded, CASE WHEN query_id // 20 % 5 <> 0 THEN r END AS first_rank,
                   CASE WHEN query_id // 20 % 5 <> 0 THEN CAST(coalesce(r <= 1, FALSE) AS BIGINT) END AS recall_at_1,
                   CASE WHEN query_id // 20 % 5 <> 0 THEN CAST(coalesce(r <= 3, FALSE) AS BIGINT) END AS recall_at_3,
                   CASE WHEN query_id // 20 % 5 <> 0 THEN coalesce(1::DOUBLE / r, 0::DOUBLE) END AS rr
            FROM q LEFT JOIN firsts USING (query_id)
        )"""
_STATUS = """,
        wording AS (
            SELECT query_id, array_to_string(t, ' ') AS w,
                   len(list_filter(t, lambda x: len(x) > 1 AND x NOT IN ({stop}))) > 0 AS signal FROM q
        ),
        cited AS (
            SELECT r.query_id, max(lexical_score) AS best_lexical, bool_or(contains(array_to_string(e.t, ' '), w)) AS exact, count(*) AS n
            FROM ranked r JOIN e USING (evidence_id) JOIN wording USING (query_id) WHERE lexical_score > 0 OR vector_score >= 0.45::DOUBLE GROUP BY 1
        ),
        graded AS (
            SELECT query_id, coalesce(best_lexical, 0::DOUBLE) AS best_lexical, n,
                   CASE WHEN NOT signal THEN 'not_applicable' WHEN n IS NULL THEN 'not_evidenced' WHEN exact OR best_lexical >= 0.65::DOUBLE THEN 'matched'
                        WHEN best_lexical >= 0.25::DOUBLE THEN 'partially_matched' ELSE 'not_evidenced' END AS status
            FROM wording LEFT JOIN cited USING (query_id)
        )""".format(stop=", ".join(f"'{w}'" for w in text.STOP_WORDS))
_RANKED = " SELECT query_id, evidence_id, rank, lexical_score, vector_score, retrieval_score FROM ranked"
ORACLE_SQL = {
    "lexical_topk": f"""
        WITH q AS (SELECT item_id AS query_id, list_distinct({tokens_sql("text")}) AS t FROM benchmark),
        qt AS (SELECT query_id, len(t) AS n, unnest(t) AS x FROM q),
        et AS (SELECT doc_id AS evidence_id, unnest(list_distinct({tokens_sql("text")})) AS x FROM documents),
        s AS (SELECT query_id, n, evidence_id, count(*) AS shared FROM qt JOIN et USING (x) GROUP BY ALL)
        SELECT query_id, evidence_id, row_number() OVER (PARTITION BY query_id ORDER BY {unit_sql("CAST(shared AS DOUBLE) / n")} DESC, evidence_id) AS rank,
               shared, {unit_sql("CAST(shared AS DOUBLE) / n")} AS lexical_score FROM s QUALIFY rank <= 3""",
    "hybrid_topk": _hybrid_sql(K) + _RANKED,
    "hybrid_topk_filtered": _hybrid_sql(K, "lang IN ('en', 'de') AND source = 'src3'") + _RANKED,
    "vector_topk": f"WITH {_VECTORS} SELECT query_id, vec_id, cosine, rank FROM top",
    "vector_topk_same_label": f"WITH {_VECTORS} SELECT query_id, max(cosine) AS best, count(*) AS candidates FROM hits WHERE label = query_label GROUP BY 1",
    "feature_hash_sparse": _hybrid_sql(K) + " SELECT id AS evidence_id, bucket, CAST(value AS BIGINT) AS value FROM v WHERE side = 'e' AND value <> 0",
    "requirement_status": _hybrid_sql(K) + _STATUS + """
        SELECT query_id, status, best_lexical, CASE WHEN status IN ('matched', 'partially_matched') THEN n ELSE 0 END AS citations FROM graded""",
    "requirement_ids": f"SELECT item_id, 'req-' || substr(sha256('a1:required:skill:all:' || array_to_string({tokens_sql('text')}, ' ')), 1, 16) AS requirement_id FROM benchmark",
    "recall_mrr": f"WITH {_VECTORS}{_METRICS} SELECT case_id, first_rank, recall_at_1, recall_at_3, round(rr, 6) AS reciprocal_rank FROM m",
    "recall_rollup": f"""
        WITH {_VECTORS}{_METRICS} SELECT category, count(*) AS cases, count(*) FILTER (graded) AS graded_cases, CAST(sum(recall_at_1) AS BIGINT) AS hits_at_1,
            CAST(sum(recall_at_3) AS BIGINT) AS hits_at_3, round(avg(rr), 6) AS mrr FROM m GROUP BY GROUPING SETS ((), (category))""",
    "mode_compare": f"""
        SELECT query_id, a.evidence_id AS lexical_first, b.evidence_id AS hybrid_first, a.evidence_id = b.evidence_id AS same
        FROM ({_hybrid_sql(K, weight=0.0)}{_RANKED} WHERE rank = 1) a JOIN ({_hybrid_sql(K)}{_RANKED} WHERE rank = 1) b USING (query_id)""",
    "threshold_whatif": _hybrid_sql(K) + _STATUS + """
        SELECT status, CASE WHEN status <> 'matched' AND vector_score >= 0.42::DOUBLE THEN 'matched' ELSE status END AS by_vector,
               CASE WHEN status <> 'matched' AND lexical_score >= 0.25::DOUBLE AND vector_score >= 0.30::DOUBLE THEN 'matched' ELSE status END AS by_both,
               count(*) AS requirements
        FROM ranked JOIN graded USING (query_id) WHERE rank = 1 GROUP BY ALL""",
}
ORACLE_SQL |= {name: ORACLE_SQL[of] for name, of in ALIASES.items()}
