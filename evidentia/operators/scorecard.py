"""Term coverage, the match scorecard, strongest evidence, project ranking and claim grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import scores, text


def supported_terms(evidence: DataFrame, terms: list[str], body: str) -> DataFrame:
    """Adds ``supported``: the terms whose normalised form the evidence text contains.  Terms are a short list of a request."""
    named = {t: text.scorecard_text(F.lit(t)) for t in _unique(terms)}
    # the text is normalised once, as the variable of a lambda, and not once for each term
    checks = F.transform(F.array(text.scorecard_text(F.col(body))), lambda s: F.array(*(F.when((n != "") & F.contains(s, n), F.lit(t)) for t, n in named.items())))
    return evidence.withColumn("supported", F.filter(F.flatten(checks), lambda t: t.isNotNull()))


def _unique(terms: list[str]) -> list[str]:
    seen: dict[str, str] = {}
    for t in terms:
        seen.setdefault(t.casefold(), t)
    return list(seen.values())


def term_coverage(evidence: DataFrame, key: str, terms: list[str], body: str) -> DataFrame:
    """(key, matched, missing, score): distinct terms that any evidence of the key supports; 50 without terms."""
    rows = supported_terms(evidence, terms, body).select(key, F.explode_outer("supported").alias("term"))
    found = rows.groupBy(key).agg(F.count_distinct("term").alias("matched"))
    found = found.withColumn("missing", (F.lit(len(_unique(terms))) - F.col("matched")).cast("bigint"))
    return found.withColumn("score", scores.percent(F.col("matched"), F.col("matched") + F.col("missing"), 50.0))


def scorecard(parts: dict[str, Column], missing: Column) -> Column:
    """Overall score: weighted components less four points for each missing requirement, at most 20."""
    total = sum((parts[n].cast("decimal(10,2)") * w for n, w in scores.SCORECARD_WEIGHTS.items()), F.lit(0).cast("decimal(12,2)")) / 100
    return scores.bounded(total - F.least(F.lit(20), missing * 4))


def strongest(evidence: DataFrame, key: str, label: str, rank: Column, limit: int = 5) -> DataFrame:
    """The records of each key with the most support: rank plus number of supported terms, then label."""
    rows = evidence.filter(F.size("supported") > 0).withColumn("strength", (rank + F.size("supported")).cast("bigint"))
    order = Window.partitionBy(key).orderBy(F.desc("strength"), F.lower(label), label)
    return rows.withColumn("position", F.row_number().over(order).cast("bigint")).filter(F.col("position") <= limit)


def weighted_terms_score(body: Column, weighted: list[tuple[str, int]]) -> Column:
    """Sum of the weights of the terms in a normalised text; the first weight of a term counts."""
    first: dict[str, int] = {}
    for term, weight in weighted:
        first.setdefault(term.lower(), weight)
    score = F.lit(0)
    for term, weight in first.items():
        score = score + F.when(F.contains(body, text.project_text(F.lit(term))), weight).otherwise(0)
    return score


def title_overlap(title: str, body: Column) -> Column:
    """Five points for each word of three letters or more that title and text share."""
    words = F.array(*map(F.lit, sorted({w for w in title.lower().split() if len(w) >= 3})))
    return 5 * F.size(F.array_intersect(words, F.split(body, " ")))


def grounding(claims: DataFrame, valid: DataFrame) -> DataFrame:
    """(claim_id, cited, unknown, reason) of claims (claim_id, evidence_ids) against known ids (evidence_id).

    A claim is grounded if it cites something and all it cites is known."""
    cited = claims.select("claim_id", F.explode_outer("evidence_ids").alias("evidence_id"))
    known = valid.select("evidence_id").distinct().withColumn("_known", F.lit(True))
    rows = cited.join(known, "evidence_id", "left")
    unknown = F.col("evidence_id").isNotNull() & F.col("_known").isNull()
    out = rows.groupBy("claim_id").agg(F.count("evidence_id").alias("cited"), F.count_if(unknown).alias("unknown"))
    reason = F.when(F.col("cited") == 0, "no evidence citation").when(F.col("unknown") > 0, "unknown evidence")
    return out.withColumn("reason", reason)


def grounding_summary(checked: DataFrame, keys: list[str]) -> DataFrame:
    """Checked and cited claims, coverage, validity, and whether every failure only lacks a citation."""
    out = checked.groupBy(*keys).agg(
        F.count("*").alias("checked_claims"),
        F.count_if(F.col("reason").isNull()).alias("cited_claims"),
        F.count_if(F.col("reason") == "no evidence citation").alias("uncited_claims"),
    )
    failed = F.col("checked_claims") - F.col("cited_claims")
    out = out.withColumn("citation_coverage", scores.percent(F.col("cited_claims"), F.col("checked_claims"), 0.0))
    return out.withColumns({"valid": (F.col("checked_claims") > 0) & (failed == 0), "recoverable": (failed > 0) & (failed == F.col("uncited_claims"))})
