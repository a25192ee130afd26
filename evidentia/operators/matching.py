"""Requirement matching: explicit phrase rules, the status gate, any/all logic, tenure and weighted coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import scores, text

#: Requirements that name one of these need evidence that names it too.
EXPLICIT_RULES = {
    "AWS": ("aws", "amazon web services", "amazon ec2", "amazon s3", "aws lambda"),
    "Kubernetes": ("kubernetes", "k8s"),
    "CI/CD": ("ci cd", "continuous integration", "continuous delivery", "continuous deployment"),
}
STATUS_RANK = {"not_applicable": -1, "not_evidenced": 0, "partially_matched": 1, "matched": 2}
#: How a requirement states years.
YEARS_BETWEEN = r"(?i)\b(\d+(?:\.\d+)?)\s*(?:-|–|—|to)\s*(\d+(?:\.\d+)?)\s*years?\b"
YEARS_AT_LEAST = r"(?i)\b(\d+(?:\.\d+)?)\s*\+?\s*years?\b"


def names_rule(tokens: Column, aliases) -> Column:
    """True where the tokens hold one of the aliases as a phrase."""
    found = F.lit(False)
    for alias in aliases:
        found = found | text.contains_phrase(tokens, alias.split())
    return found


def explicit_status(requirements: DataFrame, evidence: DataFrame, rules: dict = EXPLICIT_RULES) -> DataFrame:
    """(requirement_id, rules_named, rules_met, status) of the requirements that name a rule, over all evidence.

    Evidence is first reduced to the rules that any of it names, a row each, which requirements meet by rule."""
    named = lambda tokens: F.array_compact(F.array(*(F.when(names_rule(tokens, a), i) for i, a in enumerate(rules.values()))))
    asked = requirements.select("requirement_id", F.explode(named(F.col("tokens"))).alias("rule"))
    held = evidence.select(F.explode(named(F.col("tokens"))).alias("rule")).distinct().withColumn("_met", F.lit(1))
    counted = asked.join(held, "rule", "left").groupBy("requirement_id").agg(F.count("*").alias("rules_named"), F.count("_met").alias("rules_met"))
    status = F.when(F.col("rules_met") == F.col("rules_named"), "matched").when(F.col("rules_met") > 0, "partially_matched").otherwise("not_evidenced")
    return counted.withColumn("status", status)


def held(hits: DataFrame) -> DataFrame:
    """The hits, a few for each query, kept by Spark for all that reads them, so that evidence is ranked once; their size is then known."""
    kept = hits.persist()
    kept.count()
    return kept


def with_words(hits: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """The hits with the tokens of their evidence; only evidence that is hit is cut into words."""
    return hits.join(evidence.select(*keys, "tokens").join(hits.select(*keys).distinct(), keys, "left_semi"), keys)


def gate(hits: DataFrame, requirements: DataFrame, evidence: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(scope, query_id, status, best_lexical, citations) from ranked hits: admit, then grade; with ``scope`` ids count within their owner, model, ...

    Hits, a few for each query, meet the evidence in one join, as the small side.

    A hit is admitted by a shared token or a vector score of ``ADMITTED_VECTOR``; both read rounded scores.  Requirements without
    a signal token are not applicable, whatever was found."""
    admitted = held(hits).filter((F.col("lexical_score") > 0) | (F.col("vector_score") >= scores.ADMITTED_VECTOR))
    within = scope or []
    of_query, of_evidence = [*within, "query_id"], [*within, "evidence_id"]
    wording = requirements.select(*of_query, F.array_join("tokens", " ").alias("_q"), (F.size(text.signal_tokens(F.col("tokens"))) > 0).alias("_signal"))
    cited = with_words(admitted, evidence, of_evidence).withColumn("_e", F.array_join("tokens", " ")).drop("tokens").join(wording.drop("_signal"), of_query)
    graded = cited.groupBy(*of_query).agg(F.max("lexical_score").alias("best_lexical"), F.bool_or(F.contains("_e", "_q")).alias("_exact"), F.count("*").alias("citations"))
    rows = wording.join(graded, of_query, "left")
    status = scores.status_of(F.coalesce("best_lexical", F.lit(0.0)), F.col("citations").isNotNull(), F.coalesce("_exact", F.lit(False)))
    status = F.when(~F.col("_signal"), "not_applicable").otherwise(status)
    kept = F.when(F.col("status").isin("matched", "partially_matched"), F.col("citations")).otherwise(F.lit(0)).cast("bigint")
    return rows.withColumn("status", status).select(*of_query, "status", F.coalesce("best_lexical", F.lit(0.0)).alias("best_lexical"), kept.alias("citations"))


def best_alternative(rows: DataFrame) -> DataFrame:
    """Of the alternatives (group_id, position, status, best_lexical) the best of each group; the first wins ties."""
    rank = F.create_map(*(F.lit(x) for pair in STATUS_RANK.items() for x in pair))
    order = Window.partitionBy("group_id").orderBy(F.element_at(rank, F.col("status")).desc(), F.desc("best_lexical"), "position")
    return rows.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def coverage(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted coverage of (priority, status): context and not-applicable rows only count in the status counts."""
    scored = ~((F.col("priority") == "context") | (F.col("status") == "not_applicable"))
    weight = F.when(scored, F.when(F.col("priority") == "required", 2).otherwise(1)).otherwise(0)
    value = F.when(F.col("status") == "matched", 1.0).when(F.col("status") == "partially_matched", 0.5).otherwise(0.0)
    counts = [F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("matched", "partially_matched", "not_evidenced", "not_applicable")]
    sums = rows.groupBy(*keys).agg(F.sum(weight * value).alias("earned_weight"), F.sum(weight).cast("bigint").alias("possible_weight"), *counts)
    return sums.withColumn("score", scores.percent(F.col("earned_weight"), F.col("possible_weight"), 0.0))


def merged_tenure(intervals: DataFrame, key: str, as_of) -> DataFrame:
    """(key, islands, days, years) of the union of (start_date, end_date); open ends run to ``as_of``, later starts are dropped.

    Intervals are first reduced to one row for each start, then walked in order of start."""
    today = F.lit(as_of).cast("date")
    clipped = intervals.withColumn("end_date", F.least(F.coalesce("end_date", today), today)).filter((F.col("start_date") <= today) & (F.col("end_date") >= F.col("start_date")))
    starts = clipped.groupBy(key, "start_date").agg(F.max("end_date").alias("end_date"))
    order = Window.partitionBy(key).orderBy("start_date")
    reach = F.max("end_date").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("_reach").isNull() | (F.col("start_date") > F.col("_reach")), 1).otherwise(0)).over(order)
    parts = starts.withColumn("_reach", reach).withColumn("_island", island).groupBy(key, "_island")
    spans = parts.agg(F.datediff(F.max("end_date"), F.min("start_date")).alias("days"))
    out = spans.groupBy(key).agg(F.count("*").alias("islands"), F.sum("days").alias("days"))
    return out.withColumn("years", scores.years(F.col("days")))


def summed_tenure(intervals: DataFrame, key: str, as_of) -> DataFrame:
    """(key, years) with overlaps counted twice, as the scorecard has it."""
    end = F.coalesce("end_date", F.lit(as_of).cast("date"))
    days = F.greatest(F.datediff(end, F.col("start_date")), F.lit(0))
    return intervals.groupBy(key).agg(F.round(F.sum(days) / F.lit(scores.DAYS_SUMMED), 6).alias("years"))


def year_range(requirement: Column) -> tuple[Column, Column]:
    """(least, most) years that a requirement names; null where it has none."""
    low, high = (F.regexp_extract(requirement, YEARS_BETWEEN, i) for i in (1, 2))
    least = F.regexp_extract(requirement, YEARS_AT_LEAST, 1)
    return F.when(low != "", low).when(least != "", least).cast("decimal(10,2)"), F.when(low != "", high).cast("decimal(10,2)")


def experience_status(years_col: Column, least: Column, most: Column, has_history: Column) -> Column:
    """Status of an experience requirement: above the range is partial, half of the minimum is partial."""
    half = (least > 0) & (years_col >= least / 2)
    return (
        F.when(least.isNull(), "not_applicable").when(~has_history, "not_evidenced").when(most.isNotNull() & (years_col > most), "partially_matched")
        .when(years_col >= least, "matched").when(half, "partially_matched").otherwise("not_evidenced")
    )


def requirement_id(analysis: Column, priority: Column, kind: Column, logic: Column, wording: Column) -> Column:
    key = F.concat_ws(":", analysis, priority, kind, logic, text.retrieval_text(wording))
    return F.concat(F.lit("req-"), F.substring(F.sha2(key.cast("binary"), 256), 1, 16))
