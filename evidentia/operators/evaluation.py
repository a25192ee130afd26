"""Retrieval evaluation: recall, reciprocal rank, roll-ups by category and threshold what-if."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import scores


def case_metrics(hits: DataFrame, cases: DataFrame, cutoffs=(1, 3)) -> DataFrame:
    """(case_id, first_rank, reciprocal_rank, recall_at_k...) of ranked hits (case_id, rank, relevant).

    ``cases`` lists every case with ``graded``: ungraded ones have null metrics, graded ones without a relevant hit miss."""
    first = hits.filter("relevant").groupBy("case_id").agg(F.min("rank").alias("first_rank"))
    rows = cases.join(first, "case_id", "left")
    graded = lambda c: F.when(F.col("graded"), c)
    recall = {f"recall_at_{k}": graded(F.coalesce((F.col("first_rank") <= k).cast("bigint"), F.lit(0))).cast("bigint") for k in cutoffs}
    rr = graded(F.coalesce(F.try_divide(F.lit(1.0), F.col("first_rank")), F.lit(0.0)))
    return rows.withColumns({"first_rank": graded(F.col("first_rank")), **recall, "reciprocal_rank": rr})


def rolled_up(metrics: DataFrame, category: str, cutoffs=(1, 3)) -> DataFrame:
    """Means over graded cases for each category and, with a null category, over all."""
    aggs = [F.count("*").alias("cases"), F.count_if("graded").alias("graded_cases")]
    aggs += [F.sum(f"recall_at_{k}").alias(f"hits_at_{k}") for k in cutoffs]
    aggs.append(F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))
    return metrics.groupingSets([[], [category]], category).agg(*aggs)


def promoted(status, lexical, vector):
    """Status under each what-if rule: promote by vector alone, or by lexical and vector of the same hit."""
    by_vector = F.when((status != "matched") & (vector >= 0.42), "matched").otherwise(status)
    by_both = F.when((status != "matched") & (lexical >= 0.25) & (vector >= 0.30), "matched").otherwise(status)
    return by_vector, by_both


def ratio(hits: Column, cases: Column) -> Column:
    """{hits, cases, mean}: the mean has six decimals and is null without cases."""
    return F.struct(hits.cast("bigint").alias("hits"), cases.cast("bigint").alias("cases"), F.round(F.try_divide(hits.cast("double"), cases.cast("double")), 6).alias("mean"))


def false_positive(category: Column, kind: str, expected: Column, predicted: Column) -> Column:
    """A case of a kind ("unsupported" or "near_miss") that should find nothing but was called supported."""
    return (category == kind) & (expected == "not_evidenced") & predicted.isin("matched", "partially_matched")


def neighbor_first(hits: DataFrame, distractors: DataFrame, mode: str) -> DataFrame:
    """(case_id, neighbor_first): whether rank 1 is a labelled neighbour that the mode would cite.

    A lexical ranking cites by a shared token, others by the vector bar too; a tie of zeros that the id broke is no hit."""
    cited = F.col("lexical_score") > 0
    if mode != "lexical":
        cited = cited | (F.col("vector_score") >= scores.ADMITTED_VECTOR)
    near = distractors.select("case_id", "evidence_id").distinct().withColumn("_near", F.lit(True))
    top = hits.filter("rank = 1").join(near, ["case_id", "evidence_id"], "left")
    return top.select("case_id", (F.coalesce("_near", F.lit(False)) & cited).alias("neighbor_first"))


def separability(cases: DataFrame) -> DataFrame:
    """(paraphrase cases by where a vector threshold could stand) from (case_id, category, explicit, max_vector).

    The floor is the strongest negative that no rule decides: a threshold above it has no false positive among those.  Counted are
    paraphrase cases above the floor and at or above the citation bar, and negatives at or above the weakest paraphrase."""
    negative = F.col("category").isin("near_miss", "unsupported") & ~F.col("explicit")
    para = F.col("category") == "paraphrase"
    ends = cases.agg(F.max(F.when(negative, F.col("max_vector"))).alias("floor"), F.max_by(F.when(negative, F.col("case_id")), F.when(negative, F.struct("max_vector", -F.col("case_id")))).alias("strongest_negative"), F.min(F.when(para, F.col("max_vector"))).alias("weakest"))
    rows = cases.withColumn("_j", F.lit(1)).join(F.broadcast(ends.withColumn("_j", F.lit(1))), "_j")  # one row
    return rows.groupBy("floor", "strongest_negative", "weakest").agg(
        F.count_if(para & (F.col("max_vector") > F.col("floor"))).alias("above_floor"), F.count_if(para & (F.col("max_vector") >= scores.ADMITTED_VECTOR)).alias("at_citation_bar"),
        F.count_if(negative & (F.col("max_vector") >= F.col("weakest"))).alias("caught"),
    )
