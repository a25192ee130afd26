"""Work that must not grow with the square of a group: rows that operators make, by the metrics of their plans."""

from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import analysis, catalogs, extraction, retrieval, runs
from evidentia.plans import assembly, postings, profiles
from evidentia.plans import retrieval as ranking


def most_rows(df, kinds: str = "") -> int:
    """The most rows that an operator of the plan, of those with ``kinds`` in their name, made; runs the plan."""
    df.collect()
    found, stack = 0, [df._jdf.queryExecution().executedPlan()]
    while stack:
        plan = stack.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            stack.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            stack.append(plan.plan())
        made = plan.metrics().get("numOutputRows")
        found = max(found, made.get().value() if made.isDefined() and kinds in kind else 0)
        stack += [plan.children().apply(i) for i in range(plan.children().size())]
    return found


def test_postings_of_equal_terms_are_ranked_once(spark):
    rows = [("o", "skills", f"{i:03}", f"Label {i % 7}", None, "steel ring" if i % 3 else "ring api", 3) for i in range(300)]
    evidence = spark.createDataFrame(rows, "owner string, section string, source_id string, label string, excerpt string, body string, rank int")
    postings = spark.createDataFrame([(i, "o", ["Ring", "APIs", "api", "nothing"]) for i in range(300)], "posting_id bigint, owner string, terms array<string>")
    found = analysis.strongest_for_postings(postings, evidence, "terms", 3)
    best = sorted((r for r in rows if "api" in r[5]), key=lambda r: (r[3].lower(), r[2]))[:3]
    expected = [(n, r[2], r[3], ["Ring", "APIs", "api"]) for n, r in enumerate(best, 1)]
    for posting in (0, 299):
        assert [tuple(r) for r in found.filter(f"posting_id = {posting}").orderBy("position").select("position", "source_id", "label", "matched_terms").collect()] == expected
    assert most_rows(found) < 5_000  # every posting with every record makes 90,000


@pytest.mark.parametrize("query", [profiles.resume_import, postings._part_postings])
def test_a_table_of_one_row_group_is_many_tasks(spark, tmp_path, query):
    for name in ("customer", "part"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # planned as many parts, of which one has all rows
    try:
        assert query(spark, str(tmp_path)).select(F.spark_partition_id().alias("task")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tags_are_words_in_any_case(spark):
    catalog = catalogs.TECHNOLOGIES | catalogs.SKILLS
    texts = ["", None, "PYTHON, c++ and Node.js; javascripts", "\u017fql \u212aafka a\u0130rflow m\u0131crosof\u0131", "python\u00e9 K8S (Rest API) apis AI-Agent", "Machine  Learning machine learning.", "\u00dfpark"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, body string").repartition(2)
    plain = [F.when(reduce(lambda a, b: a | b, (text.contains_word(F.col("body"), v) for v in variants)), F.lit(name)) for name, variants in catalog.items()]
    rows = df.select(extraction.tags(F.col("body"), catalog).alias("found"), F.array_compact(F.array(*plain)).alias("expected")).collect()
    assert [r["found"] for r in rows] == [r["expected"] for r in rows] and sum(len(r["found"]) for r in rows) > 8


def test_nested_redaction_is_many_tasks(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert assembly.redact_values(spark, str(tmp_path)).select(F.spark_partition_id().alias("task")).distinct().count() > 1


def test_redaction_equals_every_pattern_tried(spark):
    texts = [
        "", None, "plain", "My_Api_Key = 'a b' and TOKEN: x;y", "tokens and = signs", "?api-key=1&Secret =2&b=3", "https://x/?AUTHORIZATION=q#f", "BEARER abc.def-1, bearer", "ghp-12345678 xoxb-aa'bb sk-\u00e9",
        "DB_URL:\"sk-1\" rk-abcdefgh12", "PASSWORD=Bearer sk-12345678 ?secret=xoxp-1", "\u212aey_SECRET=1 pa\u017f\u017fword=2 x_PASSWORD=3",
    ]
    plain = reduce(lambda c, p: F.regexp_replace(c, F.lit(p[0]), F.lit(p[1])), text.REDACTIONS, F.col("body"))
    rows = spark.createDataFrame([(t,) for t in texts], "body string").select(text.redact(F.col("body")).alias("found"), plain.alias("expected"), "body").collect()
    assert [r["found"] for r in rows] == [r["expected"] for r in rows] and sum(r["found"] != r["body"] for r in rows if r["body"]) >= 7


def test_ranking_scores_few_tokens_at_once(monkeypatch):
    sizes, made = [], retrieval.TokenLists
    monkeypatch.setattr(retrieval, "TokenLists", lambda lists: sizes.append(len(lists.flatten())) or made(lists))
    lists = pa.array([[f"t{i % 97}", f"u{j}"] * 150 for i in range(100) for j in range(30)], pa.list_(pa.string()))
    best = retrieval.Best(retrieval.QueryBlock([1], lists[:1], retrieval.Features()), 2, (0.7, 0.3))
    best.add(np.arange(3000), lists)
    assert max(sizes) <= 300_000 and best.held[4].ravel().tolist() == [0, 2910]


def test_thresholds_rank_once(spark, monkeypatch):
    calls, rank = [], retrieval.rank
    monkeypatch.setattr(retrieval, "rank", lambda *a, **k: calls.append(a) or rank(*a, **k))
    ranking.threshold_whatif(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_modes_read_evidence_once(spark, monkeypatch):
    calls, made = [], retrieval.candidates
    monkeypatch.setattr(retrieval, "candidates", lambda *a: calls.append(a) or made(*a))
    ranking.mode_compare(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_hashes_of_bigrams_are_not_remembered():
    features, lists = retrieval.Features(), pa.array([[f"t{i}" for i in range(100)], None], pa.list_(pa.string()))
    features.vectors(retrieval.TokenLists(lists))
    assert len(features.known) == 100


def test_events_of_short_runs_are_folded_at_once(spark):
    """A run with an event an hour is no chunk for each event."""
    hour, run = F.make_interval(hours=F.col("id").cast("int")), (F.col("id") % 10).alias("run")
    events = spark.range(3000).select(run, "id", (F.lit("2024-01-01").cast("timestamp") + hour).alias("at"), F.lit("start").alias("event"), F.lit("s").alias("stage"), F.lit("E").alias("error_type"), F.lit("m").alias("message"))
    found = runs.lifecycle(events, "run")
    assert most_rows(found, "Aggregate") < 500 and {tuple(r) for r in found.select("status", "moves").collect()} == {("running", 300)}
