"""Ranking: block-wise top-k against all pairs, ties, empty inputs, and the vectors."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from evidentia.operators import evaluation, retrieval, scorecard

EVIDENCE = [(i, t.split()) for i, t in enumerate(["fastapi endpoints and postgresql", "bachelor of science", "fastapi api backend", "", "api api api", "backend fastapi api", "x y z"], 1)]
QUERIES = [(1, "fastapi backend api".split()), (2, "quantum".split()), (3, []), (4, "science of x".split())]


def brute_force(k):
    out = []
    for q, qt in QUERIES:
        v, rows = retrieval.feature_counts(qt), []
        for e, et in EVIDENCE:
            w = retrieval.feature_counts(et)
            norm = math.sqrt((v**2).sum()) * math.sqrt((w**2).sum())
            lexical = len(set(qt) & set(et)) / len(set(qt)) if qt else 0.0
            cosine = max(0.0, float(v @ w) / norm) if norm else 0.0
            rounded = Decimal(repr(lexical)).quantize(Decimal("0.0001"), ROUND_HALF_UP)
            rows.append((-min(1.0, lexical * 0.7 + cosine * 0.3), -rounded, e))
        out += [(q, e, i) for i, (_, _, e) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 5])
@pytest.mark.parametrize("k", [1, 3, 10])
def test_rank_equals_all_pairs(spark, k, partitions):
    evidence = spark.createDataFrame(EVIDENCE, "evidence_id bigint, tokens array<string>").repartition(partitions)
    queries = spark.createDataFrame(QUERIES, "query_id bigint, tokens array<string>")
    assert sorted((r["query_id"], r["evidence_id"], r["rank"]) for r in retrieval.rank(evidence, queries, k).collect()) == brute_force(k)


def test_rank_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    evidence = spark.createDataFrame(EVIDENCE, "evidence_id bigint, tokens array<string>")
    queries = spark.createDataFrame(QUERIES, "query_id bigint, tokens array<string>")
    assert retrieval.rank(evidence, queries, 2).count() == 8


@pytest.mark.parametrize("block", [2, 1024])
def test_rank_modes_equal_rank(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    evidence = spark.createDataFrame(EVIDENCE, "evidence_id bigint, tokens array<string>")
    queries = spark.createDataFrame(QUERIES, "query_id bigint, tokens array<string>")
    modes = {"lexical": (0.7, 0.0), "hybrid": (0.7, 0.3), "vector": (0.0, 1.0)}
    found = retrieval.rank_modes(evidence, queries, 3, modes).collect()
    for mode, (lexical, vector) in modes.items():
        rows = retrieval.rank(evidence, queries, 3, vector_weight=vector, lexical_weight=lexical).collect()
        assert sorted(tuple(r)[1:] for r in found if r["mode"] == mode) == sorted(map(tuple, rows)) and len(rows) == 12


def test_rank_of_nothing(spark):
    none = spark.createDataFrame([], "evidence_id bigint, tokens array<string>")
    queries = spark.createDataFrame(QUERIES, "query_id bigint, tokens array<string>")
    assert retrieval.rank(none, queries, 3).count() == 0


def test_same_vector_without_shared_tokens_scores_three_tenths():
    assert min(1.0, 0.0 * 0.7 + 1.0 * 0.3) == 0.3
    assert retrieval.feature_counts([]).sum() == 0 and not retrieval.feature_counts([]).any()


def test_cosine_of_empty_vectors_is_zero(spark):
    row = spark.range(1).select(retrieval.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("a"), retrieval.cosine(F.array(F.lit(2.0)), F.array(F.lit(-1.0))).alias("b")).first()
    assert (row["a"], row["b"]) == (0.0, -1.0)


def test_case_metrics(spark):
    hits = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, True), (3, 1, False)], "case_id int, rank int, relevant boolean")
    cases = spark.createDataFrame([(1, "a", True), (2, "a", False), (3, "b", True)], "case_id int, category string, graded boolean")
    found = {r["case_id"]: (r["first_rank"], r["recall_at_1"], r["recall_at_3"], r["reciprocal_rank"]) for r in evaluation.case_metrics(hits, cases).collect()}
    assert found == {1: (2, 0, 1, 0.5), 2: (None, None, None, None), 3: (None, 0, 0, 0.0)}


def test_grounding(spark):
    claims = spark.createDataFrame([(1, [1]), (2, []), (3, [1, 9]), (4, None)], "claim_id int, evidence_ids array<int>")
    valid = spark.createDataFrame([(1,)], "evidence_id int")
    checked = scorecard.grounding(claims, valid)
    assert {r["claim_id"]: r["reason"] for r in checked.collect()} == {1: None, 2: "no evidence citation", 3: "unknown evidence", 4: "no evidence citation"}
    only_bare = scorecard.grounding_summary(checked.filter("claim_id <> 3").withColumn("o", F.lit(1)), ["o"]).first()
    assert (only_bare["valid"], only_bare["recoverable"], only_bare["citation_coverage"]) == (False, True, 33.33)


def all_pairs(rows, ids, k, same_label):
    out = []
    for q in ids:
        query, scored = rows[q], []
        for i, (x, label) in rows.items():
            if i != q and (not same_label or label == query[1] is not None):
                both = x is not None and query[0] is not None and len(x) == len(query[0])
                norm = math.hypot(*x) * math.hypot(*query[0]) if both else 0
                scored.append((-round(math.sumprod(x, query[0]) / norm, 6) if norm else -0.0, i))
        out += [(q, i, -c + 0.0, r) for r, (c, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("same_label", [False, True])
def test_vector_topk_in_blocks(spark, monkeypatch, same_label):
    rng = random.Random(4)
    rows = {i: ([rng.uniform(-1, 1) for _ in range(4)], rng.choice([1, 2, None])) for i in range(300)}
    rows |= {i: ([1.0, 2.0, 3.0, 4.0], 1) for i in range(100, 160)}  # ties
    rows |= {7: (None, 1), 20: ([], 1), 40: ([0.0] * 4, 2), 61: ([1.0], 2)}
    label = ["label"] if same_label else []
    vectors = spark.createDataFrame([(i, *r) for i, r in rows.items()], "vec_id bigint, vec array<double>, label int").select("vec_id", "vec", *label)
    queries = vectors.filter("vec_id % 5 = 0").withColumnsRenamed({"vec_id": "query_id", "vec": "query"})
    expected = all_pairs(rows, range(0, 300, 5), 3, same_label)
    for block, pairs in ((8192, 1 << 20), (16, 64)):
        monkeypatch.setattr(retrieval, "VECTOR_BLOCK", block)
        monkeypatch.setattr(retrieval, "PAIRS", pairs)
        found = retrieval.vector_topk(vectors, queries, 3)
        assert sorted((r["query_id"], r["vec_id"], r["cosine"], r["rank"]) for r in found.collect()) == expected
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_vector_topk_of_nothing(spark):
    none, one = (spark.createDataFrame(rows, "vec_id bigint, vec array<double>") for rows in ([], [(1, [1.0])]))
    for vectors, queries in ((none, one), (one, none), (one, one)):
        assert retrieval.vector_topk(vectors, queries.withColumnsRenamed({"vec_id": "query_id", "vec": "query"}), 3).collect() == []


@pytest.mark.parametrize("k", [1, 4, 30])
def test_index_equals_all_pairs(k):
    """The index of a block finds what counting all shared tokens finds, ties by id."""
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(k)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)]
    lists = [rng.choices(words, k=rng.randint(0, 25)) for _ in range(150)]
    ids = rng.sample(range(1000), 150)
    index = retrieval.EvidenceIndex(np.array(ids), pa.array(lists, pa.list_(pa.string())))
    for query in [rng.choices([*words, "none"], k=rng.randint(0, 12)) for _ in range(60)]:
        asked = set(query)
        counted = sorted((-len(asked & set(x)), i) for i, x in zip(ids, lists, strict=True) if asked & set(x))[:k]
        rows, shared, size = index.best(query, k)
        assert list(zip((-shared).tolist(), index.ids[rows].tolist(), strict=True)) == counted and size == max(len(asked), 1)


def test_many_queries(spark, monkeypatch):
    """5,000 queries, which pass by blocks of evidence, find what they find when they travel to the tasks; evidence is shuffled once."""
    import random

    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.5))}" for _ in range(3000)]
    evidence = spark.createDataFrame([(i, rng.choices(words, k=rng.randint(0, 20))) for i in range(700)], "evidence_id bigint, tokens array<string>")
    queries = spark.createDataFrame([(i, rng.choices(words, k=rng.randint(0, 6))) for i in range(5000)], "query_id bigint, tokens array<string>")
    monkeypatch.setattr(retrieval, "EVIDENCE_BLOCK", 200)
    found = retrieval.lexical_topk(evidence, queries, 3)
    rows, hybrid = sorted(map(tuple, found.collect())), sorted(map(tuple, retrieval.rank(evidence, queries, 2).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 10_000)
    assert rows == sorted(map(tuple, retrieval.lexical_topk(evidence, queries, 3).collect()))
    assert hybrid == sorted(map(tuple, retrieval.rank(evidence, queries, 2).collect()))
    moved = [x for x in str(found._jdf.queryExecution().optimizedPlan()).splitlines() if "RepartitionByExpression" in x]
    assert len(moved) == 1


def owned(spark, seed, n, owners):
    import random

    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    rows = [(rng.choice(owners), rng.choice(["m", "x"]), i, rng.choices(words, k=rng.randint(0, 6))) for i in range(n)]
    return rows


@pytest.mark.parametrize("block", [50_000, 7])
def test_rank_within_owners(spark, monkeypatch, block):
    """As ranking each owner's rows by themselves; a scope with a null belongs to nobody."""
    monkeypatch.setattr(retrieval, "EVIDENCE_BLOCK", block)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    evidence, queries = owned(spark, 1, 120, [1, 1, 1, 2, None]), owned(spark, 2, 25, [1, 2, 3, None])
    e = spark.createDataFrame(evidence, "owner int, model string, evidence_id bigint, tokens array<string>")
    q = spark.createDataFrame(queries, "owner int, model string, query_id bigint, tokens array<string>")
    got = sorted(map(tuple, retrieval.rank(e, q, 3, scope=["owner", "model"]).collect()))
    want = []
    for owner in (1, 2):
        for model in ("m", "x"):
            own = lambda df: df.filter(F.col("owner") == owner).filter(F.col("model") == model)  # noqa: B023, E731
            want += [(owner, model, *r) for r in retrieval.rank(own(e), own(q), 3).collect()]
    assert got == sorted(want) and got


@pytest.mark.parametrize("block", [8192, 5])
def test_vectors_within_owners(spark, monkeypatch, block):
    import random

    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", block)
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b"]), i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(60)]
    v = spark.createDataFrame(rows, "owner string, vec_id bigint, vec array<double>")
    q = v.filter("vec_id % 5 = 0").withColumnsRenamed({"vec_id": "query_id", "vec": "query"})
    got = sorted(map(tuple, retrieval.vector_topk(v, q, 2, scope=["owner"]).collect()))
    want = [(o, *r) for o in "ab" for r in retrieval.vector_topk(v.filter(F.col("owner") == o), q.filter(F.col("owner") == o).drop("owner"), 2).collect()]
    assert got == sorted(want) and len(got) == 24


@pytest.mark.parametrize("queries_held,ids", [(1024, 100_000), (2, 7)])
def test_full_order(spark, monkeypatch, queries_held, ids):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", queries_held)
    monkeypatch.setattr(retrieval, "ID_RANGE", ids)
    evidence, queries = owned(spark, 5, 60, [1]), owned(spark, 6, 8, [1])
    e = spark.createDataFrame([r[2:] for r in evidence], "evidence_id bigint, tokens array<string>")
    q = spark.createDataFrame([r[2:] for r in queries], "query_id bigint, tokens array<string>")
    want = []
    for *_, query, tokens in queries:
        counted = sorted((-len(set(tokens) & set(t)), i) for *_, i, t in evidence)
        want += [(query, i, rank, -n) for rank, (n, i) in enumerate(counted, 1)]
    assert sorted(tuple(r)[:4] for r in retrieval.full_order(e, q).collect()) == sorted(want)


def test_rule_masks(spark):
    """Many rules cost as much as are named together, not all their combinations."""
    from evidentia.operators import requirements

    rules = {f"r{i}": (f"a{i}",) for i in range(28)}
    evidence = spark.createDataFrame([(1, ["a0", "a1"]), (2, ["a1", "a27"]), (3, ["a5"]), (4, ["none"])], "evidence_id bigint, tokens array<string>")
    asked = spark.createDataFrame([(1, 0b11), (2, (1 << 27) | 0b10), (3, 1 << 6), (4, 0b11)], "query_id bigint, mask bigint")
    got = {r["mask"]: (r["met"], r["named"]) for r in requirements.named_evidence(asked, evidence, rules).collect()}
    assert got == {0b11: (0b11, 2), (1 << 27) | 0b10: ((1 << 27) | 0b10, 2)}
