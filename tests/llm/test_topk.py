import math
import random

import numpy as np
import pytest

from evidentia.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(rows, k, every):
    """Rows (query_id, rank, vec_id, score) in plain Python integers."""
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (query, q) in enumerate(kept):
        if query is None or query % every:
            continue
        scored = []
        for n, (i, v) in enumerate(kept):
            if n != at and len(v) == len(q):
                score = max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v))))
                scored.append((-score, i is None, i or 0, i))
        out += [(query, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return sorted(map(repr, out))


def found(df, k, every, **options):
    got = topk.top_k(df, k, f"id % {every} = 0", **options)
    return sorted(repr(tuple(r)) for r in got.select("query_id", "rank", "vec_id", "score").collect())


def vectors(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    lengths = np.exp(rng.normal(0, spread, n))
    base = rng.normal(0, 1, (n, dim))
    return [(i, (l * v / np.linalg.norm(v)).tolist()) for i, (l, v) in enumerate(zip(lengths, base))]


@pytest.mark.parametrize("spread,rows,block", [(0, 4096, 16 << 20), (1.5, 16, 2000), (0.3, 40, 700)])
def test_against_all_pairs(spark, spread, rows, block):
    """Lengths alike and far apart; buckets and blocks small enough that there are many of each."""
    data = vectors(3, 400, 6, spread)
    df = spark.createDataFrame(data, SCHEMA)
    assert found(df, 5, 7, bucket_rows=rows, block_bytes=block) == brute(data, 5, 7)


def test_odd_rows(spark):
    """Nulls, strange numbers, other dimensions, no components, repeats, ties, null ids and very large components."""
    data = [(0, None), (0, [1.0, None]), (20, [math.nan, 1.0]), (20, [math.inf, 1.0]), (0, []), (1, []), (2, []), (20, [1.0, 2.0]), (20, [1.0, 2.0]), (40, [0.0, 0.0])]
    data += [(i, [1.0, 2.0]) for i in range(1, 12)] + [(None, [1.0, 2.0]), (None, [3.0, 1.0]), (60, [-1.0, -2.0]), (80, [1.0, 2.0, 3.0]), (100, [5.0])]
    data += [(120, [1e30, -1e30]), (13, [3e38, 3e38]), (14, [-1e12, 1e9])]
    df = spark.createDataFrame(data, SCHEMA)
    for k in (1, 3, 20):
        assert found(df, k, 20, bucket_rows=4) == brute(data, k, 20)


def test_one_common_vector(spark):
    """A third of all rows are equal: all are candidates, and ties go to the smallest ids."""
    data = vectors(4, 200, 4, 0.5) + [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(100)]
    df = spark.createDataFrame(random.Random(1).sample(data, len(data)), SCHEMA)
    assert found(df, 20, 20, bucket_rows=32, block_bytes=900) == brute(data, 20, 20)


def test_empty_table_and_clashing_columns(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA), 3, "id % 20 = 0").count() == 0
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], SCHEMA).selectExpr("*", "1 AS id", "2 AS key", "3 AS length", "4 AS vec")
    assert [tuple(r) for r in topk.top_k(df, 3, "id % 20 = 0").collect()] == [(0, 1, 1, 64 * 128)]


def test_pruning_prunes(monkeypatch):
    """Both ways are taken, and verify fewer products than there are pairs."""
    data = vectors(6, 3000, 4, 0.1)
    matrix = np.floor(64 * np.array([v for _, v in data]))
    ids = np.arange(len(data))
    pack = topk.Pack(ids, ids, np.ones(len(ids), bool), topk.lengths_of(matrix), matrix)
    order = np.argsort(-pack.lengths)
    counted, by_coordinate = [], []
    plain, coordinate = topk.exact, topk.Best._by_coordinate

    def counting(vectors, queries, wide):
        counted.append(len(vectors) * len(queries))
        return plain(vectors, queries, wide)

    def noted(self, *args):
        for i, at in coordinate(self, *args):
            by_coordinate.append(i)
            yield i, at

    monkeypatch.setattr(topk, "exact", counting)
    monkeypatch.setattr(topk.Best, "_by_coordinate", noted)
    queries = topk.Pack(*(getattr(pack, n)[:100] for n in ("keys", "ids", "named", "lengths", "matrix")))
    best = topk.Best(queries, 10)
    for at in range(0, 3000, 250):
        part = order[at : at + 250]
        best.add(topk.Bucket(topk.Pack(*(getattr(pack, n)[part] for n in ("keys", "ids", "named", "lengths", "matrix")))))
    products = queries.matrix @ matrix.T
    products[np.arange(100), np.arange(100)] = -np.inf
    assert (best.scores == -np.sort(-products, axis=1)[:, :10]).all()
    assert by_coordinate and sum(counted) < 0.5 * products.size


@pytest.mark.parametrize("most,width", [(1, 1), (127, 1), (128, 2), (40_000, 4), (3e9, 8), (0.5, 8), (math.inf, 8)])
def test_packs_travel_in_few_bytes(most, width):
    matrix = np.array([[most, -1.0], [0.0, 1.0]])
    ids = np.arange(2)
    row = topk.Pack(ids, ids, np.ones(2, bool), np.array([2.0, 1.0]), matrix).row(0, 0)
    assert len(row["matrix"]) == 4 * width and (topk.Pack.of(row).matrix == matrix).all()
