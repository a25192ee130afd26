import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evidentia.llm import mixing


def words(text):
    return len((text or "").encode().split())


def targets(sizes):
    """Deal, stop at twice the size, deal the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), dict.fromkeys(order, 0.0)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        share = {s: out[s] + left * weight[s] / total for s in open_}
        left = 0.0
        for s, t in share.items():
            out[s] = min(t, 2 * sizes[s])
            left += t - out[s]
            if t >= 2 * sizes[s]:
                open_.discard(s)
    return out


def expected(rows):
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += words(text)
    goal, out, run = targets(sizes), [], defaultdict(int)
    for doc_id, text, _, source in sorted(rows, key=lambda r: (hashlib.md5(f"mix-1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0, words(r[1]))):
        n, budget = words(text), int(goal[source] + 1e-6)
        whole, rest = divmod(budget, sizes[source]) if sizes[source] else (0, 0)
        out.append((doc_id, n, sizes[source], whole * n + max(0, min(n, rest - run[source]))))
        run[source] += n
    return sorted(out, key=repr)


ROWS = [(i, "w " * (i % 9), "en", ["b", "a", None, "c", "é"][0 if i < 40 else i % 5]) for i in range(120)] + [(500, None, "en", "empty"), (None, "x y", "en", "a"), (7, "w " * 7, "en", "b")]


def test_mix(make):
    df = make(ROWS).withColumns({"size": F.lit(1), "_key": F.lit("k"), "weight": F.lit(2), "target": F.lit("t")})
    got = mixing.mix(df).collect()
    assert sorted(((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in got), key=repr) == expected(ROWS)
    taken, goal = defaultdict(int), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - goal[s]) < 1 for s in goal)


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 3, None: 50}, {"a": 0, "b": 0}, {"x": 7}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(targets(sizes))


def test_taking_repeats_and_cuts(make):
    got = mixing.take(make(ROWS[:120]))
    amounts = defaultdict(int)
    for r in got.collect():
        amounts[r["doc_id"]] += words(r["text"])
    assert {i: n for i, n in amounts.items() if n} == {i: taken for i, n, _, taken in expected(ROWS[:120]) if taken}
    assert got.columns == make([]).columns


def test_taking_rows_without_ids(make):
    rows = [(None, "w " * n, "en", "a") for n in range(1, 30)] + [(None, None, "en", "a")]
    got = mixing.take(make(rows))
    assert sum(words(r["text"]) for r in got.collect()) == int(1.5 * sum(range(1, 30))) and got.filter("text is null").count() == 1


def test_mix_of_nothing(make):
    assert mixing.mix(make([])).collect() == [] and mixing.take(make([])).collect() == []


def test_cut_keeps_what_stands_before(spark):
    row = spark.createDataFrame([("  one\ttwo \n three", 2)], "t string, n bigint").select(mixing.first_words(F.col("t"), F.col("n")).alias("x")).first()
    assert row["x"] == "  one\ttwo"
