import random

import numpy as np
from pyspark.sql import functions as F

from evidentia.llm import quality_rff as Q


def corpus(prose, n=600):
    rng, rows, labels = random.Random(1), [], []
    for i in range(n):
        good, text = i % 3 != 0, prose(i, 40 + i % 90)
        if not good:
            text = " ".join(w + "###$$" for w in text.split()) if i % 2 else " ".join([text.split()[0].upper()] * 60)
        rows.append((i, text))
        labels.append((i, int(good)))
    rng.shuffle(rows)
    return rows, labels


def test_held_out_accuracy(spark, make, prose):
    rows, labels = corpus(prose)
    measured = Q.measure(make(rows).withColumn("stats", F.lit(1))).cache()
    model = Q.fit(measured, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    scored = measured.select("doc_id", Q.held_out(F.col("doc_id")).alias("h"), Q.scorer(model)("stats").alias("s")).filter("h").collect()
    assert len(scored) > 100 and np.mean([(r["s"] >= 0.7) == dict(labels)[r["doc_id"]] for r in scored]) > 0.97
    assert all(0 <= r["s"] <= 1 for r in scored)
    direct = {r["doc_id"]: r["s"] for r in make(rows[:50]).select("doc_id", Q.text_scorer(model)("text").alias("s")).collect()}
    same = {r["doc_id"]: r["s"] for r in measured.select("doc_id", Q.scorer(model)("stats").alias("s")).collect()}
    assert all(abs(same[i] - s) < 1e-9 for i, s in direct.items())


def test_held_out_labels_teach_nothing(spark, make, prose):
    rows, labels = corpus(prose, 240)
    measured = Q.measure(make(rows)).cache()
    df = spark.createDataFrame(labels, "doc_id bigint, quality int")
    other = df.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.allclose(Q.fit(measured, df).weights, Q.fit(measured, other).weights)


def test_normal_equations_equal_one_solve(spark, make, prose):
    rows, labels = corpus(prose, 200)
    measured = Q.measure(make(rows).repartition(5)).cache()
    model = Q.fit(measured, spark.createDataFrame(labels, "doc_id bigint, quality int"))
    import zlib

    use = [r for r in measured.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and zlib.crc32(str(r["doc_id"]).encode()) // 4 % 5 != 0]
    x = model.features(np.array([r["stats"] for r in use]))
    y = np.array([dict(labels)[r["doc_id"]] for r in use], float)
    penalty = Q.RIDGE * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-9
    assert np.allclose(model.weights, np.linalg.solve(x.T @ x + penalty, x.T @ y), atol=1e-6)


def test_isotonic():
    at, p = Q.isotonic([(0, 10, 0), (10, 10, 5), (20, 10, 3), (30, 10, 10)])
    assert p.tolist() == [0.0, 0.4, 1.0] and (np.diff(at) > 0).all()


def test_odd_inputs(spark, make):
    rows = [(1, None), (2, ""), (3, " "), (4, "x" * 100_000), (None, "a b"), (1, None)]
    measured = Q.measure(make(rows)).cache()
    none = Q.fit(measured, spark.createDataFrame([(None, 1), (2, None)], "doc_id bigint, quality int"))
    assert {r["s"] for r in measured.select(Q.scorer(none)("stats").alias("s")).collect()} == {1.0}
    some = Q.fit(measured, spark.createDataFrame([(1, 1), (1, 0), (3, 1), (4, 0)], "doc_id bigint, quality int"))
    assert all(0 <= r["s"] <= 1 for r in measured.select(Q.scorer(some)("stats").alias("s")).collect())
    assert Q.measure(make([])).collect() == []


def plain_statistics(text):
    """The statistics by counting one thing after the other."""
    import math
    import re

    raw = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    n, size = len(words), len(raw)
    if not n:
        return [math.log(1 + size)] + [0.0] * 17
    of = lambda pattern: len(re.findall(pattern, raw)) / size
    often = sorted((words.count(w) for w in set(words)), reverse=True)
    lines = [x for x in raw.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
    symbol = rb"[#*$%&|<>@^~=_\\{}\[\]+/]"
    upper, lower = of(rb"[A-Z]"), of(rb"[a-z]")
    return [
        math.log(1 + size), math.log(1 + n), sum(len(w) for w in words) / n, upper / max(upper + lower, 1e-9), of(rb"[0-9]"), of(symbol), of(rb"[!?]"), of(rb"[.,;:'\"()-]"), of(rb"[\x80-\xff]"),
        len(set(words)) / n, often[0] / n, sum(often[:5]) / n, sum(a == b for a, b in zip(words, words[1:])) / n, math.log(1 + len(lines)), 1 - len(set(lines)) / max(len(lines), 1),
        math.log(1 + n / max(len(lines), 1)), sum(bool(re.match(rb"[A-Z]", w)) for w in words) / n, sum(bool(re.match(symbol, w[:1]) or re.match(symbol, w[-1:])) for w in words) / n,
    ]


def test_statistics_equal_a_plain_count(make, prose):
    texts = [None, "", " \n", "a", "A b A b", "é日 É x", "#x y* $z$ a_b", "One two.\n\nOne two.\n three!? 12", prose(3, 300), "W" * 5000, "x\ty\x0bz\n" * 50, "\\ [ ] { } + / = ~ ^ @ | < > & % $ * #"]
    got = {r["doc_id"]: r["stats"] for r in Q.measure(make(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        assert np.allclose(got[i], plain_statistics(text), atol=1e-12), text


def test_scores_equal_a_plain_evaluation(spark, make, prose):
    """Statistics, ridge, isotonic curve and scores of every row, computed without Spark."""
    import zlib

    rows, labels = corpus(prose, 300)
    rng = random.Random(4)
    labels = [(i, 1 - q if rng.random() < 0.2 else q) for i, q in labels]  # so that the curve has pools
    measured = Q.measure(make(rows).repartition(4)).cache()
    got = {r["doc_id"]: r["s"] for r in measured.select("doc_id", Q.scorer(Q.fit(measured, spark.createDataFrame(labels, "doc_id bigint, quality int")))("stats").alias("s")).collect()}
    crc, y = (lambda i: zlib.crc32(str(i).encode())), dict(labels)
    stats = {i: np.array(plain_statistics(t)) for i, t in rows}
    learn = [i for i in stats if crc(i) % 4 != 2]
    teach, check = [i for i in learn if crc(i) // 4 % 5], [i for i in learn if crc(i) // 4 % 5 == 0]
    x = np.array([stats[i] for i in teach])
    scale = np.where(x.std(axis=0) < 1e-9, 1.0, x.std(axis=0))
    features = lambda ids: Q.fourier((np.array([stats[i] for i in ids]) - x.mean(axis=0)) / scale)
    f, penalty = features(teach), Q.RIDGE * np.eye(Q.FEATURES + 1)
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(f.T @ f + penalty, f.T @ np.array([y[i] for i in teach], float))
    bins = {}
    for i, raw in zip(check, features(check) @ weights):
        bins.setdefault(min(max(int(np.floor(raw * 1000 + 1000)), 0), Q.BINS - 1), []).append(y[i])
    keys = sorted(bins)
    mean = lambda a, b: sum(sum(bins[k]) for k in keys[a : b + 1]) / sum(len(bins[k]) for k in keys[a : b + 1])
    level = [max(min(mean(a, b) for b in range(i, len(keys))) for a in range(i + 1)) for i in range(len(keys))]
    pools = {}
    for k, v in zip(keys, level):
        pools.setdefault(round(v, 12), []).extend([k] * len(bins[k]))
    at = [np.mean(ks) / 1000 - 1 + 0.0005 for ks in pools.values()]
    want = np.interp(features(list(stats)) @ weights, at, list(pools))
    assert len(pools) > 2 and np.allclose([got[i] for i in stats], want, atol=1e-6)
